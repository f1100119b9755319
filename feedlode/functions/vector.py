"""Vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_sum(vector: Column) -> Column:
    """Sum of single-precision squares, added up in double precision."""
    return F.aggregate(
        vector, F.lit(0.0).cast("double"), lambda acc, x: acc + (x * x).cast("float").cast("double")
    )
