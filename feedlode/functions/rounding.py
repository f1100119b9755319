"""Exact rounding of a mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def mean_one_decimal(total: Column, n: Column) -> Column:
    """total / n to one decimal, half away from zero, for totals >= 0; 0.0 without values.

    ``round(avg(decimal))`` rounds twice, so the tenths are found in whole numbers.
    """
    divisor = F.nullif(n * 2, F.lit(0))
    return F.coalesce(whole_div(total * 20 + n, divisor) / F.lit(10.0), F.lit(0.0))
