"""Connected components of a graph that is too large for one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlode.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (u, v) the smallest node it is connected with.

    Alternates two steps until nothing changes: each node hands its larger neighbours, then its
    smaller ones, to the smallest node near it. The number of rounds grows with the logarithm
    of the longest path; each round is two aggregations and is written before the next.
    """
    now = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .where("u <> v").distinct())
    mark = _checksum(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # Larger neighbours go to the smallest node near.
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # All edges now lead from larger to smaller: smaller neighbours go there too.
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(near, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v"))
        now = cut_lineage(small.where("u <> v").distinct())
        before, mark = mark, _checksum(now)
        if mark == before:
            break
    # A star: every node but the roots has one edge, to its root.
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _checksum(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
