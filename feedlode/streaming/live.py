"""Live results: the feed of saved insights and running statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlode.functions.rounding import mean_one_decimal
from feedlode.operators.rows import exclude_explicit, instant, present_insights
from feedlode.session import cut_lineage
from feedlode.streaming.stats import change_sums

DAY_MICROS = 24 * 3600 * 1_000_000


def live_insights(changes: DataFrame) -> DataFrame:
    """Saved non-explicit insights, new and updated ones, ready for display."""
    return present_insights(exclude_explicit(changes.drop("before")))


def running_stats(changes: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Total, last 24 hours and mean over distinct insights, from the change log.

    Works on a batch frame and on a stream in ``complete`` mode. An update counts as the
    new row minus the former one, so nothing per insight is kept as state. On a stream,
    ``as_of`` stands still; ``HourlyStats`` answers as of any time.
    """
    shown, score, scored = change_sums(changes)
    recent = F.col("created_at") >= instant(as_of) - F.make_dt_interval(F.lit(1))
    zero = F.lit(0).cast("bigint")
    return changes.groupBy().agg(
        F.coalesce(F.sum(shown), zero).alias("total_insights"),
        F.coalesce(F.sum(F.when(recent, shown)), zero).alias("live_last_24h"),
        mean_one_decimal(F.coalesce(F.sum(score), zero), F.coalesce(F.sum(scored), zero)).alias("average_potential"),
    )


def running_stats_history(
    df: DataFrame, key: str = "id", ts: str = "created_at", score: str = "commercial_potential"
) -> DataFrame:
    """The statistics as they stood after each insight, in order of time and id.

    Each insight also leaves a mark one day later, when it no longer counts as recent; the
    statistics are running sums over both. The rows are split into ranges of time and id,
    summed per range, and each range starts from the sum of those before it, so no task
    sees more than its range.
    """
    shown = exclude_explicit(df) if "is_explicit_content" in df.columns else df
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    points = F.col(score).cast("bigint")
    zero = F.lit(0).cast("bigint")
    arrived = shown.select(
        F.col(key).alias("_id"), at.alias("_at"), F.lit(1).cast("bigint").alias("_new"),
        F.lit(1).cast("bigint").alias("_recent"), F.coalesce(points, zero).alias("_score"),
        points.isNotNull().cast("bigint").alias("_scored"),
    )
    # Still recent at exactly one day, no longer the microsecond after.
    expired = shown.select(
        F.col(key).alias("_id"), (at + DAY_MICROS + 1).alias("_at"), zero.alias("_new"),
        F.lit(-1).cast("bigint").alias("_recent"), zero.alias("_score"), zero.alias("_scored"),
    )
    order = ["_at", "_new", "_id"]
    marks = arrived.unionByName(expired).repartitionByRange(*order)
    # Fixed before use: a range read again must hold the same rows.
    marks = cut_lineage(marks.withColumn("_range", F.spark_partition_id()))
    sums = ["_new", "_recent", "_score", "_scored"]
    totals = marks.groupBy("_range").agg(*[F.sum(c).alias(f"{c}_all") for c in sums])
    # One row per range, as many as there are partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range", *[F.coalesce(F.sum(f"{c}_all").over(before), zero).alias(f"{c}_start") for c in sums]
    )
    within = (
        Window.partitionBy("_range").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Summed by hand per column, so the join with the few starts comes first.
    running = marks.join(F.broadcast(starts), "_range").select(
        "_id", "_at", "_new",
        *[(F.sum(c).over(within) + F.col(f"{c}_start")).alias(f"{c}_sum") for c in sums],
    )
    return running.filter(F.col("_new") == 1).select(
        F.col("_id").alias(key),
        F.timestamp_micros("_at").alias(ts),
        F.col("_new_sum").alias("total_insights"),
        F.col("_recent_sum").alias("live_last_24h"),
        mean_one_decimal(F.col("_score_sum"), F.col("_scored_sum")).alias("average_potential"),
    )
