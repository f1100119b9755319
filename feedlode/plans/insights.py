"""Latest insights, statistics, the leading platform and trend clusters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlode.functions.fixed_values import (
    LATEST_LIMIT,
    LIVE_FEED_SIZE,
    SAMPLES_PER_CLUSTER,
    TREND_LIMIT,
    TREND_WINDOW_HOURS,
)
from feedlode.functions.limits import clamp_hours, clamp_limit
from feedlode.functions.rounding import mean_one_decimal
from feedlode.operators.rows import exclude_explicit, instant, present_insights, since
from feedlode.session import cut_lineage

# Most rows of a live feed whose keys are broadcast.
FEW_ROWS = 10_000

def latest_insights(
    df: DataFrame, limit: object = LATEST_LIMIT, include_explicit: bool = False
) -> DataFrame:
    """The newest insights, ready for display."""
    shown = df if include_explicit else exclude_explicit(df)
    newest = shown.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return present_insights(newest.limit(clamp_limit(limit)))


def top_platform(df: DataFrame) -> DataFrame:
    """The platform with most non-explicit insights; of equals the first by name."""
    counts = exclude_explicit(df).groupBy("platform").agg(F.count(F.lit(1)).alias("insights"))
    return counts.orderBy(F.col("insights").desc(), F.col("platform").asc_nulls_last()).limit(1)


def insight_stats(df: DataFrame, as_of: datetime | Column) -> DataFrame:
    """One row: total, last 24 hours, mean score and leading platform. One pass over the data."""
    recent = F.col("created_at") >= instant(as_of) - F.make_dt_interval(F.lit(1))
    by_platform = exclude_explicit(df).groupBy("platform").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(recent).alias("_recent"),
        F.sum("commercial_potential").alias("_score"),
        F.count("commercial_potential").alias("_scored"),
    )
    # A row per platform is left; most insights first, then by name, missing name last.
    rank = F.struct(-F.col("_n"), F.col("platform").isNull(), F.col("platform"))
    scored = F.coalesce(F.sum("_scored"), F.lit(0))
    return by_platform.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_insights"),
        F.coalesce(F.sum("_recent"), F.lit(0)).alias("live_last_24h"),
        mean_one_decimal(F.coalesce(F.sum("_score"), F.lit(0)), scored).alias("average_potential"),
        F.coalesce(F.min_by("platform", rank), F.lit("")).alias("top_platform"),
    )


def trend_clusters(
    df: DataFrame,
    as_of: datetime | Column,
    window_hours: object = TREND_WINDOW_HOURS,
    limit: object = TREND_LIMIT,
) -> DataFrame:
    """The most frequent cluster keys of the window, with scores, platforms and samples.

    Counts come from one narrow aggregation. Texts are only read for the at most 200 keys
    that make it into the result, and reduced to distinct texts before any are gathered.
    """
    window = since(exclude_explicit(df), "created_at", clamp_hours(window_hours), as_of)
    rows = window.filter(F.coalesce(F.col("cluster_key"), F.lit("")) != "")
    mean = mean_one_decimal(
        F.coalesce(F.sum("commercial_potential"), F.lit(0)), F.count("commercial_potential")
    )
    order = [
        F.col("insight_count").desc(), F.col("average_score").desc(),
        F.col("latest_seen_at").desc(), F.col("cluster_key"),
    ]
    # At most 200 rows, used twice below: worked out once.
    top = cut_lineage(
        rows.groupBy("cluster_key")
        .agg(
            F.coalesce(
                F.max(F.nullif(F.col("cluster_label"), F.lit(""))), F.first("cluster_key")
            ).alias("cluster_label"),
            F.count(F.lit(1)).alias("insight_count"),
            mean.alias("average_score"),
            F.coalesce(F.max("commercial_potential"), F.lit(0)).alias("top_score"),
            F.max("created_at").alias("latest_seen_at"),
        )
        .orderBy(*order)
        .limit(clamp_limit(limit))
    )
    keys = top.select("cluster_key")
    samples = _samples(rows, keys)
    # Platforms are free text, so only those of the result's keys are gathered.
    platforms = (
        rows.select("cluster_key", "platform").join(F.broadcast(keys), "cluster_key", "left_semi").distinct()
        .groupBy("cluster_key").agg(F.sort_array(F.collect_list("platform")).alias("platforms"))
    )
    none = F.array().cast("array<string>")
    top = top.join(platforms, "cluster_key")
    filled = top.join(F.broadcast(samples), "cluster_key", "left").withColumns(
        {c: F.coalesce(F.col(c), none) for c in ("sample_titles", "sample_pain_points")}
    )
    return filled.orderBy(*order)


def _samples(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The first three distinct titles and pain points of each of the (at most 200) keys."""
    kinds = F.stack(F.lit(2), F.lit("title"), F.col("title"), F.lit("pain"), F.col("core_pain_point"))
    texts = (
        rows.select("cluster_key", "title", "core_pain_point")
        .join(F.broadcast(keys), "cluster_key", "left_semi")
        .select("cluster_key", kinds.alias("kind", "text"))
        .filter(F.col("text") != "")
        .distinct()
    )
    by_text = Window.partitionBy("cluster_key", "kind").orderBy("text")
    few = texts.withColumn("rank", F.row_number().over(by_text)).filter(
        F.col("rank") <= SAMPLES_PER_CLUSTER
    )

    def of(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("text"))))

    return few.groupBy("cluster_key").agg(
        of("title").alias("sample_titles"), of("pain").alias("sample_pain_points")
    )


def live_feed(
    df: DataFrame, n: int = LIVE_FEED_SIZE, key: str = "id", ts: str = "created_at", tie: str = "id"
) -> DataFrame:
    """The last event of each id, newest first, the first n.

    Ids and times decide; whole rows are only read for the n that are shown.
    """
    last = df.groupBy(key).agg(F.max(F.struct(F.col(ts), F.col(tie))).alias("_last"))
    shown = last.select(
        F.col(key), F.col(f"_last.{ts}").alias(ts), F.col("_last").getField(tie).alias("_tie")
    )
    shown = shown.orderBy(F.col(ts).desc(), F.col("_tie").desc()).limit(n)
    # Their number is the caller's: few are handed to the tasks, more are shuffled.
    shown = F.broadcast(shown) if n <= FEW_ROWS else shown
    full = df.withColumn("_tie", F.col(tie)).join(shown, [key, ts, "_tie"])
    return full.orderBy(F.col(ts).desc(), F.col("_tie").desc()).select(*df.columns)
