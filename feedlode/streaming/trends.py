"""Trend clusters of the stored insights, from sums per hour and cluster."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from feedlode.functions.fixed_values import SAMPLES_PER_CLUSTER, TREND_LIMIT, TREND_WINDOW_HOURS
from feedlode.functions.limits import clamp_hours, clamp_limit
from feedlode.functions.rounding import mean_one_decimal
from feedlode.operators.rows import exclude_explicit
from feedlode.session import cut_lineage, scratch
from feedlode.streaming.slots import SlotTable, day_of
from feedlode.streaming.store import InsightStore

SUMS = ("hour timestamp, cluster_key string, cluster_label string, insight_count bigint, score bigint, scored bigint, "
        "top_score int, latest_seen_at timestamp, day date")
TEXTS = "hour timestamp, cluster_key string, kind string, text string, day date"
#: Kinds of texts that are shown per cluster, the column that holds each, and how many are shown.
KINDS = {"platform": ("platform", None), "title": ("title", SAMPLES_PER_CLUSTER), "pain": ("core_pain_point", SAMPLES_PER_CLUSTER)}
COLUMNS = ["cluster_key", "cluster_label", "commercial_potential", "created_at", "is_explicit_content",
           *[column for column, _ in KINDS.values()]]


def _hour() -> Column:
    return F.timestamp_seconds(F.floor(F.unix_micros("created_at") / F.lit(3_600_000_000)) * 3600)


def _clustered(rows: DataFrame) -> DataFrame:
    """Rows that count, with hour and day of the time line itself."""
    counted = exclude_explicit(rows.select(*COLUMNS)).where(F.coalesce("cluster_key", F.lit("")) != "")
    return counted.withColumns({"hour": _hour(), "day": day_of(F.col("created_at"))})


def hourly_sums(rows: DataFrame) -> DataFrame:
    """SUMS per hour and cluster: all of them can be added up or compared over hours."""
    zero = F.lit(0).cast("bigint")
    return _clustered(rows).groupBy("hour", "cluster_key", "day").agg(
        F.max(F.nullif(F.col("cluster_label"), F.lit(""))).alias("cluster_label"),
        F.count(F.lit(1)).alias("insight_count"),
        F.coalesce(F.sum("commercial_potential"), zero).cast("bigint").alias("score"),
        F.count("commercial_potential").alias("scored"),
        F.max("commercial_potential").alias("top_score"),
        F.max("created_at").alias("latest_seen_at"),
    )


def _first_texts(texts: DataFrame, *groups: str) -> DataFrame:
    """Distinct texts per group and kind, of limited kinds the first few; the limit is applied
    before the shuffle."""
    distinct = texts.select(*groups, "kind", "text").distinct()
    whole = [kind for kind, (_, most) in KINDS.items() if most is None]
    rank = F.row_number().over(Window.partitionBy(*groups, "kind").orderBy("text"))
    few = distinct.where(~F.col("kind").isin(whole)).withColumn("rank", rank)
    few = few.where(F.col("rank") <= SAMPLES_PER_CLUSTER).drop("rank")
    return few.unionByName(distinct.where(F.col("kind").isin(whole)))


def hourly_texts(rows: DataFrame) -> DataFrame:
    """TEXTS per hour and cluster: the platforms, and the first few titles and pain points."""
    pairs = F.stack(F.lit(len(KINDS)), *[c for kind, (column, _) in KINDS.items() for c in (F.lit(kind), F.col(column))])
    texts = _clustered(rows).select("hour", "cluster_key", "day", pairs.alias("kind", "text"))
    return _first_texts(texts.where((F.col("text") != "") | (F.col("kind") == "platform")), "hour", "cluster_key", "day")


class HourlyTrends:
    """Sums and first texts per hour and cluster of the rows of a store.

    A micro-batch of the store's changes works the days anew on which its rows were created, from
    narrow columns of those days' rows alone; so an update that moves a row to another cluster,
    hides it or lowers its score is right without a count being taken back. A question adds up
    one row per hour and cluster, and looks at rows only of the hour that the window begins in.
    """

    def __init__(self, spark: SparkSession, path: str, store: InsightStore) -> None:
        self.spark, self.store = spark, store
        self.sums = SlotTable(spark, f"{path}/sums", SUMS, "day")
        self.texts = SlotTable(spark, f"{path}/texts", TEXTS, "day")

    def update(self, changes: DataFrame, batch_id: int) -> None:
        """Take in a micro-batch of the change log, whose rows the store holds by now."""
        days = [r[0] for r in changes.select(day_of(F.col("created_at")).alias("day")).distinct().collect()]
        if not days:
            return
        with scratch(self.spark):
            rows = cut_lineage(self.store.on_days(days).select(*COLUMNS), self.spark)
            for table, now in ((self.sums, hourly_sums(rows)), (self.texts, hourly_texts(rows))):
                # A cluster whose last row of a day has moved on has no row there any more; a day
                # without any is marked by an empty one.
                empty = self.spark.createDataFrame([(d,) for d in days], "day date")
                now = empty.join(now, "day", "left").select(*table.columns)
                table.replace(now, batch_id, ["hour", "cluster_key"])

    def clusters(
        self, as_of: datetime, window_hours: object = TREND_WINDOW_HOURS, limit: object = TREND_LIMIT
    ) -> DataFrame:
        """``trend_clusters`` of the store's rows as of a time."""
        as_of = (as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
        border = as_of - timedelta(hours=clamp_hours(window_hours))
        edge = border.replace(minute=0, second=0, microsecond=0)
        whole = (F.col("day") >= F.lit(border.date())) & (F.col("hour") > F.lit(edge))
        within = F.col("created_at").between(F.lit(border), F.lit(edge + timedelta(hours=1) - timedelta(microseconds=1)))
        last = cut_lineage(self.store.on_days([border.date()]).select(*COLUMNS).where(within), self.spark)
        since = F.col("day") >= F.lit(border.date())
        sums = self.sums.read(where=since).where(whole).unionByName(hourly_sums(last))
        order = [F.col("insight_count").desc(), F.col("average_score").desc(), F.col("latest_seen_at").desc(), F.col("cluster_key")]
        top = sums.groupBy("cluster_key").agg(
            F.coalesce(F.max("cluster_label"), F.first("cluster_key")).alias("cluster_label"),
            F.sum("insight_count").alias("insight_count"),
            mean_one_decimal(F.sum("score"), F.sum("scored")).alias("average_score"),
            F.coalesce(F.max("top_score"), F.lit(0)).alias("top_score"),
            F.max("latest_seen_at").alias("latest_seen_at"),
        )
        # At most 200 rows.
        top = cut_lineage(top.orderBy(*order).limit(clamp_limit(limit)), self.spark)
        texts = self.texts.read(where=since).where(whole).unionByName(hourly_texts(last))
        texts = _first_texts(texts.join(F.broadcast(top.select("cluster_key")), "cluster_key", "left_semi"), "cluster_key")
        shown = texts.groupBy("cluster_key").agg(*[
            F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("text")))).alias(name)
            for kind, name in (("platform", "platforms"), ("title", "sample_titles"), ("pain", "sample_pain_points"))])
        return top.join(F.broadcast(shown), "cluster_key", "left").orderBy(*order)


def trend_sink(changes: DataFrame, trends: HourlyTrends, checkpoint: str) -> DataStreamWriter:
    """Keep the sums up to date from a stream of the store's changes."""
    return changes.writeStream.foreachBatch(trends.update).option("checkpointLocation", checkpoint)
