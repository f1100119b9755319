"""Statistics of the saved insights that go on ageing while nothing new is saved."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from feedlode.functions.rounding import mean_one_decimal
from feedlode.session import cut_lineage
from feedlode.streaming.slots import SlotTable, day_of

SUMS = ["shown", "score", "scored"]
_SUMS = ", ".join(f"{c} bigint" for c in SUMS)
#: Time that a saved insight counts as recent.
RECENT = timedelta(hours=24)


def change_sums(changes: DataFrame) -> list[Column]:
    """What the rows of a change log add to the number of insights that are shown, to the sum of
    their scores and to the number of those that have one. An update counts as the new row
    minus the former one."""
    shown = (~F.coalesce(F.col("is_explicit_content"), F.lit(False))).cast("bigint")
    was_explicit = F.coalesce(F.col("before.is_explicit_content"), F.lit(False))
    was_shown = F.when(F.col("before").isNotNull(), (~was_explicit).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    score, old_score = F.col("commercial_potential").cast("bigint"), F.col("before.commercial_potential").cast("bigint")
    zero = F.lit(0).cast("bigint")
    return [
        (shown - was_shown).alias("shown"),
        (shown * F.coalesce(score, zero) - was_shown * F.coalesce(old_score, zero)).alias("score"),
        (shown * score.isNotNull().cast("bigint") - was_shown * old_score.isNotNull().cast("bigint")).alias("scored"),
    ]


class HourlyStats:
    """Additive sums per hour of ``created_at``, and per instant of it.

    A micro-batch of the change log reads and writes only the days that its rows were created
    on. A question reads one row per hour and, of the one hour that the border of the last 24
    hours falls into, its instants; so the answer is exact at any time, and the count of recent
    insights falls as time goes by, without anything being saved.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.hours = SlotTable(spark, f"{path}/hours", f"hour timestamp, {_SUMS}, day date", "day")
        self.instants = SlotTable(spark, f"{path}/instants", f"created_at timestamp, {_SUMS}, day date", "day")

    def update(self, changes: DataFrame, batch_id: int) -> None:
        """Take in the rows of a micro-batch of the change log."""
        # Days and hours of the time line itself, whatever the session's zone.
        micros = F.unix_micros("created_at")
        added = changes.select(F.col("created_at"), *change_sums(changes), day_of(F.col("created_at")).alias("day"))
        added = cut_lineage(added.groupBy("created_at", "day").agg(*[F.sum(c).alias(c) for c in SUMS]), self.spark)
        days = self.instants.parts_of(added)
        if not days:
            return
        hour = F.timestamp_seconds(F.floor(micros / F.lit(3_600_000_000)) * 3600)
        per_hour = added.select(hour.alias("hour"), *SUMS, "day")
        for table, key, rows in ((self.instants, "created_at", added), (self.hours, "hour", per_hour)):
            known = table.read(days, before=batch_id)
            sums = rows.unionByName(known).groupBy(key, "day").agg(*[F.sum(c).alias(c) for c in SUMS])
            table.replace(sums, batch_id, [key])

    def at(self, as_of: datetime) -> DataFrame:
        """(as_of, total_insights, live_last_24h, average_potential), one row."""
        as_of = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
        border = as_of.astimezone(timezone.utc) - RECENT
        edge = border.replace(minute=0, second=0, microsecond=0)
        zero = F.lit(0).cast("bigint")
        recent = F.when(F.col("hour") > F.lit(edge), F.col("shown")).otherwise(zero)
        whole = self.hours.read().select(*SUMS, recent.alias("recent"))
        within = F.col("created_at").between(F.lit(border), F.lit(edge + timedelta(hours=1) - timedelta(microseconds=1)))
        # Only the day of the border is read, of the instants in it only those of its hour.
        last = self.instants.read([(border.date(),)]).where(within)
        last = last.select(*[zero.alias(c) for c in SUMS], F.col("shown").alias("recent"))
        return whole.unionByName(last).agg(
            F.lit(as_of).alias("as_of"),
            F.coalesce(F.sum("shown"), zero).alias("total_insights"),
            F.coalesce(F.sum("recent"), zero).alias("live_last_24h"),
            mean_one_decimal(F.coalesce(F.sum("score"), zero), F.coalesce(F.sum("scored"), zero)).alias("average_potential"),
        )


def stats_sink(changes: DataFrame, stats: HourlyStats, checkpoint: str) -> DataStreamWriter:
    """Keep the sums up to date from a stream of changes."""
    return changes.writeStream.foreachBatch(stats.update).option("checkpointLocation", checkpoint)


def ageing_stats(
    ticks: DataFrame, stats: HourlyStats, checkpoint: str, save: Callable[[DataFrame, int], None], time: str = "timestamp"
) -> DataStreamWriter:
    """Statistics as of each tick of a stream of times, Spark's ``rate`` source say: ``save`` gets
    those of the last tick of a micro-batch, whether or not anything was saved since."""

    def step(batch: DataFrame, batch_id: int) -> None:
        last = batch.agg(F.unix_micros(F.max(F.col(time).cast("timestamp")))).first()[0]
        if last is not None:
            save(stats.at(datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=last)), batch_id)

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
