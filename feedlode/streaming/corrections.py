"""De-duplication with a time to live on a stream out of order, with corrections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from feedlode.functions.fixed_values import DEDUP_TTL_SECONDS
from feedlode.operators.dedup import dedup_ttl
from feedlode.session import cut_lineage, scratch
from feedlode.streaming.slots import SlotTable, day_of

ADMITTED, WITHDRAWN, LATE = "admitted", "withdrawn", "late"


class CorrectingLedger:
    """All sightings, and what was admitted of them, so that a late one can be worked in.

    After every micro-batch the admitted sightings are those of ``dedup_ttl`` on all that came,
    in whatever order it came. A sighting changes what its key's later ones do, up to the next
    silence: so a batch takes, of the keys in it, all sightings from its first one of the key on,
    or from the one before that is admitted and less than one TTL away, and folds them anew. What
    comes out otherwise than before is given as a change: an admission, also of a sighting of an
    earlier batch, or a withdrawal.

    ``lateness_seconds`` bounds what is read: a sighting more than that behind the latest one of
    earlier batches is given as late and not worked in, and only days from then on, less one TTL,
    are read. Without it none is late and all days can be read. Sightings and changes are kept
    by day and batch; a batch that is run again finds both as they were before it and writes
    the same. A ledger belongs to one streaming checkpoint.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str] = ("platform", "id"),
        ts: str = "seen_at",
        ttl_seconds: int = DEDUP_TTL_SECONDS,
        tie: Sequence[str] = (),
        lateness_seconds: int | None = None,
    ) -> None:
        self.spark, self.path = spark, path
        self.keys, self.ts, self.tie = list(keys), ts, list(tie)
        self.ttl_seconds, self.lateness_seconds = ttl_seconds, lateness_seconds
        self.columns = list(dict.fromkeys([*keys, ts, *tie]))
        self.latest = SlotTable(spark, f"{path}/latest", "latest timestamp, one int", "one")

    def _from_day(self, name: str, first: object, batch_id: int | None) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(first))
        return rows if batch_id is None else rows.where(F.col("batch") < batch_id)

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        (
            rows.withColumn("day", day_of(F.col(self.ts))).withColumn("batch", F.lit(batch_id).cast("bigint"))
            .repartition("day")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "batch").parquet(f"{self.path}/{name}")
        )

    def _net(self, changes: DataFrame) -> DataFrame:
        """Each sighting that is admitted after all of these changes, once per time it is."""
        sums = changes.groupBy(*self.columns).agg(F.sum("sign").alias("times")).where("times > 0")
        return sums.select(*self.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).drop("nth")

    def admit(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """(keys, time, tie, change) of a micro-batch: what is admitted, withdrawn or late by it."""
        rows = cut_lineage(batch.select(*self.columns), self.spark)
        last = self.latest.read(before=batch_id).agg(F.max("latest")).first()[0]
        border = None
        if last is not None and self.lateness_seconds is not None:
            border = last - timedelta(seconds=self.lateness_seconds)
        punctual, late = rows, rows.limit(0)
        if border is not None:
            punctual, late = rows.where(F.col(self.ts) >= F.lit(border)), rows.where(F.col(self.ts) < F.lit(border))
        span = punctual.agg(F.min(self.ts), F.max(self.ts)).first()
        changes = rows.limit(0).withColumn("sign", F.lit(1))
        if span[0] is not None:
            changes = cut_lineage(self._changes(punctual, span[0], batch_id), self.spark)
            self._write(punctual, "seen", batch_id)
            newest = span[1] if last is None else max(last, span[1])
            self.latest.replace(self.spark.createDataFrame([(newest, 0)], "latest timestamp, one int"), batch_id)
        self._write(changes, "changes", batch_id)
        change = F.when(F.col("sign") > 0, ADMITTED).otherwise(WITHDRAWN).alias("change")
        told = changes.select(*self.columns, change, F.explode(F.sequence(F.lit(1), F.abs("sign"))).alias("nth"))
        return told.drop("nth").unionByName(late.withColumn("change", F.lit(LATE)))

    def _changes(self, punctual: DataFrame, first: object, batch_id: int) -> DataFrame:
        ttl = F.make_dt_interval(secs=F.lit(self.ttl_seconds))
        # A day more, as the driver's clock need not be in UTC.
        day = (first - timedelta(seconds=self.ttl_seconds, days=1)).date()
        starts = punctual.groupBy(*self.keys).agg(F.min(self.ts).alias("_first"))
        past = self._from_day("changes", day, batch_id)
        before = None
        if past is not None:
            before = self._net(past.join(starts.select(*self.keys), self.keys, "left_semi"))
            before = cut_lineage(before, self.spark)
            near = before.join(starts, self.keys).where(
                (F.col(self.ts) < F.col("_first")) & (F.col(self.ts) > F.col("_first") - ttl))
            near = near.groupBy(*self.keys).agg(F.max(self.ts).alias("_near"))
            starts = starts.join(near, self.keys, "left").select(*self.keys, F.coalesce("_near", "_first").alias("_first"))
        starts = cut_lineage(starts, self.spark)
        known = self._from_day("seen", day, batch_id)
        sightings = punctual if known is None else punctual.unionByName(known.select(*self.columns))
        concerned = sightings.join(starts, self.keys).where(F.col(self.ts) >= F.col("_first")).select(*self.columns)
        # Written down, as the rule reads it more than once.
        now = dedup_ttl(cut_lineage(concerned, self.spark), self.keys, self.ts, self.ttl_seconds, self.tie)
        signed = now.select(*self.columns, F.lit(1).alias("sign"))
        if before is not None:
            was = before.join(starts, self.keys).where(F.col(self.ts) >= F.col("_first"))
            signed = signed.unionByName(was.select(*self.columns, F.lit(-1).alias("sign")))
        return signed.groupBy(*self.columns).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")

    def read(self) -> DataFrame:
        """All admitted sightings: keys, time and tie columns."""
        changes = self._from_day("changes", None, None)
        return self._net(changes).select(*self.columns)


def corrected_stream(
    stream: DataFrame, ledger: CorrectingLedger, checkpoint: str, save: Callable[[DataFrame, int], None] | None = None
) -> DataStreamWriter:
    """Run a stream through a ledger; ``save`` gets the changes of each micro-batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch(ledger.spark):
            changes = ledger.admit(batch, batch_id)
            if save:
                save(changes, batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
