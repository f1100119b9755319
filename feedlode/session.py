"""Session settings and the shared folder for checkpoints and work tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CODEC = "spark.sql.parquet.compression.codec"
#: Most bytes of texts or vectors that go to a Python worker at once, beyond a single longer row.
BATCH_BYTES = "4m"


def build_session(app: str = "feedlode", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Long texts: keep one Arrow batch small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not by rows alone: what a Python worker holds then depends
    neither on the length of the rows nor on how many a task has."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors can reach. Whoever starts the session
    names it; the library makes none up."""
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_SETTING)
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    folder = named or context.getCheckpointDir()
    if not folder:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_open = threading.local()


def delete_paths(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete tables, wherever they are stored; what is not there is passed over."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name in paths:
        path = hadoop(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut_lineage`` writes within, in this thread, are deleted at the end: for work
    whose results are saved elsewhere by then, a micro-batch say."""
    around, outer = getattr(_open, "outer", None), getattr(_open, "paths", None)
    _open.paths, _open.outer = [], outer
    try:
        yield
    finally:
        paths, _open.paths, _open.outer = _open.paths, outer, around
        delete_paths(spark, paths)


_held: dict[tuple[str, str], list] = {}
_holding = threading.Lock()


@contextmanager
def _set(sessions: Sequence[SparkSession], key: str, value: str) -> Iterator[None]:
    """A setting within; what was there before comes back when the last thread that holds it ends."""
    held = [(spark, (spark._jsparkSession.sessionUUID(), key)) for spark in sessions]
    with _holding:
        for spark, name in held:
            _held.setdefault(name, [0, spark.conf.get(key)])[0] += 1
            spark.conf.set(key, value)
    try:
        yield
    finally:
        with _holding:
            for spark, name in held:
                _held[name][0] -= 1
                if not _held[name][0]:
                    spark.conf.set(key, _held.pop(name)[1])


@contextmanager
def shuffles_let_go(*sessions: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run within go with the end of each: for steps that end in a table
    written down. Else they stay until the driver happens to collect its garbage."""
    with _set(sessions, SHUFFLE_CLEANUP, "true"):
        yield


@contextmanager
def packed(*sessions: SparkSession) -> Iterator[None]:
    """Tables written within take about two thirds of the disk, for somewhat more time: for texts
    that are written more than once, or stay."""
    with _set(sessions, CODEC, "zstd"):
        yield


def few(cut: DataFrame, most: int) -> DataFrame:
    """Keys that were written down, to be broadcast unless they are many."""
    return F.broadcast(cut) if cut.count() <= most else cut


def let_go(cut: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote before the scratch around it ends."""
    delete_paths(cut.sparkSession, sorted({name.rsplit("/", 1)[0] for name in files_of(cut)}))


def files_of(read: DataFrame) -> list[str]:
    """The files that a frame is read from, by their plain names."""
    jvm = read.sparkSession._jvm
    return [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)).toString() for name in read.inputFiles()]


def cut_lineage(df: DataFrame, spark: SparkSession | None = None, kept: bool = False) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    Survives the loss of executors; each row is worked out once, and later steps read only
    the columns they need. ``spark`` is the session to go on in; ``kept`` says that the rows are
    wanted beyond the scratch around this call, and go with the one around that, if any.
    """
    spark = spark or df.sparkSession
    path = work_path(spark, "cut")
    paths = getattr(_open, "outer" if kept else "paths", None)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
