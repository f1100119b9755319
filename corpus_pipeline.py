"""From raw documents to token ids: toxicity, repeated lines, near duplicates, benchmark
passages, encoding. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlode.llm import decontaminate, line_dedup, near_join, pieces, toxicity
from feedlode.llm.common import fresh_name, table
from feedlode.session import cut_lineage


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_folder(stage: Stage) -> Stage:
    """A stage that, without a cluster and a named folder, writes to a temporary one."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not named and context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="pipeline-"))
        return stage(spark, docs, sf_dir)

    return run_stage


def _set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows with other names for columns that a stage's own results would replace, and the
    names that they go by meanwhile."""
    hidden: dict[str, str] = {}
    for column in docs.columns:
        if column.lower() in names:
            hidden[column] = fresh_name(f"own_{column}", [*docs.columns, *hidden.values()])
    return docs.withColumnsRenamed(hidden), hidden


def _as_before(docs: DataFrame, columns: list[str], hidden: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in columns])


@_with_folder
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are judged toxic.

    Null and empty texts stay; rows are judged one by one, repeated ones alike, and an empty table
    stays empty. All columns stay as they are, whatever their names.
    """
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"))
    examples = toxicity.fit(docs.select("doc_id", "text"), labels)
    own, hidden = _set_aside(docs, "score", "evidence")
    judged = toxicity.score(own, examples)
    return _as_before(judged.where(F.col("score") < toxicity.CUT), docs.columns, hidden)


@_with_folder
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier place. A document that has nothing left
    goes; what is left of any other stays, however little, as no passage of it stands in an
    earlier place. One that loses nothing stays as it is.

    Null and empty texts stay; rows that repeat id and text are one document. All columns stay as
    they are but for the text and, where there is one, n_chars, which follows it.
    """
    removed = fresh_name("n_removed", docs.columns)
    found = line_dedup.dedup_lines(docs, removed=removed)
    changed = F.col(removed) > 0
    left = found.where(~changed | (F.btrim("text", F.lit(line_dedup.BLANK)) != ""))
    if "n_chars" in docs.columns:
        n_chars = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", n_chars)
    return _as_before(left, docs.columns, {})


@_with_folder
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest id.

    Texts without words, so null and empty ones, all stay; of rows that repeat id and text one
    stays if they have words. All columns stay as they are.
    """
    return near_join.keep_one(docs)


@_with_folder
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark.

    Null and empty texts hold none and stay; rows that repeat id and text share their verdict. All
    columns stay as they are.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_with_folder
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, and the text that they decode to: (doc_id, lang, source,
    n_chars, n_tokens, ids, decoded). Other columns, the text among them, are left out.

    A null or empty text has no ids and decodes to the empty text; there is a row per row.
    """
    found = pieces.encode_decode(docs, pieces.model_path())
    return found.select("doc_id", "lang", "source", "n_chars",
                        F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: Nearest labelled examples and prefix tables have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), spark)
    return docs
