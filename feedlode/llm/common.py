"""What the operators of this subpackage share: reading tables, row keys, batch sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of one Arrow batch: texts are long, and some very long.
BATCH_ROWS, BATCH_BYTES = 500, "4m"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of texts small, also the results of grouped functions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def fresh_name(wanted: str, taken: Sequence[str]) -> str:
    """A column name that none of the given ones clashes with, in any letter case."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted = f"_{wanted}"
    return wanted


def without(df: DataFrame, *names: str) -> DataFrame:
    """The rows without columns that the operator is about to add."""
    gone = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


#: Separators of words, as a regular expression and as the characters that a word may hold.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """Words of lower-cased letters and digits; an empty word can stand first and last."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP)


def row_key(*columns: str) -> list[Column]:
    """Two hashes, 96 bits together, that stand for a row's values; equal rows share them."""
    values = [F.col(f"`{c}`") for c in columns]
    return [F.xxhash64(*values).alias("key_a"), F.hash(*values, F.lit(1)).alias("key_b")]


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Ask for a broadcast of a table of so many rows if they are at most `most`."""
    return F.broadcast(df) if rows <= most else df


#: The same words in DuckDB.
LOWER_SQL = f"translate({{}}, '{UPPER}', '{LOWER}')"
WORDS_SQL = (
    f"regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
