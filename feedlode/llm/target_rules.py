"""Quality rules: how much more a text looks like a trusted target than like the raw corpus.

Words and word pairs are hashed into buckets. Two multinomials over the buckets are counted:
one from trusted rows, one from all rows. A text's score is the sum of the log ratios of its
n-grams' buckets over their number; it is kept if no plain rule fails and the score reaches a
fixed threshold. No draw is involved: equal texts get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import broadcast_if_small, small_batches, table
from feedlode.llm.words import WHITE, Words, chained, mixed, ngram_starts, owners, per_text, text_bytes
from feedlode.session import cut_lineage

BUCKETS = 1 << 16
#: Added to each bucket's count, as a share of the bucket's part of all.
SMOOTHING = 1.0
#: Least score of a text that is kept, in natural logs per n-gram.
THRESHOLD = -0.12
#: Trusted ids up to which they are broadcast; beyond that they meet the texts in a shuffle.
BROADCAST_IDS = 1_000_000
MIN_WORDS = 50

SYMBOLS = b"#*$%&|<>"


def _grams(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of word pairs, and the texts that they belong to."""
    own = owners(bounds)
    pairs = np.flatnonzero(ngram_starts(bounds, 2))
    both = chained(hashes[pairs], hashes[pairs + 1]) if len(pairs) else np.empty(0, np.uint64)
    buckets = np.concatenate([hashes, both]) & np.uint64(BUCKETS - 1)
    return buckets.astype(np.int64), np.concatenate([own, own[pairs]])


def bucket_counts(rows: DataFrame, text: str = "text", trusted: str = "trusted") -> DataFrame:
    """(bucket, raw, target): how often each bucket occurs in all rows and in trusted ones."""
    small_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.between(WHITE, lower=False)
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            hashes, bounds = words.read(batch.column(0))
            buckets, own = _grams(hashes, bounds)
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            raw += np.bincount(buckets, minlength=BUCKETS)
            target += np.bincount(buckets[flags[own]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])],
            ["bucket", "raw", "target"],
        )

    parts = rows.select(text, F.coalesce(trusted, F.lit(False)).alias("trusted")).mapInArrow(
        work, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(rows: DataFrame, text: str = "text", trusted: str = "trusted") -> np.ndarray:
    """Per bucket, log of its share in trusted rows over its share in all rows.

    One row per bucket comes to the driver: BUCKETS at most, whatever the corpus. Without a
    trusted n-gram all ratios are 0.
    """
    counts = bucket_counts(rows, text, trusted).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return np.zeros(BUCKETS, np.float32)
    shares = [(c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS) for c in (target, raw)]
    return (np.log(shares[0]) - np.log(shares[1])).astype(np.float32)


class RuleCounter:
    """The plain counts of texts, and their n-grams' mean log ratio."""

    def __init__(self, ratios: np.ndarray) -> None:
        self.ratios = ratios.astype(np.float64)
        self.words = Words.between(WHITE, lower=False)
        self.lines = Words.between([0x0A], lower=False)
        self.symbol = np.zeros(256, bool)
        self.symbol[list(SYMBOLS)] = True

    def count(self, column: pa.Array) -> dict[str, np.ndarray]:
        raw, at = text_bytes(column)
        starts, ends, bounds = self.words.spans(raw, at)
        hashes = self.words.hashes(raw, starts, ends)
        # Code points: bytes that do not continue one.
        points = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        n_words = np.diff(bounds)
        buckets, own = _grams(hashes, bounds)
        n_grams = np.bincount(own, minlength=len(n_words))
        total = np.bincount(own, self.ratios[buckets], minlength=len(n_words))
        return {
            "n_words": n_words,
            "word_chars": per_text(points[ends] - points[starts], bounds),
            "n_symbols": per_text(self.symbol[raw].astype(np.int64), at),
            "n_dup_lines": self._dup_lines(raw, at, starts),
            "n_repeat_words": self._repeat_words(hashes, bounds),
            "score": total / np.maximum(n_grams, 1),
        }

    def _dup_lines(self, raw: np.ndarray, at: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
        starts, ends, bounds = self.lines.spans(raw, at)
        if not len(starts):
            return np.zeros(len(at) - 1, np.int64)
        own = owners(bounds)
        with_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
        keys = chained(self.lines.hashes(raw, starts, ends), own.astype(np.uint64))[with_word]
        own = own[with_word]
        _, first = np.unique(keys, return_index=True)
        n = len(at) - 1
        return np.bincount(own, minlength=n) - np.bincount(own[first], minlength=n)

    def _repeat_words(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(ngram_starts(bounds, 3))
        if not len(begin):
            return np.zeros(len(bounds) - 1, np.int64)
        keys = chained(hashes[begin], hashes[begin + 1], hashes[begin + 2],
                       mixed(owners(bounds)[begin].astype(np.uint64)))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = begin[counts[inverse] > 1]
        covered = np.zeros(len(hashes), bool)
        for offset in range(3):
            covered[again + offset] = True
        return per_text(covered.astype(np.int64), bounds)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, plain counts, score, base_failed, kept) of every row.

    A null text has no words: all counts and its score are 0, and it fails for want of words.
    Rows are judged one by one, so repeated keys and rows give repeated results; other columns
    are left out, whatever their names. Texts are taken whole, memory follows the longest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ratios)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = RuleCounter(shared.value)
        for batch in batches:
            found = counter.count(batch.column(1))
            columns = [pa.array(found[c], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(found["score"], pa.float64())],
                [key, *COUNTS, "score"],
            )

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (docs.select(key, text).mapInArrow(work, schema)
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= THRESHOLD)))


def trusted_rows(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """The documents with a column trusted: those labelled 1 for quality, all of them unless
    only the `most` with the smallest hash of their id are wanted."""
    ids = labels.where("quality = 1").select("doc_id").distinct()
    if most is not None:
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = cut_lineage(ids)
    flags = broadcast_if_small(ids.withColumn("trusted", F.lit(True)), ids.count(), BROADCAST_IDS)
    return docs.select("doc_id", "text").join(flags, "doc_id", "left")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = log_ratios(trusted_rows(docs, table(spark, sf_dir, "labels")))
    return judge(docs, ratios)
