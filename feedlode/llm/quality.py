"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Words are runs of letters and digits, or runs of signs, in their own letter case; a word equal
to the one before counts as the special word "again". Single words and pairs are hashed into
buckets; a text is the unit vector of its buckets' counts. A text's score is a sparse dot
product, put through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import remainder, small_batches, table
from feedlode.llm.words import NOT_ALNUM, Words, chained, mixed, ngram_starts, owners

BUCKETS = 1 << 18
#: Most labelled rows that the weights are learned from.
TRAINING_ROWS = 8_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.01
CUT = 0.7
AGAIN = np.uint64(0x5EED5EED5EED5EED)


def _kinds() -> np.ndarray:
    kinds = np.ones(256, np.uint8)
    kinds[NOT_ALNUM] = 2
    kinds[[*range(0x00, 0x21), 0x7F]] = 0
    return kinds


class Features:
    """Unit vectors of texts as (text, bucket, weight) triples, sorted by text and bucket."""

    def __init__(self) -> None:
        self.words = Words(_kinds(), lower=False)

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, bounds = self.words.read(column)
        own = owners(bounds)
        pairs = np.flatnonzero(ngram_starts(bounds, 2))
        same = pairs[hashes[pairs] == hashes[pairs + 1]] + 1
        hashes = hashes.copy()
        hashes[same] = AGAIN
        grams = np.concatenate([mixed(hashes), chained(hashes[pairs], hashes[pairs + 1])]
                               if len(hashes) else [hashes])
        own = np.concatenate([own, own[pairs]])
        keys = own.astype(np.int64) * BUCKETS + (grams & np.uint64(BUCKETS - 1)).astype(np.int64)
        keys, counts = np.unique(keys, return_counts=True)
        own, buckets = keys // BUCKETS, keys % BUCKETS
        weights = 1 + np.log(counts)
        norms = np.sqrt(np.bincount(own, weights**2, minlength=len(bounds) - 1))
        return own, buckets, weights / norms[own] if len(own) else weights


def train(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights per bucket, and the intercept last, from (buckets, weights, label) in order.

    Follow-the-regularised-leader: per coordinate the sum of gradients z and of their squares
    n; a weight is 0 while |z| does not exceed L1.
    """
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        for buckets, weights, label in examples:
            at = np.append(buckets, BUCKETS)
            x = np.append(weights, 0.2)
            zi, ni = z[at], n[at]
            w = _solved(zi, ni)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            squares = gradient * gradient
            z[at] = zi + gradient - (np.sqrt(ni + squares) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + squares
    return _solved(z, n)


def _solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> np.ndarray:
    """Weights from at most `most` labelled rows: those with the smallest hash of their id.

    labels: doc_id and label (0 or 1; null labels are left out, of repeated ids the larger
    label counts). The rows' features are made where the rows are; one task of bounded size
    runs over them in order. Without rows all weights are 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = (labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
              .agg(F.max("label").cast("double").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Features()
        for batch in batches:
            own, buckets, weights = reader.read(batch.column(1))
            ends = np.searchsorted(own, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(0), batch.column(2),
                pa.ListArray.from_arrays(ends, pa.array(buckets.astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(weights.astype(np.float32))),
            ], ["task", "doc_id", "label", "buckets", "weights"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        # Repeated rows of one id count once, so that the sample keeps its bound.
        rows = rows.drop_duplicates("doc_id")
        order = mixed(rows["doc_id"].to_numpy().astype(np.int64).view(np.uint64)).argsort(kind="stable")
        examples = [(b.astype(np.int64), w.astype(float), y) for b, w, y in
                    rows[["buckets", "weights", "label"]].iloc[order].itertuples(index=False)]
        weights = train(examples)
        at = np.flatnonzero(weights)
        return pd.DataFrame({"at": at, "weight": weights[at]})

    learned = (rows.select("doc_id", "text", "label")
               .mapInArrow(features, "task int, doc_id long, label double, buckets array<int>, weights array<float>")
               .groupBy("task").applyInPandas(learn, "at long, weight double")).toPandas()
    weights = np.zeros(BUCKETS + 1)
    weights[learned["at"]] = learned["weight"]
    return weights


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row: the chance of label 1.

    A null or empty text has no features: its score follows from the intercept alone. Rows are
    scored one by one, repeated ones alike; only the text is an input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, w = Features(), shared.value
        for batch in batches:
            own, buckets, x = reader.read(batch.column(1))
            total = np.bincount(own, w[buckets] * x, minlength=batch.num_rows) + 0.2 * w[-1]
            found = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [key, "score"])

    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, score double")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = (table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2)
              .select("doc_id", F.col("quality").alias("label")))
    return score(docs, fit(docs, labels)).select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
