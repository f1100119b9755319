from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from feedlode.llm import target_rules as t
from tests.llm.cases import MIDDLE, SMALL, TEXTS, blank_words, no_docs, odd_docs, small_rows


def plain(text) -> tuple:
    words = blank_words(text)
    lines = [line for line in (text or "").split("\n") if blank_words(line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, window in enumerate(windows) if counts[window] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_query_against_plain_counts(spark):
    for sf_dir in (SMALL, MIDDLE):
        texts = {r[0]: r[1] for r in small_rows("documents", sf_dir)}
        rows = t.op10_quality_rules(spark, sf_dir).collect()
        assert len(rows) == len(texts)
        for row in rows:
            counts = plain(texts[row["doc_id"]])
            assert tuple(row[c] for c in t.COUNTS) == counts
            assert row["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
            assert row["kept"] == (not row["base_failed"] and row["score"] >= t.THRESHOLD)
    labels = {r[0]: r[1] for r in small_rows("labels", MIDDLE)}
    judged = [(row["kept"], labels[row["doc_id"]]) for row in rows if row["doc_id"] in labels and not row["base_failed"]]
    good = [kept for kept, label in judged if label == 1]
    bad = [kept for kept, label in judged if label == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_scores_against_plain_sums(spark):
    docs = odd_docs(spark).select("doc_id", "text").withColumn("trusted", F.col("doc_id") >= 12)
    ratios = t.log_ratios(docs)
    texts = [r["text"] for r in docs.collect()]
    words = t.Words.between(t.WHITE, lower=False)
    import pyarrow as pa

    def buckets(text):
        hashes, bounds = words.read(pa.array([text], pa.string()))
        return t._grams(hashes, bounds)[0]

    raw, target = Counter(), Counter()
    for row in docs.collect():
        raw.update(buckets(row["text"]).tolist())
        if row["trusted"]:
            target.update(buckets(row["text"]).tolist())
    n_raw, n_target = sum(raw.values()), sum(target.values())
    for bucket in list(raw)[:50]:
        expected = np.log((target[bucket] + 1) / (n_target + t.BUCKETS)) - np.log((raw[bucket] + 1) / (n_raw + t.BUCKETS))
        assert abs(ratios[bucket] - expected) < 1e-5
    rows = t.judge(docs, ratios).collect()
    for row, text in zip(rows, texts, strict=True):
        own = buckets(text)
        assert abs(row["score"] - (ratios[own].astype(float).mean() if len(own) else 0)) < 1e-9
        assert tuple(row[c] for c in t.COUNTS) == plain(text)


def test_odd_rows(spark):
    zero = np.zeros(t.BUCKETS, np.float32)
    assert t.judge(no_docs(spark), zero).collect() == []
    rows = t.judge(odd_docs(spark), zero).collect()
    assert len(rows) == len(TEXTS) + 2
    assert [r["base_failed"] for r in rows if r["doc_id"] in (0, 1, 2)] == [True] * 3
    # Nothing trusted, nothing to compare with.
    assert not t.log_ratios(odd_docs(spark).withColumn("trusted", F.lit(None).cast("boolean"))).any()


def test_trusted_rows_are_bounded(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels = labels.unionAll(labels)
    rows = t.trusted_rows(docs, labels, 10).collect()
    assert len(rows) == docs.count() and sum(bool(r["trusted"]) for r in rows) == 10


def test_all_trusted_rows_count(spark, monkeypatch):
    n = 21_000
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    for limit in (t.BROADCAST_IDS, 0):
        monkeypatch.setattr(t, "BROADCAST_IDS", limit)
        rows = t.trusted_rows(docs, labels.unionAll(labels))
        assert rows.count() == 2 * n and rows.where("trusted AND doc_id % 2 = 1").count() == n
        assert rows.where("trusted AND doc_id % 2 = 0").count() == 0
        assert t.bucket_counts(rows).agg(F.sum("target")).first()[0] == n
