from __future__ import annotations

import zlib

import numpy as np
import pytest

from feedlode.llm import quality as q
from tests.llm.cases import MIDDLE, TEXTS, no_docs, odd_docs, small_rows


def auc(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    good, bad = scores[labels == 1], scores[labels == 0]
    return (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()


def test_held_out_accuracy(spark):
    labels = {r[0]: r[1] for r in small_rows("labels", MIDDLE)}
    rows = q.op5_quality(spark, MIDDLE).collect()
    assert len(rows) == len(small_rows("documents", MIDDLE))
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.7)
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([h[0] for h in held], [h[2] for h in held]) > 0.95
    assert np.mean([h[1] == h[2] for h in held]) > 0.93


def test_training_against_a_plain_loop():
    rng = np.random.default_rng(5)
    examples = []
    for _ in range(60):
        buckets = np.sort(rng.choice(50, 6, replace=False))
        weights = rng.random(6)
        examples.append((buckets, weights, float(buckets[0] % 2)))
    z, n, w = {}, {}, {}
    for _ in range(q.EPOCHS):
        for buckets, weights, label in examples:
            pairs = [*zip(buckets.tolist(), weights.tolist(), strict=True), (q.BUCKETS, 0.2)]
            total = 0.0
            for b, x in pairs:
                zi, ni = z.get(b, 0.0), n.get(b, 0.0)
                w[b] = 0.0 if abs(zi) <= q.L1 else -(zi - np.sign(zi) * q.L1) / ((q.BETA + ni**0.5) / q.ALPHA + q.L2)
                total += w[b] * x
            error = 1 / (1 + np.exp(-total)) - label
            for b, x in pairs:
                g = error * x
                sigma = ((n.get(b, 0.0) + g * g) ** 0.5 - n.get(b, 0.0) ** 0.5) / q.ALPHA
                z[b] = z.get(b, 0.0) + g - sigma * w[b]
                n[b] = n.get(b, 0.0) + g * g
    found = q.train(examples)
    for b in z:
        expected = 0.0 if abs(z[b]) <= q.L1 else -(z[b] - np.sign(z[b]) * q.L1) / ((q.BETA + n[b]**0.5) / q.ALPHA + q.L2)
        assert found[b] == pytest.approx(expected, abs=1e-9)
    assert np.count_nonzero(found) <= len(z)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(6, 1), (7, 0), (None, 1), (8, None), (12, 0), (12, 1), (99, 1)], "doc_id long, label int")
    weights = q.fit(odd_docs(spark), labels)
    rows = q.score(odd_docs(spark), weights).collect()
    assert len(rows) == len(TEXTS) + 2
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[0] == by_id[1] == by_id[3] and by_id[12] == by_id[13]
    assert all(0 < s < 1 for s in by_id.values())
    assert q.score(no_docs(spark), weights).collect() == []
    none = q.fit(odd_docs(spark), labels.where("false"))
    assert not none.any() and {r["score"] for r in q.score(odd_docs(spark), none).collect()} == {0.5}


def test_the_sample_is_bounded_and_the_same_each_time(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").selectExpr("doc_id", "quality AS label")
    one = q.fit(docs, labels, 50)
    assert np.array_equal(one, q.fit(docs.repartition(5), labels, 50))
