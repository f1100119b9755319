"""Vector search against numpy, and the model interfaces."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlode.operators import analyze, embed, similarity
from feedlode.session import BATCH_BYTES


@pytest.fixture(scope="module")
def stored(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), bool(i % 5 == 0)) for i in range(120)]
    rows += [(200, [0.0] * 16, False), (201, [1.0] * 8, False), (202, [2.0] * 8, None), (203, None, False)]
    rows += [(300 + i, rows[1][1], False) for i in range(3)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>, is_explicit_content boolean"), rows


def brute(rows, query, k, without=None):
    found = []
    for i, v, hidden in rows:
        if hidden or v is None or len(v) != len(query) or i == without or not any(v):
            continue
        a, b = np.array(v, np.float64), np.array(query, np.float64)
        found.append((-round(a @ b / np.linalg.norm(a) / np.linalg.norm(b), 12), i))
    return [i for _, i in sorted(found)[:k]]


def test_search(stored):
    df, rows = stored
    query = rows[1][1]
    got = similarity.semantic_search(df, query, 10).collect()
    assert [r["id"] for r in got] == brute(rows, query, 10)
    assert got[0]["similarity"] == pytest.approx(1) and all(r["similarity"] >= 0 for r in got)
    assert similarity.semantic_search(df, [], 10).count() == 0
    opposite = [-x for x in query]
    assert similarity.semantic_search(df, opposite, 200).agg(F.min("similarity")).first()[0] == 0


def test_similar(stored):
    df, rows = stored
    # Row 5 is explicit and may still be the target.
    for target in (1, 5):
        got = [r["id"] for r in similarity.similar_insights(df, target, 8).collect()]
        assert got == brute(rows, rows[target][1], 8, target)
    assert similarity.similar_insights(df, 203).count() == similarity.similar_insights(df, 999).count() == 0
    plan = similarity.search_ids(df, rows[1][1], 8)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_bytes": 2000}])
def test_bulk(stored, sizes):
    """Handed to the tasks or shuffled in blocks: the same as one query per row."""
    df, rows = stored
    got = {}
    for r in similarity.similar_insights_bulk(df, df.select("id"), 4, **sizes).orderBy("target_id", "rank").collect():
        got.setdefault(r["target_id"], []).append(r["id"])
    for i, v, _ in rows:
        expected = brute(rows, v, 4, i) if v is not None and any(v) else []
        assert got.get(i, []) == expected


def test_bulk_of_some(stored):
    df, rows = stored
    got = similarity.similar_insights_bulk(df, [3, 5], 6).orderBy("target_id", "rank").collect()
    assert [r["id"] for r in got] == brute(rows, rows[3][1], 6, 3) + brute(rows, rows[5][1], 6, 5)
    assert similarity.similar_insights_bulk(df, [999]).count() == 0


def test_normalized_length_is_one_or_zero(stored):
    df, _ = stored
    lengths = embed.l2_normalize(df.filter("embedding IS NOT NULL"), "embedding").select(
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("n")
    ).distinct()
    assert sorted(r["n"] for r in lengths.collect()) == [0.0, 1.0]


def test_model_rows_fail_alone(spark):
    def make():
        def answer(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return ['{"commercial_potential": 4}' if "odd" not in p else "?" for p in prompts]

        return answer

    names = ["platform", "channel", "content_kind", "title", "author", "url", "content"]
    df = spark.createDataFrame([(t,) * 7 for t in ("good", "bad", "odd")], ", ".join(f"{n} string" for n in names))
    scored = {r["title"]: r for r in analyze.score_with_model(df.coalesce(1), make, "m").collect()}
    assert scored["good"]["commercial_potential"] == 4 and scored["good"]["analysis_model"] == "m"
    assert scored["bad"]["status"] == "failed" and scored["bad"]["error"] == "RuntimeError: no"
    assert scored["odd"]["status"] == "rejected" and scored["odd"]["raw_answer"] == "?"


@pytest.mark.parametrize("copies", [1, 30])
def test_bulk_search_sorts_few_of_the_pairs(monkeypatch, copies):
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.normal(size=(12_000 // copies, 8)), copies, axis=0)[rng.permutation(12_000)]
    vectors[[3, 70]] = 0
    ids = np.arange(12_000)
    ids[50:52] = 40
    targets, k, sizes = slice(0, 300), 4, []

    def counted(keys, **options):
        sizes.append(np.asarray(keys[0]).size)
        return lexsort(keys, **options)

    lexsort = np.lexsort
    monkeypatch.setattr(similarity.np, "lexsort", counted)
    best = similarity._RunningBest(ids[targets], vectors[targets], k)
    for i in range(0, len(ids), 5000):
        best.add(ids[i : i + 5000], vectors[i : i + 5000])
    assert sum(sizes) < 0.1 * 300 * len(ids)
    with np.errstate(invalid="ignore"):
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    wanted = []
    for i in range(300):
        if i in (3, 70):
            continue
        cosines = (units @ units[i]).round(12)
        cosines[(ids == ids[i]) | np.isnan(cosines)] = -np.inf
        wanted += [(ids[i], ids[j], cosines[j]) for j in lexsort((ids, -cosines))[:k]]
    got = best.result().to_pylist()
    assert [(r["target_id"], r["id"]) for r in got] == [w[:2] for w in wanted]
    assert np.allclose([r["cosine"] for r in got], [w[2] for w in wanted], rtol=0, atol=1e-11)


def test_model_is_asked_in_batches_of_bounded_bytes(spark):
    def make():
        return lambda prompts: [json.dumps({"core_pain_point": str(sum(map(len, prompts)))}) for _ in prompts]

    session = spark.newSession()
    text = F.repeat(F.col("id").cast("string"), 100_000).alias("content")
    others = [F.lit("").alias(n) for n in ("platform", "channel", "content_kind", "title", "author", "url")]
    posts = session.range(100, 200, 1, 1).select(text, *others)
    held = {int(r[0]) for r in analyze.score_with_model(posts, make, "m").select("core_pain_point").collect()}
    assert 300_000 <= max(held) < 8 << 20


def test_hash_vectors_are_counted_in_slices(spark, monkeypatch):
    session = spark.newSession()
    texts = [("one two two",), ("",), (None,), ("drei vier",), ("one",)]
    df = session.createDataFrame(texts, "t string").coalesce(1)
    whole = [list(r["embedding"]) for r in embed.hash_embed(df, "t", 32).collect()]
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == BATCH_BYTES
    monkeypatch.setattr(embed, "CELLS", 64)
    assert [list(r["embedding"]) for r in embed.hash_embed(df, "t", 32).collect()] == whole
    vectors = embed.hash_vectors(32).func(pa.array([["one", "two"], [], ["drei", "vier"], [], ["one"]]))
    assert len(vectors) == 5 and len(embed.hash_vectors(32).func(pa.array([], pa.list_(pa.string())))) == 0


def test_embedding_model(spark):
    def make():
        def vectors(texts, mode, titles):
            assert mode == "document" and all(t == "T" for t in titles)
            return [[3.0, 4.0] if t != "none" else None for t in texts]

        return vectors

    df = spark.createDataFrame([("a",), (" <b> </b>",), ("none",)], "t string").withColumn("title", F.lit("<i>T</i>"))
    got = {r["t"]: r["embedding"] for r in embed.embed_with_model(df, "t", make, "m", title="title").collect()}
    assert [round(x, 5) for x in got["a"]] == [0.6, 0.8]
    assert got[" <b> </b>"] is None and got["none"] is None


def test_models_are_not_mixed(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [0.9, 0.1], "a"), (4, [0.5, 0.5], None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, embedding_model string").withColumn(
        "title", F.lit(None).cast("string"))
    assert [r["id"] for r in similarity.similar_insights(df, 1, 9).collect()] == [3]
    got = similarity.semantic_search(df, [1.0, 0.0], 9, model="b").collect()
    assert [r["id"] for r in got] == [2] and got[0]["title"] == "" and "embedding" not in got[0].asDict()
    bulk = similarity.similar_insights_bulk(df, [1, 2], 9).collect()
    assert [(r["target_id"], r["id"]) for r in bulk] == [(1, 3)]


def test_hashes_of_long_tokens():
    import time

    import pyarrow as pa

    def plain(token):
        value = 0xCBF29CE484222325
        for byte in token.encode():
            value = ((value ^ byte) * 0x100000001B3) % 2**64
        return value

    tokens = [f"token{i}" for i in range(20_000)] + ["x" * 50_000, "", "é" * 300, "ab"]
    start = time.perf_counter()
    hashes = embed.token_hashes(pa.array(tokens))
    assert time.perf_counter() - start < 1
    for i in (*range(0, 20_000, 999), *range(20_000, 20_004)):
        assert int(hashes[i]) == plain(tokens[i])


def test_one_bad_row_costs_few_calls():
    calls = []

    def scorer(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise RuntimeError("no")
        return ["ok"] * len(prompts)

    answers = analyze._ask_halved(scorer, ["good"] * 100 + ["bad"] + ["good"] * 155)
    assert [a for a, _ in answers].count("ok") == 255 and answers[100] == (None, "RuntimeError: no")
    assert len(calls) <= 17
