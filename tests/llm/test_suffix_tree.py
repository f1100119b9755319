from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from feedlode.llm import suffix_tree as s
from tests.llm.cases import MIDDLE, SMALL, TEXTS, blank_words, lowered, no_docs, odd_docs, small_rows


def base(rows: list[tuple], held) -> list[tuple]:
    tokens = [[*blank_words(lowered(text)), None] for _, text in rows]
    counts = Counter(t for (key, _), own in zip(rows, tokens, strict=True) if not held(key) for t in own)
    n, v = sum(counts.values()), len(counts)
    return [(key, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own))
            for (key, _), own in zip(rows, tokens, strict=True)]


def check(got, rows, held) -> None:
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    expected = sorted(base(rows, held), key=order)
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=order)
    assert [f[:4] for f in found] == [e[:4] for e in expected]
    assert [f[4] for f in found] == pytest.approx([e[4] for e in expected], rel=1e-9)


@pytest.mark.parametrize("blocks", [True, False])
def test_query_against_plain_counts(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(s, "BLOCK_BYTES", 50_000)
        monkeypatch.setattr(s, "STRETCH_WORDS", 20_000)
    held = lambda key: zlib.crc32(str(key).encode()) % 7 == 2
    sf_dir = MIDDLE if blocks else SMALL
    rows = [r[:2] for r in small_rows("documents", sf_dir)]
    got = s.op4_lm_score(spark, sf_dir).collect()
    check(got, rows, held)
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and r["score"] < 0
    if blocks:
        # On texts that it has not seen the tree is nearer than single words.
        held_rows = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held_rows) > sum(r["base_score"] for r in held_rows)


def plain_tree(rows: list[tuple], held, share: float, least: float) -> list[float]:
    """The same tree with dictionaries, word by word."""
    texts = [[None, *blank_words(lowered(text)), None] for _, text in rows]
    training = [t for (key, _), t in zip(rows, texts, strict=True) if not held(key)]
    n_all = sum(len(t) - 1 for t in training)
    after = defaultdict(Counter)
    for t in training:
        for i in range(1, len(t)):
            for length in range(3):
                if i >= length:
                    after[tuple(t[i - length:i])][t[i]] += 1
    after = {c: n for c, n in after.items() if not c or sum(n.values()) >= max(1.0, share * n_all)}
    size = {c: sum(n.values()) for c, n in after.items()}
    even = n_all + len(after[()]) + 1

    def chance(word, context, without=0):
        if not context:
            return (after[()][word] + 1) / even
        types = len(after[context])
        return (after[context][word] - without + types * chance(word, context[1:])) / (size[context] - without + types)

    gain = {c: sum(n * math.log(chance(w, c, 1) / chance(w, c[1:])) for w, n in after[c].items()) for c in after if c}
    kept = {c[i:] for c, g in gain.items() if g >= least for i in range(len(c) + 1)} | {()}
    out = []
    for t in texts:
        total = 0.0
        for i in range(1, len(t)):
            # The longest candidate, then its longest retained end.
            context = next(c for c in (tuple(t[max(0, i - k):i]) for k in (2, 1, 0)) if c in after)
            while context not in kept:
                context = context[1:]
            total += math.log10(chance(t[i], context))
        out.append(total)
    return out, kept


@pytest.mark.parametrize("share, least", [(1e-3, 10.0), (5e-3, 0.0), (1e-2, -1e9)])
def test_scores_against_a_plain_tree(spark, monkeypatch, share, least):
    monkeypatch.setattr(s, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(s, "STRETCH_WORDS", 30_000)
    real = s.candidates, s.retain
    monkeypatch.setattr(s, "candidates", lambda docs: real[0](docs, share))
    monkeypatch.setattr(s, "retain", lambda gathered, shorter: real[1](gathered, shorter, least))
    rows = [r[:2] for r in small_rows("documents", MIDDLE)][:250]
    held = lambda key: zlib.crc32(str(key).encode()) % 7 == 2
    docs = spark.createDataFrame([(k, t, held(k)) for k, t in rows], "doc_id long, text string, held_out boolean")
    expected, kept = plain_tree(rows, held, share, least)
    got = {r["doc_id"]: r["score"] for r in s.score(docs.repartition(3)).collect()}
    assert [got[k] for k, _ in rows] == pytest.approx(expected, rel=1e-9)
    assert any(len(c) == 1 for c in kept) and any(len(c) == 2 for c in kept) == (share < 5e-3)


def test_contexts_that_tell_nothing_are_left_out(spark):
    # After "x" comes mostly "a", after "y" anything.
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(300):
        words = []
        for _ in range(20):
            words.append(str(rng.choice(["x", "y"])))
            words.append("a" if words[-1] == "x" and rng.random() < 0.9 else str(rng.choice(["a", "b", "c", "d"])))
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    contexts, _ = s.candidates(docs, 0.01)
    tree = s.retain(s.cut_lineage(s._gather(s._requests(docs, contexts, 2), contexts.shorter)), contexts.shorter)
    words = s.Words.between(s.WHITE).read(pa.array(["x a"]))[0]
    assert all(tree.retained[s._look_up(contexts.singles, contexts.single_numbers, words)])
    pair = s.chained(words[1:], words[:1])
    # "a x" foretells no more than "x".
    assert s._look_up(contexts.pairs, contexts.pair_numbers, pair)[0] > 0
    assert not tree.retained[s._look_up(contexts.pairs, contexts.pair_numbers, pair)][0]


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    docs = odd_docs(spark).withColumn("held_out", F.col("doc_id") % 3 == 0)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = s.score(docs).collect()
    assert len(got) == len(TEXTS) + 2
    check(got, rows, lambda key: key is not None and key % 3 == 0)
    assert s.score(docs.where("false")).collect() == []
    nothing = s.score(no_docs(spark).withColumn("held_out", F.lit(True)).unionAll(docs.withColumn("held_out", F.lit(True))))
    assert {r["train_tokens"] for r in nothing.collect()} == {0}


def test_a_frequent_word_sends_its_contexts_not_its_places(spark):
    texts = ["so so so so so so so so so so " * 100 for _ in range(40)]
    docs = spark.createDataFrame([(i, t, i == 3) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    contexts, n_all = s.candidates(docs.where("NOT held_out").repartition(1))
    assert n_all == 39 * 1001
    sent = s._requests(docs.repartition(1), contexts, 4).where("stretch >= 0").select("contexts").collect()
    # The word after nothing, after itself and after two of itself, and the end.
    assert sum(len(s._unpacked(pa.scalar(bytes(r["contexts"])), np.int32)) for r in sent) <= 4


def test_pairs_that_are_added_up_on_the_way(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(s, "STRETCH_WORDS", 20_000)
    held = lambda key: zlib.crc32(str(key).encode()) % 7 == 2
    rows = [r[:2] for r in small_rows("documents", MIDDLE)][:250]
    docs = spark.createDataFrame([(k, t, held(k)) for k, t in rows], "doc_id long, text string, held_out boolean").repartition(3)
    docs = s.cut_lineage(docs)
    at_once = {r["doc_id"]: r for r in s.score(docs).collect()}
    monkeypatch.setattr(s, "MERGE_PAIRS", 50)
    got = s.score(docs).collect()
    check(got, rows, held)
    assert [r["score"] for r in got] == pytest.approx([at_once[r["doc_id"]]["score"] for r in got], rel=1e-9)
