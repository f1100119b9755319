from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from feedlode.llm import suffix_dedup as d
from tests.llm.cases import LONG, MIDDLE, SMALL, TEXTS, no_docs, odd_docs, small_rows


def plain(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Spans by counting all strings."""
    counts = Counter(hash(t[i:i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if counts[hash(t[i:i + length])] > 1:
                gone[i + 1:i + 1 + length] = True
        change = np.flatnonzero(gone[1:] != gone[:-1])
        out.append([(int(a), int(b)) for a, b in zip(change[::2], change[1::2], strict=True)])
    return out


def without(text: bytes, spans) -> bytes:
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return text


@pytest.mark.parametrize("sf_dir, most", [(SMALL, None), (MIDDLE, None), (MIDDLE, 2)])
def test_query_against_all_strings(spark, monkeypatch, sf_dir, most):
    if most:
        monkeypatch.setattr(d, "MOST_ROWS", most)
    rows = small_rows("documents", sf_dir)
    texts = [(r[1] or "").encode() for r in rows]
    want = {r[0]: (t, spans) for r, t, spans in zip(rows, texts, plain(texts, d.LENGTH), strict=True)}
    got = d.op13_suffix_dedup(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        text, spans = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(text), sum(b - a for a, b in spans), len(spans))
        assert r["kept_sha256"] == hashlib.sha256(without(text, spans)).hexdigest()
    assert any(0 < r["n_removed"] < r["n_bytes"] for r in got)


@pytest.mark.parametrize("most", [1, 2, 5, 2_000])
@pytest.mark.parametrize("letters", ["a", "ab", "abcdéfgh"])
def test_short_strings_at_all_group_sizes(spark, monkeypatch, most, letters):
    monkeypatch.setattr(d, "LENGTH", 12)
    monkeypatch.setattr(d, "GRAM", 4)
    monkeypatch.setattr(d, "STRETCH", 64)
    monkeypatch.setattr(d, "MOST_ROWS", most)
    rng = random.Random(f"{most}{letters}")
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 8))) for _ in range(80)]
    texts += [None, "", texts[3], texts[3], "é" * 40, "x" * 11, "y" * 13, "z" * 200]
    docs = spark.createDataFrame([(i % 85, t) for i, t in enumerate(texts)], "doc_id long, text string")
    order = {(i % 85, t): spans for i, (t, spans) in
             enumerate(zip(texts, plain([(t or "").encode() for t in texts], 12), strict=True))}
    got = d.drop_repeats(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = order[r["doc_id"], r["text"]]
        assert [tuple(s) for s in r["spans"]] == spans
        assert bytes(r["kept"]) == without((r["text"] or "").encode(), spans)


def test_equal_hashes_are_compared_byte_by_byte(spark, monkeypatch):
    # All strings have equal hashes: only equal bytes may go.
    monkeypatch.setattr(d, "LENGTH", 12)
    monkeypatch.setattr(d, "GRAM", 4)
    monkeypatch.setattr(d.PrefixHashes, "equal", lambda self, a, b, size: np.ones(len(a), bool))
    rng = random.Random(1)
    texts = [f"{rng.random()}the same words{rng.random()}" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain([t.encode() for t in texts], 12)
    for r in d.drop_repeats(docs).collect():
        assert [tuple(s) for s in r["spans"]] == want[r["doc_id"]]


def test_sorted_like_the_bytes():
    rng = random.Random(3)
    raw = np.frombuffer("".join(rng.choice("ab") for _ in range(5000)).encode(), np.uint8)
    places = np.array(rng.sample(range(5000 - d.LENGTH), 700))
    group = np.sort(np.array([rng.randrange(9) for _ in places]))
    order = d.sorted_order(d.PrefixHashes(raw), places, group)
    data = raw.tobytes()
    keys = [(group[i], data[places[i]:places[i] + d.LENGTH]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(700))


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("place", "SPANS").withColumnRenamed("lines", "runs")
    rows = d.drop_repeats(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    assert set(rows[0].asDict()) == {*docs.columns, "kept", "spans"} - {"SPANS"}
    for r in rows:
        text = (r["text"] or "").encode()
        if r["text"] == TEXTS[12]:
            assert bytes(r["kept"]) == b"" and [tuple(s) for s in r["spans"]] == [(0, len(text))]
        elif r["text"] != LONG:
            assert bytes(r["kept"]) == text and r["spans"] == []
    assert d.drop_repeats(no_docs(spark)).collect() == []


def test_a_text_of_one_letter_stays_small(spark):
    docs = spark.createDataFrame([(1, "a" * 300_000), (2, "b" * 200)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in d.drop_repeats(docs).collect()}
    assert bytes(got[1]["kept"]) == b"" and len(got[1]["spans"]) == 1 and len(got[2]["kept"]) == 200
    narrow = docs.select(*d.row_key("doc_id", "text"), "text")
    own = d.segments(narrow.join(d.suspects(narrow), ["key_a", "key_b"]).select("key_a", "key_b", "text", "suspects"))
    assert own.count() < 20
