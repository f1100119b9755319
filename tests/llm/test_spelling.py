from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from feedlode.llm import spelling as s
from tests.llm.cases import MIDDLE, SMALL, lowered, no_docs, odd_docs, small_rows


def plain_words(rows) -> dict[str, int]:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_near(words) -> dict[str, set[str]]:
    """By patterns with one letter left open, and by leaving one out."""
    open_, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            open_[w[:i] + "?" + w[i + 1:]].add(w)
            shorter = w[:i] + w[i + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in open_.values():
        for w in group:
            near[w] |= group - {w}
    return near


def expected(words) -> set[tuple]:
    near, form = plain_near(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_against_plain_search(spark, sf_dir):
    want = expected(plain_words([r[:2] for r in small_rows("documents", sf_dir)]))
    rows = s.op12_spelling_variants(spark, sf_dir)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] and r[2] != r[1] for r in got)


@pytest.mark.parametrize("common, most", [(0, None), (1, None), (3, 5), (1000, None)])
def test_any_dictionary_finds_all(spark, monkeypatch, common, most):
    # Few letters, so that nearly all words have near ones, at every place of the word.
    monkeypatch.setattr(s, "COMMON", common)
    if most:
        monkeypatch.setattr(s, "MOST_GRAMS", most)
    rng = random.Random(common)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 40) for _ in range(900)}
    words |= {w[:i] + w[i + 1:]: 9 for w in list(words)[::7] for i in range(len(w)) if len(w) > 5}
    words |= {"ä" * n: n for n in range(5, 40)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    if most:
        assert len(s.common_grams(frame)) <= most
    assert {tuple(r) for r in s.variant_groups(frame).collect()} == expected(words)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    words = s.word_counts(docs)
    assert {r["word"]: r["n"] for r in words.collect()} == plain_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert s.variant_groups(s.word_counts(no_docs(spark))).collect() == []


def test_long_chains(spark):
    links = [(f"w{i:04}", f"w{i + 1:04}") for i in range(100)]
    got = s.follow(spark.createDataFrame(links, "word string, form string")).collect()
    assert {r["word"]: r["root"] for r in got} == {w: "w0100" for w, _ in links}
