from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from feedlode.llm import near_join as n
from feedlode.llm.graph import components
from tests.compare import compare, connect
from tests.llm.cases import MIDDLE, SMALL, TEXTS, no_docs, odd_docs, small_rows, words_of


def shingles(text) -> frozenset:
    words = words_of(text)
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute(rows: list[tuple]) -> dict[int, tuple]:
    """Row number: (smallest key that hangs together with it, number of links)."""
    sets = [shingles(text) for _, text in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    links = defaultdict(set)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                common[j] += 1
        for j, c in common.items():
            if j != i and 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                links[i].add(j)
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        keys = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = (min(keys, default=None), len(links[j]))
    return out


def check(got, rows) -> None:
    expected = brute(rows)
    assert sorted(map(repr, ((r["doc_id"], r["class_id"], r["n_links"]) for r in got))) == \
        sorted(repr((rows[i][0], *found)) for i, found in expected.items())


def test_query_against_brute_force(spark):
    for sf_dir in (SMALL, MIDDLE):
        rows = [r[:2] for r in small_rows("documents", sf_dir)]
        check(n.op8_near_duplicates(spark, sf_dir).collect(), rows)


def test_query_against_sql(spark):
    assert compare(n.op8_near_duplicates(spark, MIDDLE), n.OP8_SQL, connect(MIDDLE)) == []


def near_copies(k: int, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    text = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(k):
        words = list(text)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 16)
    monkeypatch.setattr(n, "COLUMNS", 64)
    rows = near_copies(120) + [(1000 + i, text) for i, text in near_copies(7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(n.join_similar(docs).collect(), rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(n.join_similar(docs).collect(), rows)
    assert n.join_similar(no_docs(spark)).collect() == []
    kept = n.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count(TEXTS[12]) == 1 and texts.count(TEXTS[6]) == 1
    assert len(texts) == len(TEXTS) - 1 and None in texts and "" in texts
    assert n.keep_one(no_docs(spark)).collect() == []


def test_one_of_each_group_stays(spark):
    rows = near_copies(20) + [(None, near_copies(1)[0][1]), (500, "alone here with some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {found[0] for found in brute(rows).values()}
    assert {r["doc_id"] for r in n.keep_one(docs).collect()} == expected


def test_prefixes_are_shortened_to_the_recall():
    length = n.prefix_length(n.SIMILARITY)
    assert 1 - (1 - n.SIMILARITY**length) ** n.TREES >= n.RECALL
    assert 1 - (1 - n.SIMILARITY**(length + 1)) ** n.TREES < n.RECALL
    assert n.prefix_length(1.0) == n.LABEL and n.prefix_length(0.01) == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)]
    frame = spark.createDataFrame(edges, "u long, v long")
    parent = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                changed = True
    assert {r["node"]: r["root"] for r in components(frame).collect()} == parent
    assert components(frame.where("false")).collect() == []


def test_links_of_sets():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [1, 2, 3], [9])]
    assert n.linked(sets, None, 0.8).tolist() == [
        [False, True, False, False], [True, False, False, False], [False] * 4, [False] * 4]
    assert n.linked(sets[:1], sets[1:], 0.75).tolist() == [[True, False, False]]
