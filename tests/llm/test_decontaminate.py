from __future__ import annotations

import pytest

from feedlode.llm import decontaminate as d
from tests.compare import compare, connect
from tests.llm.cases import MIDDLE, SMALL, TEXTS, no_docs, odd_docs, words_of


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_against_sql(spark, sf_dir):
    assert compare(d.op3_decontamination(spark, sf_dir), d.OP3_SQL, connect(sf_dir)) == []


def brute(text, items, size):
    words = words_of(text)
    hit, found = set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        windows = [own[i:i + size] for i in range(len(own) - size + 1)] or ([own] if own else [])
        for window in windows:
            for i in range(len(words) - len(window) + 1):
                if words[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [
    (1, "alpha beta gamma delta"), (2, "beta"), (3, None), (4, ""), (5, "the the the"), (6, "Alpha, BETA gamma!"),
    (7, "one two three four"), (10, "text here same"), (11, "wort3 é3 wort4"), (12, "never seen words"), (None, "mit"),
]


def test_odd_rows_against_plain_search(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    extra = [(100, "x alpha beta gamma delta beta gamma y"), (101, "the the the the, the"), (100, "alpha beta"),
             (102, "alpha beta gamma alpha beta gamma delta")]
    docs = odd_docs(spark).unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    listed = [i for i in ITEMS if i[0] is not None]
    named = items.where("item_id IS NOT NULL")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], tuple(r["item_ids"]))
                 for r in d.find(docs, named, size=3).collect())
    expected = []
    for row in docs.select("doc_id", "text").collect():
        n, hit, found = brute(row["text"], listed, 3)
        expected.append((row["doc_id"] or -1, n, hit, len(found), tuple(found)))
    assert got == sorted(expected)
    assert sum(hit > 0 for _, _, hit, _, _ in got) > 5


def test_rows_without_passages_stay(spark):
    items = spark.createDataFrame(ITEMS[:8], "item_id long, text string")
    kept = d.drop_contaminated(odd_docs(spark), items, size=3)
    assert kept.columns == odd_docs(spark).columns
    expected = sorted(repr(t) for t in [*TEXTS, TEXTS[6], TEXTS[12]] if not brute(t, ITEMS[:8], 3)[1])
    assert sorted(repr(r["text"]) for r in kept.collect()) == expected


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.find(no_docs(spark), items).collect() == []
    rows = d.find(odd_docs(spark), items.where("false")).collect()
    assert len(rows) == len(TEXTS) + 2 and not any(r["n_hit"] for r in rows)


def test_places_near_each_other(spark):
    docs = spark.createDataFrame([(1, "rare x x scarce x x"), (2, "rare scarce"), (3, "scarce then rare")],
                                 "doc_id long, text string").select("text", "doc_id", *d.row_key("doc_id", "text"))
    items = spark.createDataFrame([(1, "rare x scarce")], "item_id long, text string")
    index = d.build_index(docs, items, size=3)
    names = {r["key_a"]: r["doc_id"] for r in docs.collect()}
    near = {(names[r["key_a"]], r["gap"]) for r in d.near_places(index, 1).collect()}
    assert near == {(1, 1), (2, 1)}
    assert {r["key_a"] for r in d.near_places(index, 0).collect()} == set()


def test_no_python_in_the_plan(spark):
    plan = d.op3_decontamination(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
