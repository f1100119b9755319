from __future__ import annotations

import corpus_pipeline as p
from feedlode.llm import catalog
from tests.llm.cases import MIDDLE, SMALL, TEXTS, small_rows, words_of
from tests.llm.test_near_join import shingles


def test_registered():
    assert [f"op{n}" for n in range(1, 14)] == [name.split("_")[0] for name in catalog.QUERIES if name != "pipeline"]
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert catalog.QUERIES["pipeline"] is p.run
    assert len(p.STAGES) == 5


def test_every_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for _, stage in p.STAGES[:-1]:
        docs = p.cut_lineage(stage(spark, docs, MIDDLE))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > sizes[4] > sizes[0] / 2
    rows = docs.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    # No two are near copies of each other, and none holds a passage of the benchmark.
    where = {}
    for r in rows:
        own = shingles(r["text"])
        for other in {where[g] for g in own if g in where}:
            theirs = shingles(other)
            assert len(own & theirs) < 0.8 * len(own | theirs)
        where.update(dict.fromkeys(own, r["text"]))
    windows = set()
    for _, text in small_rows("benchmark", MIDDLE):
        words = words_of(text)
        windows |= {tuple(words[i:i + 10]) for i in range(len(words) - 9)}
    for r in rows:
        words = words_of(r["text"])
        assert not windows & {tuple(words[i:i + 10]) for i in range(len(words) - 9)}


def test_copies_go_with_their_passages(spark):
    import random

    from tests.llm.test_line_dedup import sentences

    rng = random.Random(9)
    whole = " ".join(sentences(rng, 30))
    passage = " ".join(sentences(rng, 8))
    rows = [(1, whole), (2, whole), (3, passage + " " + " ".join(sentences(rng, 12))),
            (4, " ".join(sentences(rng, 12)) + " " + passage), (5, None), (6, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in p.drop_repeated_lines(spark, docs, SMALL).collect()}
    assert set(got) == {1, 3, 4, 5, 6}
    assert got[1]["text"] == whole and got[3]["text"] == rows[2][1] and got[5]["text"] is None
    assert len(got[4]["text"]) == got[4]["n_chars"] < len(rows[3][1])


def test_what_stands_nowhere_else_stays(spark):
    import random

    from tests.llm.test_line_dedup import sentences

    rng = random.Random(4)
    shared, own = sentences(rng, 60), sentences(rng, 3)
    rows = [(1, " ".join(shared[:30])), (2, " ".join(shared[30:])), (3, " ".join(shared + own)),
            (4, " ".join(shared[:20] + own[:1] + shared[20:])), (5, " ".join(shared))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in p.drop_repeated_lines(spark, docs, SMALL).collect()}
    # The line of 4 is shorter than a passage, all of 5 stands before.
    assert {k: r["text"].strip() for k, r in got.items()} == {
        1: rows[0][1], 2: rows[1][1], 3: " ".join(own), 4: own[0]}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_run(spark):
    rows = p.run(spark, SMALL).collect()
    before = {r[0]: r for r in small_rows("documents")}
    assert 0 < len(rows) <= len(before)
    for r in rows:
        assert r["n_tokens"] == len(r["ids"])
        assert r["decoded"] is not None and (r["n_chars"] == len(r["decoded"]) or "▁" in r["decoded"])
        assert r["source"] == before[r["doc_id"]][3]


def odd_documents(spark):
    """Documents with nulls, repeats and columns that stages might use themselves."""
    kinds = ("doc_id long, text string, lang string, source string, n_chars long, Score string, evidence int, "
             "n_removed string, lines int, key_a string, word int, likely boolean, bits long")
    extra = ("mine", 7, "kept", 3, "k", 5, True, 9)
    rows = [(i if i != 4 else None, t, "en", None, None, *extra) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6], rows[1]], kinds)


def test_stages_leave_other_columns_as_they_are(spark):
    docs = odd_documents(spark)
    for name, stage in p.STAGES[:-1]:
        rows = stage(spark, docs, SMALL)
        assert rows.columns == docs.columns, name
        rows = rows.collect()
        assert rows and all((r["Score"], r["evidence"], r["n_removed"], r["lines"], r["key_a"], r["word"], r["likely"], r["bits"])
                            == ("mine", 7, "kept", 3, "k", 5, True, 9) for r in rows), name
        # Null and empty texts stay, in every row.
        assert sum(not r["text"] for r in rows) == 3, name
    assert p.encode(spark, docs, SMALL).count() == docs.count()
    without = docs.drop("n_chars")
    assert p.drop_repeated_lines(spark, without, SMALL).columns == without.columns


def test_stages_on_an_empty_table(spark):
    docs = odd_documents(spark).where("false")
    for _, stage in p.STAGES:
        assert stage(spark, docs, SMALL).collect() == []
