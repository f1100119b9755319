from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from feedlode.llm import fill_middle as f
from feedlode.llm.words import text_bytes
from tests.compare import compare, connect
from tests.llm.cases import LONG, SMALL, TEXTS, no_docs, odd_docs, small_rows

ODD = [*TEXTS, "<P>", "a<S>b", "<M", "x < P > y", "é<", "<P<S", "ééé abc", "😀" * 9, "a", "Ab cD\r\n日本語 x́"]


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), out


def test_query_against_plain_cuts(spark):
    texts = {r[0]: r[1] for r in small_rows("documents")}
    rows = f.op11_fill_middle(spark, SMALL).collect()
    assert len(rows) == len(texts)
    forms = set()
    for r in rows:
        n, form, p, m, out = plain(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}


def test_query_against_sql(spark):
    assert compare(f.op11_fill_middle(spark, SMALL), f.OP11_SQL, connect(SMALL)) == []


def test_odd_texts_under_many_ids(spark):
    rows = [(i, t) for i in [None, *range(60)] for t in ODD if t != LONG or i in (None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = f.fill_in_middle(docs)
    got = made.select("doc_id", "text", *f.RESULTS, f.restore(made["output"], made["form"]).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in f.RESULTS) == plain(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("place", "FORM").withColumnRenamed("lines", "draw_one")
    rows = f.fill_in_middle(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    assert set(rows[0].asDict()) == {*docs.columns, *f.RESULTS} - {"FORM"}
    assert {r["draw_one"] for r in rows} == set(r["draw_one"] for r in docs.collect())
    assert f.fill_in_middle(no_docs(spark)).collect() == []
    with pytest.raises(ValueError):
        f.fill_in_middle(docs.withColumnRenamed("text", "output"), text="output")


def test_exceptions_only_where_characters_have_several_bytes():
    for text in ["", "ascii only", "é", "aéb😀c日́", "éé" * 50 + "x" * 100 + "😀"]:
        raw, _ = text_bytes(pa.array([text], pa.string()))
        index = f.ExceptionIndex(raw)
        assert len(index.byte_at) == sum(len(c.encode()) > 1 for c in text)
        places = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
        points = np.arange(len(text) + 1)
        assert (index.points(places) == points).all() and (index.bytes(points) == places).all()
