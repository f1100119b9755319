"""Golden rows for text, ids, times, clusters and scoring."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlode.functions import fixed_values as fixed
from feedlode.functions.ids import post_id
from feedlode.functions.limits import clamp_hours, clamp_limit
from feedlode.functions.rounding import mean_one_decimal
from feedlode.functions.text import clean, first_sentence
from feedlode.functions.timeparse import parse_time
from feedlode.operators.analyze import analyze_heuristic, build_prompts, parse_model_output
from feedlode.operators.cluster import assign_clusters
from feedlode.operators.embed import hash_embed, signed_buckets, token_hashes
from feedlode.operators.rows import match_keywords, parse_times, since


def one_column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


def test_clean(spark):
    values = ["<b>a</b>\n\t b", "  x ", "　y　", "a\x0bb", "a < b > c", "<>", "a \x85", ""]
    expected = ["a b", "x", "y", "a\x0bb", "a c", "<>", "a", ""]
    assert one_column(spark, values, clean) == expected


def test_first_sentence(spark):
    values = ["A b. C", ".x y!", "x" * 200, "好累。真的", "手" * 60, "ok", ""]
    expected = ["A b.", ".x y!", "x" * 140 + "...", "好累。", "手" * 46 + "...", "ok", ""]
    assert one_column(spark, values, first_sentence) == expected


def test_times(spark):
    cases = {
        "2024-01-02T03:04:05Z": datetime(2024, 1, 2, 3, 4, 5),
        "2024-01-02T03:04:05.123456789+08:00": datetime(2024, 1, 1, 19, 4, 5, 123456),
        "Tue, 02 Jan 2024 03:04:05 -0700": datetime(2024, 1, 2, 10, 4, 5),
        "Tue, 02 Jan 2024 03:04:05 EST": datetime(2024, 1, 2, 3, 4, 5),
        "Tue, 02 Jan 2024 03:04:05 GMT+3": datetime(2024, 1, 2, 0, 4, 5),
        "02 Jan 70 03:04 UTC": datetime(1970, 1, 2, 3, 4),
        "02 Dec 68 03:04 -0700": datetime(2068, 12, 2, 10, 4),
        "2024-01-02 03:04:05": datetime(2024, 1, 2, 3, 4, 5),
        " 2024-01-02 ": datetime(2024, 1, 2),
        "2024-02-30": None, "02 Foo 24 03:04 UTC": None, "": None, "soon": None, None: None,
    }
    assert one_column(spark, list(cases), lambda c: parse_time(c).cast("timestamp_ntz")) == list(cases.values())
    df = spark.createDataFrame([("",)], "t string")
    read = parse_times(df, "t", datetime(2024, 1, 31)).select(F.col("t").cast("timestamp_ntz"))
    assert read.first()[0] == datetime(2024, 1, 31)


def test_post_id(spark):
    df = spark.createDataFrame(
        [(" ", "Reddit", "r/Excel", "https://e.x/1", "Title"), (None,) * 5, (" 7 ", "a", "b", "c", "d")],
        "i string, p string, c string, u string, t string",
    )
    got = [r[0] for r in df.select(post_id(*[F.col(c) for c in "ipcut"])).collect()]
    assert got == [
        "660343f74dfca2e8c3c43dd5f834b5118d95807a", "2b1adebaf9888dfa23224fca9497ca84a44b1f22", "7",
    ]


CLUSTERS = [
    ("Manual spreadsheet work is too slow", ["manual", "spreadsheet"], "manual::slow::spreadsheet::work", None),
    ("help, me export data", [], "data::export::help", None),
    ("help me export data", [], "data::export", None),
    ("data data data data data export", [], "data", None),
    ("手動整理報表好累", ["手動", "好累"], "手動::整理::報表::好累::手動整理報表好累", None),
    ("求救 Excel 手動", [], "ex::ce::l手::動::excel", None),
    ("ok go", [], "okgo", None),
    ("", ["copy paste", "Too Slow!"], "copy paste::too slow", "copy paste / too slow"),
    ("!!", ["!!", "??"], " ", "!!"),
    ("", [], "uncategorized", "uncategorized"),
    ("", None, "uncategorized", "uncategorized"),
    ("<b>Export</b> to  PDF", [], "export::pdf", "Export to PDF"),
    ("x" * 130, [], "x" * 120, "x" * 120 + "..."),
]


def test_clusters(spark):
    df = spark.createDataFrame(
        [(i, p, k) for i, (p, k, _, _) in enumerate(CLUSTERS)],
        "i int, core_pain_point string, matched_keywords array<string>",
    )
    rows = assign_clusters(df).orderBy("i").collect()
    for row, (pain, _, key, label) in zip(rows, CLUSTERS):
        assert (row["cluster_key"], row["cluster_label"]) == (key, label or pain)


def test_keywords_keep_order_and_spelling(spark):
    df = spark.createDataFrame([("a", "MANUAL slow", "er"), ("b", "x", "y")], "i string, title string, content string")
    found = match_keywords(df, ["slow", " Manual", "slow", "slow er", ""]).collect()
    assert [(r["i"], r["matched_keywords"]) for r in found] == [("a", ["slow", "Manual", "slow er"])]
    assert match_keywords(df, []).count() == 2
    assert match_keywords(df, [" "]).count() == 0


def test_heuristic(spark):
    posts = [
        ("Manual Excel export is slow", "", 9, "Manual Excel export is slow", False),
        ("door sensor manual", "", 7, "door sensor manual", False),
        ("nothing special", "", 5, "nothing special", False),
        ("SCAM alert", "", 5, "SCAM alert", True),
        ("<i></i>", "First one. Second", 5, "First one.", False),
        ("", "", 5, fixed.PAIN_POINT_DEFAULT, False),
    ]
    df = spark.createDataFrame([(i, t, c) for i, (t, c, *_) in enumerate(posts)], "i int, title string, content string")
    for row, (_, _, score, pain, explicit) in zip(analyze_heuristic(df).orderBy("i").collect(), posts):
        assert (row["commercial_potential"], row["core_pain_point"], row["is_explicit_content"]) == (score, pain, explicit)
    assert analyze_heuristic(df).filter("i = 1").first()["saas_feasibility"] == fixed.FEASIBILITY_MEDIUM
    assert "PythonUDF" not in analyze_heuristic(df)._jdf.queryExecution().toString()


MODEL_CASES = [
    ('```json\n{"commercial_potential":15}\n```', 10), ("{}", 1), ("null", 1),
    ('{"Commercial_Potential":7}', 7), ('{"commercial_potential":null}', 1),
    ('{"commercial_potential":7.0}', None), ('{"commercial_potential":"7"}', None),
    ('{"a":1} x', None), ('{"a":1} {"b":2}', None), ('{"a":1},{"b":2}', None), ("nope", None), ("", None),
    ("[1]", None), ('{"a":1', None), ('{"core_pain_point": 5}', None), ('{"a":1}]} {x}', None),
]


def test_model_output(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(MODEL_CASES)], "i int, raw string")
    rows = parse_model_output(df, "raw").orderBy("i").collect()
    got = [(raw, row["commercial_potential"]) for row, (raw, _) in zip(rows, MODEL_CASES)]
    assert got == MODEL_CASES
    assert rows[1]["core_pain_point"] == fixed.MODEL_PAIN_POINT
    assert [r["status"] for r in rows] == ["ok" if s else "rejected" for _, s in MODEL_CASES]


def test_prompt_holds_all_fields(spark):
    df = spark.createDataFrame(
        [("P", "C", "K", "T %s", None, "U", "X")],
        "platform string, channel string, content_kind string, title string, author string, url string, content string",
    )
    prompt = build_prompts(df).first()["prompt"]
    assert "platform: P\nchannel: C\ncontent_kind: K\ntitle: T %s\nauthor: \nurl: U\n" in prompt
    assert prompt.endswith("\nX")


def test_token_hash():
    hashes = token_hashes(pa.array(["a", "foobar", "手動", ""]))
    assert [f"{int(h):016x}" for h in hashes] == [
        "af63dc4c8601ec8c", "85944171f73967e8", "c22773af8426adb0", "cbf29ce484222325",
    ]
    buckets, signs = signed_buckets(pa.array(["manual", "spreadsheet", "手動"]), 256)
    assert (buckets.tolist(), signs.tolist()) == ([67, 217, 176], [1.0, -1.0, -1.0])


def test_hash_embed(spark):
    df = spark.createDataFrame([(0, "manual spreadsheet manual"), (1, "the"), (2, None)], "i int, t string")
    vectors = [r["embedding"] for r in hash_embed(df, "t").orderBy("i").collect()]
    assert {i: round(v, 4) for i, v in enumerate(vectors[0]) if v} == {67: 0.7071, 217: -0.7071}
    assert set(vectors[1]) == set(vectors[2]) == {0.0}
    assert len(hash_embed(df, "t", 8).first()["embedding"]) == 32


def test_mean_is_exact(spark):
    df = spark.createDataFrame([(49_999 * 6 + 950_001 * 5, 1_000_000), (0, 0), (101, 20)], "t bigint, n bigint")
    got = [r[0] for r in df.select(mean_one_decimal(F.col("t"), F.col("n"))).collect()]
    assert got == [5.0, 0.0, 5.1]


@pytest.mark.parametrize("value,limit", [(-1, 20), (0, 20), ("abc", 20), (500, 200), ("7", 7)])
def test_limits(value, limit):
    assert clamp_limit(value) == limit


def test_window(spark):
    assert clamp_hours(0) == 24
    df = spark.sql("SELECT explode(array(timestamp'2024-01-30 00:00:00Z', timestamp'2024-01-29 23:59:59Z')) AS t")
    assert since(df, "t", 24, datetime(2024, 1, 31)).count() == 1
