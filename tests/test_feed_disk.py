"""What the feed keeps on disk while it runs."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from feedlode.plans import catalog, tables
from feedlode.schema import RAW_SCHEMA
from feedlode.session import cut_lineage, few, files_of, let_go, packed, scratch, shuffles_let_go, work_path
from feedlode.streaming import details as details_module
from feedlode.streaming import flow
from feedlode.streaming.details import LatestDetails
from feedlode.streaming.store import InsightStore

START = datetime(2024, 1, 1)
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, ids):
    folder = work_path(spark, "test-documents")
    rows = [(i, f"A title {i}\nsome data of {i}" if n % 3 else f"nothing {i}", "en" if n % 2 else "de", f"src{n % 4}", 20)
            for n, i in enumerate(ids)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def exists(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_parts_hold_every_document_once(spark):
    ids = [None, None, -30, -1, 0, 24, 25, 26, 49, 50, 1000, 1000, *range(5000, 5200)]
    sf = documents(spark, ids)
    docs = tables.table(spark, sf, "documents")
    for size, most in ((1 << 40, 9), (1, 1), (1, 4), (1, 50)):
        parts = tables.feed_parts(spark, sf, size, most)
        held = [[r[0] for r in docs.where(part).select("doc_id").collect()] for part in parts]
        assert len(parts) <= most and sorted(map(str, sum(held, []))) == sorted(map(str, ids))
        assert (len(parts) == 1) == (most == 1 or size > 1)
        # A feed is in one part.
        feeds = [{None if i is None else i // tables.FEED_SIZE for i in part} for part in held]
        assert sum(map(len, feeds)) == len(set().union(*feeds))
    assert len(tables.feed_parts(spark, documents(spark, []), 1, 4)) == 1


def test_payloads_lie_there_a_part_at_a_time(spark, monkeypatch):
    sf = documents(spark, range(100))
    whole = tables.all_payloads(spark, sf).count()
    monkeypatch.setattr(catalog, "FEED_PART_BYTES", 1)
    monkeypatch.setattr(catalog, "FEED_PARTS", 2)
    real, there, folders = flow.run_feed, [], set()

    def watched(raw, store, *given, **named):
        landed = store.path.replace("/insights", "/landed")
        folders.add(landed)
        there.append(spark.read.schema(RAW_SCHEMA).parquet(landed).count())
        return real(raw, store, *given, **named)

    monkeypatch.setattr(flow, "run_feed", watched)
    rows = catalog.run_feed(spark, sf).collect()
    # Each part is there twice, once for each time that it is fetched; never all of them.
    assert len(there) == 4 and sum(there) == 2 * whole and max(there) < 0.8 * whole
    assert not exists(spark, folders.pop())
    # 66 documents with a keyword; of the atom and transcript feeds 20 of 25 items are read.
    found = sum(1 for n in range(100) if n % 3)
    limited = sum(1 for n in range(100) if n % 3 and n % 25 < 20)
    assert len(rows) == 2 * found + 2 * limited


def test_what_a_feed_leaves_is_packed(spark):
    folder = work_path(spark, "test-packed-feed")
    items = [{"data": {"id": str(i), "title": "data"}} for i in range(3)]
    text = json.dumps({"data": {"children": items}})
    spark.createDataFrame([("listing", "s", START, text)], RAW_SCHEMA).write.partitionBy("source").parquet(f"{folder}/landed")
    store = InsightStore(spark, f"{folder}/store", buckets=2)
    before = [spark.conf.get(k) for k in ("spark.sql.parquet.compression.codec", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")]
    for _ in range(2):
        flow.run_feed(
            flow.read_landed(spark, f"{folder}/landed"), store, flow.feed_ledger(spark, f"{folder}/ledger"),
            f"{folder}/checkpoint", None, {"listing": ["data"]},
        ).trigger(availableNow=True).start().awaitTermination()
    assert store.read().count() == 3
    assert all(name.endswith(".zstd.parquet") for name in files_of(spark.read.parquet(f"{folder}/store/changes")))
    after = [spark.conf.get(k) for k in ("spark.sql.parquet.compression.codec", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")]
    assert before == after


def test_settings_come_back_with_the_last_that_holds_them(spark):
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key)
    one, two = packed(spark, spark), packed(spark)
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(key) == "zstd"
    two.__exit__(None, None, None)
    assert spark.conf.get(key) == before
    with shuffles_let_go(spark), packed(spark):
        assert spark.range(100).repartition(3).groupBy("id").count().count() == 100
    assert spark.conf.get(key) == before


def test_a_cut_can_go_before_its_scratch(spark):
    with scratch(spark):
        cut = cut_lineage(spark.range(5))
        folder = files_of(cut)[0].rsplit("/", 1)[0]
        assert few(cut, 4) is cut and few(cut, 5).count() == 5 and exists(spark, folder)
        let_go(cut)
        assert not exists(spark, folder)


def payloads(spark, rows):
    return spark.createDataFrame(
        [("forum_detail", k, START + timedelta(hours=h), json.dumps({"content": text})) for k, h, text in rows], RAW_SCHEMA)


def test_details_are_not_written_beside_their_table(spark, monkeypatch):
    details = LatestDetails(spark, work_path(spark, "test-details-beside"), buckets=2)
    details.update(payloads(spark, [(str(i), 5, f"old {i}") for i in range(60)]), 0)
    written, real = [], details_module.cut_lineage

    def counted(frame, *given, **named):
        cut = real(frame, *given, **named)
        written.append(cut.count())
        return cut

    monkeypatch.setattr(details_module, "cut_lineage", counted)
    monkeypatch.setattr("feedlode.streaming.slots.cut_lineage", counted)
    got = details.update(payloads(spark, [("1", 9, "new"), ("2", 1, "late"), ("x", 1, "other")]), 1)
    assert sorted(map(tuple, got.collect())) == [("1", "new"), ("2", "old 2"), ("x", "other")]
    # Only what the batch is about: its posts, those with a newer detail, and what it gives.
    assert max(written) == 3
    kept = {r["post_id"]: r["detail"] for r in details.read().collect()}
    assert kept == {str(i): f"old {i}" for i in range(60)} | {"1": "new", "x": "other"}


ROW = "platform string, source_post_id string, id bigint, commercial_potential int, embedding array<float>, is_explicit_content boolean, created_at timestamp"


def shuffled(frame):
    """The parts of the plan below an exchange by key."""
    text, found = frame._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    for i, line in enumerate(text):
        if "Exchange hashpartitioning" in line:
            below = [line]
            for other in text[i + 1:]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            found.append("\n".join(below))
    return found


def test_readers_and_merges_do_not_shuffle_whole_rows(spark):
    store = InsightStore(spark, work_path(spark, "test-no-shuffle"), ROW, buckets=2)
    for batch, keys in enumerate(("ab", "bc", "b")):
        rows = [(None if k == "c" else "p", k, batch, batch, [1.0], False, START + timedelta(hours=batch)) for k in keys]
        store.merge(spark.createDataFrame(rows, ROW), batch_id=batch)
    wanted = spark.createDataFrame([("p", "b"), ("p", "zz")], "platform string, source_post_id string")
    with scratch(spark):
        for frame, scores in ((store.read(), {"a": 0, "b": 2, "c": 1}), (store.matching(wanted), {"b": 2})):
            assert all("embedding" not in part for part in shuffled(frame))
            assert {r["source_post_id"]: r["commercial_potential"] for r in frame.collect()} == scores
            assert frame.count() == len(scores)
    assert {r["source_post_id"]: r["id"] for r in store.read().collect()} == {"a": 0, "b": 0, "c": 1}


def test_the_log_is_worked_in_part_by_part(spark, monkeypatch):
    """Rows, days and buckets as if at once; nothing is written beside the base."""
    store = InsightStore(spark, work_path(spark, "test-compact-parts"), ROW, buckets=7, compact_every=2)
    row = lambda k, n: ("p", str(k), n, n, [1.0], False, START + timedelta(days=k % 3))
    for batch in range(4):
        rows = [row(k, batch) for k in range(10 * batch, 10 * batch + 30)]
        store.merge(spark.createDataFrame(rows, ROW), batch_id=batch)
    assert store._current()[:3] == (4, 4, 0)
    kept = {int(r["source_post_id"]): (r["id"], r["commercial_potential"]) for r in store.read().collect()}
    assert store.read().count() == 60
    assert kept == {k: (max(0, k // 10 - 2), min(3, k // 10)) for k in range(60)}
