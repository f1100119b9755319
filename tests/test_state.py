"""De-duplication, upsert, store and streams against plain Python rules."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedlode.operators import analyze, similarity
from feedlode.operators.dedup import dedup_ttl
from feedlode.operators.report import ingestion_outcomes, ingestion_report
from feedlode.operators.upsert import upsert_latest
from feedlode.plans import catalog, insights, tables
from feedlode.schema import INSIGHT_SCHEMA, RAW_SCHEMA
from feedlode.session import work_path
from feedlode.sources import payloads
from feedlode.streaming import flow, live, stats, trends
from feedlode.streaming.corrections import CorrectingLedger
from feedlode.streaming.dedup import SightingLedger, dedup_ttl_stream
from feedlode.streaming.details import LatestDetails
from feedlode.streaming.slots import SlotTable
from feedlode.streaming.store import InsightStore, insight_sink

START = datetime(2024, 1, 1)
SCHEMA = "platform string, id string, seen_at timestamp, n int"


def plain_rule(rows, ttl):
    last, kept = {}, []
    for platform, key, at, n in sorted(rows, key=lambda r: (r[2], r[3])):
        if (platform, key) not in last or at - last[platform, key] >= ttl:
            last[platform, key] = at
            kept.append(n)
    return sorted(kept)


def random_rows(seed, count, minutes):
    """A third of all rows have one key."""
    rng = random.Random(seed)
    return [
        ("p", "hot" if rng.random() < 0.34 else str(rng.randrange(30)),
         START + timedelta(minutes=rng.randrange(minutes)), n)
        for n in range(count)
    ]


def frame(spark, rows):
    df = spark.createDataFrame([(p, i, (t - START).total_seconds(), n) for p, i, t, n in rows], "platform string, id string, s double, n int")
    return df.select("platform", "id", F.timestamp_micros(F.lit(1704067200000000) + (F.col("s") * 1000000).cast("bigint")).alias("seen_at"), "n")


def kept(df):
    return sorted(r["n"] for r in df.select("n").collect())


def test_border(spark):
    rows = [("p", "a", START + timedelta(minutes=m), m) for m in (0, 5, 9, 10, 11, 30)]
    assert kept(dedup_ttl(frame(spark, rows), ttl_seconds=600, tie=["n"])) == [0, 10, 30]


def test_batch_rule(spark):
    for seed, minutes, ttl in ((1, 400, 600), (2, 3000, 1800)):
        rows = random_rows(seed, 600, minutes)
        expected = plain_rule(rows, timedelta(seconds=ttl))
        assert kept(dedup_ttl(frame(spark, rows), ttl_seconds=ttl, tie=["n"])) == expected


def test_busy_keys_are_split_by_time(spark):
    """The way of stretches with too many rows for one task gives the same."""
    rows = random_rows(3, 500, 300)
    expected = plain_rule(rows, timedelta(seconds=600))
    got = dedup_ttl(frame(spark, rows), ttl_seconds=600, tie=["n"], max_group_rows=20)
    assert kept(got) == expected


def test_stream_equals_batch(spark):
    """Any split into micro-batches in order of time admits the same sightings."""
    rows = sorted(random_rows(4, 400, 600), key=lambda r: (r[2], r[3]))
    folder = work_path(spark, "test-dedup")
    for part, start in enumerate(range(0, 400, 150)):
        frame(spark, rows[start : start + 150]).coalesce(1).write.parquet(f"{folder}/in/part={part}")
    stream = (
        spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/in").drop("part")
    )
    ledger = SightingLedger(spark, f"{folder}/ledger", ttl_seconds=600, tie=["n"])
    query = dedup_ttl_stream(stream, ledger, f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    assert kept(ledger.read()) == plain_rule(rows, timedelta(seconds=600))
    # The last micro-batch run again finds and leaves the same.
    again = ledger.admit(frame(spark, rows[300:]), 2)
    assert set(kept(again)) <= set(kept(ledger.read()))
    assert kept(ledger.read()) == plain_rule(rows, timedelta(seconds=600))


ROW = "platform string, source_post_id string, id bigint, commercial_potential int, embedding array<float>, is_explicit_content boolean, created_at timestamp"


def writes(spark, *rows):
    data = [("p", k, n, s, [1.0] if v else None, e, START + timedelta(hours=n)) for k, n, s, v, e in rows]
    return spark.createDataFrame(data, ROW)


def state(df):
    return {
        r["source_post_id"]: (r["id"], r["commercial_potential"], r["embedding"], r["created_at"].hour)
        for r in df.collect()
    }


def test_upsert(spark):
    base = writes(spark, ("a", 1, 5, True, False), ("b", 2, 6, True, False))
    late = writes(spark, ("a", 4, 8, False, True), ("a", 3, 7, True, False), ("c", 6, 2, True, False), ("c", 5, 1, True, False))
    merged = upsert_latest(base, late)
    assert state(merged) == {"a": (1, 8, None, 1), "b": (2, 6, [1.0], 2), "c": (5, 2, [1.0], 5)}
    assert state(upsert_latest(merged, late)) == state(merged)


@pytest.mark.parametrize("compact_every", [1, 2, 10])
def test_store(spark, compact_every):
    folder = work_path(spark, "test-store")
    store = InsightStore(spark, folder, ROW, buckets=4, compact_every=compact_every)
    assert store.read().count() == 0
    store.merge(writes(spark, ("a", 1, 5, True, False), ("b", 2, 6, True, None)), batch_id=0)
    late = writes(spark, ("a", 4, 8, False, True), ("a", 3, 7, True, False), ("c", 5, 1, True, False))
    for _ in range(2):  # a repeated batch changes nothing
        store.merge(late, batch_id=1)
    store.merge(writes(spark), batch_id=2)
    assert state(store.read()) == {"a": (1, 8, None, 1), "b": (2, 6, [1.0], 2), "c": (5, 1, [1.0], 5)}
    changes = {(r["version"], r["source_post_id"]): r["before"] for r in store.changes().collect()}
    assert set(changes) == {(1, "a"), (1, "b"), (2, "a"), (2, "c")}
    assert changes[2, "a"]["commercial_potential"] == 5 and changes[2, "c"] is None
    # "a" became explicit and no longer counts; updates are not counted as new.
    stats = live.running_stats(store.changes(), START + timedelta(hours=28)).first()
    assert tuple(stats) == (2, 1, 3.5)


def test_insight_sink_over_several_batches(spark):
    folder = work_path(spark, "test-sink")
    for part in range(3):
        writes(spark, ("a", part + 1, part, True, False), (str(part), part + 1, 9, True, False)).coalesce(1).write.parquet(f"{folder}/in/part={part}")
    stream = spark.readStream.schema(ROW + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").drop("part")
    store = InsightStore(spark, f"{folder}/store", ROW, buckets=2, compact_every=2)
    insight_sink(stream, store, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert store.read().count() == 4
    assert state(store.read())["a"][0::3] == (1, 1)


def test_report(spark):
    rows = [("p", "a", START, 0), ("p", "a", START + timedelta(minutes=1), 1), ("q", "b", START, 2)]
    seen = frame(spark, rows).withColumn("source", F.col("platform"))
    admitted = dedup_ttl(seen, tie=["n"])
    failed = spark.createDataFrame([("r", "error", "r: bad")], "source string, outcome string, error string")
    failed = failed.withColumn("n", F.lit(1).cast("bigint"))
    report = ingestion_report(ingestion_outcomes(seen, admitted).unionByName(failed), ["p", "q", "r", "s"])
    got = {r["source"]: tuple(r)[1:] for r in report.collect()}
    assert got["p"] == (1, 2, 1, 1, 0, 0, []) and got["r"] == (1, 0, 0, 0, 1, 0, ["r: bad"])
    # A configured source that was silent counts as one.
    assert got["s"] == (1, 0, 0, 0, 0, 0, []) and got["(total)"] == (4, 3, 2, 1, 1, 0, ["r: bad"])
    # Equal repeats are duplicates.
    twice = seen.unionAll(seen.limit(1))
    rows = ingestion_outcomes(twice, dedup_ttl(twice, tie=["n"])).where("source = 'p'").collect()
    assert {r["outcome"]: r["n"] for r in rows} == {"enqueued": 1, "duplicate": 2}


def test_whole_feed_in_two_runs(spark):
    """A second run with the same payloads, fetched later, and a broken one adds no row."""
    sf = "/root/testdata/sf0.001"
    folder = work_path(spark, "test-feed")
    raw = tables.listing_payloads(spark, sf)
    store = InsightStore(spark, f"{folder}/insights", INSIGHT_SCHEMA, buckets=4)
    words = {"listing": catalog.KEYWORDS}

    def run():
        stream = flow.read_landed(spark, f"{folder}/landed")
        flow.run_feed(
            stream, store, flow.feed_ledger(spark, f"{folder}/ledger"), f"{folder}/checkpoint",
            tables.AS_OF, words, log=f"{folder}/log",
        ).trigger(availableNow=True).start().awaitTermination()

    raw.write.partitionBy("source").parquet(f"{folder}/landed")
    run()
    first = store.read().count()
    assert first == payloads.parse_listing(raw, tables.AS_OF, catalog.KEYWORDS).posts.count() > 0
    later = raw.withColumn("fetched_at", F.col("fetched_at") + F.make_dt_interval(F.lit(1)))
    broken = raw.limit(1).withColumn("payload", F.lit("{"))
    later.unionByName(broken).write.mode("append").partitionBy("source").parquet(f"{folder}/landed")
    run()
    assert store.read().count() == first
    total = spark.read.parquet(f"{folder}/log/report").filter("source = '(total)'").orderBy("batch").collect()
    assert [(r["enqueued"], r["skipped_duplicates"], r["errors"]) for r in total] == [(first, 0, 0), (0, first, 1)]
    assert spark.read.parquet(f"{folder}/log/rejects").count() == 1
    shown = live.live_insights(store.changes().drop("version"))
    assert shown.count() == first and "embedding" not in shown.columns


def test_store_keeps_few_manifests(spark, monkeypatch):
    monkeypatch.setattr("feedlode.streaming.store.MANIFESTS", 2)
    folder = work_path(spark, "test-manifests")
    store = InsightStore(spark, folder, ROW, buckets=2, compact_every=2)
    for batch in range(5):
        rows = writes(spark, ("a", batch, batch, True, False), (str(batch), batch, 1, True, False))
        store.merge(rows.coalesce(1), batch_id=batch)
    stored = state(store.read())
    assert stored["a"] == (0, 4, [1.0], 0) and len(stored) == 6
    assert spark.read.parquet(f"{folder}/manifest").select("version").distinct().count() == 2


def test_late_sightings(spark):
    """Out of order: admitted if far from all admitted ones, whatever the days between."""
    folder = work_path(spark, "test-late")
    ledger = SightingLedger(spark, f"{folder}/ledger", ttl_seconds=3600, tie=["n"])
    hours = [[12, 30], [2, 11.5, 12.5, 29.2], [-400, 12.9, 13, 28.9]]
    for batch, times in enumerate(hours):
        rows = [("p", "a", START + timedelta(hours=h), i + 10 * batch) for i, h in enumerate(times)]
        ledger.admit(frame(spark, rows), batch)
    got = sorted((r["seen_at"] - START).total_seconds() / 3600 for r in ledger.read().collect())
    assert got == [-400, 2, 12, 13, 28.9, 30]


def test_any_split_keeps_sightings_apart(spark):
    rows = random_rows(8, 300, 900)
    folder = work_path(spark, "test-splits")
    ledger = SightingLedger(spark, f"{folder}/ledger", ttl_seconds=1800, tie=["n"])
    for batch, start in enumerate((100, 0, 200)):
        ledger.admit(frame(spark, rows[start:start + 100]), batch)
    times = {}
    for r in ledger.read().collect():
        times.setdefault((r["platform"], r["id"]), []).append(r["seen_at"])
    for own in times.values():
        own.sort()
        assert all(b - a >= timedelta(seconds=1800) for a, b in zip(own, own[1:]))


def test_old_batches_are_not_applied_again(spark):
    folder = work_path(spark, "test-replay")
    store = InsightStore(spark, folder, ROW, buckets=2, compact_every=6)
    store.merge(writes(spark, ("a", 1, 1, True, False)), "A", 0)
    for batch in range(17):
        store.merge(writes(spark, ("a", batch + 2, 10 + batch, True, False)).coalesce(1), "B", batch)
    before = state(store.read())
    store.merge(writes(spark, ("a", 1, 1, True, False)), "A", 0)
    assert state(store.read()) == before and before["a"][1] == 26


def test_a_merge_that_died_shows_nothing(spark, monkeypatch):
    folder = work_path(spark, "test-crash")
    store = InsightStore(spark, folder, ROW, buckets=2)
    store.merge(writes(spark, ("a", 1, 5, True, False)), batch_id=0)

    real = InsightStore._log

    def die(self, *given):
        real(self, *given)
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(InsightStore, "_log", die)
        with pytest.raises(RuntimeError):
            store.merge(writes(spark, ("a", 3, 9, True, False)), batch_id=1)
    assert {r["version"] for r in store.changes().collect()} == {1}
    store.merge(writes(spark, ("b", 2, 7, True, False)), batch_id=1)
    stats = live.running_stats(store.changes(), START + timedelta(hours=28)).first()
    assert tuple(stats) == (2, 0, 6.0)
    # What a move that broke off left is read where it is, and moved by the next merge alone.
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{folder}/staged"))
    files.rename(path(f"{folder}/changes/version=2"), path(f"{folder}/staged/version=2"))
    assert store.changes().count() == 2 and state(store.read())["b"][1] == 7
    assert files.exists(path(f"{folder}/staged/version=2")) and not files.exists(path(f"{folder}/changes/version=2"))
    store.merge(writes(spark), batch_id=2)
    assert not files.exists(path(f"{folder}/staged/version=2")) and store.change_stream().isStreaming
    assert spark.read.parquet(f"{folder}/changes").select("version").distinct().count() == 2


def feed_rows(store):
    rows = store.read().select("source_post_id", "raw_content", "matched_keywords").collect()
    return sorted((r[0], r[1], tuple(r[2])) for r in rows)


@pytest.mark.parametrize("order", ["before", "with", "after"])
def test_details_whenever_they_land(spark, order):
    lists = spark.createDataFrame(
        [("forum", "job", START, '[{"id": 1, "title": "data", "excerpt": "short"}, {"id": 2, "title": "data", "excerpt": "x"}]')],
        RAW_SCHEMA)
    detail = spark.createDataFrame(
        [("forum_detail", "1", START, '{"content": "the full text of data"}')], RAW_SCHEMA)
    parts = {"before": [detail, lists], "with": [lists.unionByName(detail)], "after": [lists, detail]}[order]
    results = []
    for max_files in (1, 1000):
        folder = work_path(spark, "test-details")
        store = InsightStore(spark, f"{folder}/store", INSIGHT_SCHEMA, buckets=2)

        def run():
            landed = f"{folder}/landed"
            flow.run_feed(
                flow.read_landed(spark, landed, max_files), store, flow.feed_ledger(spark, f"{folder}/ledger"),
                f"{folder}/checkpoint", None, {"forum": ["data"]}, details=LatestDetails(spark, f"{folder}/details", buckets=4),
            ).trigger(availableNow=True).start().awaitTermination()

        for part in parts:
            part.coalesce(1).write.mode("append").partitionBy("source").parquet(f"{folder}/landed")
            if max_files == 1:
                # Worked off before the next one lands.
                run()
        run()
        results.append(feed_rows(store))
    assert results[0] == results[1] == [("1", "the full text of data", ("data",)), ("2", "x", ("data",))]


def test_rows_a_model_fails_on_are_kept_apart(spark):
    texts = [("listing", "s", START, json.dumps({"data": {"children": [
        {"data": {"id": str(i), "title": t}} for i, t in enumerate(("good", "bad", "odd", "fine"))]}}))]
    folder = work_path(spark, "test-model")
    spark.createDataFrame(texts, RAW_SCHEMA).write.partitionBy("source").parquet(f"{folder}/landed")
    store = InsightStore(spark, f"{folder}/store", INSIGHT_SCHEMA, buckets=2)

    def make():
        def answer(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return ['{"commercial_potential": 4}' if "odd" not in p else "?" for p in prompts]

        return answer

    flow.run_feed(
        flow.read_landed(spark, f"{folder}/landed"), store, flow.feed_ledger(spark, f"{folder}/ledger"),
        f"{folder}/checkpoint", None, {"listing": []}, log=f"{folder}/log",
        analyse=lambda posts: analyze.score_with_model(posts, make, "m"),
    ).trigger(availableNow=True).start().awaitTermination()
    assert {r["title"]: r["commercial_potential"] for r in store.read().collect()} == {"good": 4, "fine": 4}
    rejects = spark.read.parquet(f"{folder}/log/rejects").collect()
    assert {(json.loads(r["payload"])["title"], r["stage"], r["error"]) for r in rejects} == {
        ("bad", "analysis", "RuntimeError: no"), ("odd", "analysis", "unreadable answer")}


def test_live_feed_is_as_long_as_asked_for(spark):
    df = spark.range(600).select(F.col("id"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    assert insights.live_feed(df, 500).count() == 500


def test_stream_queries_take_several_batches(spark):
    stream = catalog._stream(spark, "/root/testdata/sf0.001", "events", "ts")
    query = stream.writeStream.format("noop").option(
        "checkpointLocation", work_path(spark, "test-batches")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 3


def detail_payloads(spark, rows):
    return spark.createDataFrame(
        [("forum_detail", str(k), START + timedelta(hours=h), json.dumps({"content": text})) for k, h, text in rows], RAW_SCHEMA)


def test_latest_details_by_post(spark):
    folder = work_path(spark, "test-latest-details")
    details = LatestDetails(spark, folder, buckets=4)
    landed = details.update(detail_payloads(spark, [(1, 2, "one"), (2, 2, "two"), (1, 1, "older")]), 0)
    assert sorted(map(tuple, landed.collect())) == [("1", "one"), ("2", "two")]
    # One that lands late is no newer for that; of equal times the last read counts.
    landed = details.update(detail_payloads(spark, [(1, 0, "late"), (2, 2, "again"), (3, 5, "three")]), 3)
    assert sorted(map(tuple, landed.collect())) == [("1", "one"), ("2", "again"), ("3", "three")]
    # A batch that is run again starts from what was before it, and gives the same.
    again = details.update(detail_payloads(spark, [(1, 0, "late"), (2, 2, "again"), (3, 5, "three")]), 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, landed.collect()))
    assert details.update(detail_payloads(spark, []), 4).count() == 0
    wanted = spark.createDataFrame([("1",), ("3",), ("3",), ("9",)], "post_id string")
    assert sorted(map(tuple, details.of(wanted).collect())) == [("1", "one"), ("3", "three")]
    assert details.of(wanted.where("false")).count() == 0
    assert {r["post_id"]: r["detail"] for r in details.read().collect()} == {"1": "one", "2": "again", "3": "three"}


def test_details_read_per_batch_do_not_grow(spark, monkeypatch):
    folder = work_path(spark, "test-details-bounded")
    read, sizes = SlotTable.read, []

    def counted(self, parts=None, before=None, where=None):
        found = read(self, parts, before, where)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(SlotTable, "read", counted)
    day = 24
    details = LatestDetails(spark, folder, buckets=2, keep_seconds=2 * day * 3600)
    for batch in range(10):
        details.update(detail_payloads(spark, [(100 * batch + i, batch * day, "x") for i in range(20)]), batch)
    # Those of the last two days and of the batch's own, of all that ever landed.
    assert sizes[0] == 0 and max(sizes) == sizes[-1] == 60 and len(sizes) == 10
    # Of the files, only those of the wanted bucket are read.
    own = details.of(spark.createDataFrame([("900",)], "post_id string"))
    assert own.count() == 1
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_a_slot_table_keeps_the_rows_of_a_batch_that_broke_off(spark, monkeypatch):
    table = SlotTable(spark, work_path(spark, "test-slots"), "k string, v int, part int", "part")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int, part int")
    table.replace(frame(("a", 1, 0), ("b", 1, 1)), 0)
    table.replace(frame(("a", 2, 0)), 1)
    # Half of batch 2 was written when it broke off.
    table.replace(frame(("a", 9, 0)), 2)
    assert {tuple(r) for r in table.read(before=2).collect()} == {("a", 2, 0), ("b", 1, 1)}
    table.replace(frame(("a", 3, 0), ("b", 3, 1)), 2)
    assert {tuple(r) for r in table.read().collect()} == {("a", 3, 0), ("b", 3, 1)}
    assert {tuple(r) for r in table.read([(1,)]).collect()} == {("b", 3, 1)}
    table.replace(frame(), 3)
    assert table.read([]).count() == 0 and table.read().count() == 2
    # Two slots per partition, however many batches.
    assert len({f.rsplit("/", 1)[0] for f in spark.read.parquet(table.path).inputFiles()}) == 4


def test_recent_count_falls_while_nothing_is_saved(spark):
    folder = work_path(spark, "test-hourly")
    rng = random.Random(5)
    store = InsightStore(spark, f"{folder}/store", "platform string, source_post_id string, id bigint, commercial_potential int, "
                         "is_explicit_content boolean, created_at timestamp", buckets=2)
    sums = stats.HourlyStats(spark, f"{folder}/sums")
    rows = {}
    for batch in range(4):
        writes_ = []
        for _ in range(60):
            key = rng.randrange(120)
            at = START + timedelta(microseconds=rng.randrange(3 * 86_400 * 1_000_000))
            writes_.append(("p", str(key), key, rng.choice([None, 1, 5, 10]), rng.choice([None, True, False]), at))
        writes_ = list({w[1]: w for w in writes_}.values())
        for w in writes_:
            rows[w[1]] = (w[3], w[4], rows[w[1]][2] if w[1] in rows else w[5])
        store.merge(spark.createDataFrame(writes_, store.schema), batch_id=batch)
        changes = store.changes().where(F.col("version") == batch + 1)
        sums.update(changes, batch)
        if batch == 2:
            sums.update(changes, batch)
    shown = [(score, at) for score, explicit, at in rows.values() if not explicit]
    scores = [s for s, _ in shown if s is not None]
    counts = []
    for hours in (0, 30, 60.25, 72, 84.7, 95.99, 96, 97):
        as_of = START + timedelta(hours=hours)
        got = sums.at(as_of).first()
        recent = sum(at >= as_of - timedelta(hours=24) for _, at in shown)
        assert (got["total_insights"], got["live_last_24h"]) == (len(shown), recent)
        assert abs(got["average_potential"] - sum(scores) / len(scores)) <= 0.05 + 1e-9
        counts.append(recent)
    assert counts == sorted(counts, reverse=True) and counts[-1] == 0 < counts[3]
    # To the microsecond.
    one = max(at for _, at in shown)
    day = timedelta(hours=24)
    assert sums.at(one + day).first()["live_last_24h"] == 1
    assert sums.at(one + day + timedelta(microseconds=1)).first()["live_last_24h"] == 0
    assert stats.HourlyStats(spark, f"{folder}/none").at(START).first()["total_insights"] == 0


def dated(spark, *rows):
    """(key, day, score) as writes."""
    values = [("p", key, i, score, "x" * 500, START + timedelta(days=day)) for i, (key, day, score) in enumerate(rows)]
    return spark.createDataFrame(values, DATED)


DATED = ("platform string, source_post_id string, id bigint, commercial_potential int, raw_content string, "
         "created_at timestamp")


def test_store_reads_only_the_days_and_columns_wanted(spark):
    folder = work_path(spark, "test-days")
    store = InsightStore(spark, folder, DATED + ", is_explicit_content boolean, embedding array<float>", buckets=2, compact_every=2)
    full = lambda *rows: dated(spark, *rows).selectExpr("*", "false AS is_explicit_content", "array(cast(id + 1 AS float), 1.0f) AS embedding")
    store.merge(full(*[(f"{d}-{i}", d, 1) for d in range(6) for i in range(3)]), batch_id=0)
    store.merge(full(("0-0", 9, 5), ("new", 5, 2)), batch_id=1)
    store.merge(full(("5-1", 9, 7)), batch_id=2)
    assert store._current()[:3] == (3, 2, 1)
    recent = store.read(START + timedelta(days=4, hours=1))
    assert {r["source_post_id"]: r["commercial_potential"] for r in recent.collect()} == {"5-0": 1, "5-1": 7, "5-2": 1, "new": 2}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert any("day" in line.split("PartitionFilters")[1].split("]")[0] for line in plan.splitlines() if "/base" in line)
    rows = spark.read.parquet(f"{folder}/base").where("day >= '2024-01-05'")
    assert {r["source_post_id"] for r in rows.collect()} == {"4-0", "4-1", "4-2", "5-0", "5-1", "5-2", "new"}
    # An updated row stays on the day of its first insertion.
    assert {r["source_post_id"]: r["created_at"].day for r in store.read().collect()}["0-0"] == 1
    # A merge reads narrow columns of its buckets only.
    plan = store._known(store._current(), full(("0-0", 9, 5)))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("raw_content" not in line and "embedding" not in line for line in scans)
    assert any("bucket" in line.split("PartitionFilters")[1].split("]")[0] for line in scans if "/base" in line)
    # A search goes over the base without shuffling it.
    found = similarity.search_ids(store.read(), [1.0, 1.0], 3)
    text = found._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(text) if "FileScan" in line and "/base" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    above, level = [], depth(text[at])
    for line in reversed(text[:at]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert any("LeftAnti" in line for line in above) and not any(" Exchange" in line or "- Exchange" in line for line in above)
    assert found.count() == 3
    # The rows found are fetched from their partitions, the columns scanned are few.
    rows = store.rows_of(store.read().where("source_post_id = '4-1'").select("platform", "source_post_id", "created_at"))
    assert [r["source_post_id"] for r in rows.collect()] == ["4-1"]
    parts = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "/base" in line]
    assert parts and all("day" in line.split("PartitionFilters")[1].split("]")[0] for line in parts)
    shown = similarity.semantic_search(store.read(), [1.0, 1.0], 4, fetch=store.rows_of).collect()
    assert len(shown) == 4 and [r["similarity"] for r in shown] == sorted((r["similarity"] for r in shown), reverse=True)


def test_rows_that_share_an_id(spark):
    rows = [("p", "a", 7, [1.0, 0.0]), ("p", "b", 7, [0.9, 0.1]), ("p", "c", 8, [0.0, 1.0]), ("q", "a", 9, [0.5, 0.5])]
    insights = spark.createDataFrame(rows, "platform string, source_post_id string, id bigint, embedding array<float>")
    names = lambda df: [(r["id"], r["similarity"]) for r in df.select("id", F.round("similarity", 3).alias("similarity")).collect()]
    assert names(similarity.semantic_search(insights, [1.0, 0.0], 2)) == [(7, 1.0), (7, 0.994)]
    assert names(similarity.semantic_search(insights, [1.0, 0.0], 3)) == [(7, 1.0), (7, 0.994), (9, 0.707)]
    assert names(similarity.similar_insights(insights, 7, 5, key={"platform": "p", "source_post_id": "a"})) == [
        (7, 0.994), (9, 0.707), (8, 0.0)]
    assert names(similarity.similar_insights(insights, 8, 2)) == [(9, 0.707), (7, 0.11)]


def test_store_stays_small(spark):
    folder = work_path(spark, "test-retention")
    shared = spark.sparkContext.getCheckpointDir()
    store = InsightStore(spark, folder, DATED + ", is_explicit_content boolean", buckets=2, compact_every=4, keep_changes=4)
    cuts = lambda: {p.name for p in Path(shared.removeprefix("file:")).glob("cut-*")}
    before, opened = cuts(), None
    for batch in range(18):
        rows = [(str(k), k % 3, batch) for k in range(40)]
        store.merge(dated(spark, *rows).selectExpr("*", "false AS is_explicit_content").coalesce(1), batch_id=batch)
        if batch == 9:
            # Between two compactions: a reader that has begun.
            opened = store.read()
        if batch == 13:
            assert {r["commercial_potential"] for r in opened.collect()} == {9} and opened.count() == 40
    assert {r["commercial_potential"] for r in store.read().collect()} == {17} and store.read().count() == 40
    assert cuts() == before
    kept = {int(p.name[8:]) for p in Path(f"{folder}/changes".removeprefix("file:")).glob("version=*")}
    assert kept == set(range(13, 19))
    # Two slots of three days and two buckets, whatever the number of merges.
    assert len(list(Path(f"{folder}/base".removeprefix("file:")).glob("day=*/bucket=*/slot=*"))) <= 12


@pytest.mark.parametrize("seed, lateness", [(1, None), (2, None), (3, 40 * 3600)])
def test_corrections_equal_the_batch_rule(spark, seed, lateness):
    """Whatever the order: after each batch the ledger holds what the batch rule gives."""
    rng = random.Random(seed)
    rows = random_rows(seed, 240, 2400)
    rows += [rows[5], rows[9]]
    rng.shuffle(rows)
    ledger = CorrectingLedger(spark, work_path(spark, "test-corrections"), ttl_seconds=3 * 3600, tie=["n"], lateness_seconds=lateness)
    told, withdrawn = {}, 0
    for batch, start in enumerate(range(0, len(rows), 81)):
        part = rows[start:start + 81]
        for _ in range(2 if batch == 1 else 1):  # a batch that is run again
            changes = ledger.admit(frame(spark, part), batch).collect()
        for r in changes:
            sign = {"admitted": 1, "withdrawn": -1}[r["change"]]
            withdrawn += sign < 0
            told[r["n"]] = told.get(r["n"], 0) + sign
        expected = plain_rule(rows[:start + len(part)], timedelta(hours=3))
        assert kept(ledger.read()) == expected
        assert sorted(n for n, times in told.items() for _ in range(times)) == expected
    assert withdrawn > 0


def test_corrections_within_a_stated_lateness(spark):
    ledger = CorrectingLedger(spark, work_path(spark, "test-lateness"), ttl_seconds=3600, tie=["n"], lateness_seconds=3 * 3600)
    at = lambda *hours: frame(spark, [("p", "a", START + timedelta(hours=h), i) for i, h in hours])
    ledger.admit(at((0, 0), (1, 10), (2, 10.9), (3, 11.5)), 0)
    # 9.5 takes the place of 10; 10.9 is due then, and 11.5 no longer. 8 is too late.
    changes = {(r["n"], r["change"]) for r in ledger.admit(at((4, 9.5), (5, 8)), 1).collect()}
    assert changes == {(4, "admitted"), (1, "withdrawn"), (2, "admitted"), (3, "withdrawn"), (5, "late")}
    assert kept(ledger.read()) == [0, 2, 4]
    assert ledger.admit(at(), 2).count() == 0 and kept(ledger.read()) == [0, 2, 4]


def test_hourly_trends_equal_the_batch_answer(spark, monkeypatch):
    folder = work_path(spark, "test-trends")
    rng = random.Random(11)
    schema = ("platform string, source_post_id string, id bigint, commercial_potential int, is_explicit_content boolean, "
              "cluster_key string, cluster_label string, title string, core_pain_point string, created_at timestamp")
    store = InsightStore(spark, f"{folder}/store", schema, buckets=2, compact_every=2)
    sums = trends.HourlyTrends(spark, f"{folder}/sums", store)
    for batch in range(4):
        rows = {}
        for _ in range(70):
            key = str(rng.randrange(90))
            at = START + timedelta(seconds=rng.randrange(4 * 86_400))
            rows[key] = (rng.choice("pq"), key, int(key), rng.choice([None, 1, 4, 9]), rng.choice([None, False, False, True]),
                         rng.choice(["a", "b", "c", "", None]), rng.choice(["", "label", None]), f"t{rng.randrange(9)}",
                         rng.choice(["", None, "x", "y", "z"]), at)
        store.merge(spark.createDataFrame(list(rows.values()), schema), batch_id=batch)
        changes = store.changes().where(F.col("version") == batch + 1)
        for _ in range(2 if batch == 1 else 1):
            sums.update(changes, batch)
    # The last row of a day moves away: nothing of it is left.
    for hours, window in ((96, 96), (90.5, 30), (72.25, 7), (97, 1), (300, 5)):
        as_of = START + timedelta(hours=hours)
        want = insights.trend_clusters(store.read(), as_of, window, 50)
        got = sums.clusters(as_of, window, 50).select(*want.columns)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    asked = []
    real = InsightStore.on_days
    monkeypatch.setattr(InsightStore, "on_days", lambda self, days: asked.append(list(days)) or real(self, days))
    sums.clusters(START + timedelta(hours=90), 48, 50)
    assert asked == [[(START + timedelta(hours=42)).date()]]
    assert sums.clusters(START, 24, 5).count() > 0 and trends.HourlyTrends(
        spark, f"{folder}/none", InsightStore(spark, f"{folder}/empty", schema)).clusters(START).count() == 0


def test_corrected_batches_are_landed_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = [(n, START + timedelta(hours=7 * n), n % 9, "view") for n in range(600)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    folders = []
    monkeypatch.setattr(catalog, "work_path", lambda spark, name: folders.append(work_path(spark, name)) or folders[-1])
    got = catalog.dedup_corrected(spark, str(tmp_path))
    sightings = [(kind, str(user), at, n) for n, at, user, kind in rows]
    assert sorted(r["event_id"] for r in got.collect()) == plain_rule(sightings, timedelta(seconds=catalog.TWO_DAYS))
    files = len(spark.read.parquet(f"{folders[0]}/landed").inputFiles())
    assert files == catalog.STREAM_PARTS * spark.sparkContext.defaultParallelism
    # Each part is one micro-batch, as before.
    batches = {r[0] for r in spark.read.parquet(f"{folders[0]}/out").select("batch").distinct().collect()}
    assert batches == set(range(catalog.STREAM_PARTS))
