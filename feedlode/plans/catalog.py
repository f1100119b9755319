"""One named query per operator, over the given tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from feedlode.functions.text import clean, first_sentence
from feedlode.operators import analyze, cluster, dedup, embed, report, rows, similarity, upsert
from feedlode.plans import insights, tables
from feedlode.plans.tables import AS_OF, KEYWORDS
from feedlode.schema import RAW_SCHEMA
from feedlode.session import cut_lineage, delete_paths, files_of, packed, shuffles_let_go, work_path
from feedlode.sources import payloads, queue
from feedlode.streaming import flow, live, stats, trends
from feedlode.streaming.corrections import ADMITTED, WITHDRAWN, CorrectingLedger, corrected_stream
from feedlode.streaming.dedup import SightingLedger, dedup_ttl_stream
from feedlode.streaming.details import LatestDetails
from feedlode.streaming.store import InsightStore, insight_sink

Query = Callable[[SparkSession, str], DataFrame]

# Words that occur in the given texts; the defaults of the operators do not.
WORDS = {
    "manual_words": ["license"], "sheet_words": ["data"], "strain_words": ["worthless"],
    "physical_words": ["double"], "explicit_signals": ["that"],
}
TWO_DAYS = 2 * 24 * 3600
STREAM_PARTS = 3
# Documents whose payloads land at once, in bytes as stored, and the most parts.
FEED_PART_BYTES = 32_000_000
FEED_PARTS = 12
TREND_AS_OF = tables.AS_OF.replace(day=1, hour=12)
TREND_HOURS = 11
LIVE_TRENDS_AS_OF = tables.AS_OF.replace(day=5, hour=12, minute=34, second=56)
TOP = 20


def shown(df: DataFrame) -> DataFrame:
    """Plain columns: times without zone, lists joined by a bar."""

    def plain(field: T.StructField) -> Column:
        col = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.ArrayType):
            col = F.array_join(col, "|")
        return col.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def shown_posts(df: DataFrame) -> DataFrame:
    digest = df.withColumn("content_md5", F.md5(F.col("content").cast("binary"))).drop(
        "content", "source", "feed", "fetched_at"
    )
    return shown(digest)


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with keywords found (none is dropped), analysis and cluster."""
    posts = tables.document_posts(spark, sf)
    hits = payloads.keyword_hits([F.col("title"), F.col("content")], KEYWORDS)
    scored = analyze.analyze_heuristic(posts.withColumn("matched_keywords", hits), **WORDS)
    return cluster.assign_clusters(scored)


# Rows


def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = tables.table(spark, sf, "pages").select("page_id", "html")
    return rows.clean_text(pages, ["html"])


def parse_times(spark: SparkSession, sf: str) -> DataFrame:
    """Event times written in one layout per event type, and read again."""
    ts = F.col("ts").cast("timestamp")
    month = F.element_at(
        F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]),
        F.month(ts),
    )
    day, clock = F.date_format(ts, "dd"), F.date_format(ts, "HH:mm:ss")
    written = (
        F.when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
        .when(
            F.col("event_type") == "error",
            F.concat_ws(" ", F.lit("Mon,"), day, month, F.date_format(ts, "yyyy"), clock, F.lit("-0330")),
        )
        .when(
            F.col("event_type") == "click",
            F.concat_ws(" ", day, month, F.date_format(ts, "yy HH:mm"), F.lit("EST")),
        )
        .when(F.col("event_type") == "purchase", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("?")))
    )
    events = tables.table(spark, sf, "events").select("event_id", written.alias("written"))
    return shown(rows.parse_times(events, "written", AS_OF, "read_at"))


def assign_post_id(spark: SparkSession, sf: str) -> DataFrame:
    posts = tables.document_posts(spark, sf)
    some = posts.withColumn("id", F.when(F.col("channel") == "en", F.concat(F.lit("  "), "id")))
    return rows.assign_post_id(some).select("url", "id")


def match_keywords(spark: SparkSession, sf: str) -> DataFrame:
    found = rows.match_keywords(tables.document_posts(spark, sf), KEYWORDS)
    return shown(found.select("doc_id", "matched_keywords"))


def first_sentences(spark: SparkSession, sf: str) -> DataFrame:
    staged = tables.document_posts(spark, sf).withColumn("body", clean(F.col("content")))
    return staged.select("doc_id", first_sentence(F.col("body")).alias("sentence"))


# Sources


def _parsed(parsed: payloads.Parsed) -> DataFrame:
    return shown_posts(parsed.posts)


def parse_forum(spark: SparkSession, sf: str) -> DataFrame:
    lists, details = tables.forum_payloads(spark, sf)
    return _parsed(payloads.parse_forum(lists, details, AS_OF, KEYWORDS))


def parse_listing(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(payloads.parse_listing(tables.listing_payloads(spark, sf), AS_OF, KEYWORDS))


def parse_atom(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(payloads.parse_atom(tables.atom_payloads(spark, sf), AS_OF, KEYWORDS))


def parse_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(payloads.parse_transcripts(tables.transcript_payloads(spark, sf), AS_OF, KEYWORDS))


def conversation_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    items = payloads.conversation_items(tables.table(spark, sf, "conversations"))
    return shown_posts(payloads.transcript_posts(items, AS_OF))


def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All four kinds of feed, without keywords; counted per source and channel."""
    none: dict[str, list[str]] = {k: [] for k in ("forum", "listing", "atom", "transcript")}
    posts = payloads.parse_sources(tables.all_payloads(spark, sf), AS_OF, none).posts
    return posts.groupBy("source", "platform", "content_kind").agg(
        F.count(F.lit(1)).alias("posts"),
        F.sum(F.length("content")).alias("content_chars"),
        F.sum(F.length("title")).alias("title_chars"),
    )


def feed_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Listing payloads cut off for one forum are rejected, the others read."""
    raw = tables.listing_payloads(spark, sf)
    broken = F.when(F.col("feed") == "sub1", F.concat(F.lit("<"), F.col("payload")))
    raw = raw.withColumn("payload", F.coalesce(broken, F.col("payload")))
    rejects = payloads.parse_listing(raw, AS_OF, []).rejects
    return rejects.groupBy("feed", "error").agg(F.count(F.lit(1)).alias("payloads"))


def limit_per_feed(spark: SparkSession, sf: str) -> DataFrame:
    posts = tables.document_posts(spark, sf).select("platform", "channel", "doc_id")
    return payloads.limit_per_feed(posts, ["platform", "channel"], ["doc_id"], 20)


def queue_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    posts = tables.document_posts(spark, sf).withColumn("content_kind", F.lit(" "))
    hits = payloads.keyword_hits([F.col("title"), F.col("content")], KEYWORDS)
    messages = queue.to_queue(posts.withColumn("matched_keywords", hits), AS_OF)
    return shown_posts(queue.from_queue(messages).posts)


# Analysis


def analyze_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    return analysed(spark, sf).select(
        "doc_id", "core_pain_point", "current_workaround", "commercial_potential",
        "saas_feasibility", "is_explicit_content", "analysis_model",
    )


def build_prompts(spark: SparkSession, sf: str) -> DataFrame:
    prompts = analyze.build_prompts(tables.document_posts(spark, sf))
    return prompts.select(
        "doc_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"),
        F.length("prompt").cast("bigint").alias("prompt_chars"),
    )


def _model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers a model might give on the documents, some of them unusable."""
    score = (F.col("n_chars") % 25 - 5).cast("int")
    answer = F.to_json(
        F.struct(
            F.when(F.col("lang") == "de", "").otherwise(F.col("text")).alias("core_pain_point"),
            score.alias("Commercial_Potential"),
            (F.col("lang") == "fr").alias("is_explicit_content"),
        )
    )
    raw = (
        F.when(F.col("source") == "src1", F.concat(answer, F.lit(" done")))
        .when(F.col("source") == "src2", F.replace(answer, F.lit("false"), F.lit('"no"')))
        .when(F.col("source") == "src3", F.lit("I cannot help with that"))
        .when(F.col("lang") == "es", F.concat(F.lit("```\n"), answer, F.lit("\n```")))
        .otherwise(F.concat(F.lit(" ```json\n"), answer, F.lit("\n``` ")))
    )
    return tables.table(spark, sf, "documents").select("doc_id", raw.alias("raw_answer"))


def parse_model_output(spark: SparkSession, sf: str) -> DataFrame:
    read = analyze.parse_model_output(_model_answers(spark, sf), "raw_answer")
    return read.withColumn(
        "core_pain_point", F.md5(F.col("core_pain_point").cast("binary"))
    ).drop("raw_answer")


def _stub_scorer() -> Callable[[list[str]], list[str]]:
    """Stands in for a model: the score is the length of the prompt; one word makes it fail."""

    def answer(prompts: list[str]) -> list[str]:
        if any("worthless" in p for p in prompts):
            raise ValueError("worthless")
        return [json.dumps({"commercial_potential": len(p) % 10 + 1}) for p in prompts]

    return answer


def score_with_model(spark: SparkSession, sf: str) -> DataFrame:
    scored = analyze.score_with_model(tables.document_posts(spark, sf), _stub_scorer, "stub")
    return scored.select(
        "doc_id", "status", "error", "commercial_potential", "core_pain_point", "analysis_model"
    )


# Clusters


def assign_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return analysed(spark, sf).select("doc_id", "cluster_key", "cluster_label")


def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_sizes(analysed(spark, sf))


# Vectors


def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    texts = embed.embedding_text(analysed(spark, sf))
    return texts.select(
        "doc_id", F.md5(F.col("embedding_text").cast("binary")).alias("text_md5"),
        F.length("embedding_text").cast("bigint").alias("text_chars"),
    )


def _vector_summary(df: DataFrame, key: str, vector: str) -> DataFrame:
    zero = F.lit(0.0)
    positions = F.transform(F.col(vector), lambda x, i: x.cast("double") * (i + 1))
    return df.select(
        key,
        F.size(vector).cast("bigint").alias("dims"),
        F.size(F.filter(vector, lambda x: x != 0)).cast("bigint").alias("filled"),
        F.round(F.aggregate(vector, zero, lambda a, x: a + x.cast("double")), 6).alias("total"),
        F.round(F.aggregate(positions, zero, lambda a, x: a + x), 6).alias("weighted"),
    )


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    return _vector_summary(embed.hash_embed(docs, "text"), "doc_id", "embedding")


def _stub_embedder() -> Callable[[list[str], str, list[str]], list[list[float] | None]]:
    """Stands in for a model: counts of four letters; a text with a certain word fails."""

    def vectors(texts: list[str], _mode: str, _titles: list[str]) -> list[list[float] | None]:
        if any("worthless" in t for t in texts):
            raise ValueError("worthless")
        return [[float(t.count(letter)) for letter in "aeiz"] for t in texts]

    return vectors


def embed_with_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    embedded = embed.embed_with_model(docs, "text", _stub_embedder, "stub")
    parts = [
        F.round(F.col("embedding")[i].cast("double"), 6).alias(f"v{i}") for i in range(4)
    ]
    return embedded.select("doc_id", "embedding_model", *parts)


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    longer = tables.table(spark, sf, "embeddings").withColumn(
        "embedding",
        F.transform(
            "embedding", lambda x: (x.cast("double") * F.col("label").cast("double")).cast("float")
        ),
    )
    return _vector_summary(embed.l2_normalize(longer, "embedding"), "vec_id", "embedding")


def _similar(df: DataFrame) -> DataFrame:
    return df.select("id", "cluster_key", F.round("similarity", 4).alias("similarity"))


def semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    stored = tables.vectors(spark, sf)
    return _similar(similarity.semantic_search(stored, similarity.vector_of(stored, 1), TOP))


def similar_insights(spark: SparkSession, sf: str) -> DataFrame:
    return _similar(similarity.similar_insights(tables.vectors(spark, sf), 2, TOP))


def similar_bulk(spark: SparkSession, sf: str) -> DataFrame:
    stored = tables.vectors(spark, sf)
    pairs = similarity.similar_insights_bulk(stored, stored.select("id"), 8)
    return pairs.select(
        "target_id", "id", F.round("similarity", 4).alias("similarity"),
        F.col("rank").cast("bigint").alias("rank"),
    )


def search_text(spark: SparkSession, sf: str) -> DataFrame:
    """A text query over hash vectors of all documents."""
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    stored = cut_lineage(embed.hash_embed(docs, "text").drop("text"))
    query = embed.hash_embed_query(spark, "license of the data")
    found = similarity.semantic_search(stored, query, TOP)
    return found.select("id", F.round("similarity", 4).alias("similarity"))


# De-duplication, upsert, accounting


def dedup_ttl(spark: SparkSession, sf: str) -> DataFrame:
    admitted = dedup.dedup_ttl(tables.sightings(spark, sf), ttl_seconds=TWO_DAYS, tie=["event_id"])
    return shown(admitted)


def _event_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a write of its (type, user) row."""
    return tables.scored_events(spark, sf).select(
        "platform", F.regexp_extract("title", " (\\d+)$", 1).alias("source_post_id"), "id",
        "commercial_potential",
        F.when(F.col("commercial_potential") > 2, F.array(F.col("commercial_potential").cast("float"))).alias(
            "embedding"
        ),
        "is_explicit_content", "created_at",
    )


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Events before the middle of the month, then the later ones written over them."""
    writes = _event_updates(spark, sf)
    order = ["created_at", "id"]
    middle = F.lit("2024-01-16").cast("timestamp_ntz").cast("timestamp")
    early, late = writes.filter(F.col("created_at") < middle), writes.filter(F.col("created_at") >= middle)
    base = upsert.latest_updates(early, ["platform", "source_post_id"], order, ["id", "created_at"])
    merged = upsert.upsert_latest(base, late, order=order)
    return shown(merged)


def ingestion_report(spark: SparkSession, sf: str) -> DataFrame:
    seen = tables.sightings(spark, sf).withColumn("source", F.col("platform"))
    failed = F.col("source") == "error"
    fetched = seen.filter(~failed)
    admitted = dedup.dedup_ttl(fetched, ttl_seconds=TWO_DAYS, tie=["event_id"])
    errors = seen.filter(failed).select(
        "source", F.lit("error").alias("outcome"), F.concat("source", F.lit(": fetch failed")).alias("error")
    )
    outcomes = report.ingestion_outcomes(fetched, admitted).unionByName(errors.withColumn("n", F.lit(1).cast("bigint")))
    return shown(report.ingestion_report(outcomes))


# Analytic queries


def latest_insights(spark: SparkSession, sf: str) -> DataFrame:
    return shown(insights.latest_insights(tables.scored_events(spark, sf)))


def latest_with_explicit(spark: SparkSession, sf: str) -> DataFrame:
    return shown(insights.latest_insights(tables.scored_events(spark, sf), 500, include_explicit=True))


def insight_stats(spark: SparkSession, sf: str) -> DataFrame:
    return insights.insight_stats(tables.scored_events(spark, sf), tables.AS_OF.replace(day=30))


def top_platform(spark: SparkSession, sf: str) -> DataFrame:
    return insights.top_platform(tables.scored_events(spark, sf))


def trend_clusters(spark: SparkSession, sf: str) -> DataFrame:
    labels = tables.table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("flag"))
    # Trends are read from stored rows: each text is analysed once, not once per pass.
    stored = cut_lineage(
        analysed(spark, sf).select(
            "doc_id", "cluster_key", "cluster_label", "commercial_potential", "platform", "title",
            "core_pain_point", F.col("published_at").alias("created_at"),
        )
    )
    stored = stored.join(labels, "doc_id", "left").withColumnRenamed("flag", "is_explicit_content")
    return shown(insights.trend_clusters(stored, TREND_AS_OF, TREND_HOURS, 12))


def event_trends(spark: SparkSession, sf: str) -> DataFrame:
    stored = tables.scored_events(spark, sf).withColumn("core_pain_point", F.col("source_url"))
    return shown(insights.trend_clusters(stored, AS_OF, 240, 200))


def live_feed(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.scored_events(spark, sf).select(
        F.col("title").alias("key"), "id", "commercial_potential", "created_at"
    )
    return shown(insights.live_feed(events, 60, "key", "created_at", "id"))


def running_stats(spark: SparkSession, sf: str) -> DataFrame:
    return shown(live.running_stats_history(tables.scored_events(spark, sf)))


# Streams. Each runs until the input is used up, then its result is read.


def _stream(spark: SparkSession, sf: str, name: str, order: str) -> DataFrame:
    """A given table as a stream of several micro-batches, in order of a column."""
    rows = tables.table(spark, sf, name)
    folder = work_path(spark, f"landed-{name}")
    cuts = rows.select(F.percentile_approx(
        F.unix_micros(F.col(order).cast("timestamp")),
        F.array(*[F.lit(i / STREAM_PARTS) for i in range(1, STREAM_PARTS)]),
    )).first()[0] or []
    at = F.unix_micros(F.col(order).cast("timestamp"))
    part = sum(((at >= cut).cast("int") for cut in cuts), F.lit(0))
    # Landed one after another: a file stream goes by the time of its files.
    parts = cut_lineage(rows.withColumn("_part", part))
    files = spark.sparkContext.defaultParallelism
    for i in range(len(cuts) + 1):
        landed = parts.filter(F.col("_part") == i).drop("_part").repartition(files)
        landed.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _finish(writer: DataStreamWriter, name: str) -> None:
    running = writer.queryName(f"{name}-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    running.awaitTermination()


def _to_parquet(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream into a fresh table and read it."""
    folder = work_path(spark, name)
    writer = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
    )
    _finish(writer, name)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = _stream(spark, sf, "events", "ts").select(
        F.col("event_type").alias("platform"), F.col("user_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("seen_at"), "event_id",
    )
    folder = work_path(spark, "dedup")
    ledger = SightingLedger(spark, f"{folder}/ledger", ttl_seconds=TWO_DAYS, tie=["event_id"])
    _finish(dedup_ttl_stream(events, ledger, f"{folder}/checkpoint"), "dedup")
    return shown(ledger.read().select("platform", "id", "seen_at", "event_id"))


def dedup_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """The same out of order: the days are dealt to micro-batches at random, so that most sightings
    come late. What the changes leave admitted is what the batch rule admits."""
    events = tables.table(spark, sf, "events")
    folder = work_path(spark, "corrected")
    rows = cut_lineage(events.select(
        F.col("event_type").alias("platform"), F.col("user_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("seen_at"), "event_id",
        F.pmod(F.xxhash64(F.to_date("ts")), F.lit(STREAM_PARTS)).alias("_part")))
    files = spark.sparkContext.defaultParallelism
    for i in range(STREAM_PARTS):
        rows.where(F.col("_part") == i).drop("_part").repartition(files).write.mode("append").parquet(f"{folder}/landed")
    schema = rows.drop("_part").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/landed")
    ledger = CorrectingLedger(spark, f"{folder}/ledger", ttl_seconds=TWO_DAYS, tie=["event_id"])

    def save(changes: DataFrame, batch_id: int) -> None:
        changes.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    _finish(corrected_stream(stream, ledger, f"{folder}/checkpoint", save), "corrected")
    sign = F.when(F.col("change") == ADMITTED, 1).when(F.col("change") == WITHDRAWN, -1)
    told = spark.read.parquet(f"{folder}/out").groupBy("platform", "id", "seen_at", "event_id").agg(F.sum(sign).alias("n"))
    return shown(told.where("n > 0").drop("n"))


STORE_SCHEMA = (
    "platform string, source_post_id string, id bigint, commercial_potential int, "
    "embedding array<float>, is_explicit_content boolean, created_at timestamp"
)


def _event_store(spark: SparkSession, sf: str) -> InsightStore:
    """All events, streamed into a store of (type, user) rows."""
    folder = work_path(spark, "store")
    store = InsightStore(spark, folder, STORE_SCHEMA, order=["created_at", "id"], buckets=8)
    score = (F.floor("value") % 10 + 1).cast("int")
    stream = _stream(spark, sf, "events", "ts").select(
        F.col("event_type").alias("platform"), F.col("user_id").cast("string").alias("source_post_id"),
        F.col("event_id").alias("id"), score.alias("commercial_potential"),
        F.when(score > 2, F.array(score.cast("float"))).alias("embedding"),
        F.when(F.col("user_id") % 7 == 0, True).when(F.col("user_id") % 7 == 1, False).alias("is_explicit_content"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    _finish(insight_sink(stream, store, f"{folder}/checkpoint"), "store")
    return store


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_event_store(spark, sf).read())


def live_insights(spark: SparkSession, sf: str) -> DataFrame:
    """Saved non-explicit rows, streamed on from the store's change log."""
    changes = _event_store(spark, sf).change_stream()
    texts = {c: F.lit(None).cast("string") for c in rows.SHOWN_TEXTS if c not in changes.columns}
    full = changes.withColumns({
        **texts, "matched_keywords": F.lit(None).cast("array<string>"),
        "published_at": F.lit(None).cast("timestamp"),
    })
    # Every change is handed on; the last one of a row tells how it stands.
    keys, values = ["platform", "source_post_id"], ["commercial_potential", "published_at", "created_at"]
    saved = _to_parquet(spark, live.live_insights(full).select(*keys, *values, "version"), "live")
    last = saved.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("_last"))
    return shown(last.select(*keys, "_last.*"))


def running_stats_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics kept up to date from the store's change log."""
    changes = _event_store(spark, sf).change_stream()
    folder = work_path(spark, "stats")
    totals = live.running_stats(changes, tables.AS_OF.replace(day=30))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    writer = totals.writeStream.outputMode("complete").foreachBatch(save)
    _finish(writer.option("checkpointLocation", f"{folder}/checkpoint"), "stats")
    kept = spark.read.parquet(f"{folder}/out")
    return kept.orderBy(F.col("batch").desc()).limit(1).drop("batch")


def ageing_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics from the change log as of several times, on a stream of them: the first halfway
    through the days, the others while nothing is saved any more."""
    folder = work_path(spark, "ageing")
    kept = stats.HourlyStats(spark, f"{folder}/sums")
    _finish(stats.stats_sink(_event_store(spark, sf).change_stream(), kept, f"{folder}/sums-checkpoint"), "sums")
    # A time in each file, landed in order.
    for hours in (-350, *range(0, 31, 5)):
        tick = F.timestamp_seconds(F.unix_seconds(F.lit(tables.AS_OF)) + hours * 3600 + 1234)
        spark.range(1).select(tick.alias("at")).coalesce(1).write.mode("append").parquet(f"{folder}/ticks")
    ticks = spark.readStream.schema("at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/ticks")

    def save(answer: DataFrame, batch_id: int) -> None:
        answer.coalesce(1).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    _finish(stats.ageing_stats(ticks, kept, f"{folder}/checkpoint", save, "at"), "ageing")
    return shown(spark.read.parquet(f"{folder}/out").drop("batch"))


def live_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Trend clusters from hourly sums that a stream of changes keeps up to date. Updates move rows
    from one cluster to another, as its key has their score in it."""
    folder = work_path(spark, "trends")
    schema = (
        "platform string, source_post_id string, id bigint, commercial_potential int, is_explicit_content boolean, "
        "cluster_key string, cluster_label string, title string, core_pain_point string, created_at timestamp")
    store = InsightStore(spark, f"{folder}/store", schema, order=["created_at", "id"], buckets=2)
    score = (F.floor("value") % 10 + 1).cast("int")
    stream = _stream(spark, sf, "events", "ts").select(
        F.col("event_type").alias("platform"), F.col("user_id").cast("string").alias("source_post_id"),
        F.col("event_id").alias("id"), score.alias("commercial_potential"),
        F.when(F.col("user_id") % 7 == 0, True).when(F.col("user_id") % 7 == 1, False).alias("is_explicit_content"),
        F.concat_ws("::", F.lit("k"), (score % 4).cast("string")).alias("cluster_key"),
        F.lit("").alias("cluster_label"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("title"),
        F.concat(F.lit("pain "), score).alias("core_pain_point"), F.col("ts").cast("timestamp").alias("created_at"),
    )
    _finish(insight_sink(stream, store, f"{folder}/checkpoint"), "trend-store")
    sums = trends.HourlyTrends(spark, f"{folder}/sums", store)
    _finish(trends.trend_sink(store.change_stream(), sums, f"{folder}/sums-checkpoint"), "trends")
    return shown(sums.clusters(LIVE_TRENDS_AS_OF, 72, 12))


def run_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of all four kinds, each fetched twice, through to the store; its rows."""
    folder = work_path(spark, "feed")
    landed = f"{folder}/landed"
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    store = InsightStore(spark, f"{folder}/insights", buckets=8)
    words = {k: KEYWORDS for k in ("forum", "listing", "atom", "transcript")}

    def analyse(batch: DataFrame) -> DataFrame:
        return analyze.analyze_heuristic(batch, **WORDS)

    details = LatestDetails(spark, f"{folder}/details", buckets=8)

    def land(rows: DataFrame) -> None:
        with packed(spark), shuffles_let_go(spark):
            rows.write.mode("append").partitionBy("source").parquet(landed)

    def work_off() -> None:
        files = flow.read_landed(spark, landed, max_files=1_000_000)
        ledger = flow.feed_ledger(spark, f"{folder}/ledger")
        _finish(flow.run_feed(files, store, ledger, f"{folder}/checkpoint", AS_OF, words, analyse=analyse, details=details), "feed")

    # Payloads land a part of the feeds at a time, are worked off, land again, fetched an hour later,
    # and go when they have been worked off once more: of all that is fetched, which is many times
    # the documents, never more lies there at once.
    for part in tables.feed_parts(spark, sf, FEED_PART_BYTES, FEED_PARTS):
        land(tables.all_payloads(spark, sf, part))
        work_off()
        first = spark.read.schema(RAW_SCHEMA).parquet(landed)
        files = files_of(first)
        land(first.withColumn("fetched_at", F.col("fetched_at") + hour))
        delete_paths(spark, files)
        work_off()
        delete_paths(spark, [landed])
    stored = store.read().select(
        "platform", "channel", "content_kind", "source_post_id", "cluster_key", "core_pain_point",
        "commercial_potential", "is_explicit_content", "matched_keywords", "embedding_model",
        F.size("embedding").cast("bigint").alias("dims"), "published_at", "created_at",
    )
    return shown(stored)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        trend_clusters, event_trends, latest_insights, latest_with_explicit, insight_stats, top_platform,
        live_feed, running_stats, clean_pages, parse_times, assign_post_id, match_keywords,
        first_sentences, parse_forum, parse_listing, parse_atom, parse_transcripts,
        conversation_transcripts, union_sources, feed_rejects, limit_per_feed, queue_roundtrip,
        analyze_heuristic, build_prompts, parse_model_output, score_with_model, assign_clusters,
        cluster_sizes, embedding_text, hash_embed, embed_with_model, l2_normalize, semantic_search,
        similar_insights, similar_bulk, search_text, dedup_ttl, dedup_stream, dedup_corrected, upsert_latest,
        stream_upsert, ingestion_report, live_insights, running_stats_stream, ageing_stats, live_trends, run_feed,
    )
}
