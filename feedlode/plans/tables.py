"""Views of the given tables as payloads, posts, sightings and insights."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
KEYWORDS = ["license", "data", "worthless", "double", "that"]
# More than the items of one feed that are read of some kinds.
FEED_SIZE = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. How finely its files are split is left to the session's settings."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes_after_start(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + minutes * 60)


def document_posts(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """Documents as posts: the first line with text is the title. ``where`` is a condition on
    the columns of the table."""
    first_line = F.regexp_extract("text", "(?s)\\A[\\t\\n\\f\\r ]*([^\\n]*)", 1)
    documents = table(spark, sf_dir, "documents")
    return (documents if where is None else documents.where(where)).select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("platform"),
        F.col("lang").alias("channel"),
        F.lit("post").alias("content_kind"),
        first_line.alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("doc://"), F.col("doc_id")).alias("url"),
        F.lit("").alias("author"),
        minutes_after_start(F.col("doc_id")).alias("published_at"),
        F.array().cast("array<string>").alias("matched_keywords"),
        "doc_id",
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("platform"),
        F.col("user_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        "event_id",
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as insights: one id per event, score from the value."""
    text = F.lit(None).cast("string")
    missing = [
        "cluster_label", "author", "raw_content", "core_pain_point", "current_workaround",
        "saas_feasibility", "analysis_model", "embedding_model",
    ]
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("platform"),
        F.col("event_type").alias("channel"),
        F.lit("post").alias("content_kind"),
        F.concat_ws("::", F.col("event_type"), (F.col("user_id") % 10).cast("string")).alias("cluster_key"),
        F.col("event_id").cast("string").alias("source_post_id"),
        F.concat_ws(" ", F.col("event_type"), F.col("user_id").cast("string")).alias("title"),
        F.concat(F.lit("event://"), F.col("event_id")).alias("source_url"),
        (F.floor("value") % 10 + 1).cast("int").alias("commercial_potential"),
        F.when(F.col("user_id") % 7 == 0, True).when(F.col("user_id") % 7 == 1, False).alias(
            "is_explicit_content"
        ),
        F.lit(None).cast("array<string>").alias("matched_keywords"),
        F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("timestamp")).alias("published_at"),
        F.col("ts").cast("timestamp").alias("created_at"),
        *[text.alias(c) for c in missing],
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as insights; every seventh label is explicit."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("cluster_key"),
        (F.col("label") == 7).alias("is_explicit_content"),
        "embedding",
    )


def _feed_number() -> Column:
    return F.floor(F.col("doc_id") / FEED_SIZE).cast("bigint")


def _payloads(df: DataFrame, source: str, feed: Column, fetched: Column, payload: Column) -> DataFrame:
    return df.select(
        F.lit(source).alias("source"), feed.alias("feed"), fetched.alias("fetched_at"),
        payload.alias("payload"),
    )


def _in_feeds(docs: DataFrame, item: Column) -> DataFrame:
    """Items of 25 documents at a time, in order of id."""
    return docs.groupBy(_feed_number().alias("n")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col("doc_id"), item.alias("item")))),
            lambda s: s["item"],
        ).alias("items")
    )


def forum_payloads(spark: SparkSession, sf_dir: str, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Lists of 25 documents as JSON; those not in English also have a detail payload."""
    docs = document_posts(spark, sf_dir, where)
    item = F.struct(
        F.col("doc_id").alias("id"), "title",
        F.concat(F.lit("<p>"), F.col("content"), F.lit("</p>")).alias("excerpt"),
        F.date_format(F.col("published_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
        F.when(F.col("channel") == "fr", "Anonymous").otherwise(F.col("platform")).alias("school"),
    )
    feeds = _in_feeds(docs, item)
    fetched = minutes_after_start(F.col("n"))
    lists = _payloads(feeds, "forum", F.concat(F.lit("f"), F.col("n") % 7), fetched, F.to_json("items"))
    full = F.concat(F.lit("<b>Full</b> "), F.col("content"))
    detail = F.to_json(F.struct(full.alias("content")))
    some = docs.filter(F.col("channel") != "en")
    details = _payloads(some, "forum_detail", F.col("id"), F.col("published_at"), detail)
    return lists, details


def listing_payloads(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    item = F.struct(
        F.struct(
            F.col("id"), "title", F.col("content").alias("selftext"),
            F.concat(F.lit("/d/"), F.col("id")).alias("permalink"), F.col("platform").alias("author"),
            (F.unix_seconds("published_at") + F.lit(0.5)).alias("created_utc"),
        ).alias("data")
    )
    feeds = _in_feeds(document_posts(spark, sf_dir, where), item)
    payload = F.to_json(F.struct(F.struct(F.col("items").alias("children")).alias("data")))
    return _payloads(
        feeds, "listing", F.concat(F.lit("sub"), F.col("n") % 5), minutes_after_start(F.col("n")), payload
    )


def _xml_text(col: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(sign), F.lit(entity))
    # XML 1.0 has no such characters; line ends are read as newlines.
    return F.regexp_replace(col, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")


def atom_payloads(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """Feeds of 25 documents as Atom XML; French documents have a blank id, German ones have
    markup within their text, of which only the direct text counts."""
    inner = F.concat(F.lit("<div><p>"), _xml_text(F.col("title")), F.lit("</p>" + "<p>in<b>ner</b></p> " * 8 + "</div>"))
    body = _xml_text(F.col("content"))
    entry = F.concat(
        F.lit("<entry><id>"), F.when(F.col("channel") == "fr", " ").otherwise(F.col("id")),
        F.lit("</id><title>"), _xml_text(F.col("title")),
        F.lit('</title><summary type="text">'), F.col("channel"),
        F.when(F.col("channel") == "de", F.concat(F.lit('</summary><content type="xhtml">'), body, inner))
        .otherwise(F.concat(F.lit('</summary><content type="text">'), body)),
        F.lit("</content><updated>"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        F.lit('</updated><author><name>'), F.col("platform"),
        F.lit('</name></author><link rel="self" href="x://self"/><link href="'), F.col("url"),
        F.lit('"/></entry>'),
    )
    feeds = _in_feeds(document_posts(spark, sf_dir, where), entry)
    payload = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed '), F.col("n").cast("string"),
        F.lit("</title>"), F.array_join("items", ""), F.lit("</feed>"),
    )
    return _payloads(
        feeds, "atom", F.concat(F.lit("app"), F.col("n")), minutes_after_start(F.col("n")), payload
    )


def transcript_payloads(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """Feeds of 25 documents as JSON; French ones have no id, English ones no transcript."""
    item = F.struct(
        F.when(F.col("channel") != "fr", F.col("id")).alias("id"),
        F.when(F.col("platform") == "src7", " ").otherwise(F.col("platform")).alias("platform"),
        "channel", "title",
        F.when(F.col("channel") != "en", F.col("content")).alias("transcript"),
        F.concat(F.lit("<i>c</i> "), F.col("content")).alias("content"),
        "url", "author",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
    )
    feeds = _in_feeds(document_posts(spark, sf_dir, where), item)
    return _payloads(
        feeds, "transcript", F.concat(F.lit("t"), F.col("n")), minutes_after_start(F.col("n")),
        F.to_json(F.struct("items")),
    )


def all_payloads(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    lists, details = forum_payloads(spark, sf_dir, where)
    rest = [f(spark, sf_dir, where) for f in (listing_payloads, atom_payloads, transcript_payloads)]
    raw = lists.unionByName(details)
    for other in rest:
        raw = raw.unionByName(other)
    return raw


def feed_parts(spark: SparkSession, sf_dir: str, part_bytes: int, most: int) -> list[Column]:
    """Conditions that part the documents by whole feeds, in order of id, into parts of about so
    many bytes each as stored, but of no more than ``most`` in number."""
    documents = table(spark, sf_dir, "documents")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    stored = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    parts = min(most, -(-stored // part_bytes))
    shares = [F.lit(i / parts) for i in range(1, parts)]
    found = documents.select(F.percentile_approx(_feed_number(), F.array(*shares))).first()[0] if shares else None
    cuts = sorted({n * FEED_SIZE for n in found or []})
    if not cuts:
        return [F.lit(True)]
    key = F.col("doc_id")
    inner = [(key >= low) & (key < high) for low, high in zip(cuts, cuts[1:])]
    return [key.isNull() | (key < cuts[0]), *inner, key >= cuts[-1]]


