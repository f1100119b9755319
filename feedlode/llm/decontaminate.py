"""Benchmark decontamination with a positional inverted index.

Every benchmark item is cut into windows of consecutive words. The corpus is indexed once: for
each window's rarest words (by corpus count) the index stores where they stand in which
document, with the words around. A window's places are found by intersecting the lists of its
rarest words, moved by their offsets; what is left is compared word by word. DataFrame
operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import WORDS_SQL, broadcast_if_small, fresh_name, row_key, split_words, table
from feedlode.session import cut_lineage

WINDOW = 10
#: Rarest distinct words of a window whose lists are intersected.
RAREST = 2
#: Most rows of the benchmark's words and windows that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Stands at the end of every document's words; no word can be equal to it.
END = "\n"


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item_id, words): all runs of `size` words of an item, or all of its words if fewer."""
    words = F.filter(split_words(F.col(f"`{text}`")), lambda w: w != "")
    read = items.select(F.col(f"`{item}`").alias("item_id"), words.alias("all_words"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all_words") - size + 1))
    return (read.where(F.size("all_words") > 0)
            .select("item_id", "all_words", F.explode(starts).alias("start"))
            .select("item_id", F.slice("all_words", F.col("start"), size).alias("words")))


def _corpus_words(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("key_a", "key_b", split_words(F.col(f"`{text}`")).alias("doc_words"))


def word_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word of the vocabulary occurs in the corpus."""
    spread = docs.select(F.explode(split_words(F.col(f"`{text}`"))).alias("word"))
    counts = spread.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    return vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass
class Index:
    """Windows with their rarest words, and the stored places of these words."""

    #: phrase, words, and anchors: array of (n, word, offset), rarest first.
    windows: DataFrame
    #: (phrase, item_id)
    items: DataFrame
    #: (key_a, key_b, word, place, around, around_from); word END: place is the size.
    postings: DataFrame
    few_windows: int


def build_index(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id",
                item_text: str = "text", size: int = WINDOW) -> Index:
    """Index documents with columns key_a, key_b and text for the windows of the items.

    The benchmark's words are looked up while the documents are read: only places of windows'
    rarest words are stored, each with the words up to a window's size to either side.
    """
    pairs = cut_lineage(item_windows(items, item, item_text, size)
                        .select(F.array_join("words", " ").alias("phrase"), "words", "item_id").distinct())
    n_pairs = pairs.count()
    windows = pairs.select("phrase", "words").distinct()
    spread = windows.select("phrase", F.posexplode("words").alias("offset", "word"))
    # The first place of a word in the window stands for it.
    spread = spread.groupBy("phrase", "word").agg(F.min("offset").alias("offset"))
    vocabulary = broadcast_if_small(spread.select("word").distinct(), n_pairs * size, BROADCAST_ROWS)
    counts = cut_lineage(word_counts(docs, vocabulary, text))
    ranked = (spread.join(broadcast_if_small(counts, n_pairs * size, BROADCAST_ROWS), "word")
              .groupBy("phrase").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "word", "offset"))),
                                             1, RAREST).alias("anchors")))
    # A window with a word that the corpus lacks can't occur.
    windows = cut_lineage(windows.join(ranked, "phrase").where(F.col("anchors")[0]["n"] > 0))
    anchors = (windows.select(F.explode("anchors").alias("a")).select(F.col("a.word").alias("word")).distinct())
    anchors = anchors.unionAll(docs.sparkSession.range(1).select(F.lit(END).alias("word")))
    words = _corpus_words(docs, text).withColumn("doc_words", F.array_append("doc_words", F.lit(END)))
    spread = words.select("key_a", "key_b", "doc_words", F.posexplode("doc_words").alias("place", "word"))
    kept = spread.join(broadcast_if_small(anchors, n_pairs * RAREST, BROADCAST_ROWS), "word")
    first = F.greatest(F.lit(0), F.col("place") - (size - 1))
    is_end = F.col("word") == END
    # Empty words that a split leaves first and last are not words.
    edges = ((F.col("doc_words")[0] == "").cast("int")
             + ((F.col("place") > 1) & (F.get("doc_words", F.col("place") - 1) == "")).cast("int"))
    postings = kept.select(
        "key_a", "key_b", "word",
        F.when(is_end, F.col("place") - edges).otherwise(F.col("place")).alias("place"),
        F.when(~is_end, F.slice("doc_words", first + 1, 2 * size - 1)).alias("around"),
        first.alias("around_from"))
    return Index(windows, pairs.select("phrase", "item_id"), cut_lineage(postings), n_pairs)


def _candidates(index: Index, adjusted: Column) -> DataFrame:
    """Places of the windows' rarest words, each moved back by the word's offset."""
    lists = index.windows.select(
        "phrase", F.size("words").alias("n_words"), F.size("anchors").alias("n_anchors"),
        F.posexplode("anchors").alias("rank", "anchor"))
    lists = lists.select("phrase", "n_words", "n_anchors", "rank", "anchor.word", "anchor.offset")
    lists = broadcast_if_small(lists, index.few_windows * RAREST, BROADCAST_ROWS)
    found = index.postings.where(F.col("word") != END).join(lists, "word")
    return found.withColumn("start", adjusted)


def phrase_places(index: Index) -> DataFrame:
    """(key_a, key_b, phrase, start, n_words): every exact place of every window."""
    start = F.col("place") - F.col("offset")
    moved = _candidates(index, start).where("start >= 0")
    # Compared where the rarest word stands: its neighbourhood covers the window.
    here = F.slice("around", F.greatest(F.lit(1), F.col("start") - F.col("around_from") + 1), F.col("n_words"))
    exact = (F.col("rank") == 0) & (F.array_join(here, " ") == F.col("phrase"))
    met = moved.groupBy("key_a", "key_b", "phrase", "start").agg(
        F.first("n_words").alias("n_words"), F.first("n_anchors").alias("n_anchors"),
        # One bit per word whose list has the place.
        F.bit_or(F.expr("shiftleft(1, rank)")).alias("ranks"), F.max(exact).alias("exact"))
    return met.where("ranks = shiftleft(1, n_anchors) - 1 AND exact").select("key_a", "key_b", "phrase", "start", "n_words")


def near_places(index: Index, slack: int) -> DataFrame:
    """(key_a, key_b, phrase, start, gap): where a window's rarest words stand at most `slack`
    words off their distance in the window; gap 0 are places of the words as in the window.

    Windows with a single distinct word have exact places only.
    """
    moved = _candidates(index, F.col("place") - F.col("offset"))
    first = moved.where("rank = 0").select("key_a", "key_b", "phrase", "start")
    other = moved.where("rank = 1").select("key_a", "key_b", "phrase", F.col("start").alias("other"))
    # Equal or neighbouring stretches of slack + 1 words hold all pairs, and few others.
    width = slack + 1
    here = first.withColumn("stretch", F.floor(F.col("start") / width))
    near = other.withColumn("stretch", F.explode(F.array(*[
        F.floor(F.col("other") / width) + d for d in (-1, 0, 1)])))
    gap = F.abs(F.col("start") - F.col("other"))
    return (here.join(near, ["key_a", "key_b", "phrase", "stretch"]).where(gap <= slack)
            .groupBy("key_a", "key_b", "phrase", "start").agg(F.min(gap).alias("gap")))


def _covered(spans: Column) -> Column:
    """Number of places within sorted (start, end) spans."""
    step = lambda done, s: F.struct(
        (done["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], done["reach"]))).alias("n"),
        F.greatest(done["reach"], s["end"]).alias("reach"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(spans, zero, step, lambda done: done["n"])


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, n_items, item_ids) of every row of the documents.

    n_hit counts words inside any place of a window; item_ids are the sorted ids, as strings, of
    the items with a place. Null and empty texts have no words; items without words have no
    windows. Rows that repeat a key and a text get the same result each; null keys are kept.
    Other columns are left out, so their names don't matter.
    """
    keyed = docs.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").alias("doc_text"))
    keyed = keyed.select("doc_key", "doc_text", *row_key("doc_key", "doc_text"))
    index = build_index(keyed, items, "doc_text", item, item_text, size)
    places = cut_lineage(phrase_places(index))
    spans = places.groupBy("key_a", "key_b").agg(F.array_sort(F.collect_set(
        F.struct("start", (F.col("start") + F.col("n_words")).alias("end")))).alias("spans"))
    hits = spans.select("key_a", "key_b", _covered(F.col("spans")).alias("n_hit"))
    found = (places.select("key_a", "key_b", "phrase").distinct()
             .join(broadcast_if_small(index.items, index.few_windows, BROADCAST_ROWS), "phrase")
             .groupBy("key_a", "key_b").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))
    sizes = index.postings.where(F.col("word") == END).select("key_a", "key_b", F.col("place").alias("n_words"))
    ids = keyed.select(F.col("doc_key").alias(key), "key_a", "key_b")
    # One row per key: repeated rows would multiply in the join.
    sizes = sizes.distinct().join(hits.join(found, ["key_a", "key_b"]), ["key_a", "key_b"], "left")
    return ids.join(sizes, ["key_a", "key_b"]).select(
        F.col(f"`{key}`"), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                      item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows, all columns, whose text holds no window of an item; null texts are kept."""
    names = docs.columns
    key_a, key_b = (fresh_name(n, names) for n in ("key_a", "key_b"))
    narrow = docs.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").alias("doc_text"))
    narrow = narrow.select("doc_text", *row_key("doc_key", "doc_text"))
    places = phrase_places(build_index(narrow, items, "doc_text", item, item_text, size))
    hit = cut_lineage(places.select("key_a", "key_b").distinct()).toDF(key_a, key_b)
    keyed = docs.select("*", *row_key(key, text)).toDF(*names, key_a, key_b)
    return keyed.join(hit, [key_a, key_b], "left_anti").drop(key_a, key_b)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents
), items AS (
  SELECT item_id, {WORDS_SQL} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[i:i + {WINDOW - 1}] AS phrase, len(w[i:i + {WINDOW - 1}]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, i, n, w[i:i + n - 1] AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), hits AS (
  SELECT r, i, places.n, item_id FROM places JOIN windows USING (phrase)
), words AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
