"""Spelling variants: words that differ by one character, found by an index of variable-length grams.

A dictionary of grams is built from the words themselves: a gram is made longer only while it
stands in many words, so that common beginnings are told apart by longer grams and lists of the
index stay short. A word is decomposed by it: from a place on, its gram is the shortest that the
dictionary doesn't go on from, half the word at most. Such a gram depends on its own characters
only, so an edit affects it only from within. Of each word two grams that don't overlap are
chosen, those of the shortest lists: one edit affects one of the two at most, and the other
stands in the near word as far from the begin, or from the end, as here. Their lists, merged,
hold every near word; what they hold besides is ruled out by the edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import LOWER, UPPER, table
from feedlode.session import cut_lineage

#: Letters of a word, lower-cased; a word has so many of them, and occurs so often, at least.
LETTERS = "a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 5, 3
#: One in so many runs, drawn by its digest, is taken without one of its letters.
SLIP = 97
#: A form occurs so many times as often as the word.
FORM_RATIO = 2
#: Shortest and longest gram; a gram that stands in more places than this is made longer.
SHORTEST, LONGEST, COMMON = 2, 8, 32
#: Most grams that the dictionary makes longer; beyond that, only more common ones are.
MOST_GRAMS = 400_000


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of the whole texts with the number of their occurrences.

    A null text has no words, a null key counts as an empty one. Rows that repeat count again.
    """
    lowered = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER)
    # Shorter runs can't become words; greedy, so that a match is a whole run.
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))
    own = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    read = docs.select(own.alias("own"), F.explode(runs).alias("run"))
    drawn = read.select("run", F.crc32(F.concat("own", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    without_one = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = drawn.select(F.when(F.col("h") % SLIP == 0, without_one).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= MIN_COUNT))


def gram_counts(words: DataFrame, word: str = "word") -> DataFrame:
    """(gram, n): in how many places of the words each gram stands, up to half of each word."""
    size = F.length(word)
    most = F.least(F.floor(size / 2), F.lit(LONGEST)).cast("int")
    of_length = lambda q: F.transform(F.sequence(F.lit(1), size - q + 1), lambda p: F.substring(word, p, q))
    grams = F.flatten(F.transform(F.sequence(F.lit(SHORTEST), most), of_length))
    long_enough = words.where(size >= 2 * SHORTEST)
    return long_enough.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def common_grams(words: DataFrame, word: str = "word", most: int | None = None) -> dict[str, int]:
    """The grams that are made longer, with their counts: at most `most`, whatever the words.

    Whatever is common has a common beginning, so the dictionary can be walked letter by letter.
    """
    most = MOST_GRAMS if most is None else most
    counts = cut_lineage(gram_counts(words, word).where(F.col("n") > COMMON))
    # By powers of two, so that a row per power comes to the driver.
    powers = counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()
    least = COMMON
    while sum(r["count"] for r in powers if 2 ** (r["power"] + 1) > least + 1) > most:
        least = 2 ** int(least + 1).bit_length() - 1
    return {r["gram"]: r["n"] for r in counts.where(F.col("n") > least).collect()}


def gram_at(word: str, place: int, most: int, common: Mapping[str, int]) -> str:
    """The gram from a place on, of `most` characters at most."""
    size = SHORTEST
    while size < most and word[place:place + size] in common:
        size += 1
    return word[place:place + size]


def _longest(size: int) -> int:
    return min(size // 2, LONGEST)


def listed(word: str, common: Mapping[str, int]) -> set[str]:
    """All lists of the index that the word is in: grams with their side and distance from it,
    for decompositions of words that are as long as this one, or longer or shorter by one."""
    size, out = len(word), set()
    for most in {_longest(n) for n in (size - 1, size, size + 1) if n >= MIN_LENGTH}:
        for place in (0, 1):
            out.add(f"<{place}{gram_at(word, place, most, common)}")
        for back in (most, most + 1):
            if back <= size:
                out.add(f">{back} {gram_at(word, size - back, most, common)}")
    return out


def merged(word: str, common: Mapping[str, int]) -> tuple[str, str]:
    """The two lists that hold every near word: grams that one edit can't both affect, as they
    don't overlap; of several such pairs the one of the least places."""
    size = len(word)
    most = _longest(size)
    best = None
    for place in (0, 1):
        left = gram_at(word, place, most, common)
        for back in (most, most + 1):
            if place + len(left) > size - back:
                continue
            right = gram_at(word, size - back, most, common)
            cost = common.get(left, COMMON) + common.get(right, COMMON)
            if best is None or cost < best[0]:
                best = cost, f"<{place}{left}", f">{back} {right}"
    return best[1:]


def gram_index(words: DataFrame, common: Mapping[str, int], word: str = "word") -> DataFrame:
    """All columns, and the lists that each word is `listed` in and those `merged` for it."""
    shared = words.sparkSession.sparkContext.broadcast(dict(common))
    extra = [F.lit(None).cast("array<string>").alias(c) for c in ("listed", "merged")]
    place = words.columns.index(word)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            own = batch.column(place).to_pylist()
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([sorted(listed(w, known)) for w in own], kind),
                 pa.array([merged(w, known) for w in own], kind)],
                [*batch.schema.names, "listed", "merged"])

    return words.mapInArrow(work, words.select("*", *extra).schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of (word, n): each pair of distinct words that differ by exactly one
    inserted, deleted or replaced code point, both ways; a pair that both lists hold comes twice.

    The words must be distinct, not null and of MIN_LENGTH code points at least.
    """
    indexed = cut_lineage(gram_index(words, common_grams(words)))
    lists = indexed.select(F.explode("listed").alias("list"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    wanted = indexed.select(F.explode("merged").alias("list"), "word")
    # The join's own condition, so that no row is made of a candidate that is none.
    close = ((wanted["list"] == lists["list"])
             & (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1))
    return wanted.join(lists, close).select("word", "near", "near_n")


def follow(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last that is reached from form to form. The links must
    not go round in a circle. Each round goes twice as far; rows of a word are never gathered."""
    found = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(found.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        found = step.select("word", "root")
        if step.where("moved").isEmpty():
            return found


def variant_groups(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per row of (word, n).

    The form is the near word of the largest n, of several the smallest in code-point order,
    if that n is FORM_RATIO times the word's at least. As n grows from form to form, no chain
    is long or closed; the root is its last word, the word itself if it has no form. Without
    words there are no rows.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count_distinct("near").alias("n_near"), best)
    joined = words.select("word", "n").join(near, "word", "left")
    has_form = -F.col("best.order") >= FORM_RATIO * F.col("n")
    found = cut_lineage(joined.select(
        "word", "n", F.when(has_form, F.col("best.near")).alias("form"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, -F.col("best.order")).alias("form_n")))
    roots = follow(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variant_groups(cut_lineage(word_counts(docs)))
