"""Line de-duplication by runs of lines.

A line here ends at a line break, or at the end of a sentence within it, so that a passage put
into the middle of other text still consists of whole lines. A passage is at least two lines of
ten words together, or one line of fifty. A hash rolls over the lines: from every line on, the
shortest run of lines that is a passage is a chunk, and so is the shortest that ends with a line,
where no other does. A chunk's borders depend on its own lines only, so whatever passage stands in
two places has equal chunks there, and they cover it from its first line to its last. Borders at
fewer lines would miss passages of two. Chunks whose hash occurs in one place only go at once; the
others are compared byte by byte, and all but the first of equal ones are removed.
DataFrame operations only. Two passes over narrow rows find the documents with suspects; only
their texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlode.llm.common import fresh_name, row_key, table
from feedlode.session import cut_lineage, scratch, shuffles_let_go

#: A passage has this many lines and words, or is one line of LONG_LINE words.
MIN_LINES, MIN_WORDS, LONG_LINE = 2, 10, 50
#: After a line break, or after a sentence end and the space behind it (none behind those of
#: scripts without spaces). The first part, which the second implies, is quick to rule out most
#: places.
LINE_END = r"(?<=[\n 。！？])(?<=\n|[.!?] |[。！？])"
BLANK = " \t\r\n"
#: All blanks between two lines, where they hold such an end: where they begin with it, or hold a
#: line break further on, which is looked for from the first blank only.
GAP = rf"[{BLANK}](?:(?<![^.!?] )(?<![\t\r])|(?=[{BLANK}])(?<![{BLANK}]{{2}})[ \t\r]*+\n)[{BLANK}]*+"
#: What counts as a word in lines with few blanks: a stretch between white space, of a very long
#: one every twenty characters; in scripts without spaces, two letters.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
WORD = rf"[{UNSPACED}]{{1,2}}|[^\s\u00a0{UNSPACED}]{{1,20}}"
FEW_BLANKS = 15
#: A mark that is put at line ends; texts that hold it themselves are split in another way.
MARK = "\x01"
#: Bits of the filter that tells documents without suspects apart: 8 MB, whatever their number. The
#: fuller it is, the more documents are shuffled for nothing.
FILTER_BITS = 1 << 26
#: Places of one chunk that meet its first place in one task.
MOST_PLACES = 10_000
#: First line and number of lines of a place in one number: so many bits are the latter.
SPOT_BITS = 16
SPOT = 1 << SPOT_BITS


def split_lines(text: Column) -> Column:
    """The lines with all that ends them; put together again they are the text."""
    whole = F.coalesce(text, F.lit(""))
    # Split at a single character, which takes no regular expression.
    quick = F.split(_marked(whole), MARK)
    return F.when(F.contains(whole, F.lit(MARK)), F.split(whole, LINE_END)).otherwise(quick)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marked(text: Column) -> Column:
    """The text with a mark after each line."""
    def put(end: str) -> Callable[[Column], Column]:
        # Most texts lack some of these, and to find that out is far cheaper than to replace nothing.
        return lambda x: F.when(F.contains(x, F.lit(end)), F.replace(x, F.lit(end), F.lit(end + MARK))).otherwise(x)

    for end in ("\n", ". ", "! ", "? ", "。", "！", "？"):
        text = _let(text, put(end))
    return text


def _words(lines: Column) -> Column:
    """Words of each line without blanks around it, by the blanks in it if it has one every so many
    bytes at least."""
    tight = F.transform(lines, lambda x: F.octet_length(F.replace(x, F.lit(" "), F.lit(""))))

    def count(line: Column, tight: Column) -> Column:
        plain = F.octet_length(line) - tight + 1
        return F.when(F.octet_length(line) <= FEW_BLANKS * plain, plain).otherwise(
            F.greatest(F.lit(1), F.regexp_count(line, F.lit(WORD))))

    return F.zip_with(lines, tight, count)


def bare_lines(text: Column) -> Column:
    """The lines that are not blank, without the blanks around them."""
    some, broken = F.lit(False), text
    for end in "。！？":
        some = some | F.contains(text, F.lit(end))
        broken = F.replace(broken, F.lit(end), F.lit(end + "\n"))
    # Most texts lack these ends, and to find that out is far cheaper than to replace nothing.
    whole = F.coalesce(F.when(some, broken).otherwise(text), F.lit(""))
    return F.array_remove(F.split(F.concat(F.lit("\n"), whole, F.lit("\n")), GAP), "")


def chunk_hash(*lines: Column) -> Column:
    return F.xxhash64(*lines)


def chunk_places(docs: DataFrame) -> DataFrame:
    """(key_a, first, size, chunk) of (key_a, lines): the shortest passage from each line on, and
    the shortest up to each line where that is none of the others, with a hash of its lines. Lines
    are counted from 0.

    Once the words of each line are counted, all is done in generated code, a line at a time, so
    that no row that is made holds the other lines of its text. That code is kept short, as long
    code is compiled badly or not at all.
    """
    read = docs.select("key_a", "lines", _words(F.col("lines")).alias("words"))
    # The outer form, as the other is given a filter that splits all texts once more.
    read = read.select("key_a", "lines", "words", F.posexplode_outer("lines").alias("at", "line"))
    at = F.col("at")
    word = lambda i: F.get("words", at + i)
    # Words of so many lines from this one on, and up to this one; null beyond the text. As many
    # lines as words are always enough.
    read = read.select("key_a", "lines", "words", "at", word(0).alias("on_1"), word(0).alias("up_1"), word(1).alias("w_next"))
    for n in range(2, MIN_WORDS + 1):
        read = read.select("*", (F.col(f"on_{n - 1}") + word(n - 1)).alias(f"on_{n}"),
                           (F.col(f"up_{n - 1}") + word(1 - n)).alias(f"up_{n}"))
    w, w_next = F.col("on_1"), F.col("w_next")
    onward = up_to = F.lit(None).cast("int")
    for n in range(MIN_WORDS, 1, -1):
        onward = F.when(F.col(f"on_{n}") >= MIN_WORDS, n).otherwise(onward)
        # Up to the next line: without it those are a passage, too, so none that starts there ends here.
        longer = F.when(F.col(f"up_{n - 1}") + w_next < MIN_WORDS, n + 1)
        up_to = F.when(F.col(f"up_{n}") >= MIN_WORDS, longer).otherwise(up_to)
    onward = F.when(w >= LONG_LINE, 1).otherwise(onward)
    up_to = F.when(w_next < LONG_LINE, F.when(w >= LONG_LINE, 2).otherwise(up_to))
    # Most lines have but the first of both.
    one = (w < LONG_LINE) & (F.col("on_2") >= MIN_WORDS)
    ends = F.explode(F.when(one, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    runs = read.select("key_a", "lines", "at", w.alias("w"), onward.alias("onward"), up_to.alias("up_to"), ends.alias("ends"))
    runs = runs.select("key_a", "lines", F.when(F.col("ends") & (F.col("w") < LONG_LINE), at + 2 - F.col("up_to")).otherwise(at)
                       .alias("first"), F.when(F.col("ends"), F.col("up_to")).otherwise(F.col("onward")).alias("size"))
    first, size = F.col("first"), F.col("size")
    line = lambda i: F.get("lines", first + i)
    chunk = (F.when(size == 2, chunk_hash(line(0), line(1))).when(size == 1, chunk_hash(line(0)))
             .otherwise(chunk_hash(F.slice("lines", first + 1, size))))
    return runs.where("size IS NOT NULL").select("key_a", "first", size.cast("short").alias("size"), chunk.alias("chunk"))


def likely(docs: DataFrame, keys: DataFrame, key: str = "key_a", name: str = "likely") -> DataFrame:
    """The rows with a column `name`: false only where the key is none of these. A filter of fixed
    size decides, FILTER_BITS at most, so it can be broadcast whatever the number of keys."""
    word, bits = (fresh_name(n, [*docs.columns, name]) for n in ("word", "bits"))
    place = lambda column: F.pmod(F.col(column), F.lit(FILTER_BITS))
    row = lambda column: F.shiftright(place(column), 6)
    bit = lambda column: F.pmod(place(column), F.lit(64)).cast("int")
    own = keys.select(row(key).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), bit(key)).alias(bits))
    own = own.groupBy(word).agg(F.bit_or(bits).alias(bits))
    found = docs.withColumn(word, row(key)).join(F.broadcast(own), word, "left")
    return found.withColumn(name, F.coalesce(F.getbit(bits, bit(key)) == 1, F.lit(False))).drop(word, bits)


def repeated_places(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(key_a, key_b, places): per document the (first, last) lines, counted from 1 among those that
    are not blank, of chunks that stand, byte for byte, in an earlier place too. Earlier is the
    smaller `order`, then key, then line. A document that is one line and equals another such is
    a copy, not a passage within a text, and stays."""
    own = docs.select("key_a", "key_b", F.col(f"`{order}`").alias("rank"), F.col(f"`{text}`").alias("doc_text"))
    # Written down, as finding them costs more than reading them twice. Texts that share a key of 64
    # bits get each other's suspects, which their bytes rule out.
    lines = own.select("key_a", bare_lines(F.col("doc_text")).alias("lines"))
    places = cut_lineage(chunk_places(lines))
    # Rows that repeat key and text are one document: they only make more suspects. Joins here are
    # by hash: what they hold is narrow and small beside the other side, which need not be sorted.
    again = places.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1")
    again = cut_lineage(again.select("chunk", F.ceil(F.col("n") / MOST_PLACES).cast("int").alias("parts")))
    # Most chunks stand in one place; the filter rules nearly all of those out before the shuffle.
    some = likely(places, again, "chunk").where("likely").drop("likely")
    # The places of a chunk in one text are one row from here on; all rows of a chunk are together.
    met = some.join(again.hint("shuffle_hash"), "chunk").groupBy("key_a", "chunk", "parts").agg(
        F.collect_set(F.col("first").cast("long") * SPOT + F.col("size")).alias("spots"))
    suspects = cut_lineage(met.groupBy("key_a").agg(F.collect_list(F.struct("chunk", "parts", "spots")).alias("suspects")))
    texts = likely(own, suspects.select("key_a")).where("likely")
    read = texts.join(suspects.hint("shuffle_hash"), "key_a").select("key_a", "key_b", "rank", "suspects", "doc_text")
    read = _once(read, "lines", bare_lines(F.col("doc_text")))
    first = lambda s: F.shiftright(s, SPOT_BITS).cast("int")
    size = lambda s: F.pmod(s, F.lit(SPOT)).cast("int")
    spelt = lambda s: F.struct(
        F.array_join(F.slice("lines", first(s) + 1, size(s)), "\n").alias("bytes"),
        (first(s) + 1).alias("first"), (first(s) + size(s)).alias("last"))
    fits = lambda spots: F.filter(spots, lambda s: first(s) + size(s) <= F.size("lines"))
    # Spelt out before they are made rows, so that no row holds the other lines of its text.
    each = read.select("key_a", "key_b", "rank", (F.size("lines") == 1).alias("alone"), F.inline(F.transform(
        "suspects", lambda x: F.struct(x["chunk"].alias("chunk"), x["parts"].alias("parts"),
                                       F.transform(fits(x["spots"]), spelt).alias("spelt")))))
    # One row for all places of a text that are equal.
    each = each.select("*", F.explode(F.array_distinct("spelt.bytes")).alias("bytes"))
    runs = F.transform(F.filter("spelt", lambda s: s["bytes"] == F.col("bytes")),
                       lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    each = each.select("key_a", "key_b", "rank", "chunk", "parts", "alone", "bytes", runs.alias("runs"))
    found = cut_lineage(each.select("chunk", "parts", "bytes", F.struct(
        F.col("rank").isNull().alias("last_null"), "rank", "key_a", "key_b",
        (F.array_min("runs.first") - 1).alias("first"), "alone").alias("place"), "runs"))
    # The first of equal bytes; the hash deals the rows out, the bytes decide.
    usual = found.where("parts = 1").withColumn("kept", F.min("place").over(Window.partitionBy("chunk", "bytes")))
    # Of a chunk that very many have, it meets the texts in parts.
    hot = found.where("parts > 1")
    firsts = hot.groupBy("chunk", "bytes").agg(F.min("place").alias("kept"), F.max("parts").alias("parts"))
    firsts = firsts.select("chunk", "bytes", "kept", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    hot = hot.withColumn("part", F.pmod("place.key_a", "parts").cast("int")).join(firsts, ["chunk", "part", "bytes"])
    own = ["place", "kept", "runs"]
    met = usual.select(*own).unionByName(hot.select(*own))
    # All places but the first of all.
    later = F.filter("runs", lambda r: (F.col("place") != F.col("kept")) | (r["first"] > F.col("kept.first") + 1))
    met = met.where("NOT (place <> kept AND place.alone AND kept.alone)").select(
        "place.key_a", "place.key_b", later.alias("runs"))
    return met.where(F.size("runs") > 0).groupBy("key_a", "key_b").agg(
        F.flatten(F.collect_list("runs")).alias("places"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose value is worked out once per row, however often it is used: what is
    used within a function over an array would else be worked out per element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def dedup_lines(docs: DataFrame, text: str = "text", order: str = "doc_id",
                removed: str = "n_removed") -> DataFrame:
    """All columns of the rows, the text without repeated passages, and the number of lines removed.

    A null text stays null, an empty one empty. Rows that repeat the order column and the text
    are one document and are treated alike, so none of them loses its text to another. A column
    that bears the result's name is replaced. Texts are split in the JVM one by one: memory
    follows the longest.
    """
    names = [c for c in docs.columns if c.lower() != removed.lower()]
    taken = [*names, removed]
    key_a, key_b, places, lines, kept, numbers, marked = (
        fresh_name(n, taken) for n in ("key_a", "key_b", "places", "lines", "kept", "numbers", "likely"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], *row_key(order, text))
    keyed = keyed.toDF(*names, key_a, key_b)
    narrow = docs.select(F.col(f"`{order}`").alias("doc_order"), F.col(f"`{text}`").alias("doc_text"))
    narrow = narrow.select("*", *row_key("doc_order", "doc_text"))
    # What is written on the way goes as soon as the places are known.
    with shuffles_let_go(docs.sparkSession), scratch(docs.sparkSession):
        found = cut_lineage(repeated_places(narrow, "doc_text", "doc_order"), kept=True)
    every = likely(keyed, found.select(F.col("key_a").alias(key_a)), key_a, marked)
    own = [F.col(f"`{c}`") for c in names]
    plain = every.where(~F.col(marked)).select(*own, F.lit(0).cast("long").alias(removed))
    joined = every.where(marked).join(found.toDF(key_a, key_b, places).hint("shuffle_hash"), [key_a, key_b], "left")
    # Lines are wanted only where some go.
    split = F.when(F.col(places).isNotNull(), split_lines(F.col(f"`{text}`")))
    spread = _once(joined, lines, split)
    # Places are counted among lines that are not blank: the number of each of those.
    # Nearly all begin with a byte beyond the blanks, which is quick to see.
    holds = lambda x: (x >= F.lit("!")) | x.rlike(rf"[^{BLANK}]")
    bare = F.filter(F.transform(lines, lambda x, i: F.when(holds(x), i + 1)), lambda i: i.isNotNull())
    spread = _once(spread, numbers, bare)
    gone = F.flatten(F.transform(F.col(places), lambda p: F.sequence(
        F.element_at(numbers, p["first"]), F.element_at(numbers, p["last"]))))
    left = F.array_except(F.sequence(F.lit(1), F.size(lines)), gone)
    spread = _once(spread, kept, F.when(F.col(places).isNotNull(), left))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i)), "")
    new_text = F.when(F.col(kept).isNull(), F.col(f"`{text}`")).otherwise(rest)
    count = F.when(F.col(kept).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    changed = spread.select(*[new_text.alias(c) if c == text else F.col(f"`{c}`") for c in names], count.alias(removed))
    return plain.unionByName(changed)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
