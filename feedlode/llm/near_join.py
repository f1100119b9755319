"""Similarity join of texts on the Jaccard similarity of their word n-grams.

Texts with the same set of n-grams are one class from the start. Of every class, minimum hashes
are arranged as the labels of a forest: each tree orders the classes by its own row of hashes,
and classes with a common prefix in a tree are candidates. Prefixes are shortened until pairs
at the threshold are found with the target recall. Candidates that hang together are then
compared exactly, all with all, in blocks: whole pairs never leave a task, only the number of
links of each class and enough links to tell what hangs together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import WORDS_SQL, fresh_name, row_key, small_batches, table
from feedlode.llm.graph import components
from feedlode.llm.words import NOT_ALNUM, Words, chained, mixed, ngram_starts
from feedlode.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
#: Trees, hashes of a tree's label, and the share of pairs at the threshold to be found.
TREES, LABEL, RECALL = 24, 6, 0.9999
#: Classes that are compared all with all in one task, and n-grams counted at once.
BLOCK, COLUMNS = 512, 16_384
#: A character of a word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Classes of small groups that share a task.
TOGETHER = 2_000


def prefix_length(similarity: float, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> int:
    """The longest prefix that finds pairs of this similarity with the recall; at least 1."""
    length = label
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


class Shingles:
    """Sets of hashed word n-grams, and the labels of the forest."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size = size
        self.words = Words.between(NOT_ALNUM)
        seeds = mixed(np.arange(1, 2 * TREES * LABEL + 1, dtype=np.uint64))
        self.flips = (seeds[::2] >> np.uint64(32)).astype(np.uint32)
        self.factors = (seeds[1::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def sets(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct n-grams of each text, one after another, and where each begins.

        A text of fewer words, but not none, has all its words as its one n-gram.
        """
        hashes, bounds = self.words.read(column)
        n = self.size
        begin = np.flatnonzero(ngram_starts(bounds, n))
        grams = chained(*[hashes[begin + i] for i in range(n)]) if len(begin) else np.empty(0, np.uint64)
        cuts = np.searchsorted(begin, bounds)
        parts, sizes = [], []
        for i in range(len(bounds) - 1):
            own = grams[cuts[i]:cuts[i + 1]]
            if len(own):
                own = np.unique(own)
            elif bounds[i] < bounds[i + 1]:
                few = hashes[bounds[i]:bounds[i + 1]]
                own = chained(*[few[j:j + 1] for j in range(len(few))], np.full(1, len(few), np.uint64))
            parts.append(own)
            sizes.append(len(own))
        return (np.concatenate(parts) if parts else grams), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def prefixes(self, grams: np.ndarray, cuts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of each tree's prefix, (texts, trees); texts must have n-grams."""
        low = (grams >> np.uint64(32)).astype(np.uint32)
        keys = np.empty((len(cuts) - 1, TREES), np.uint64)
        for tree in range(TREES):
            key = np.full(len(cuts) - 1, tree + 1, np.uint64)
            for j in range(tree * LABEL, tree * LABEL + length):
                value = (low ^ self.flips[j]) * self.factors[j]
                value ^= value >> np.uint32(15)
                value *= np.uint32(0x2C1B3C6D)
                key = chained(key, np.minimum.reduceat(value, cuts[:-1]).astype(np.uint64))
            keys[:, tree] = key
        return keys


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[cuts[1:]] - sums[cuts[:-1]]


def read_sets(docs: DataFrame, length: int) -> DataFrame:
    """(doc_key, key_a, key_b, node, n_grams, prefixes) of rows (doc_key, key_a, key_b, doc_text).

    node stands for the set: the sum of its hashes mixed anew, null without words. Sets are
    taken as equal if this 64-bit number and their size are.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_key"].dataType.simpleString()
    schema = f"doc_key {kind}, key_a long, key_b int, node long, n_grams long, prefixes array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            grams, cuts = shingles.sets(batch.column(3))
            sizes = np.diff(cuts)
            some = np.flatnonzero(sizes)
            own = np.append(cuts[some], cuts[-1])
            node = _sums(mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), cuts) + sizes.astype(np.uint64)
            keys = shingles.prefixes(grams, own, length) if len(some) else np.empty((0, TREES), np.uint64)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, TREES, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2),
                pa.array(node.view(np.int64), mask=sizes == 0), pa.array(sizes),
                pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1).view(np.int64))),
            ], ["doc_key", "key_a", "key_b", "node", "n_grams", "prefixes"])

    return docs.select("doc_key", "key_a", "key_b", "doc_text").mapInArrow(work, schema)


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(u, v): every class with the smallest one of each prefix that it shares in some tree."""
    spread = classes.select("node", F.explode("prefixes").alias("prefix"))
    shared = spread.groupBy("prefix").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = shared.where("low < high").select("prefix", "low")
    return (spread.join(shared, "prefix").where("node > low")
            .select(F.col("node").alias("u"), F.col("low").alias("v")).distinct())


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which sets have the similarity: a matrix of left against right, or of left with itself.

    Common n-grams are counted by products of 0/1 matrices, some columns at a time; n-grams that
    only one set has are left out.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    inside = shared[columns]
    owner, columns = owner[inside], place[columns[inside]]
    order = np.argsort(columns, kind="stable")
    owner, columns = owner[order], columns[order]
    m, n = len(left), len(sets) - (len(left) if right is not None else 0)
    common = np.zeros((m, n), np.float32)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(columns, [low, low + COLUMNS])
        width = min(COLUMNS, int(shared.sum()) - low)
        ones = np.zeros((len(sets), width), np.float32)
        ones[owner[a:b], columns[a:b] - low] = 1
        common += ones[:m] @ (ones[m:] if right is not None else ones).T
    a = sizes[:m, None]
    b = (sizes[m:] if right is not None else sizes)[None, :]
    found = common >= similarity * (a + b - common) - 1e-6
    if right is None:
        np.fill_diagonal(found, False)
    return found


def _roots(nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix of links the smallest node that it hangs together with."""
    roots = nodes.copy()
    while True:
        near = np.where(found, roots[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(roots, near)
        if np.array_equal(new, roots):
            return roots
        roots = new


def compare(members: DataFrame, similarity: float) -> DataFrame:
    """(node, links, root) from rows (task, group, side, node, copies, grams).

    A task is a pair of blocks (i, j) of one group, whose sides 0 and 1 are compared if the
    blocks differ, or several whole groups (j is -1). links counts the rows behind linked
    classes; root is a class that the node hangs together with.
    """

    def work(key: tuple, table: pa.Table) -> pa.Table:
        task = key[0].as_py()
        crossed = 0 <= task["j"] != task["i"]
        group = table["group"].to_numpy()
        side, node = table["side"].to_numpy(), table["node"].to_numpy()
        copies = table["copies"].to_numpy()
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in table["grams"]]
        order = np.lexsort((node, side, group))
        nodes, links, roots = [], [], []
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            left = [i for i in part if side[i] == 0]
            right = [i for i in part if side[i] == 1]
            if crossed and not (left and right):
                continue
            if crossed:
                half = linked([grams[i] for i in left], [grams[i] for i in right], similarity)
                found = np.zeros((len(part), len(part)), bool)
                found[:len(left), len(left):] = half
                found |= found.T
            else:
                found = linked([grams[i] for i in left], None, similarity)
            own = np.array(left + right)
            nodes.append(node[own])
            links.append(found @ copies[own])
            roots.append(_roots(node[own], found))
        empty = [np.empty(0, np.int64)]
        columns = {"node": nodes, "links": links, "root": roots}
        return pa.table({name: np.concatenate(empty + values) for name, values in columns.items()})

    return members.groupBy("task").applyInArrow(work, "node long, links long, root long")


def _members(classes: DataFrame, groups: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Rows for `compare`: the n-grams of one text of each class that has candidates."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    wanted = (classes.join(groups, "node").join(sizes, "root")
              .select("key_a", "key_b", "node", "copies", F.col("root").alias("group"), "size"))
    n_small = sizes.where(F.col("size") <= BLOCK).agg(F.sum("size")).first()[0] or 0
    texts = (docs.join(wanted, ["key_a", "key_b"]).dropDuplicates(["node"])
             .select("doc_text", "node", "copies", "group", "size"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            grams, cuts = shingles.sets(batch.column(0))
            values = [grams[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.binary()), *batch.columns[1:]], ["grams", "node", "copies", "group", "size"])

    sets = texts.mapInArrow(work, "grams binary, node long, copies long, group long, size long")
    # Small groups share tasks. The classes of a large one are dealt into blocks, and each
    # pair of blocks is a task.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    sets = sets.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = sets.select("grams", "node", "copies", "group", "blocks", "block", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    shared = F.pmod(F.xxhash64("group"), F.lit(max(1, -(-n_small // TOGETHER))))
    return spread.select(
        F.when(F.col("blocks") == 1, F.struct(F.lit(0).cast("long").alias("g"), shared.cast("int").alias("i"),
                                              F.lit(-1).alias("j")))
        .otherwise(F.struct(F.col("group").alias("g"), low.alias("i"), high.alias("j"))).alias("task"),
        "group", (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "copies", "grams")


def _classed(docs: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_key, doc_text, key_a, key_b), and (doc_key, key_a, key_b, root, n_links); root is null
    without words."""
    keyed = docs.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").alias("doc_text"))
    keyed = keyed.select("*", *row_key("doc_key", "doc_text"))
    rows = cut_lineage(read_sets(keyed, prefix_length(similarity)))
    one = F.min(F.struct("key_a", "key_b")).alias("row")
    classes = cut_lineage(rows.where("node IS NOT NULL").groupBy("node").agg(
        one, F.count("*").alias("copies"), F.any_value("prefixes").alias("prefixes"))
        .select("node", "row.*", "copies", "prefixes"))
    groups = cut_lineage(components(candidate_edges(classes.select("node", "prefixes"))))
    narrow = classes.select("node", "key_a", "key_b", "copies")
    found = cut_lineage(compare(_members(narrow, groups, keyed, similarity), similarity))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    info = narrow.select("node", "copies").join(links, "node", "left").join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("doc_key", "key_a", "key_b", "node").join(info, "node", "left").select(
        "doc_key", "key_a", "key_b", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return keyed, cut_lineage(out)


def join_similar(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, n_links) of every row.

    n_links is the number of other rows whose text has the similarity, copies included; class_id
    is the smallest key among the rows that hang together by such links. Words are lower-cased
    letters and digits. A text without words, so a null or empty one, has no links and is a
    class of its own; null keys are passed over in class_id unless there is no other. Rows that
    repeat key and text count as copies of each other. Other columns are left out.
    """
    _, rows = _classed(docs, key, text, similarity)
    named = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_key").alias("class_id"))
    return rows.join(named, "root", "left").select(
        F.col("doc_key").alias(key),
        F.when(F.col("root").isNull(), F.col("doc_key")).otherwise(F.col("class_id")).alias("class_id"), "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text",
             similarity: float = SIMILARITY) -> DataFrame:
    """The rows, all columns, with one row of each class: that of the smallest key.

    Rows without words are all kept; of rows that repeat key and text with words one is kept.
    """
    _, rows = _classed(docs, key, text, similarity)
    first = F.min(F.struct(F.col("doc_key").isNull(), "doc_key", "key_a", "key_b")).alias("first")
    kept = rows.where("root IS NOT NULL").groupBy("root").agg(first).select("first.key_a", "first.key_b")
    key_a, key_b = (fresh_name(n, docs.columns) for n in ("key_a", "key_b"))
    keyed = docs.select("*", *row_key(key, text)).toDF(*docs.columns, key_a, key_b)
    wordless = ~F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(WORD)
    one = (keyed.where(~wordless).join(kept.toDF(key_a, key_b), [key_a, key_b], "left_semi")
           .dropDuplicates([key_a, key_b]))
    return keyed.where(wordless).unionByName(one).drop(key_a, key_b)


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents
), grams AS (
  SELECT DISTINCT r, CASE WHEN len(w) < {SHINGLE} THEN w ELSE w[i:i + {SHINGLE - 1}] END AS g
  FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT r, count(*) AS n FROM grams GROUP BY r
), common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.r <> b.r GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes s ON s.r = x JOIN sizes t ON t.r = y
  WHERE c >= {SIMILARITY} * (s.n + t.n - c) - 1e-6
), reached AS (
  SELECT r, r AS m FROM docs UNION SELECT reached.r, y FROM reached JOIN links ON x = m
), classes AS (
  SELECT reached.r, min(doc_id) AS class_id FROM reached JOIN docs ON docs.r = m GROUP BY reached.r
), counts AS (
  SELECT x AS r, count(*) AS n FROM links GROUP BY x
)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links
FROM docs JOIN classes USING (r) LEFT JOIN counts USING (r)
"""
