"""Scores of texts under a probabilistic suffix tree over words, learned from the corpus.

The symbols are a text's lower-cased words and its end. The tree's states are contexts of up to
two symbols; the end stands before a text, too. A context is a candidate if it makes up a least
share of all symbols, so that there is a bounded number of them. It is retained if the symbols
after it diverge from those after its next shorter context: if, each occurrence being foretold
from all others, it foretells them better. Then its shorter context is retained, too. The next
symbols of a state are smoothed with those of its shorter context, down to the add-one unigrams
of all words. A symbol is scored at the longest retained context before it.

Counts of next symbols may not fit anywhere in whole. Blocks of documents count their pairs of
context and next word, and send the counts to stretches of the range of word hashes, which add
them up. With the tree known, a stretch tells each block the chances of its pairs, and the block
sums them up over its documents. So a word that makes up a large part of all symbols sends its
different contexts, not its places, and a task holds a stretch's different pairs and one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import remainder, small_batches, table
from feedlode.llm.words import WHITE, Words, chained, mixed, owners
from feedlode.session import cut_lineage, shuffles_let_go

#: Least share of a candidate context among all symbols.
LEAST_SHARE = 1e-4
#: What a context must gain in foretelling its next symbols, in nats over all of them.
LEAST_GAIN = 10.0
#: Bytes of text in a block, and symbols in a stretch of the hash range.
BLOCK_BYTES, STRETCH_WORDS = 8 << 20, 2_000_000
#: Pairs that a task holds until it adds them up or sends them on.
MERGE_PAIRS = 500_000
END_WORD = mixed(np.zeros(1, np.uint64))[0]


def _symbols(words: Words, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes with the end before and after each text, and where each text begins."""
    hashes, bounds = words.read(column)
    n = len(bounds) - 1
    begins = bounds + 2 * np.arange(n + 1)
    out = np.full(begins[-1], END_WORD, np.uint64)
    out[np.arange(len(hashes)) + 2 * owners(bounds) + 1] = hashes
    return out, begins


def _scored(begins: np.ndarray) -> np.ndarray:
    """Places of all symbols but the ends put before the texts."""
    real = np.ones(begins[-1], bool)
    real[begins[:-1]] = False
    return np.flatnonzero(real)


def frequent_words(docs: DataFrame, share: float = LEAST_SHARE) -> tuple[np.ndarray, int]:
    """Sorted hashes of a set that holds all words of at least this share, and the number of
    symbols. Such a word has the share in at least one partition, and a partition has at most
    1 / share of them."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.between(WHITE)
        keys, counts, n = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in batches:
            symbols, begins = _symbols(words, batch.column(0))
            n += len(symbols) - batch.num_rows
            new, times = np.unique(symbols[_scored(begins)], return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, times])).astype(np.int64)
        often = np.flatnonzero(counts >= max(1, share * n))
        rows = np.append(keys[often].view(np.int64), 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(np.append(np.zeros(len(often), np.int64), n))], ["word", "n"])

    found = cut_lineage(docs.select("text").mapInArrow(work, "word long, n long"))
    total = found.agg(F.sum("n")).first()[0] or 0
    words = found.where("n = 0").select("word").distinct().toPandas()["word"].to_numpy(np.int64)
    return np.sort(words.view(np.uint64)), total


@dataclass
class Contexts:
    """Candidate contexts: 0 is the empty one, then single words, then pairs of them."""

    #: Sorted hashes and their numbers.
    singles: np.ndarray
    single_numbers: np.ndarray
    pairs: np.ndarray
    pair_numbers: np.ndarray
    #: The next shorter context of each.
    shorter: np.ndarray

    def find(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Number of the longest candidate before each scored symbol."""
        at = _scored(begins)
        before = symbols[at - 1]
        found = _look_up(self.singles, self.single_numbers, before)
        first = np.zeros(len(symbols), bool)
        first[begins[:-1] + 1] = True
        deep = np.flatnonzero((found > 0) & ~first[at])
        longer = _look_up(self.pairs, self.pair_numbers, chained(symbols[at[deep] - 2], before[deep]))
        found[deep] = np.where(longer > 0, longer, found[deep])
        return found


def _look_up(keys: np.ndarray, numbers: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int32)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, numbers[at], 0).astype(np.int32)


def candidates(docs: DataFrame, share: float = LEAST_SHARE) -> tuple[Contexts, int]:
    """All contexts of at least the share, and the number of symbols."""
    words, total = frequent_words(docs, share)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, known = Words.between(WHITE), shared.value
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        n = np.int64(len(known) + 1)
        for batch in batches:
            symbols, begins = _symbols(finder, batch.column(0))
            place = _look_up(known, np.arange(1, len(known) + 1), symbols).astype(np.int64)
            at = _scored(begins) - 1
            first = np.zeros(len(symbols), bool)
            first[begins[:-1]] = True
            # The word before a symbol, and with it the one before that, unless none is there.
            one = place[at]
            two = np.where(first[at], 0, place[np.maximum(at - 1, 0)])
            some = one > 0
            new, times = np.unique(two[some] * n + one[some], return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, times])).astype(np.int64)
            if len(keys) > MERGE_PAIRS:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys // n), pa.array(keys % n), pa.array(counts)], ["two", "one", "n"])
                keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys // n), pa.array(keys % n), pa.array(counts)], ["two", "one", "n"])

    least = max(1.0, share * total)
    counted = cut_lineage(docs.select("text").mapInArrow(work, "two long, one long, n long")
                          .groupBy("two", "one").agg(F.sum("n").alias("n")))
    singles = counted.groupBy("one").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("one").toPandas()
    pairs = counted.where((F.col("two") > 0) & (F.col("n") >= least)).select("two", "one").toPandas()
    one = np.sort(singles["one"].to_numpy(np.int64)) - 1
    single_keys = words[one]
    number = {int(w): i + 1 for i, w in enumerate(one)}
    left, right = pairs["two"].to_numpy(np.int64) - 1, pairs["one"].to_numpy(np.int64) - 1
    pair_keys = chained(words[left], words[right]) if len(left) else np.empty(0, np.uint64)
    order = np.argsort(pair_keys)
    shorter = np.concatenate([
        np.zeros(1 + len(one), np.int64), np.array([number[int(r)] for r in right[order]], np.int64)])
    contexts = Contexts(single_keys, np.arange(1, len(one) + 1), pair_keys[order],
                        np.arange(len(one) + 1, len(one) + 1 + len(order)), shorter)
    return contexts, total


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(data: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), kind)


PARTS = {"words": "binary", "sizes": "binary", "contexts": "binary", "counts": "binary"}
HEADS = {"times": "binary", "places": "binary", "doc_ids": "array<long>", "held_out": "array<boolean>",
         "n_tokens": "array<long>"}
TYPES = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
         "array<boolean>": pa.list_(pa.bool_())}


def _fields(kinds: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in kinds.items())


def _schema(kinds: dict[str, str]) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in kinds.items()])


def _place_type(n_docs: int) -> type:
    return np.uint16 if n_docs <= 1 << 16 else np.uint32


def _requests(docs: DataFrame, contexts: Contexts, stretches: int) -> DataFrame:
    """Blocks of documents: one row with their ids and sizes, whose stretch is negative, and one
    row per stretch of the hash range with the block's pairs of its words and their contexts.

    A pair has its number of occurrences in training (counts). They are sorted by the word's hash
    and context, and words have a number of pairs each (sizes). The block's own row has, for its
    pairs of all stretches in order, the number of all occurrences (times) and the documents'
    numbers in the block of each (places).
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(contexts)
    kinds = {"stretch": "long", "block": "long", **PARTS, **HEADS}
    schema = _schema(kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, words = shared.value, Words.between(WHITE)
        size = len(contexts.shorter)
        edges = np.array([(i << 64) // stretches for i in range(1, stretches)], np.uint64)
        block = TaskContext.get().partitionId() << 32
        hashes, own, before, ids, held, sizes, taken = [], [], [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, taken
            keys, pairs = np.unique(np.concatenate(hashes), return_inverse=True)
            pairs = pairs * size + np.concatenate(before)
            order = np.argsort(pairs, kind="stable")
            pairs, places = pairs[order], np.concatenate(own)[order]
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            pairs, times = pairs[first], np.diff(first, append=len(pairs))
            training = np.add.reduceat(~np.array(held, bool)[places], first, dtype=np.int64)
            word, context = pairs // size, pairs % size
            cuts = np.array([0, *np.searchsorted(keys, edges), len(keys)])
            rows = [{"stretch": -1, "block": block, "times": _packed(times.astype(np.int32)),
                     "places": _packed(places.astype(_place_type(len(ids)))),
                     "doc_ids": list(ids), "held_out": list(held), "n_tokens": list(sizes)}]
            edge = np.searchsorted(word, cuts)
            for stretch in np.flatnonzero(np.diff(cuts)).tolist():
                a, b, x, y = cuts[stretch], cuts[stretch + 1], edge[stretch], edge[stretch + 1]
                rows.append({
                    "stretch": stretch, "block": block,
                    # Differences of sorted numbers take less room.
                    "words": _packed(np.diff(keys[a:b], prepend=np.uint64(0))),
                    "sizes": _packed(np.bincount(word[x:y] - a, minlength=b - a).astype(np.int32)),
                    "contexts": _packed(context[x:y].astype(np.int32)),
                    "counts": _packed(training[x:y].astype(np.int32)),
                })
            yield from pa.Table.from_pylist(rows, schema).to_batches()
            block, taken = block + 1, 0
            for part in (hashes, own, before, ids, held, sizes):
                part.clear()

        for batch in batches:
            symbols, begins = _symbols(words, batch.column(2))
            at = _scored(begins)
            n_tokens = np.diff(begins) - 1
            hashes.append(symbols[at])
            own.append(np.repeat(np.arange(batch.num_rows), n_tokens) + len(ids))
            before.append(contexts.find(symbols, begins))
            ids += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
            sizes += n_tokens.tolist()
            taken += batch.column(2).nbytes
            if taken >= BLOCK_BYTES:
                yield from flush()
        if ids:
            yield from flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(work, _fields(kinds))


@dataclass
class Pairs:
    """Pairs of words and contexts, sorted by both: hashes of the words, number of pairs of each
    word, and of each pair the context and number of occurrences in training."""

    words: np.ndarray
    sizes: np.ndarray
    contexts: np.ndarray
    counts: np.ndarray

    @classmethod
    def read(cls, row: dict[str, pa.Scalar]) -> Pairs:
        return cls(np.cumsum(_unpacked(row["words"], np.uint64), dtype=np.uint64),
                   *[_unpacked(row[n], np.int32) for n in ("sizes", "contexts", "counts")])

    def keys(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """One number per pair; words have the given numbers."""
        return np.repeat(numbers.astype(np.int64), self.sizes) * size + self.contexts


def _merged(parts: list[Pairs], size: int) -> Pairs:
    """The pairs of all that occur in training, with the sums of their counts."""
    words, number = np.unique(np.concatenate([p.words for p in parts]), return_inverse=True)
    cuts = np.cumsum([len(p.words) for p in parts])[:-1]
    some = [p.counts > 0 for p in parts]
    keys = [p.keys(own, size)[s] for p, own, s in zip(parts, np.split(number, cuts), some, strict=True)]
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(at, np.concatenate([p.counts[s] for p, s in zip(parts, some, strict=True)]), len(keys))
    sizes = np.bincount(keys // size, minlength=len(words))
    return Pairs(words[sizes > 0], sizes[sizes > 0], keys % size, counts.astype(np.int64))


def _by_stretch(rows: DataFrame) -> DataFrame:
    """All rows of a stretch in one partition, one after the other, in order of blocks."""
    return rows.repartition("stretch").sortWithinPartitions("stretch", "block")


GATHERED = {"stretch": "long", "all_words": "binary", "all_pairs": "binary", "all_counts": "binary", "types": "binary"}


def _gather(requests: DataFrame, shorter: np.ndarray) -> DataFrame:
    """One row per stretch: its words that occur in training (all_words), their pairs with all
    contexts, shorter ones included, with their counts, and, per context, how many occurrences and
    different words follow it (types: two numbers for each context in order)."""
    shared = requests.sparkSession.sparkContext.broadcast(shorter)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value)
        parts, stretch, waiting = [], None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if stretch is None:
                return
            found = _merged(parts, size)
            keys, n = _counts(found.keys(np.arange(len(found.words)), size), found.counts, shared.value)
            stats = np.stack([np.bincount(keys % size, n, size).astype(np.int64),
                              np.bincount(keys % size, minlength=size)], 1)
            yield from pa.Table.from_pylist([{
                "stretch": stretch, "all_words": _packed(np.diff(found.words, prepend=np.uint64(0))),
                "all_pairs": _packed(np.diff(keys, prepend=0)), "all_counts": _packed(n), "types": _packed(stats),
            }], _schema(GATHERED)).to_batches()

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                if row["stretch"].as_py() != stretch:
                    yield from done()
                    parts, stretch, waiting = [], row["stretch"].as_py(), 0
                parts.append(Pairs.read(row))
                waiting += len(parts[-1].counts)
                # What has been added up stands first.
                if waiting > max(MERGE_PAIRS, len(parts[0].counts)):
                    parts, waiting = [_merged(parts, size)], 0
        yield from done()

    return _by_stretch(requests.where("stretch >= 0").select("stretch", "block", *PARTS)).mapInArrow(
        work, _fields(GATHERED))


def _counts(keys: np.ndarray, n: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (word, longest candidate context) with their counts: sorted pairs of words with all
    contexts that they follow, the shorter ones and the empty one included, and their counts."""
    size = len(shorter)
    every, times = [keys], [n]
    for _ in range(2):
        w, c = keys // size, keys % size
        deep = c > 0
        keys, n = w[deep] * size + shorter[c[deep]], n[deep]
        every.append(keys)
        times.append(n)
    keys, inverse = np.unique(np.concatenate(every), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate(times), len(keys)).astype(np.int64)


@dataclass
class Tree:
    """Candidate contexts with their counts, numbers of different next words, and whether they
    are states; totals of the corpus."""

    shorter: np.ndarray
    counts: np.ndarray
    types: np.ndarray
    retained: np.ndarray

    @property
    def even(self) -> float:
        """What a count of all symbols is divided by in the unigrams."""
        return float(self.counts[0] + self.types[0] + 1)

    def state(self, context: np.ndarray) -> np.ndarray:
        """The longest retained context of each candidate."""
        state = np.arange(len(self.shorter), dtype=np.int64)
        for _ in range(2):
            state = np.where(self.retained[state], state, self.shorter[state])
        return state[context]


class Stretch:
    """The words of a stretch of the hash range, their counts in all contexts, and their chances.
    A word that doesn't occur in training has the number after all others."""

    def __init__(self, row: dict[str, pa.Scalar], tree: Tree) -> None:
        self.tree = tree
        self.size = len(tree.shorter)
        self.words = np.cumsum(_unpacked(row["all_words"], np.uint64), dtype=np.uint64)
        self.keys, self.n = np.cumsum(_unpacked(row["all_pairs"], np.int64)), _unpacked(row["all_counts"], np.int64)
        self.total = np.zeros(len(self.words) + 1, np.int64)
        plain = self.keys % self.size == 0
        self.total[self.keys[plain] // self.size] = self.n[plain]

    def number(self, words: np.ndarray) -> np.ndarray:
        return _look_up64(self.words, np.arange(len(self.words)), words, len(self.words))

    def count(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        return _look_up64(self.keys, self.n, word * self.size + context)

    def chance(self, word: np.ndarray, context: np.ndarray, count: np.ndarray | None = None,
               without: int = 0) -> np.ndarray:
        """Chance of each word after each context; `without` occurrences are left out of the
        context's own counts."""
        out = (self.total[word] + 1) / self.tree.even
        shorter = self.tree.shorter[context]
        for level in (shorter, context):
            deep = np.flatnonzero(level > 0)
            if level is context:
                n = self.count(word[deep], level[deep]) - without
                all_n = self.tree.counts[level[deep]] - without
            else:
                n, all_n = self.count(word[deep], level[deep]), self.tree.counts[level[deep]]
            weight = np.maximum(self.tree.types[level[deep]], 1)
            out[deep] = (n + weight * out[deep]) / (all_n + weight)
        return out


def _look_up64(keys: np.ndarray, numbers: np.ndarray, wanted: np.ndarray, other: int = 0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, numbers[at], other)


STORED = ["all_words", "all_pairs", "all_counts"]


def retain(gathered: DataFrame, shorter: np.ndarray, least: float = LEAST_GAIN) -> Tree:
    """Counts of the contexts, and which of them are retained. One row per candidate context
    comes to the driver."""
    spark = gathered.sparkSession
    size = len(shorter)

    def per_context(rows: DataFrame, values: int) -> np.ndarray:
        found = rows.groupBy("context").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(values)]).toPandas()
        out = np.zeros((size, values))
        out[found["context"]] = found[[f"v{i}" for i in range(values)]]
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 2), np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += _unpacked(value, np.int64).reshape(-1, 2)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(total[some, 0]), pa.array(total[some, 1])], ["context", "v0", "v1"])

    counts = per_context(gathered.select("types").mapInArrow(count, "context long, v0 long, v1 long"), 2).astype(np.int64)
    tree = Tree(shorter, counts[:, 0], counts[:, 1], np.zeros(size, bool))
    tree.retained[0] = True
    shared = spark.sparkContext.broadcast(tree)

    def gain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                stretch = Stretch({n: batch.column(n)[i] for n in STORED}, shared.value)
                word, context = stretch.keys // size, stretch.keys % size
                deep = np.flatnonzero(context > 0)
                word, context, n = word[deep], context[deep], stretch.n[deep]
                better = stretch.chance(word, context, without=1)
                plain = stretch.chance(word, shared.value.shorter[context])
                total += np.bincount(context, n * np.log(better / plain), size)
                # Before the next one is read.
                del stretch, word, context, deep, n, better, plain
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["context", "v0"])

    gains = per_context(gathered.select(*STORED).mapInArrow(gain, "context long, v0 double"), 1)[:, 0]
    kept = gains >= least
    kept[0] = True
    kept[np.unique(shorter[kept])] = True
    return Tree(shorter, tree.counts, tree.types, kept)


def _parts(requests: DataFrame, gathered: DataFrame, tree: Tree) -> DataFrame:
    """(block, stretch, totals, model): for the pairs that a block has of a stretch, in order, the
    word's occurrences in training and its log10 chance under the tree."""
    shared = gathered.sparkSession.sparkContext.broadcast(tree)
    kinds = {"block": "long", "stretch": "long", "totals": "binary", "model": "binary"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        state, stretch = tree.state(np.arange(len(tree.shorter))), None
        for batch in batches:
            out = {n: [] for n in kinds}
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                if row["all_words"].is_valid:
                    # It stands before the stretch's requests.
                    stretch = None
                    stretch = Stretch(row, tree)
                    continue
                own = Pairs.read(row)
                word = np.repeat(stretch.number(own.words), own.sizes)
                out["block"].append(row["block"].as_py())
                out["stretch"].append(row["stretch"].as_py())
                out["totals"].append(_packed(stretch.total[word]))
                out["model"].append(_packed(np.log10(stretch.chance(word, state[own.contexts]))))
            yield pa.RecordBatch.from_pydict(out, _schema(kinds))

    null = lambda kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
    sums = gathered.select("stretch", F.lit(-1).cast("long").alias("block"), *null(PARTS), *STORED)
    asked = requests.where("stretch >= 0").select("stretch", "block", *PARTS, *null(dict.fromkeys(STORED, "binary")))
    return _by_stretch(sums.unionAll(asked)).mapInArrow(work, _fields(kinds))


def score(docs: DataFrame, held_out: str = "held_out", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows that are not held out. A null or empty text is its end alone. Repeated
    rows count as often as they stand and are scored alike; null keys stay null. Without any
    training row every symbol has the chance 1. Other columns are left out. Memory follows the
    longest text.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{held_out}`"), F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    with shuffles_let_go(docs.sparkSession):
        contexts, n_all = candidates(rows.where("NOT held_out"))
        requests = cut_lineage(_requests(rows, contexts, max(1, -(-n_all // STRETCH_WORDS))))
        gathered = cut_lineage(_gather(requests, contexts.shorter))
        tree = retain(gathered, contexts.shorter)
    even = tree.even

    def gather(rows: pa.Table) -> pa.Table:
        valid = rows["doc_ids"].is_valid().to_pylist()
        head = valid.index(True)
        column = {n: rows[n][head].values for n in ("doc_ids", "held_out", "n_tokens")}
        n = len(column["doc_ids"])
        # In order of stretches the pairs are those of the block.
        parts = sorted((i for i in range(rows.num_rows) if i != head), key=lambda i: rows["stretch"][i].as_py())
        total = np.concatenate([_unpacked(rows["totals"][i], np.int64) for i in parts])
        model = np.concatenate([_unpacked(rows["model"][i], np.float64) for i in parts])
        times, places = _unpacked(rows["times"][head], np.int32), _unpacked(rows["places"][head], _place_type(n))
        summed = lambda values: np.bincount(places, np.repeat(values, times), n)
        return pa.table({
            "doc_id": column["doc_ids"], "held_out": column["held_out"], "n_tokens": column["n_tokens"],
            "n_known": pa.array(summed(total > 0).astype(np.int64)), "train_tokens": pa.array(np.full(n, n_all, np.int64)),
            "base_score": pa.array(summed(np.log10((total + 1) / even))), "score": pa.array(summed(model)),
        })

    null = lambda kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
    told = {"totals": "binary", "model": "binary"}
    heads = requests.where("stretch < 0").select("block", "stretch", *null(told), *HEADS)
    tails = _parts(requests, gathered, tree).select("block", "stretch", *told, *null(HEADS))
    return heads.unionAll(tails).groupBy("block").applyInArrow(
        gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held_out", remainder(F.col("doc_id"), 7) == 2))
