"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine over a block-max index.

From a bounded sample of labelled rows, the words are kept whose presence goes with the label
beyond chance. Over these words the examples get unit TF-IDF vectors, in an inverted index
whose blocks carry the largest weight of each word. A text's bound for a block is what the
block's largest weights would give: blocks are taken from the highest bound on, until no block
left can hold a nearer example. The nearest ones vote by squared cosine; a logistic curve
fitted to the examples' own leave-one-out votes turns the vote into a chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import remainder, small_batches, table, without
from feedlode.llm.words import NOT_ALNUM, Words, owners

#: Most examples of each label, and most words that are kept.
TOXIC_EXAMPLES, CLEAN_EXAMPLES, KEPT_WORDS = 2_000, 4_000, 2_048
#: Least log-likelihood ratio (G squared) of a kept word, and how much more often it must occur
#: in texts of label 1: words of a language or a topic go with a label, too, but weakly. The
#: ratio is that of one wrong word in a hundred runs over half a million words.
SIGNIFICANT, LIFT = 32.0, 3.0
NEIGHBOURS, BLOCK, EVIDENCE = 15, 32, 3
CUT = 0.7
REMEMBER = 50_000


def _word_counts(words: Words, column: pa.Array, kept: np.ndarray | None = None):
    """(text, word, count) triples, sorted by text and word; of the kept words only, if given."""
    hashes, bounds = words.read(column)
    own = owners(bounds)
    if kept is not None:
        at = np.searchsorted(kept, hashes)
        at[at == len(kept)] = 0
        found = kept[at] == hashes if len(kept) else np.zeros(len(hashes), bool)
        hashes, own = at[found].astype(np.uint64), own[found]
    order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return own[first], hashes[first], np.diff(np.append(first, len(own)))


def telling_words(examples: pd.DataFrame, most: int = KEPT_WORDS) -> np.ndarray:
    """Sorted hashes of the words that go with label 1 beyond chance.

    examples: label, and words (hashes of the distinct words of a text). G squared compares in
    how many texts of either label a word occurs.
    """
    labels = examples["label"].to_numpy()
    n1, n0 = int((labels == 1).sum()), int((labels != 1).sum())
    if not n1 or not n0:
        return np.empty(0, np.uint64)
    words = np.concatenate([np.asarray(w, np.int64).view(np.uint64) for w in examples["words"]])
    toxic = np.repeat(labels == 1, [len(w) for w in examples["words"]])
    words, inverse = np.unique(words, return_inverse=True)
    a = np.bincount(inverse[toxic], minlength=len(words)).astype(float)
    b = np.bincount(inverse[~toxic], minlength=len(words)).astype(float)

    def term(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    share = (a + b) / (n1 + n0)
    g2 = 2 * (term(a, n1 * share) + term(n1 - a, n1 * (1 - share))
              + term(b, n0 * share) + term(n0 - b, n0 * (1 - share)))
    good = np.flatnonzero((g2 >= SIGNIFICANT) & ((a + 0.5) * n0 >= LIFT * (b + 0.5) * n1))
    good = good[np.lexsort((words[good], -g2[good]))][:most]
    return np.sort(words[good])


@dataclass
class Examples:
    """The labelled examples over the kept words; bounded by the sample and the kept words."""

    kept: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]
    #: Rows of each label that there are, sampled or not.
    population: tuple[int, int]


class BlockMaxIndex:
    """Inverted lists of unit vectors, in blocks with their largest weights."""

    def __init__(self, examples: Examples) -> None:
        n_words = len(examples.kept)
        filled = [i for i, (terms, _) in enumerate(examples.vectors) if len(terms)]
        counts = np.zeros(n_words)
        for i in filled:
            counts[examples.vectors[i][0]] += 1
        self.idf = np.log((len(examples.vectors) + 1) / (counts + 1)) + 1
        unit = {i: self.weights(*examples.vectors[i]) for i in filled}
        # Like examples side by side make tight blocks.
        filled.sort(key=lambda i: (int(examples.vectors[i][0][unit[i].argmax()]), int(examples.ids[i])))
        self.rows = np.array(filled, np.int64)
        self.labels = examples.labels[self.rows].astype(float) if filled else np.empty(0)
        self.ids = examples.ids[self.rows] if filled else np.empty(0, np.int64)
        self.n_blocks = -(-len(filled) // BLOCK)
        lists: list[list[tuple[int, float]]] = [[] for _ in range(n_words)]
        self.highest = np.zeros((n_words, max(self.n_blocks, 1)))
        for place, i in enumerate(filled):
            for term, weight in zip(examples.vectors[i][0], unit[i], strict=True):
                lists[term].append((place, weight))
                self.highest[term, place // BLOCK] = max(self.highest[term, place // BLOCK], weight)
        self.places = [np.array([p for p, _ in x], np.int64) for x in lists]
        self.values = [np.array([w for _, w in x]) for x in lists]
        self.blocks = [p // BLOCK for p in self.places]

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(counts)) * self.idf[terms]
        return raw / np.sqrt((raw * raw).sum())

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS,
                but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a common word, nearest first,
        equal ones by place; `but` is a place to leave out."""
        if not len(terms) or not self.n_blocks:
            return np.empty(0, np.int64), np.empty(0)
        q = self.weights(terms, counts)
        bounds = q @ self.highest[terms]
        places, cosines, least = np.empty(0, np.int64), np.empty(0), 0.0
        order = np.argsort(-bounds, kind="stable")
        at, step = 0, 4
        while at < len(order):
            highest = bounds[order[at]]
            if highest <= 0 or len(places) == k and highest < least - 1e-12:
                break
            # Some blocks at a time, twice as many each time.
            taken = np.zeros(self.n_blocks, bool)
            taken[order[at:at + step]] = True
            at, step = at + step, 2 * step
            found = np.zeros(len(self.rows))
            for term, weight in zip(terms, q, strict=True):
                inside = taken[self.blocks[term]]
                found[self.places[term][inside]] += weight * self.values[term][inside]
            hit = np.flatnonzero(found)
            hit = hit[hit != but]
            places, cosines = np.append(places, hit), np.append(cosines, np.round(found[hit], 12))
            if len(places) > k:
                best = np.lexsort((places, -cosines))[:k]
                places, cosines = places[best], cosines[best]
            if len(places) == k:
                least = cosines.min()
        best = np.lexsort((places, -cosines))
        return places[best], cosines[best]

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the nearest, by squared cosine; 0 if there are none."""
        weights = cosines * cosines
        return float(weights @ self.labels[places] / weights.sum()) if len(places) else 0.0


def calibrate(index: BlockMaxIndex, examples: Examples) -> tuple[float, float]:
    """Slope and intercept of the chance as a logistic function of the vote.

    Every example votes on as if it were not there; the labels are weighted back from the
    sample to their shares among all labelled rows, and held off 0 and 1 by one row each.
    """
    votes = np.zeros(len(examples.vectors))
    for place, i in enumerate(index.rows):
        votes[i] = index.vote(*index.nearest(*examples.vectors[i], but=place))
    y = (examples.labels == 1).astype(float)
    n0, n1 = len(y) - y.sum(), y.sum()
    if not n0 or not n1:
        return 0.0, -4.0 if not n1 else 4.0
    share = np.where(y == 1, examples.population[1] / n1, examples.population[0] / n0)
    share /= share.mean()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([votes, np.ones(len(votes))], 1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (share * (p - target)) + 1e-3 * at
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        at -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 0)), float(at[1])


def fit(docs: DataFrame, labels: DataFrame) -> Examples:
    """Examples from (doc_id, label): of each label those with the smallest hash of their id.

    Null ids and labels are left out, of repeated ids the larger label counts. The sample is
    bounded, so one task may look at its words and the driver may hold its vectors.
    """
    small_batches(docs.sparkSession)
    rows = (labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
            .groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    sizes = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = (rows.where("label = 1").orderBy(*order).limit(TOXIC_EXAMPLES)
              .unionAll(rows.where("label <> 1").orderBy(*order).limit(CLEAN_EXAMPLES)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.between(NOT_ALNUM)
        for batch in batches:
            own, hashes, counts = _word_counts(words, batch.column(1))
            ends = np.searchsorted(own, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(0), batch.column(2),
                pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
            ], ["task", "doc_id", "label", "words", "counts"])

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
        kept = telling_words(rows)
        # Row -1 carries the kept words, the others their places in it.
        out = [(-1, -1, kept.view(np.int64), np.zeros(len(kept), np.int32))]
        for doc_id, label, words, counts in rows[["doc_id", "label", "words", "counts"]].itertuples(index=False):
            words = np.asarray(words, np.int64).view(np.uint64)
            inside = np.isin(words, kept)
            out.append((doc_id, label, np.searchsorted(kept, words[inside]), np.asarray(counts)[inside]))
        return pd.DataFrame(out, columns=["doc_id", "label", "words", "counts"])

    schema = "doc_id long, label int, words array<long>, counts array<int>"
    found = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
             .select("doc_id", "text", "label").mapInArrow(read, f"task int, {schema}")
             .groupBy("task").applyInPandas(select, schema)).collect()
    head = [r for r in found if r["label"] == -1]
    body = [r for r in found if r["label"] != -1]
    return Examples(
        kept=np.array(head[0]["words"] if head else [], np.int64).view(np.uint64),
        ids=np.array([r["doc_id"] for r in body], np.int64),
        labels=np.array([r["label"] for r in body], np.int64),
        vectors=[(np.array(r["words"], np.int64), np.array(r["counts"], float)) for r in body],
        population=(sum(n for label, n in sizes.items() if label != 1), sizes.get(1, 0)),
    )


class Judge:
    """Scores texts by their nearest examples; equal word counts are looked up once."""

    def __init__(self, examples: Examples, curve: tuple[float, float]) -> None:
        self.kept, self.index, self.curve = examples.kept, BlockMaxIndex(examples), curve
        self.words = Words.between(NOT_ALNUM)
        self.known: dict[bytes, tuple[float, list]] = {}
        self.none = (self.chance(0.0), [])

    def chance(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.curve[0] * vote + self.curve[1]))))

    def judge(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list]:
        key = terms.tobytes() + counts.tobytes()
        found = self.known.get(key)
        if found is None:
            places, cosines = self.index.nearest(terms, counts.astype(float))
            evidence = [{"doc_id": int(self.index.ids[p]), "cosine": float(c), "label": int(self.index.labels[p])}
                        for p, c in zip(places[:EVIDENCE], cosines, strict=False)]
            found = self.chance(self.index.vote(places, cosines)), evidence
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[key] = found
        return found

    def column(self, column: pa.Array) -> list[tuple[float, list]]:
        own, terms, counts = _word_counts(self.words, column, self.kept)
        terms = terms.astype(np.int64)
        ends = np.searchsorted(own, np.arange(len(column) + 1))
        return [self.judge(terms[a:b], counts[a:b]) if a < b else self.none
                for a, b in zip(ends[:-1], ends[1:], strict=True)]


EVIDENCE_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))


def score(docs: DataFrame, examples: Examples, text: str = "text") -> DataFrame:
    """All columns of the rows, and score and evidence: the chance of label 1 and the nearest
    examples. Columns of these two names are replaced.

    A text without a kept word, so a null or empty one, has no evidence and the chance of an
    empty vote. Rows are scored one by one, repeated ones alike; only the text is an input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    curve = calibrate(BlockMaxIndex(examples), examples)
    shared = spark.sparkContext.broadcast(examples)
    docs = without(docs, "score", "evidence")
    place = docs.columns.index(text)
    kinds = ("double", "score"), ("array<struct<doc_id: long, cosine: double, label: int>>", "evidence")
    schema = docs.select("*", *[F.lit(None).cast(kind).alias(name) for kind, name in kinds]).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, curve)
        for batch in batches:
            found = judge.column(batch.column(place))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], EVIDENCE_TYPE)],
                [*batch.schema.names, "score", "evidence"])

    return docs.mapInArrow(work, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows that labels may be learned from."""
    return (labels.where(remainder(F.col("doc_id"), 3) != 1)
            .select("doc_id", F.col("toxic").alias("label")))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    examples = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, examples).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")
