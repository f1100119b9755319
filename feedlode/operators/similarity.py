"""Exact vector search: top-k by cosine for one query, one row, or many rows at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlode.functions.fixed_values import SEARCH_LIMIT
from feedlode.functions.limits import clamp_limit
from feedlode.operators.rows import exclude_explicit, present_insights
from feedlode.schema import INSIGHT_KEYS
from feedlode.session import small_batches

# Vectors of one block of targets that each task holds, in bytes.
BLOCK_BYTES = 64 << 20
# Largest set of targets handed to the tasks from the driver; beyond it they are shuffled.
BROADCAST_BYTES = 64 << 20
# Cosines are compared to this many decimals.
DIGITS = 12


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), width).astype(np.float64)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows at length one; a zero vector becomes NaN, as its cosine is undefined."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


def _best(ids: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one target, undefined ones left out; equal cosines by id."""
    # Equal vectors can differ in the last bits of their cosine.
    cosines = cosines.round(DIGITS)
    known = ~np.isnan(cosines)
    ids, cosines = ids[known], cosines[known]
    order = np.lexsort((ids, -cosines))[:k]
    return ids[order], cosines[order]


MODEL = "embedding_model"


#: From the id and locators of rows to the rows.
Fetch = Callable[[DataFrame], DataFrame]


def _candidates(
    insights: DataFrame, width: int, id_col: str, vector_col: str, model: str | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Id and vector of every row that can be found: of the same length, and of the same model
    if that is known."""
    shown = exclude_explicit(insights) if "is_explicit_content" in insights.columns else insights
    if model is not None and MODEL in insights.columns:
        shown = shown.filter(F.col(MODEL) == model)
    usable = shown.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == width))
    return usable.select(F.col(id_col).alias("id"), *carry, F.col(vector_col).alias("vector"))


def _batches_of_top_k(
    query: np.ndarray, k: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    unit = _unit_rows(query.reshape(1, -1))[0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            cosine = _unit_rows(_matrix(batch.column("vector"), len(unit))) @ unit if batch.num_rows else np.empty(0)
            rows = pa.Table.from_batches([batch]).drop_columns(["vector"]).append_column("cosine", pa.array(cosine))
            kept = rows if kept is None else pa.concat_tables([kept, rows])
            # Numbers of rows stand for the ids, so that equal ids are told apart.
            ids = kept.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            best, cosines = _best(np.argsort(order), kept.column("cosine").to_numpy(), k)
            kept = kept.take(order[best])
            kept = kept.set_column(kept.schema.get_field_index("cosine"), "cosine", pa.array(cosines))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return search


def locators(insights: DataFrame) -> list[str]:
    """Columns that tell a row from others of its id, and where it is stored, as far as given."""
    return [c for c in (*INSIGHT_KEYS, "created_at") if c in insights.columns]


def search_ids(
    insights: DataFrame,
    query_vector: Sequence[float],
    k: int,
    id_col: str = "id",
    vector_col: str = "embedding",
    without_id: int | None = None,
    model: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Ids and cosines of the k nearest rows, with the columns to ``carry``.

    Only those and the vector are read. Every task keeps its own k best, so no more than k rows
    per task leave it.
    """
    small_batches(insights.sparkSession)
    query = np.asarray(query_vector, dtype=np.float64)
    rows = _candidates(insights, len(query), id_col, vector_col, model, carry)
    if without_id is not None:
        rows = rows.filter(F.col("id") != without_id)
    kinds = ", ".join(f"`{c}` {insights.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"id bigint, {kinds}{', ' if kinds else ''}cosine double"
    best = rows.mapInArrow(_batches_of_top_k(query, k), schema)
    return best.orderBy(F.col("cosine").desc(), F.col("id"), *carry).limit(k)


def _with_rows(
    insights: DataFrame, found: DataFrame, id_col: str, carry: Sequence[str], fetch: Fetch | None
) -> DataFrame:
    """The rows of the at most 200 that were found, ready for display.

    They come to the driver, as ids and places, so that the rows can be fetched by a filter that
    the files' statistics and bloom filters answer, or by whoever knows where they are.
    """
    spark = insights.sparkSession
    best = spark.createDataFrame(found.collect(), found.schema)
    ids = [r["id"] for r in best.select("id").collect()]
    rows = fetch(best.drop("cosine")) if fetch else insights.filter(F.col(id_col).isin(ids))
    near = best.select(
        F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in carry],
        F.greatest(F.lit(0.0), F.col("cosine")).alias("similarity"), F.col("cosine").alias("_cosine"),
    )
    same = F.col(id_col) == F.col("_id")
    for c in carry:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    full = present_insights(rows.join(F.broadcast(near), same).drop("_id", *[f"_{c}" for c in carry]))
    return full.orderBy(F.col("_cosine").desc(), F.col(id_col), *[c for c in carry if c in full.columns]).drop("_cosine")


def semantic_search(
    insights: DataFrame,
    query_vector: Sequence[float],
    k: object = SEARCH_LIMIT,
    id_col: str = "id",
    vector_col: str = "embedding",
    model: str | None = None,
    fetch: Fetch | None = None,
) -> DataFrame:
    """The k non-explicit rows closest to the query, with ``similarity`` = max(0, cosine).

    An empty query finds nothing. Rows without a vector, with one of another length or of
    another model than ``model``, or with a zero vector are left out. Only ids, vectors and
    ``locators`` are scanned; then the rows found are fetched, by ``fetch`` if it is given,
    ``InsightStore.rows_of`` say, which reads no more than their partitions.
    """
    if len(query_vector) == 0:
        return present_insights(insights.withColumn("similarity", F.lit(0.0)).limit(0))
    carry = locators(insights)
    found = search_ids(insights, query_vector, clamp_limit(k), id_col, vector_col, model=model, carry=carry)
    return _with_rows(insights, found, id_col, carry, fetch)


def vector_of(
    insights: DataFrame, row_id: int, id_col: str = "id", vector_col: str = "embedding"
) -> list[float]:
    """The vector of one row, explicit or not; empty if there is none."""
    target = insights.filter((F.col(id_col) == row_id) & F.col(vector_col).isNotNull())
    row = target.select(vector_col).first()
    return list(row[0]) if row else []


def similar_insights(
    insights: DataFrame,
    row_id: int,
    k: object = SEARCH_LIMIT,
    id_col: str = "id",
    vector_col: str = "embedding",
    fetch: Fetch | None = None,
    key: Mapping[str, str] | None = None,
) -> DataFrame:
    """The k rows most like row ``row_id``, without that row; only vectors of its model count.

    Ids are hashes, and two rows can share one: ``key`` then names the row by its natural key,
    and only that row is left out. The row is looked up by a filter on the id that the files'
    statistics and bloom filters answer; ``fetch`` as in ``semantic_search``.
    """
    named = MODEL in insights.columns
    target = insights.filter((F.col(id_col) == row_id) & F.col(vector_col).isNotNull())
    own = F.lit(True)
    for name, value in (key or {}).items():
        own = own & F.col(name).eqNullSafe(F.lit(value))
    target = target.filter(own)
    row = target.select(vector_col, F.col(MODEL) if named else F.lit(None)).first()
    if not row or not row[0]:
        return present_insights(insights.withColumn("similarity", F.lit(0.0)).limit(0))
    others = insights.filter((F.col(id_col) != row_id) | ~own) if key else insights
    carry = locators(insights)
    found = search_ids(
        others, list(row[0]), clamp_limit(k), id_col, vector_col,
        without_id=None if key else row_id, model=row[1], carry=carry,
    )
    return _with_rows(insights, found, id_col, carry, fetch)


class _RunningBest:
    """The k best rows of each target of one block, kept while the rows stream by."""

    def __init__(self, target_ids: np.ndarray, targets: np.ndarray, k: int) -> None:
        self.target_ids, self.units, self.k = target_ids, _unit_rows(targets), k
        # Places that no row has taken have a cosine of minus infinity and come last.
        self.ids = np.empty((len(target_ids), 0), np.int64)
        self.cosines = np.empty((len(target_ids), 0), np.float64)
        self.seen = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        units = _unit_rows(vectors)
        # A slice of rows at a time bounds the matrix of cosines. The first ones are small and set
        # the bar, so that of a later one few cosines are among the k best.
        most = max(1, (8 << 20) // max(1, len(self.target_ids)))
        start = 0
        while start < len(ids):
            end = start + min(most, max(self.k, self.seen))
            self._merge(ids[start:end], units[start:end])
            start = end

    def _merge(self, ids: np.ndarray, units: np.ndarray) -> None:
        cosines = self.units @ units.T
        # The bar is rounded, the cosines are not yet. Undefined ones are never above it.
        full = self.cosines.shape[1] == self.k
        bar = self.cosines[:, -1] - 10.0**-DIGITS if full else np.full(len(self.units), -np.inf)
        self.seen += len(ids)
        width = min(self.k, self.seen)
        if (more := width - self.ids.shape[1]) > 0:
            self.ids = np.pad(self.ids, ((0, 0), (0, more)))
            self.cosines = np.pad(self.cosines, ((0, 0), (0, more)), constant_values=-np.inf)
        target, row = np.nonzero(cosines >= bar[:, None])
        other = self.target_ids[target] != ids[row]
        target, row = target[other], row[other]
        if not len(target):
            return
        hit, place = np.unique(target, return_inverse=True)
        places = np.concatenate([np.repeat(np.arange(len(hit)), width), place])
        all_ids = np.concatenate([self.ids[hit].ravel(), ids[row]])
        values = np.concatenate([self.cosines[hit].ravel(), cosines[target, row].round(DIGITS)])
        order = np.lexsort((all_ids, -values, places))
        places = places[order]
        rank = np.arange(len(order)) - np.searchsorted(places, np.arange(len(hit)))[places]
        # Every target that was hit has as many entries as places, or more.
        best = order[rank < width]
        self.ids[hit] = all_ids[best].reshape(len(hit), width)
        self.cosines[hit] = values[best].reshape(len(hit), width)

    def result(self) -> pa.RecordBatch:
        width = self.ids.shape[1]
        known = np.isfinite(self.cosines).ravel()
        target = np.repeat(self.target_ids, width)[known]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(target, pa.int64()),
                pa.array(self.ids.ravel()[known], pa.int64()),
                pa.array(self.cosines.ravel()[known], pa.float64()),
            ],
            names=["target_id", "id", "cosine"],
        )


PAIR_SCHEMA = "target_id bigint, id bigint, cosine double"


def _search_shared_block(rows: DataFrame, targets: DataFrame, width: int, k: int) -> DataFrame:
    """All targets in every task: for target sets of a checked size. Rows are not moved."""
    held = targets.toArrow()
    ids = held.column("target_id").to_numpy()
    vectors = _matrix(held.column("target_vector"), width)
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _RunningBest(*shared.value, k)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column("id").to_numpy(), _matrix(batch.column("vector"), width))
        yield best.result()

    return rows.mapInArrow(search, PAIR_SCHEMA)


def _search_shuffled_blocks(
    rows: DataFrame, targets: DataFrame, width: int, k: int, blocks: int, chunks: int
) -> DataFrame:
    """Blocks of targets meet chunks of rows in ``blocks`` x ``chunks`` groups.

    Both sides are dealt out by hash of the id, so groups are even whatever the data. Each
    group streams its rows past one block of targets and gives k rows per target.
    """
    block_of = F.pmod(F.xxhash64("target_id"), F.lit(blocks)).cast("int")
    chunk_of = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int")
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = targets.select(
        block_of.alias("block"), every_chunk.alias("chunk"), "target_id", "target_vector"
    )
    right = rows.select(every_block.alias("block"), chunk_of.alias("chunk"), "id", "vector")

    def search(left_side: pa.Table, right_side: pa.Table) -> pa.Table:
        if left_side.num_rows == 0 or right_side.num_rows == 0:
            empty = _RunningBest(np.empty(0, np.int64), np.empty((0, width)), k)
            return pa.Table.from_batches([empty.result()])
        best = _RunningBest(
            left_side.column("target_id").to_numpy(),
            _matrix(left_side.column("target_vector"), width),
            k,
        )
        best.add(right_side.column("id").to_numpy(), _matrix(right_side.column("vector"), width))
        return pa.Table.from_batches([best.result()])

    paired = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    return paired.applyInArrow(search, PAIR_SCHEMA)


def similar_insights_bulk(
    insights: DataFrame,
    ids: Sequence[int] | DataFrame,
    k: object = SEARCH_LIMIT,
    id_col: str = "id",
    vector_col: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k rows most like each target, as many as asked for: (target_id, id, similarity, rank).

    ``ids``, a list or a frame with the id column, states the targets: the work is that of all
    rows for each of them. Vectors of different length or model are not compared. The number
    and length of the target vectors is looked up first: up to ``broadcast_bytes`` they are
    handed to the tasks, beyond that both sides are shuffled in blocks. No pair of rows is
    ever written out, only the k best of each target per task.
    """
    k = k if isinstance(k, int) and k > 0 else SEARCH_LIMIT
    targets = insights.filter(F.col(vector_col).isNotNull())
    if isinstance(ids, DataFrame):
        targets = targets.join(ids.select(id_col).distinct(), id_col, "left_semi")
    else:
        targets = targets.filter(F.col(id_col).isin([int(i) for i in ids]))
    model = F.col(MODEL) if MODEL in insights.columns else F.lit(None).cast("string")
    targets = targets.select(
        F.col(id_col).alias("target_id"), F.col(vector_col).alias("target_vector"), model.alias("model")
    )
    # Each length and model, of which there are few, is searched on its own.
    kinds = targets.groupBy(F.size("target_vector").alias("width"), "model").count().collect()
    parts = []
    for width, name, n in sorted(
        ((r["width"], r["model"], r["count"]) for r in kinds if r["width"] > 0), key=str
    ):
        some = targets.filter((F.size("target_vector") == width) & F.col("model").eqNullSafe(name)).drop("model")
        rows = _candidates(insights, width, id_col, vector_col, name)
        size = n * width * 8
        if size <= broadcast_bytes:
            parts.append(_search_shared_block(rows, some, width, k))
        else:
            blocks = math.ceil(size / block_bytes)
            chunks = max(1, math.ceil(rows.count() * width * 8 / block_bytes))
            parts.append(_search_shuffled_blocks(rows, some, width, k, blocks, chunks))
    if not parts:
        empty = insights.sparkSession.createDataFrame([], PAIR_SCHEMA)
        return empty.select("target_id", "id", "cosine", F.lit(0).alias("rank")).drop("cosine")
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    order = Window.partitionBy("target_id").orderBy(F.col("cosine").desc(), F.col("id"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    similarity = F.greatest(F.lit(0.0), F.col("cosine")).alias("similarity")
    return ranked.select("target_id", "id", similarity, "rank")
