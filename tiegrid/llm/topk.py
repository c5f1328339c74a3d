"""Exact top-k inner products by block-at-a-time pruning.

Vectors lie in blocks of BLOCK rows, in the order in which they are stored. A
block keeps a forward index (its matrix of integers) and, as every dimension
counts as two terms (its positive and its negative part), the largest value of
each term. The sum of a query's weights times these maxima bounds all its
scores in the block. For each query the blocks are taken in falling order of
their bounds and scored until the next bound lies below the k-th best score; a
bound equal to it is still scored, as an equal score with a smaller id counts.

Scores and bounds are exact: doubles are used only where no sum of products can
reach 2**53, longs up to 2**62, and Python's integers beyond.

Queries go to the executors in batches of bounded size, one pass over the
vectors for each batch; a task hands on k rows for each query. Of several
batches, each is written before the next is read, so the driver holds one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiegrid.llm.common import materialize

#: Vectors in a block, blocks that are scored at once for a query, and vectors that a task holds at a time.
BLOCK, AHEAD, HELD = 16, 16, 65536
#: Queries that are sent to the executors at once, and of these, scored together.
BATCH, TOGETHER = 20_000, 256
#: Stands for a place that no vector has taken; the score can't be negated out of range.
NO_ID, NO_SCORE = np.iinfo(np.int64).max, -np.iinfo(np.int64).max


def integer_vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, floor(scale * x) of their components); null, empty and non-finite vectors take no part."""
    wide = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(wide.offsets.to_numpy())
    values = wide.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ok = np.asarray(wide.is_valid()) & (sizes > 0)
    bad = np.zeros(len(sizes), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = wide.offsets[0].as_py()
    values = values[first : first + sizes.sum()]
    np.add.at(bad, owner[~np.isfinite(values)], 1)
    ok &= bad == 0
    width = int(sizes[ok].max()) if ok.any() else 0
    out = np.zeros((int(ok.sum()), width))
    place = np.cumsum(ok) - 1
    within = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = ok[owner]
    out[place[owner[use]], within[use]] = np.floor(scale * values[use])
    return np.nonzero(ok)[0], out


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which every inner product of a row of ``a`` with one of ``b``, and every bound, is exact."""
    if not len(a) or not len(b):
        return float
    largest = float((np.abs(a).max(0) * np.abs(b).max(0)).sum())
    return float if largest < 2**52 else np.int64 if largest < 2**61 else object


def as_exact(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is object:
        return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)
    return values.astype(kind)


class Blocks:
    """The forward indexes and term maxima of a stretch of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        pad = -len(ids) % BLOCK
        self.real = np.concatenate((np.ones(len(ids), bool), np.zeros(pad, bool))).reshape(-1, BLOCK)
        self.ids = np.concatenate((ids, np.zeros(pad, ids.dtype))).reshape(-1, BLOCK)
        if pad:
            vectors = np.vstack([vectors, np.repeat(vectors[-1:], pad, 0)])
        self.forward = vectors.reshape(-1, BLOCK, vectors.shape[1])
        self.most, self.least = self.forward.max(1), self.forward.min(1)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.scores = np.full((queries, k), NO_SCORE, np.int64)
        self.ids = np.full((queries, k), NO_ID, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.hstack([self.scores[rows], scores])
        ids = np.hstack([self.ids[rows], ids])
        order = np.lexsort((ids, -scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.ids[rows] = np.take_along_axis(ids, order, 1)


def search(blocks: Blocks, query_ids: np.ndarray, queries: np.ndarray, best: Best, rows: np.ndarray) -> None:
    """Offer every vector of the blocks that can be among the best of a query; ``rows`` are the queries' rows in ``best``."""
    bounds = blocks.bounds(queries)
    order = np.argsort(-bounds, axis=1, kind="stable")
    ranked = np.take_along_axis(bounds, order, 1)
    open_ = np.arange(len(rows))
    for at in range(0, order.shape[1], AHEAD):
        # A query with places left takes every block.
        open_ = open_[(best.ids[rows[open_], -1] == NO_ID) | (ranked[open_, at] >= best.scores[rows[open_], -1])]
        if not len(open_):
            break
        chosen = order[open_, at : at + AHEAD]
        scores = np.matmul(blocks.forward[chosen].reshape(len(open_), -1, queries.shape[1]), queries[open_, :, None])[:, :, 0]
        ids = blocks.ids[chosen].reshape(len(open_), -1)
        barred = ~blocks.real[chosen].reshape(len(open_), -1) | (ids == query_ids[open_, None])
        if scores.dtype == object:
            if (np.abs(scores[~barred]) > NO_ID).any():
                raise OverflowError("an inner product is beyond what a long can hold")
            scores[barred] = 0
        scores = scores.astype(np.int64)
        scores[barred] = NO_SCORE
        best.offer(rows[open_], scores, np.where(barred, NO_ID, ids))


def batches_of(queries: DataFrame, id_col: str, vector_col: str, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) of the queries, BATCH at a time, read from one partition after another."""
    block: list = []
    for row in queries.select(id_col, vector_col).toLocalIterator():
        block.append(row)
        if len(block) == BATCH:
            yield as_arrays(block, scale)
            block = []
    if block:
        yield as_arrays(block, scale)


def as_arrays(rows: list, scale: int) -> tuple[np.ndarray, np.ndarray]:
    ok, vectors = integer_vectors(pa.array([r[1] for r in rows], pa.list_(pa.float64())), scale)
    return np.array([rows[k][0] for k in ok], np.int64), vectors


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all other rows.

    Components are floor(scale * x). Ties go to the smaller id; ranks begin at
    1; fewer than k others give fewer rows. Vectors that are null, empty or
    hold a null or non-finite component, and rows with a null id, take no part.
    A shorter vector counts as filled up with zeros. Of queries that repeat an
    id the least vector counts; a query's own id is no candidate. Repeated
    candidates are candidates each. An inner product that a long can't hold
    raises an error. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, number)
    usable = vectors.filter(sound)
    schema = "query_id bigint, vec_id bigint, score bigint"
    asked = queries.filter(sound).groupBy(id_col).agg(F.min(vector_col).alias(vector_col))
    batches = batches_of(asked, id_col, vector_col, scale)

    def one_pass(batch: tuple[np.ndarray, np.ndarray], alone: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(batch)
        found = _one_pass(usable, shared, k, scale, id_col, vector_col, schema)
        if not alone:
            # Several batches rank one by one, so that no more than k rows of a query are kept.
            found = materialize(ranked(found), "topk")
            shared.destroy()
        return found

    def ranked(found: DataFrame) -> DataFrame:
        by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = next(batches, None)
    if first is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    second = next(batches, None)
    if second is None:
        return ranked(one_pass(first, True))
    found = one_pass(first, False).union(one_pass(second, False))
    for batch in batches:
        found = found.union(one_pass(batch, False))
    return found


def _one_pass(usable: DataFrame, shared, k: int, scale: int, id_col: str, vector_col: str, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best = Best(len(query_ids), k)
        held: list = []

        def work() -> None:
            ids = np.concatenate([i for i, _ in held])
            width = max(queries.shape[1], *(v.shape[1] for _, v in held))
            vectors, wide = np.vstack([widened(v, width) for _, v in held]), widened(queries, width)
            kind = exact_type(vectors, wide)
            blocks, wide = Blocks(ids, as_exact(vectors, kind)), as_exact(wide, kind)
            for at in range(0, len(query_ids), TOGETHER):
                rows = np.arange(at, min(at + TOGETHER, len(query_ids)))
                search(blocks, query_ids[rows], wide[rows], best, rows)
            held.clear()

        count = 0
        for batch in batches:
            ok, vectors = integer_vectors(batch.column(1), scale)
            if len(ok):
                held.append((batch.column(0).to_numpy(zero_copy_only=False)[ok].astype(np.int64), vectors))
                count += len(ok)
            if count >= HELD:
                work()
                count = 0
        if held:
            work()
        for at in range(0, len(query_ids), 1000):
            scores, ids = best.scores[at : at + 1000], best.ids[at : at + 1000]
            real = ids != NO_ID
            asked = np.repeat(query_ids[at : at + 1000], k).reshape(-1, k)[real]
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked), pa.array(ids[real]), pa.array(scores[real])], names=["query_id", "vec_id", "score"]
            )

    return usable.select(F.col(id_col).cast("bigint"), F.col(vector_col)).mapInArrow(run, schema)


def widened(vectors: np.ndarray, width: int) -> np.ndarray:
    return vectors if vectors.shape[1] == width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
