"""Exact top-k inner products without random access to the sorted lists.

Candidates are dealt into blocks of ``block_rows``; each block has one sorted list per dimension, written to the shared
folder once and read by every group of queries. For a query the lists are read in step, each from its good end: the
high one where the weight is positive, the low one where it is negative. A component read is known; one not yet read
is at most the list's last value read and at least its worst value, which bounds each candidate's score from both
sides, and bounds the score of all candidates that no list has shown yet (the threshold). The k-th best lower bound,
over this and all earlier blocks of the task, is what a candidate must reach. Reading a block stops for a query when
outsiders cannot reach it (the threshold is below) and few of the seen candidates can: their final scores are then
resolved from the vectors. Else the depth doubles, up to the whole lists. Bounds of many queries are matrix products.

Bounds are rounded, with a slack that covers the rounding; final scores are whole numbers of any size. A score that
does not fit a long is the largest or smallest long.

Queries come to the tasks in groups of ``query_rows``; each group is one pass over all blocks, so neither the driver
nor a task holds more than one group whatever the number of queries.

Vectors that are null or hold null or non-finite components take no part. Vectors of another length than the
query's are no candidates for it; empty ones score 0 with each other. Very long vectors make their block larger in
proportion. Ids are taken as unique: of rows that repeat a query's id the smallest vector asks, and none of them is a
candidate for it; repeated candidate rows are each a candidate. Ties go to the smaller id. Null ids take no part. An
empty table gives no rows. Of further columns none is read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

LONG = (1 << 63) - 1
#: Doubles beyond this are compared as whole numbers only: sums of their products may not be finite.
HUGE = 1e120
SHALLOWEST = 32


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exact; ``scale`` is a power of two."""
    return math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale


def exact_scores(queries: np.ndarray, rows: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of pairs of raw vectors, row by row."""
    q, x = np.floor(queries * scale), np.floor(rows * scale)
    reach = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if reach < 2.0**62 and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 2.0**62:
        return (q.astype(np.int64) * x.astype(np.int64)).sum(1)
    made = (sum(whole(a, scale) * whole(b, scale) for a, b in zip(u, v)) for u, v in zip(queries.tolist(), rows.tolist()))
    return np.array([max(-LONG - 1, min(LONG, n)) for n in made], np.int64)


class Lists:
    """A block of vectors and, for each dimension, its rows in ascending order; counts the entries that are read."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32) if order is None else order
        self.entries = 0

    def read(self, start: int, end: int) -> np.ndarray:
        """The rows at places [start, end) of every list."""
        self.entries += self.order.shape[0] * (end - start)
        return self.order[:, start:end]

    def depths(self) -> Iterator[int]:
        n, r = len(self.ids), max(1, len(self.ids) // SHALLOWEST)
        while 2 * r < n:  # from both ends
            yield r
            r *= 2
        yield n


def block_top(
    queries: np.ndarray, own: np.ndarray, lists: Lists, k: int, best: np.ndarray, scale: int = 256
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of all pairs that can be among the best ``k``; raises ``best``, the
    k-th best lower bound of each query so far, in place."""
    n, d = lists.vectors.shape
    huge = (np.abs(lists.vectors) > HUGE).any(axis=1)[None, :] | (np.abs(queries) > HUGE).any(axis=1)[:, None]
    q, x = np.floor(np.clip(queries, -HUGE, HUGE) * scale), np.floor(np.clip(lists.vectors, -HUGE, HUGE) * scale)
    slack = 1e-12 * (np.abs(q).sum(1) * np.abs(x).max(initial=0)) + 0.25
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    mine = own[:, None] == lists.ids[None, :]
    at, live, found = np.arange(d), np.arange(len(q)), []
    high, low, done = np.zeros((n, d), bool), np.zeros((n, d), bool), 0
    unset = ~np.isfinite(best)
    worst_high, worst_low = (x[lists.order[:, j], at] if n else None for j in (0, n - 1))
    for r in lists.depths():
        if r < n:
            high[lists.read(n - r, n - done), at[:, None]] = True
            low[lists.read(done, r), at[:, None]] = True
            done = r
            last_high, last_low = x[lists.order[:, n - r], at], x[lists.order[:, r - 1], at]
            # Lower bounds are only worth their cost until an earlier block has set the mark.
            first = live[unset[live]]
            if len(first) and n >= k:
                lower = plus[first] @ np.where(high, x, worst_high).T + minus[first] @ np.where(low, x, worst_low).T
                lower[mine[first] | huge[first]] = -np.inf
                best[first] = np.maximum(best[first], np.partition(lower, n - k, axis=1)[:, n - k] - slack[first])
            threshold = plus[live] @ last_high + minus[live] @ last_low
            closed = live[threshold < best[live] - slack[live]]
            if not len(closed):
                continue
            upper = plus[closed] @ np.where(high, x, last_high).T + minus[closed] @ np.where(low, x, last_low).T
            alive = (upper >= (best[closed] - slack[closed])[:, None]) | huge[closed]
            few = alive.sum(axis=1) <= max(4 * k, n // 16)
        else:
            lists.read(done, n - done)
            closed, upper = live, q[live] @ x.T
            if n >= k:
                others = np.where(mine[live] | huge[live], -np.inf, upper)
                best[live] = np.maximum(best[live], np.partition(others, n - k, axis=1)[:, n - k] - slack[live])
            alive = (upper >= (best[live] - slack[live])[:, None]) | huge[live]
            few = np.ones(len(live), bool)
        a, b = np.nonzero(alive[few])
        found.append((closed[few][a], b))
        live = np.setdiff1d(live, closed[few])
        if not len(live):
            break
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    other = ~mine[a, b]
    a, b = a[other], b[other]
    scores = np.empty(len(a), np.int64)
    for s in range(0, len(a), 1 << 16):
        e = s + (1 << 16)
        scores[s:e] = exact_scores(queries[a[s:e]], lists.vectors[b[s:e]], scale)
    return a, b, scores


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    query_rows: int = 4096,
    block_rows: int = 8192,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` highest integer inner products of each query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the id column.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "topk")
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
        .filter(
            F.col("vec_id").isNotNull() & F.col("v").isNotNull()
            & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
        )
    )
    rows = ws.keep(rows, "vectors")
    lists = ws.keep(_lists(rows.select("vec_id", "v"), block_rows), "lists")
    asked = ws.keep(rows.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    groups = max(1, -(-asked.count() // query_rows))
    passes = []
    for g in range(groups):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).collect()  # about query_rows rows
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {len(r["v"]) for r in part}:
            own = sorted((r["vec_id"], r["v"]) for r in part if len(r["v"]) == d)
            by_length[d] = np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.float64).reshape(len(own), d)
        passes.append(_one_pass(lists, spark.sparkContext.broadcast(by_length), k, scale))
    found = reduce(DataFrame.unionAll, passes)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _lists(rows: DataFrame, block_rows: int) -> DataFrame:
    """One row for each block of vectors of one length: ids, vectors and sorted lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(d: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(d)))
            made = Lists(ids, vectors)
            return pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, made.order)]],
                names=["d", "ids", "vectors", "sorted"],
            )

        for batch in batches:
            values = batch.column(1)
            lengths = values.value_lengths().to_numpy(zero_copy_only=False)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                held.setdefault(d, []).append((ids[at], flat[(edges[at][:, None] + np.arange(d)[None, :])]))
                if sum(len(i) for i, _ in held[d]) >= block_rows:
                    yield block(d)
        for d in list(held):
            yield block(d)

    return rows.mapInArrow(run, "d int, ids binary, vectors binary, sorted binary")


def _one_pass(lists: DataFrame, queries, k: int, scale: int) -> DataFrame:
    """Each task's best ``k`` for each query of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple] = {}
        for batch in batches:
            for d, ids, vectors, order in zip(*[c.to_pylist() for c in batch.columns]):
                if d not in queries.value:
                    continue
                ids = np.frombuffer(ids, np.int64)
                block = Lists(ids, np.frombuffer(vectors, np.float64).reshape(len(ids), d), np.frombuffer(order, np.int32).reshape(d, len(ids)))
                own, q = queries.value[d]
                if d not in state:
                    none = np.zeros(0, np.int64)
                    state[d] = np.full(len(own), -np.inf), none, none, none
                best, *top = state[d]
                parts = [top]
                for s in range(0, len(own), 512):
                    a, b, score = block_top(q[s : s + 512], own[s : s + 512], block, k, best[s : s + 512], scale)
                    parts.append([a + s, ids[b], score])
                a, b, score = (np.concatenate(x) for x in zip(*parts))
                rank = np.lexsort((b, -score.astype(object) if len(score) and score.min() == -LONG - 1 else -score, a))
                a, b, score = a[rank], b[rank], score[rank]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                state[d] = best, a[keep], b[keep], score[keep]
        for d, (_, a, b, score) in state.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries.value[d][0][a]), pa.array(b), pa.array(score)], names=["query_id", "vec_id", "score"]
            )

    return lists.mapInArrow(run, "query_id long, vec_id long, score long")
