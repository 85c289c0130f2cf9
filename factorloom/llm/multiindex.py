"""Nearest neighbours by an inverted multi-index: two codebooks, cells of centroid pairs, exact reranking."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, stored

#: Vectors that the codebooks are fitted to at most, rows of a cell that meet a query in one task.
FITTED = 20_000
BLOCK_ROWS = 4096
#: Queries, those with the least hashes, on which the share of entries to be seen is measured, and the recall that they must reach.
TRIED, RECALL = 100, 0.95
#: Queries of a cell that meet a block of entries in one task.
QUERY_ROWS = 4096


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null, empty or zero, and has only finite components."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.withColumn("_v", v).where(F.col("_v").isNotNull() & ~bad & F.exists("_v", lambda x: x != 0.0))


@dataclass
class Codebooks:
    """Centroids of the two halves of a vector."""

    halves: list[np.ndarray]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half to each centroid."""
        out, at = [], 0
        for c in self.halves:
            h = x[:, at : at + c.shape[1]]
            at += c.shape[1]
            out.append(np.maximum((h * h).sum(1)[:, None] - 2 * h @ c.T + (c * c).sum(1)[None, :], 0))
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.halves[1]) + b.argmin(1)


def centroids_for(n: int) -> int:
    """Centroids of a half for ``n`` entries: they grow with the fourth root, so that entries of a cell grow with the square root of n."""
    return int(min(512, max(4, round(2.5 * n**0.25))))


def fit_codebooks(sample: np.ndarray, centroids: int, rounds: int = 12) -> Codebooks:
    """Lloyd's rounds on each half of a bounded sample; empty centroids stay where they are."""
    halves, split = [], sample.shape[1] // 2
    for h in (sample[:, :split], sample[:, split:]):
        start = np.unique(h, axis=0)
        c = start[np.random.default_rng(3).permutation(len(start))[: min(centroids, len(start))]].copy()
        for _ in range(rounds):
            near = np.argmin((c * c).sum(1)[None, :] - 2 * h @ c.T, axis=1)
            n = np.bincount(near, minlength=len(c))
            for k in np.flatnonzero(n):
                c[k] = h[near == k].mean(0)
        halves.append(c)
    return Codebooks(halves)


def traverse(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells in ascending order of a[i] + b[j] until they hold ``wanted`` entries.

    The heap starts at the best pair of sorted halves; a pair is put in when both pairs before it are out.
    """
    order_a, order_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    sa, sb = a[order_a].tolist(), b[order_b].tolist()
    heap, out, held = [(sa[0] + sb[0], 0, 0)], [], 0
    taken = [0] * len(sa)  # pairs out in each row, a prefix
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        taken[i] = j + 1
        cell = order_a[i] * len(sb) + order_b[j]
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        if j + 1 < len(sb) and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if i + 1 < len(sa) and taken[i + 1] == j:
            heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
    return out


def needed_shares(entries: DataFrame, ids: np.ndarray, q: np.ndarray, books: Codebooks, sizes: np.ndarray, k: int) -> np.ndarray:
    """For each of the true ``k`` neighbours of the queries (ids, q): the share of entries that a query has seen with the neighbour's cell.

    Each task keeps the nearest of a batch for each query, so what travels is bounded by the batches.
    """

    def nearest(batches: Batches) -> Batches:
        for batch in batches:
            own, x, cell = batch.column("id").to_numpy(), _matrix(batch.column("_v")), batch.column("cell").to_numpy()
            if not len(own):
                continue
            d = (x * x).sum(1)[None, :] - 2 * q @ x.T + (q * q).sum(1)[:, None]
            d[own[None, :] == ids[:, None]] = np.inf
            at = np.argpartition(d, min(k, len(own)) - 1, axis=1)[:, :k]
            row = np.repeat(np.arange(len(ids)), at.shape[1])
            at = at.ravel()
            some = np.isfinite(d[row, at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[some], pa.int32()), pa.array(d[row, at][some]), pa.array(own[at][some]), pa.array(cell[at][some])], ["query", "d", "id", "cell"]
            )

    order = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    found = entries.mapInArrow(nearest, "query int, d double, id long, cell int").withColumn("n", order).where(F.col("n") <= k)
    a, b = books.distances(q)
    total, seen = int(sizes.sum()), {}
    for row in range(len(ids)):
        cells = traverse(a[row], b[row], sizes, total)
        for cell, share in zip(cells, (np.cumsum(sizes[cells]) / total).tolist(), strict=True):
            seen[row, cell] = share
    return np.array([seen[r["query"], r["cell"]] for r in found.select("query", "cell").collect()])


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", visited: float | None = None) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance in double precision): the ``k`` nearest rows that were found.

    Every usable row is in the index; the codebooks come from at most FITTED rows with the least hashes. A query looks
    at whole cells until it has seen ``visited`` of all entries and at least k + 1. Without ``visited`` that share is measured: it is
    the least one that finds RECALL of the true neighbours of at most TRIED queries. Entries of a cell are dealt out to blocks of
    about BLOCK_ROWS, and a block meets the queries of its cell in one product, so neither a large cell nor copies of one
    vector end in one task. Ties go to the smaller vec_id; the query's own row is left out. Vectors that are null, empty,
    zero, or hold null or non-finite components, and rows without id, take no part. Vectors of several lengths are refused with a
    ValueError. Repeated rows are entries each; all rows with a query's id count as its own. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    base = usable(vectors, vector).select(F.col(vec_id).alias("id"), "_v").where("id is not null")
    asked = usable(queries, vector).select(F.col(vec_id).alias("query_id"), F.col("_v").alias("q")).where("query_id is not null")
    sample = base.orderBy(F.xxhash64("id"), "id").limit(FITTED).select("_v").collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], result)
    every = base.select("_v").unionByName(asked.select(F.col("q").alias("_v"))).agg(F.min(F.size("_v")).alias("low"), F.max(F.size("_v")).alias("high"))
    low, high = every.first()
    if low != high:
        raise ValueError(f"vectors of several lengths: {low} to {high}")
    if low < 2:
        raise ValueError("vectors need two components for two halves")
    books = fit_codebooks(np.array([r["_v"] for r in sample]), centroids_for(base.count()))
    n_cells = len(books.halves[0]) * len(books.halves[1])

    def assign(batches: Batches) -> Batches:
        for batch in batches:
            x = _matrix(batch.column("_v"))
            cells = books.cells(x) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("_v"), pa.array(cells, pa.int32())], ["id", "_v", "cell"])

    entries = stored(base.mapInArrow(assign, "id long, _v array<double>, cell int"), "entries")
    sizes = np.zeros(n_cells, np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    if visited is None:
        tried = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(TRIED).collect()
        shares = np.zeros(0)
        if tried:
            shares = needed_shares(entries, np.array([r["query_id"] for r in tried]), np.array([r["q"] for r in tried]), books, sizes, k)
        visited = float(np.quantile(shares, RECALL, method="higher")) if len(shares) else 1.0
    wanted = max(k + 1, int(np.ceil(visited * sizes.sum())))
    blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))

    def route(batches: Batches) -> Batches:
        for batch in batches:
            x = _matrix(batch.column("q"))
            if not len(x):
                continue
            a, b = books.distances(x)
            for row in range(len(x)):
                cells = traverse(a[row], b[row], sizes, wanted)
                one = batch.slice(row, 1)
                take = pa.array(np.zeros(len(cells), np.int64))
                yield pa.RecordBatch.from_arrays([one.column("query_id").take(take), one.column("q").take(take), pa.array(cells, pa.int32())], ["query_id", "q", "cell"])

    routed = asked.mapInArrow(route, "query_id long, q array<double>, cell int")
    of = F.element_at(F.array(*[F.lit(int(n)) for n in blocks]), F.col("cell") + 1)
    groups = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // QUERY_ROWS)))).cast("int")
    routed = routed.withColumn("block", F.explode(F.sequence(F.lit(0), of - 1))).withColumn("part", groups)
    routed = stored(routed, "routed")
    # Each block of entries meets each group of queries that come to its cell once; both are bounded.
    met = routed.select("cell", "block", "part").distinct().toDF("cell", "block", "part")
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("id"), of).cast("int")).join(met, ["cell", "block"])

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left.column("id").to_numpy(), _matrix(left.column("_v").combine_chunks())
        asking, q = right.column("query_id").to_numpy(), _matrix(right.column("q").combine_chunks())
        out: list[tuple[np.ndarray, ...]] = []
        if len(ids) and len(asking):
            near = (x * x).sum(1)[None, :] - 2 * q @ x.T
            for row in range(len(asking)):
                # A margin for rounding, then the exact measure.
                other = np.flatnonzero(ids != asking[row])
                if not len(other):
                    continue
                d = near[row, other]
                least = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                some = other[d <= least + 1e-9 * (1 + np.abs(least) + (q[row] * q[row]).sum())]
                exact = np.sqrt(((x[some] - q[row]) ** 2).sum(1))
                best = np.lexsort((ids[some], exact))[:k]
                out.append((np.full(len(best), asking[row]), ids[some][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c.astype("f8" if t == kinds[2] else "i8"), t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    found = dealt.groupBy("cell", "block", "part").cogroup(routed.groupBy("cell", "block", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
