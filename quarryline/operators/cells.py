"""Stored vectors in coarse cells, and exact nearest neighbours that skip cells and vectors by the triangle inequality.

Cells come from k-means of a bounded sample (SAMPLE vectors, by a hash of their ids); every vector is then dealt to its nearest centre and kept with its distance to it, in a folder per cell. A query at
distance d from a centre is at least |d - t| from a vector at distance t from that centre, so with the k-th distance found so far as a limit

1. the query's nearest cells that hold k vectors together are read first and give the limit,
2. other cells are read only if their nearest possible vector is within it: t lies between the cell's least and greatest distance,
3. of a cell that is read only the vectors whose own bound is within the limit are multiplied with the query.

What is skipped is farther than the k-th, so the list is that of a full scan. Cosine distance uses vectors of length 1, whose squared distance is twice the cosine distance; vectors of length 0 have a cell of their own (-1) that
every query reads.

Blocks of QUERY_BLOCK queries go to the tasks; a task keeps k rows per query. On the driver are the centres, a block's queries and their k first rows, all of stated size.

Defined cases: rows with a null id or vector are no vectors; rows that share an id are vectors of their own; ties go to the smaller id; fewer than k vectors give as many rows as there are; an empty table gives none.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = 64
SAMPLE = 20_000
ROUNDS = 8
QUERY_BLOCK = 4096
#: Distances are rounded to six places before they are ranked; bounds leave room for that.
MARGIN = 2e-6
VECTORS = "chunk_id long, embedding array<double>, distance double, cell int"
NEAR = "query_id long, chunk_id long, distance double, tested long"


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """k-means from evenly spaced rows of the sample, which come in the order of a hash."""
    if not len(sample):
        return sample
    own = np.unique(sample, axis=0)
    at = own[np.linspace(0, len(own) - 1, min(cells, len(own))).astype(int)]
    for _ in range(ROUNDS):
        nearest = squared(sample, at).argmin(1)
        n = np.bincount(nearest, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, nearest, sample)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


@dataclasses.dataclass(frozen=True)
class CellIndex:
    """Vectors (chunk_id, embedding) under a folder. metric: squared l2, or cosine."""

    spark: SparkSession
    root: str
    metric: str = "l2"

    def write(self, vectors: DataFrame, cells: int = CELLS) -> None:
        own = vectors.where("chunk_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<double>"))
        some = own.orderBy(F.xxhash64("chunk_id"), "chunk_id", "embedding").limit(SAMPLE).select("embedding").toArrow().column(0)
        sample = matrix(some.combine_chunks()) if len(some) else np.zeros((0, 1))
        at, cosine = centres(unit(sample[np.linalg.norm(sample, axis=1) > 0]) if self.metric == "cosine" else sample, cells), self.metric == "cosine"

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(1))
                    void = np.linalg.norm(x, axis=1) == 0 if cosine or not len(at) else np.zeros(len(x), bool)
                    x = unit(x) if cosine else x
                    d = squared(x, at) if len(at) else np.zeros((len(x), 1))
                    cell = np.where(void, -1, d.argmin(1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(void, 0.0, np.sqrt(d.min(1)))), pa.array(cell)], ["chunk_id", "embedding", "distance", "cell"])

        own.mapInArrow(deal, VECTORS).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors")
        stats = self.vectors().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"))
        spread = self.spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(at)], "cell int, centre array<double>")
        stats.join(spread, "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cells")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(VECTORS).parquet(f"{self.root}/vectors")

    def cells(self) -> list:
        """cell, n, least, most, centre: CELLS rows and one at most."""
        return self.spark.read.schema("cell int, n long, least double, most double, centre array<double>").parquet(f"{self.root}/cells").orderBy("cell").collect()

    def near(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id, distance of the k nearest of each query (query_id, embedding), and `tested`: with the first of a query's rows of a task, how many vectors it was multiplied with."""
        cells = self.cells()
        own = queries.where("query_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
        blocks = -(-own.count() // QUERY_BLOCK)
        found: list[DataFrame] = []
        for b in range(blocks if cells else 0):
            rows = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
            if rows:
                found += self.block(cells, np.array([r.query_id for r in rows]), np.array([list(r.embedding) for r in rows], np.float64), k)
        return functools.reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], NEAR)

    def block(self, cells: list, ids: np.ndarray, q: np.ndarray, k: int) -> list[DataFrame]:
        own = unit(q) if self.metric == "cosine" else q
        n = np.array([c.n for c in cells])
        known = [j for j, c in enumerate(cells) if c.centre is not None]
        to = np.zeros((len(ids), len(cells)))
        if known:
            to[:, known] = np.sqrt(squared(own, np.array([cells[j].centre for j in known], np.float64)))
        least, most = (np.array([getattr(c, name) for c in cells]) for name in ("least", "most"))
        bound = np.maximum(np.maximum(to - most[None, :], least[None, :] - to), 0)
        bound[:, [j for j, c in enumerate(cells) if c.centre is None]] = 0  # not measured from a centre
        # the nearest cells that hold k vectors together
        order = np.argsort(to, axis=1, kind="stable")
        before = np.cumsum(n[order], 1) - n[order]
        first = np.zeros(to.shape, bool)
        np.put_along_axis(first, order, before < k, 1)
        one = self.scan(cells, ids, q, to, first, np.full(len(ids), np.inf), k)
        limit = np.full(len(ids), np.inf)
        place = {i: p for p, i in enumerate(ids.tolist())}
        # at most k rows per query of the block
        last = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))).where(F.col("rank") == k).select("query_id", "distance").collect()
        for r in last:
            limit[place[r.query_id]] = np.sqrt((2 * r.distance if self.metric == "cosine" else r.distance) + MARGIN)
        rest = ~first & (bound <= limit[:, None] + MARGIN)
        return [one, self.scan(cells, ids, q, to, rest, limit, k)] if rest.any() else [one]

    def scan(self, cells: list, ids: np.ndarray, q: np.ndarray, to: np.ndarray, asked: np.ndarray, limit: np.ndarray, k: int) -> DataFrame:
        wanted = {cells[j].cell: np.flatnonzero(asked[:, j]) for j in np.flatnonzero(asked.any(0))}
        distance = {cells[j].cell: to[wanted[cells[j].cell], j] for j in np.flatnonzero(asked.any(0))}
        cosine = self.metric == "cosine"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            tested = np.zeros(len(ids), np.int64)
            for batch in batches:
                chunk_ids, x, t, cell = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                for c in np.unique(cell).tolist():
                    rows, who = np.flatnonzero(cell == c), wanted[c]
                    y = x[rows]
                    for at, p in enumerate(who.tolist()):
                        some = np.flatnonzero(np.abs(t[rows] - distance[c][at]) <= limit[p] + MARGIN) if c >= 0 else np.arange(len(rows))
                        if not len(some):
                            continue
                        tested[p] += len(some)
                        z = y[some]
                        d = 1 - (z @ q[p]) / np.maximum(np.linalg.norm(z, axis=1) * np.linalg.norm(q[p]), 1e-300) if cosine else np.maximum((q[p] ** 2).sum() + (z**2).sum(1) - 2 * z @ q[p], 0)
                        old_d, old_i = best.get(p, (np.zeros(0), np.zeros(0, np.int64)))
                        d, i = np.r_[old_d, np.round(d, 6)], np.r_[old_i, chunk_ids[rows[some]]]
                        first = np.lexsort((i, d))[:k]
                        best[p] = d[first], i[first]
            for p, (d, i) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), ids[p])), pa.array(i), pa.array(d), pa.array(np.r_[tested[p], np.zeros(len(d) - 1, np.int64)])], ["query_id", "chunk_id", "distance", "tested"])

        return self.vectors().where(F.col("cell").isin(list(wanted))).mapInArrow(run, NEAR)


def top(near: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, distance: as `retrieval.dense_top`."""
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "chunk_id", "distance")


def report(near: DataFrame, total: int) -> DataFrame:
    """query_id, how many vectors it was multiplied with, and the share of all that was skipped."""
    return near.groupBy("query_id").agg(F.sum("tested").alias("tested")).select("query_id", "tested", F.round(1 - F.col("tested") / total, 6).alias("skipped"))
