"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt into buckets of similar length, the longest first. For a query and a bucket, its k-th best score so far
gives the least cosine that a vector of the bucket's length needs: above 1 the bucket is skipped; a high one prunes by
the ranges that single coordinates of a unit vector may have, a low one by length alone. What stays is verified by
its product. Thresholds start from the HEAD longest vectors. Queries are a stated set, taken in blocks of BLOCK, ROUND
blocks a job.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import as_batch, settle

BLOCK = 4096
#: Blocks that one job takes together, each of them with each part of the buckets as a task.
ROUND = 16
HEAD = 1024
BUCKET = 2048
#: From this local cosine on, coordinates prune; below it length does.
HIGH = 0.6
FOCUS = 3
#: Relative slack of bounds in floating point; a bound only decides what is verified.
SLACK = 1e-7


def _usable(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (floor(scale * x) of each component) and length of every row whose id and components are usable."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e")).where(F.col("id").isNotNull() & _usable("e"))
    ints = own.select("id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return ints.select("id", "v", F.sqrt(square).alias("length"))


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, np.int64).reshape(len(rows), -1)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point only where that is exact, and those beyond 64 bits as the nearest number of 64 bits."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return q @ v.T
    exact = q.astype(object) @ v.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if len(scores) > 4 * self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]

    def kth(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf


class Queries:
    """A block of queries of one dimension, with a first bound on their k-th score."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.lengths = np.sqrt((values.astype(np.float64) ** 2).sum(1))
        unit = values / np.maximum(self.lengths, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.focus_values = np.take_along_axis(unit, self.focus, 1)
        self.bounds = np.full(len(ids), -np.inf)

    def learn(self, ids: np.ndarray, values: np.ndarray) -> None:
        scores = _products(self.values, values)
        for q in range(len(self.ids)):
            own = scores[q][ids != self.ids[q]]
            if len(own) >= self.k:
                self.bounds[q] = np.partition(own, len(own) - self.k)[len(own) - self.k]

    def search(self, best: _Best, ids: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        """One bucket, longest first."""
        need = np.maximum(self.bounds, [best.kth(q) for q in range(len(self.ids))])
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = need / (self.lengths * lengths[0])
        free = ~(need > 0) | ~np.isfinite(cosine)  # no bound on the length follows
        todo = free | (cosine <= 1 + SLACK)
        by_coordinate = todo & ~free & (cosine >= HIGH)
        by_length = np.flatnonzero(todo & ~by_coordinate)
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(free[by_length], -np.inf, need[by_length] / self.lengths[by_length] * (1 - SLACK))
            upto = np.searchsorted(-lengths, -least, side="right")
            most = int(upto.max())
            scores = _products(self.values[by_length], values[:most]) if most else np.zeros((len(by_length), 0), np.int64)
            for row, q, n in zip(scores, by_length.tolist(), upto.tolist(), strict=True):
                self._offer(best, q, need[q], row[:n], ids[:n])
        if by_coordinate.any():
            unit = values.T / np.maximum(lengths, 1e-300)
            for q in np.flatnonzero(by_coordinate).tolist():
                t = min(1.0, cosine[q] * (1 - SLACK))
                stay = np.ones(len(ids), bool)
                for f, x in zip(self.focus[q].tolist(), self.focus_values[q].tolist(), strict=True):
                    stay &= (unit[f] >= self._low(x, t) - SLACK) & (unit[f] <= self._high(x, t) + SLACK)
                at = np.flatnonzero(stay)
                if len(at):
                    self._offer(best, q, need[q], _products(self.values[q : q + 1], values[at])[0], ids[at])

    @staticmethod
    def _low(x: float, t: float) -> float:
        """The least that a coordinate of a unit vector can be whose cosine with the query is t at least; x: the query's own."""
        return -1.0 if x <= -t else x * t - np.sqrt(max(0.0, (1 - t * t) * (1 - x * x)))

    @staticmethod
    def _high(x: float, t: float) -> float:
        return 1.0 if x >= t else x * t + np.sqrt(max(0.0, (1 - t * t) * (1 - x * x)))

    def _offer(self, best: _Best, q: int, need: float, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= need) & (ids != self.ids[q])
        if good.any():
            best.add(q, scores[good], ids[good])


def _search(buckets: DataFrame, shared) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        blocks = shared.value
        best = {d: _Best(len(b.ids), b.k) for d, b in blocks.items()}
        for batch in batches:
            ids, lengths = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            sizes = batch.column(1).value_lengths().to_numpy()
            flat, ends = batch.column(1).flatten().to_numpy(), np.cumsum(sizes)
            for d in set(np.unique(sizes).tolist()) & set(blocks):
                own = np.flatnonzero(sizes == d)
                for i in range(0, len(own), BUCKET):
                    at = own[i : i + BUCKET]
                    at = at[np.argsort(-lengths[at], kind="stable")]
                    blocks[d].search(best[d], ids[at], flat[(ends[at] - d)[:, None] + np.arange(d)], lengths[at])
        for d, b in blocks.items():
            for q, query in enumerate(b.ids.tolist()):
                if len(best[d].ids[q]):
                    yield as_batch([[query] * len(best[d].ids[q]), best[d].ids[q], best[d].scores[q]], schema)

    return buckets.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest integer inner products of each query with all other rows.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor rows without an id; vectors are
    only compared with those of as many components. A score beyond 64 bits counts as the nearest number of 64 bits. Ties go to the smaller id. Of rows that share a query's id the
    least vector asks, and none of them is its answer. Fewer than k other rows give all of them. Further columns are not read.
    """
    spark = df.sparkSession
    all_rows = vectors(df, id_col, vector_col, scale)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = settle(all_rows.repartitionByRange(parts, F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), "id"))
    chosen = settle(buckets.withColumn(id_col, F.col("id")).where(is_query).groupBy("id").agg(F.min("v").alias("v")))
    n = -(-chosen.count() // BLOCK)
    head = buckets.orderBy(F.desc("length"), "id").limit(HEAD).select("id", "v").collect()
    found, rounds = [], []
    for b in range(n):
        part = chosen if n == 1 else chosen.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b)
        rows, blocks = part.orderBy("id").collect(), {}
        for d in {len(r.v) for r in rows}:
            own, near = [r for r in rows if len(r.v) == d], [r for r in head if len(r.v) == d]
            blocks[d] = Queries(np.array([r.id for r in own], np.int64), _matrix([r.v for r in own]), k)
            if near:
                blocks[d].learn(np.array([r.id for r in near], np.int64), _matrix([r.v for r in near]))
        found.append(_search(buckets, spark.sparkContext.broadcast(blocks)))
        if len(found) == ROUND and b < n - 1:
            rounds.append(settle(reduce(DataFrame.unionByName, found)))
            found = []
    answers = reduce(DataFrame.unionByName, rounds + found) if found else spark.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
