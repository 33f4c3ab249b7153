"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector, less the mean of all vectors, is divided by its length and rotated at random; the signs of its coordinates, packed
to bits, are its code. Beside the code stand two correction scalars: that length, and the product of the unit vector with
the code's own direction. Bits and scalars estimate the inner product with a query, with an error that stays
below a bound known from the scalars but for a small probability (parameter `sigmas`).

Queries are a stated set, taken in blocks of bounded size that are broadcast; of each block all codes are read once. A query
starts from its k-th best product over a small head of vectors, which are all reranked. Another vector is chosen for
reranking where its estimate plus the bound reaches the k-th best product so far; reranking is exact, on the original vectors. The codes lie beside the vectors,
so what is chosen is at hand and no vector is shuffled; a task hands on k rows a query at most.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import as_batch, bounded_batches, settle

#: Bytes of query vectors in a block.
BLOCK_BYTES = 16 * 2**20
#: Vectors, the first by a hash of their id, from which queries take their first bounds.
HEAD = 2048
#: Codes and queries that are estimated at a time.
CODES, QUERIES = 2048, 1024
#: Relative slack of sums in floating point; a bound only decides what is reranked.
SLACK = 1e-9


@lru_cache(maxsize=4)
def rotation(dimension: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every worker."""
    q, r = np.linalg.qr(np.random.default_rng(dimension).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (rows of bytes), lengths and fits. A vector equal to the mean has length 0 and any code."""
    own = vectors - mean
    length = np.sqrt((own * own).sum(1))
    rotated = own @ rotation(own.shape[1]).T
    fit = np.abs(rotated).sum(1) / (np.maximum(length, 1e-300) * np.sqrt(own.shape[1]))
    return np.packbits(rotated > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def signs(codes: np.ndarray, dimension: int) -> np.ndarray:
    """The code's directions: bits as 1 and -1 over the root of the dimension."""
    bits = np.unpackbits(codes, axis=1, count=dimension).astype(np.float32)
    return (2 * bits - 1) / np.float32(np.sqrt(dimension))


def products(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows, each summed in the same order wherever its row stands."""
    return (vectors * q).sum(1)


class Queries:
    """A block of queries of one dimension: rotated, with their products with the mean and a first bound on the k-th product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, mean: np.ndarray, k: int, sigmas: float):
        self.ids, self.vectors, self.mean, self.k = ids, vectors, mean, k
        self.rotated = (vectors @ rotation(vectors.shape[1]).T).astype(np.float32)
        self.length = np.sqrt((vectors * vectors).sum(1))
        self.on_mean = vectors @ mean
        self.error = sigmas / np.sqrt(max(1, vectors.shape[1] - 1)) * self.length
        self.bounds = np.full(len(ids), -np.inf)

    def learn(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for i in range(0, len(self.ids), QUERIES):
            found = self.vectors[i : i + QUERIES] @ vectors.T
            found[self.ids[i : i + QUERIES, None] == ids[None, :]] = -np.inf
            if len(ids) > self.k:
                least = np.partition(found, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                self.bounds[i : i + QUERIES] = np.where(np.isfinite(least), least - SLACK * (1 + np.abs(least)), -np.inf)


class Best:
    """The k best (product, id) of each query of a block so far, and what was reranked for them."""

    def __init__(self, block: Queries):
        n = len(block.ids)
        self.block, self.score, self.id = block, np.full((n, block.k), -np.inf), np.full((n, block.k), np.iinfo(np.int64).max)
        self.least = block.bounds.copy()

    def search(self, ids: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray, vectors: np.ndarray, head: np.ndarray) -> int:
        """Estimate all products of the block with these codes and rerank what may be among the k best, and the ids of the head; how many that were."""
        b, reranked, always = self.block, 0, np.isin(ids, head)
        directions = signs(codes, vectors.shape[1])
        scale = (length / fit).astype(np.float32)
        spread = np.maximum(length * np.sqrt(np.maximum(0.0, 1 - fit * fit)) / fit, 1e-30)
        for i in range(0, len(b.ids), QUERIES):
            end = i + QUERIES
            upper = (b.rotated[i:end] @ directions.T) * scale  # a query's product with a vector, as its code tells it
            upper += (b.error[i:end, None] * spread + b.on_mean[i:end, None] + 1e-6 * b.length[i:end, None] * length).astype(np.float32)
            chosen = ((upper >= self.least[i:end, None]) | always) & (ids != b.ids[i:end, None])
            for q in np.flatnonzero(chosen.any(1)).tolist():
                reranked += self._rerank(i + q, ids, vectors, np.flatnonzero(chosen[q]))
        return reranked

    def _rerank(self, q: int, ids: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> int:
        exact = products(self.block.vectors[q], vectors[at])
        good = exact >= self.least[q]
        score, own = np.concatenate([self.score[q], exact[good]]), np.concatenate([self.id[q], ids[at[good]]])
        order = np.lexsort((own, -score))[: self.block.k]
        self.score[q], self.id[q] = score[order], own[order]
        self.least[q] = max(self.least[q], score[order][-1])
        return len(at)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (doubles) of the rows whose id and vector are usable."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(finite & F.exists("v", lambda x: x != 0))


def _matrices(batch: pa.RecordBatch, column: int):
    """Of each dimension in a batch: rows, and their vectors as a matrix."""
    sizes, flat = batch.column(column).value_lengths().to_numpy(), batch.column(column).flatten().to_numpy()
    ends = np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, flat[(ends[at] - d)[:, None] + np.arange(d)]


def means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each dimension; the driver gets one vector a dimension."""
    schema = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("place", pa.int32()), ("s", pa.float64())])

    def add(batches):
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, at, v in _matrices(batch, 1):
                n, s = sums.get(d, (0, 0.0))
                sums[d] = n + len(at), s + v.sum(0)
        for d, (n, s) in sums.items():
            yield as_batch([[d] * d, [n] * d, np.arange(d, dtype=np.int32), s], schema)

    sums = vectors.select("id", "v").mapInArrow(add, "d int, n long, place int, s double").groupBy("d", "place").agg((F.sum("s") / F.sum("n")).alias("m"))
    out: dict[int, np.ndarray] = {}
    for r in sums.orderBy("d", "place").collect():
        out.setdefault(r.d, np.zeros(r.d))[r.place] = r.m
    return out


def coded(vectors: DataFrame, mean: dict[int, np.ndarray]) -> DataFrame:
    """id, v, code, length and fit. Settled."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("code", pa.binary()), ("length", pa.float64()), ("fit", pa.float64())])
    centres = vectors.sparkSession.sparkContext.broadcast(mean)

    def run(batches):
        for batch in batches:
            for d, at, v in _matrices(batch, 1):
                codes, length, fit = encode(v, centres.value[d])
                own = batch.take(pa.array(at))
                yield as_batch([own.column(0), own.column(1), [c.tobytes() for c in codes], length, fit], schema)

    return settle(vectors.mapInArrow(run, "id long, v array<double>, code binary, length double, fit double"))


def _search(codes: DataFrame, shared) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        head, blocks = shared.value
        best = {d: Best(b) for d, b in blocks.items()}
        for batch in batches:
            ids, length, fit = (batch.column(i).to_numpy() for i in (0, 3, 4))
            for d, at, v in _matrices(batch, 1):
                if d in best:
                    packed = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                    for i in range(0, len(at), CODES):
                        own = at[i : i + CODES]
                        best[d].search(ids[own], packed[i : i + CODES], length[own], fit[own], v[i : i + CODES], head)
        for b in best.values():
            for i in range(0, len(b.block.ids), QUERIES):
                found = np.isfinite(b.score[i : i + QUERIES])
                queries = np.repeat(b.block.ids[i : i + QUERIES], found.sum(1))
                if len(queries):
                    yield as_batch([queries, b.id[i : i + QUERIES][found], b.score[i : i + QUERIES][found]], schema)

    return codes.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, sigmas: float = 2.0) -> DataFrame:
    """query_id, rank, vec_id and score: about the k largest inner products of each query with all other rows, each of them exact.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor rows without an id;
    vectors are only compared with those of as many components. Ties go to the smaller id. Of rows that share a query's id
    the least vector asks, and none of them is its answer. Fewer than k other rows give all of them; an empty table gives
    none. The bound is `sigmas` times the expected error: at 2 some two neighbours in a thousand are missed, at infinity none. Further columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    vectors = usable(df, id_col, vector_col)
    mean = means(vectors)
    codes = coded(vectors, mean)
    chosen = settle(codes.withColumn(id_col, F.col("id")).where(is_query).groupBy("id").agg(F.min("v").alias("v")))
    head = codes.orderBy(F.xxhash64("id"), "id").limit(HEAD).select("id", "v").toArrow().combine_chunks().to_batches()
    head_ids = np.sort(np.concatenate([h.column(0).to_numpy() for h in head] or [np.zeros(0, np.int64)]))
    near = {d: (h.column(0).to_numpy()[at], v) for h in head for d, at, v in _matrices(h, 1)}
    total = chosen.agg(F.coalesce(F.sum(F.size("v") * 8), F.lit(0)).alias("bytes")).first().bytes
    blocks, found = -(-total // BLOCK_BYTES), []
    for b in range(blocks):
        part = chosen if blocks == 1 else chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        rows, queries = part.orderBy("id").toArrow().combine_chunks(), {}
        for batch in rows.to_batches():
            for d, at, v in _matrices(batch, 1):
                queries[d] = Queries(batch.column(0).to_numpy()[at], v, mean[d], k, sigmas)
                if d in near:
                    queries[d].learn(*near[d])
        answers = _search(codes, spark.sparkContext.broadcast((head_ids, queries)))
        found.append(answers if blocks == 1 else settle(answers))
    answers = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
