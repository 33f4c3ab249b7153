"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed words, A-Z lower-cased, and hashed 4-grams of character shapes (letters by case, digits, all else as
itself). A bounded sample of labelled texts (SAMPLE rows, the parameter `sample`) gives term weights, the latent space by
a truncated singular value decomposition, and the labelled vectors that are broadcast: at most SAMPLE x DIMENSIONS
numbers. Every text's cosine with every labelled vector is computed, a block of texts at a time, and the labels of its
NEIGHBOURS nearest vote by similarity; of vectors at the same cosine, to DIGITS decimals, those first in the sample vote.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import as_batch, bounded_batches, chunks, text_input
from .ngrams import code_points, hashed
from .words import between, word_hashes

WORD_TERMS = SHAPE_TERMS = 2048
TERMS = WORD_TERMS + SHAPE_TERMS
DIMENSIONS = 64
SAMPLE = 6_000
NEIGHBOURS = 15
DIGITS = 5
#: Votes weigh as this power of the cosine.
POWER = 4
ROWS = 512
THRESHOLD = 0.7


#: What stands between words.
_BETWEEN = between(32, range(9, 14))


def _shapes() -> np.ndarray:
    table = np.arange(65_536, dtype=np.uint32)
    for code in range(65_536):
        char = chr(code)
        if char.isalpha():
            table[code] = ord("A") if char.isupper() else ord("a")
        elif char.isdigit():
            table[code] = ord("0")
    return table


_SHAPES: list[np.ndarray] = []


def _counted(text: np.ndarray, term: np.ndarray, texts: int, terms: int) -> np.ndarray:
    return np.bincount(text * terms + term, minlength=texts * terms).reshape(texts, terms)


def term_counts(texts: list[str]) -> np.ndarray:
    """log(1 + count) of each term, texts x TERMS: words first, then shapes."""
    if not _SHAPES:
        _SHAPES.append(_shapes())
    n = len(texts)
    words, at = word_hashes(texts, _BETWEEN)
    by_word = _counted(np.repeat(np.arange(n), np.diff(at)), (words % np.uint64(WORD_TERMS)).astype(np.int64), n, WORD_TERMS)
    points, _ = code_points(texts)
    bins = hashed(_SHAPES[0][np.minimum(points, 65_535)], 4, SHAPE_TERMS)
    text = np.cumsum(points == 0)[: len(bins)] - 1
    zeros = np.concatenate([[0], np.cumsum(points == 0)])
    inside = zeros[3 : 3 + len(bins)] - zeros[1 : 1 + len(bins)] == 0  # neither middle character ends a text
    keep = inside & (text < n)
    by_shape = _counted(text[keep].astype(np.int64), bins[keep].astype(np.int64), n, SHAPE_TERMS)
    return np.log1p(np.concatenate([by_word, by_shape], 1), dtype=np.float32)


def _blocks(batches):
    for ids, texts in chunks(batches):
        for i in range(0, len(ids), ROWS):
            yield ids[i : i + ROWS], [t or "" for t in texts[i : i + ROWS]]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _latent_space(rows: np.ndarray, dimensions: int) -> np.ndarray:
    """Right singular vectors by subspace iteration from a fixed start, terms x dimensions."""
    start = np.random.default_rng(0).standard_normal((rows.shape[1], min(dimensions + 10, *rows.shape))).astype(np.float32)
    basis = np.linalg.qr(rows @ start)[0]
    for _ in range(3):
        basis = np.linalg.qr(rows @ (rows.T @ basis))[0]
    return np.ascontiguousarray(np.linalg.svd(basis.T @ rows, full_matrices=False)[2][:dimensions].T)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and label of at most `sample` labelled rows, chosen by a hash of the id; of an id's labels the least counts. docs: doc_id, text; labels: doc_id, label, not null."""
    chosen = labels.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).select("doc_id", "text", "label").limit(sample)


class Model:
    """Term weights, latent space and labelled vectors; small enough to broadcast (SAMPLE and TERMS bound it)."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        """counts is used up: it is the one large matrix of the driver, and is weighted in place."""
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        self.weights = (np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))) + 1).astype(np.float32)
        counts *= self.weights
        counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
        self.space = _latent_space(counts, DIMENSIONS) if len(counts) else np.zeros((TERMS, 0), np.float32)
        self.vectors = _unit(counts @ self.space)

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit((counts * self.weights) @ self.space)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosines = np.round(self.project(counts) @ self.vectors.T, DIGITS)
        k = min(NEIGHBOURS, len(self.labels))
        least = np.partition(cosines, len(self.labels) - k, axis=1)[:, [len(self.labels) - k]]
        chosen, level = cosines > least, cosines == least
        free = k - chosen.sum(1)
        for row in np.flatnonzero(level.sum(1) > free):
            level[row, np.flatnonzero(level[row])[free[row] :]] = False
        near = np.nonzero(chosen | level)[1].reshape(len(counts), k)
        votes = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** POWER
        total = votes.sum(1)
        share = (votes * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-9, np.clip(share, 0, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0 or 1). Terms are counted where the rows lie; the driver gets the terms that occur in `sample` rows."""
    rows = labelled_sample(docs, labels, sample)
    schema = pa.schema([("label", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        for labels, texts in _blocks(batches):
            rows = term_counts(texts)
            terms = [np.flatnonzero(x) for x in rows]
            yield as_batch([labels, [t.astype("<u2").tobytes() for t in terms], [x[t].astype(np.float16).tobytes() for x, t in zip(rows, terms, strict=True)]], schema)

    found = rows.select("label", "text").mapInArrow(count, "label int, terms binary, counts binary").toArrow()
    counts = np.zeros((found.num_rows, TERMS), np.float32)
    for row, terms, values in zip(counts, found.column(1).to_pylist(), found.column(2).to_pylist(), strict=True):
        row[np.frombuffer(terms, "<u2")] = np.frombuffer(values, np.float16)
    return Model(counts, found.column(0).to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def rate(batches):
        for ids, texts in _blocks(batches):
            yield as_batch([ids, shared.value.score(term_counts(texts))], schema)

    return docs.select("doc_id", "text").mapInArrow(rate, "doc_id long, score double")


def held_out(doc_id):
    """crc32(doc_id as text) mod 4 is 2; a null id reads as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fitted(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """The model of the rows that are not held out. docs: doc_id, text; labels: doc_id, quality."""
    bounded_batches(docs.sparkSession)
    learn = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return fit(text_input(docs, "doc_id", "text"), learn.select("doc_id", F.col("quality").cast("int").alias("label")), sample=sample)


def quality_digest(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= THRESHOLD) of every row.

    Null and empty texts, and texts unlike all labelled ones, get the labels' mean; without labels that is 0.5. Rows with
    the same id are scored each; further columns are not read.
    """
    model = fitted(docs, labels, sample=sample)
    found = score(text_input(docs, "doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all columns, whose text scores at least THRESHOLD. Texts are scored where they lie, without a shuffle.

    Null and empty texts score the labels' mean (0.5 without labels) and stay or go by it; rows that repeat are judged
    each; other columns, whatever their names, stay as they are; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample=sample))
    names = docs.columns
    at = names.index("text")

    def choose(batches):
        for batch in batches:
            keep: list[bool] = []
            for _, texts in _blocks([batch.select([at, at])]):
                keep += (model.value.score(term_counts(texts)) >= THRESHOLD).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
