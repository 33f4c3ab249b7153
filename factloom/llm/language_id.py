"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all training texts are gathered a partition, summed by Spark, and kept as a matrix of log probabilities, with
the log share of the texts of each language (the prior) beside it. The matrix is broadcast, LANGUAGES languages
(LANGUAGES x (2 * BINS + 1) numbers) a pass; more languages take further passes. Texts are scored in sparse batches; the
score is the posterior probability of the language that is predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import as_batch, bounded_batches, chunks, settle
from .ngrams import code_points, hashed

BINS = 1 << 14
#: Languages of one pass.
LANGUAGES = 256
SMOOTHING = 0.5

_LETTERS: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _LETTERS.append(table)
    return _LETTERS[0][points]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of bigrams and trigrams, by the text they begin in: two rows of bins (2 * BINS: none), bounds of texts, letters a text.

    Letters are lower-cased; all else reads as one space a character, and n-grams without a letter don't count.
    """
    points, bounds = code_points([t.lower() for t in texts])
    letter = _is_letter(points)
    symbols = np.where(letter, points, np.uint32(32)).astype(np.uint32)
    per_text = np.add.reduceat(letter.astype(np.int64), bounds[:-1])
    bins = np.full((2, len(points)), 2 * BINS, np.uint32)
    inside = points != 0
    for row, n in ((0, 2), (1, 3)):
        size = len(points) - n + 1
        if size <= 0:
            continue
        some, apart = np.zeros(size, bool), np.zeros(size, bool)
        for k in range(n):
            some |= letter[k : k + size]
            if 0 < k < n - 1:  # a zero may stand at either end, as a word's edge, but not between two texts
                apart |= ~inside[k : k + size]
        ok = some & ~apart
        bins[row, :size][ok] = hashed(symbols, n, BINS)[ok] + row * BINS
    return bins, bounds, per_text


def _key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs: text, lang. lang, bin and n of all texts; bin 2 * BINS counts the texts. Settled."""
    schema = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])

    def count(batches):
        counts: dict[str, np.ndarray] = {}

        def rows():
            for lang, found in counts.items():
                at = np.flatnonzero(found)
                yield as_batch([[lang] * len(at), at.astype(np.int32), found[at]], schema)
            counts.clear()

        for langs, texts in chunks(batches):
            groups: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts, strict=True):
                if text:
                    groups.setdefault(lang, []).append(text)
            for lang, own in groups.items():
                bins, _, _ = _grams(own)
                found = np.bincount(bins.ravel(), minlength=2 * BINS + 1)
                found[2 * BINS] = len(own)
                counts[lang] = counts[lang] + found if lang in counts else found
            if len(counts) > LANGUAGES:  # a worker's memory stays bounded
                yield from rows()
        yield from rows()

    totals = docs.select("lang", "text").mapInArrow(count, "lang string, bin int, n long")
    return settle(totals.groupBy("lang", "bin").agg(F.sum("n").alias("n")))


class Model:
    """Some languages in order and their weights, bins x languages; the last row is the log prior."""

    def __init__(self, langs: list[str], counts: np.ndarray, texts: int):
        """counts: languages x (2 * BINS + 1), the last column the texts of each; texts: those of all languages."""
        self.langs = langs
        weights = counts.astype(np.float64)
        for half in (slice(0, BINS), slice(BINS, 2 * BINS)):
            weights[:, half] += SMOOTHING
            weights[:, half] = np.log(weights[:, half] / weights[:, half].sum(1, keepdims=True))
        self.prior = np.log(weights[:, -1] / texts)
        weights[:, -1] = 0
        self.weights = np.ascontiguousarray(weights.T.astype(np.float32))

    def log_probabilities(self, bins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts x languages."""
        out = np.tile(self.prior, (len(bounds) - 1, 1))
        for row in bins:
            for i in range(len(self.langs)):
                out[:, i] += np.add.reduceat(self.weights[:, i][row], bounds[:-1], dtype=np.float64)
        return out


def models(docs: DataFrame) -> list[Model]:
    """docs: text, lang. A model of all texts, in passes of LANGUAGES languages; the driver gets one pass at a time, and the names."""
    totals = gram_counts(docs)
    sizes = {r.lang: r.n for r in totals.where(F.col("bin") == 2 * BINS).select("lang", "n").collect()}
    names, out = sorted(sizes), []
    for k in range(0, len(names), LANGUAGES):
        own = names[k : k + LANGUAGES]
        counts = np.zeros((len(own), 2 * BINS + 1), np.int64)
        # a row a language, so the driver holds numbers only, and no name beside each
        found = totals.where(F.col("lang").between(own[0], own[-1])).groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("counts")).toArrow()
        rows, lists = [own.index(x) for x in found.column(0).to_pylist()], found.column(1).combine_chunks()
        flat = lists.flatten()
        counts[np.repeat(rows, lists.value_lengths().to_numpy()), flat.field("bin").to_numpy()] = flat.field("n").to_numpy()
        out.append(Model(own, counts, sum(sizes.values())))
    return out


def identify(docs: DataFrame, train_on: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", known: DataFrame | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    Learns from the rows of known (docs, unless given) where train_on holds and lang is not null. A text that is null,
    empty or without a letter is 'und' with score 0, as are all texts where there is nothing to learn from; equal
    scores go to the language that comes first in order; further columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    learnt = (known if known is not None else docs).where(train_on & F.col(lang_col).isNotNull())
    passes = models(learnt.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang_pred", pa.string()), ("best", pa.float64()), ("total", pa.float64())])

    def score(model, last):
        def run(batches):
            for batch in batches:
                begin = 0
                for ids, texts in chunks([batch]):
                    rows = batch.slice(begin, len(ids))
                    begin += len(ids)
                    bins, bounds, letters = _grams([t or "" for t in texts])
                    logp = model.value.log_probabilities(bins, bounds)
                    at = logp.argmax(1)
                    best = logp[np.arange(len(ids)), at]
                    total = best + np.log(np.exp(logp - best[:, None]).sum(1))  # log of the sum over this pass's languages
                    before_best, before_total = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
                    better = best > before_best
                    preds = [model.value.langs[i] if b else p for i, b, p in zip(at.tolist(), better.tolist(), rows.column(2).to_pylist(), strict=True)]
                    best, total = np.maximum(best, before_best), np.logaddexp(total, before_total)
                    if last:
                        some = letters > 0
                        preds = [p if s else "und" for p, s in zip(preds, some.tolist(), strict=True)]
                        yield as_batch([ids, preds, np.where(some, np.exp(np.minimum(best - total, 0)), 0.0)], pa.schema([schema.field(0), schema.field(2), ("score", pa.float64())]))
                    else:
                        yield as_batch([ids, texts, preds, best, total], schema)

        return run

    none = F.lit(float("-inf"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit("und").alias("lang_pred"), none.alias("best"), none.alias("total"))
    for k, model in enumerate(passes):
        last = k == len(passes) - 1
        own = own.mapInArrow(score(spark.sparkContext.broadcast(model), last), "doc_id long, lang_pred string, score double" if last else "doc_id long, text string, lang_pred string, best double, total double")
        if not last:
            own = settle(own)
    return own if passes else own.select("doc_id", "lang_pred", F.lit(0.0).alias("score"))


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row: learnt where crc32(doc_id as text) mod 5 is not 0, predicted everywhere.

    A null id reads as an empty text. Null and empty texts, and those without letters, are 'und' with score 0; rows that
    repeat are judged each; an empty table gives no rows; of other columns only lang is read, to learn from.
    """
    held = lambda c: F.crc32(_key(c)) % 5 == 0
    found = identify(docs, ~held(F.col("doc_id")))
    return found.select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
