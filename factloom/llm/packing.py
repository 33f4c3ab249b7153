"""Packing of tokenised documents into sequences of a fixed size by best-two-fit.

What packing depends on is only how many pieces there are of each length: at most max_tokens numbers, whatever the
input. The driver packs that histogram by patterns (a multiset of lengths, and how many sequences are made like it);
pieces are numbered within their length where they lie, and each takes the place that the patterns give its number.
"""

from __future__ import annotations

import zlib
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._runtime import as_batch, bounded_batches, chunks, settle, text_input

END = 1

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local_rank long"

Pattern = namedtuple("Pattern", "lengths times")


def _document_ids(texts: list[str], library: bpe.Pieces) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.array([END], "<u4")] * len(texts)
    plain = [i for i, t in enumerate(texts) if t and bpe.is_plain(t)]
    if plain:
        data, begin, length, closing = bpe.cut([library.normalised(texts[i]) for i in plain], words=True)
        keys = bpe.packed_keys(data, begin, length)
        found, inverse = bpe.distinct(data, begin, length, keys, bpe.mixed(keys))
        ids = [(END,) if p == b"\0" else x for p, x in zip(found, library.ids(found), strict=True)]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat, places = np.array([y for x in ids for y in x], "<u4"), np.cumsum(sizes) - sizes
        each = sizes[inverse]
        ends = np.cumsum(each)
        stream = flat[np.repeat(places[inverse] - ends + each, each) + np.arange(ends[-1])]
        stops = ends[closing]
        for i, a, b in zip(plain, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            out[i] = stream[a:b]
    for i, t in enumerate(texts):
        if t and not bpe.is_plain(t):
            out[i] = np.array([*library.whole(t), END], "<u4")
    return out


def tokenised_pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096) -> DataFrame:
    """A row a piece, with its number among the pieces of its length in its partition (part, local_rank)."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])

    def cut(batches):
        library, part = bpe.Pieces.of(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(max_tokens + 1, np.int64)
        for ids, texts in chunks(batches):
            rows = []
            for doc, tokens in zip(ids, _document_ids([t or "" for t in texts], library), strict=True):
                for k, a in enumerate(range(0, len(tokens), max_tokens)):
                    own = tokens[a : a + max_tokens]
                    rows.append((doc, k, a, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            if rows:
                yield as_batch(list(zip(*rows, strict=True)), schema)

    return text_input(docs, id_col, text_col).mapInArrow(cut, PIECES)


def _largest_pair(left: np.ndarray, gap: int, over: int) -> tuple[int, int] | None:
    """The two lengths that are left whose sum is largest, at most gap and more than over."""
    here = np.flatnonzero(left[: gap + 1] > 0)
    if not len(here):
        return None
    partner = np.searchsorted(here, gap - here, side="right") - 1
    own = (partner >= 0) & (here[np.maximum(partner, 0)] == here) & (left[here] < 2)
    partner = partner - own
    sums = np.where(partner >= 0, here + here[np.maximum(partner, 0)], -1)
    best = int(np.argmax(sums))
    return (int(here[best]), int(here[partner[best]])) if sums[best] > over else None


def best_two_fit(counts: np.ndarray, size: int) -> list[Pattern]:
    """Patterns that use every piece. counts[n] is the number of pieces of n tokens.

    A bin takes the longest piece that is left, and then always the longest that fits. If a gap stays, its smallest piece
    gives way to two unpacked ones that fill more of the gap and the place of that piece together. The bin is repeated
    as often as the counts allow, so patterns are at most about as many as lengths.
    """
    left, patterns = counts.astype(np.int64).copy(), []
    longest = size
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return patterns
        own: list[int] = []
        room = size
        while room:
            fit = np.flatnonzero(left[1 : room + 1])
            if not len(fit):
                break
            n = int(fit[-1]) + 1
            k = max(1, min(int(left[n]), room // n))
            own += [n] * k
            left[n] -= k
            room -= n * k
        if room and own:
            smallest = own[-1]
            pair = _largest_pair(left, room + smallest, smallest)
            if pair and len(own) > 1:
                own.pop()
                left[smallest] += 1
                for n in pair:
                    own.append(n)
                    left[n] -= 1
        lengths, each = np.unique(own, return_counts=True)
        more = int((left[lengths] // each).min())
        left[lengths] -= more * each
        patterns.append(Pattern(sorted(own, reverse=True), more + 1))


def _places(patterns: list[Pattern], size: int) -> np.ndarray:
    """Rows (length, first number, pieces a bin, first bin, offset in the bin), by length and first number."""
    rows, taken, base = [], np.zeros(size + 1, np.int64), 0
    for lengths, times in patterns:
        values, each = np.unique(lengths, return_counts=True)
        at = 0
        for n, k in zip(values[::-1].tolist(), each[::-1].tolist(), strict=True):
            rows.append((n, int(taken[n]), k, base, at))
            taken[n] += k * times
            at += n * k
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place_pieces(pieces: DataFrame, max_tokens: int = 4096) -> DataFrame:
    """Give each of settled pieces its sequence_id and offset."""
    spark = pieces.sparkSession
    per_part = settle(pieces.groupBy("part", "length").agg((F.max("local_rank") + 1).alias("n")))
    counts = np.zeros(max_tokens + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most max_tokens rows
        counts[r.length] = r.n
    places = spark.sparkContext.broadcast(_places(best_two_fit(counts, max_tokens), max_tokens))
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def put(batches):
        table = places.value
        rank_bits = 2**40  # lengths and numbers in one ascending key
        keys = table[:, 0] * rank_bits + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 5))
            row = table[np.searchsorted(keys, length * rank_bits + rank, side="right") - 1]
            number = rank - row[:, 1]
            own = [batch.column(i) for i in range(3)]
            yield as_batch([*own, length, batch.column(4), row[:, 3] + number // row[:, 2], row[:, 4] + number % row[:, 2] * length], schema)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096) -> DataFrame:
    """Pack every document, as token ids and an end id, into sequences of at most max_tokens.

    A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the end id
    alone; rows with the same id are packed each; an empty table gives no rows; further columns are not read.
    """
    pieces = settle(tokenised_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, max_tokens=max_tokens))
    return place_pieces(pieces, max_tokens)


