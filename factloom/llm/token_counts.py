"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a compact hash table of frequent pre-tokens and their token counts, broadcast to the tasks; it is bounded by
FREQUENT entries of at most 24 bytes. It is made of the pre-tokens of the first SAMPLE texts of at most LONGEST characters,
which the driver reads; that affects speed and not results. Tier two is each worker's cache of what the library gave for the rest. Neither texts nor pre-tokens are
shuffled; every text is read and counted once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._runtime import as_batch, bounded_batches, chunks, text_input

FREQUENT = 65_536
#: Texts of the sample, and the longest that it takes.
SAMPLE, LONGEST = 2_000, 50_000


def _pieces(texts: list[str]):
    data, begin, length, closing = bpe.cut(texts)
    row = np.cumsum(closing)[~closing]
    begin, length = begin[~closing], length[~closing]
    keys = bpe.packed_keys(data, begin, length)
    return data, begin, length, row, keys, bpe.mixed(keys)


def frequent_pieces(docs: DataFrame, size: int = FREQUENT, sample: int = SAMPLE) -> list[bytes]:
    """The most frequent pre-tokens of a sample of texts, at most `size`."""
    texts = [r.text for r in docs.select("text").where(F.length("text").between(1, LONGEST)).limit(sample).collect()]
    counts: dict[bytes, int] = {}
    for _, some in chunks([pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["n", "text"])]):
        plain = [t for t in some if bpe.is_plain(t)]
        if plain:
            data, begin, length, _, keys, hashes = _pieces(plain)
            found, inverse = bpe.distinct(data, begin, length, keys, hashes)
            for piece, n in zip(found, np.bincount(inverse, minlength=len(found)).tolist(), strict=True):
                if len(piece) <= bpe.PACKED:
                    counts[piece] = counts.get(piece, 0) + n
    return [p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, frequent: int = FREQUENT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    vocabulary: a file of byte-level BPE for the tokenizers library, readable at the same place on every worker.
    Null and empty texts have 0 bytes and 0 tokens; rows with the same id are counted each; further columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = text_input(docs, id_col, text_col)
    pieces = frequent_pieces(docs, frequent, sample)
    table = spark.sparkContext.broadcast(bpe.CompactTable(pieces, [len(x) for x in bpe.Pieces.of(vocabulary).ids(pieces)]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def count(batches):
        library = bpe.Pieces.of(vocabulary)
        for ids, texts in chunks(batches):
            texts = [t or "" for t in texts]
            plain = np.array([bpe.is_plain(t) if t else True for t in texts])
            out = np.zeros(len(texts), np.int64)
            if plain.any():
                at = np.flatnonzero(plain)
                data, begin, length, row, keys, hashes = _pieces([texts[i] for i in at.tolist()])
                n = table.value.find(keys, hashes)
                n[length > bpe.PACKED] = -1
                rest = np.flatnonzero(n < 0)
                if len(rest):
                    found, inverse = bpe.distinct(data, begin[rest], length[rest], [k[rest] for k in keys], hashes[rest])
                    n[rest] = np.array([len(x) for x in library.ids(found)], np.int32)[inverse]
                out[at] = np.bincount(row, n, len(at)).astype(np.int64)
            for i in np.flatnonzero(~plain).tolist():
                out[i] = len(library.whole(texts[i]))
            yield as_batch([ids, out, [len(t.encode("utf-8", "replace")) for t in texts]], schema)

    counted = docs.mapInArrow(count, "doc_id long, n_tokens long, n_bytes long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
