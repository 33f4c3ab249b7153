"""Benchmark decontamination by an FM-index a shard of documents.

Test phrases (windows of 13 words of the benchmark's items) are searched backwards in the index of each shard, located
by sampled positions, and merged into spans to remove. A shard is about a million characters of texts; its index lives
as long as its task needs it, and all phrases of a pass are searched in it. A word that no item has can't be part of a
phrase, so a shard indexes only runs of benchmark words that are long enough for the shortest phrase; this drops no
occurrence. Words are compared by 64-bit hashes.

The benchmark is the stated query set: it is taken in blocks of about BLOCK_WORDS words, each of which is broadcast as a
few flat arrays (about 30 bytes a word), BLOCKS of them a pass.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runtime import CHUNK_CHARS, bounded_batches, settle, unfolded, whole_rows
from .fm_index import FMIndex
from .spans import replaced
from .words import between, rolled, word_hashes

WINDOW = 13
BLOCK_WORDS = 500_000
#: Blocks that a worker holds at a time; more take further passes.
BLOCKS = 4

#: What stands between words, in lower-cased UTF-8, and what a word is in the text itself.
_BETWEEN = between(range(0x30), range(0x3A, 0x61), range(0x7B, 0x80))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

HITS = "array<struct<first:int,last:int,start:int,end:int>>"


class Phrases:
    """The distinct windows of a block of items, as places in one stream of word hashes."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [item for item, _ in items]
        self.stream, at = word_hashes([text for _, text in items], _BETWEEN)
        sizes = np.diff(at)
        windows = np.where(sizes > 0, np.maximum(1, sizes - WINDOW + 1), 0)
        item = np.repeat(np.arange(len(items), dtype=np.int32), windows)
        starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(at[:-1], windows)
        lengths = np.minimum(WINDOW, sizes[item])
        keys = rolled(self.stream, WINDOW)[starts] if len(starts) else np.zeros(0, np.uint64)
        for i in np.flatnonzero(lengths < WINDOW).tolist():
            keys[i] = rolled(self.stream[starts[i] : starts[i] + lengths[i]], int(lengths[i]))[0]
        keys ^= lengths.astype(np.uint64)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.starts, self.lengths = starts[first].astype(np.int32), lengths[first].astype(np.int32)
        order = np.argsort(inverse, kind="stable")
        self.item, self.bounds = item[order], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(first)))])

    def items_of(self, window: int) -> list[str]:
        return [self.names[i] for i in self.item[self.bounds[window] : self.bounds[window + 1]].tolist()]


class Vocabulary:
    """Bits of the hashed words of some blocks, and the length of their shortest phrase. Other words may share a bit; they match nothing."""

    def __init__(self, blocks: list[Phrases]):
        n = sum(len(b.stream) for b in blocks)
        self.mask = np.uint64((1 << max(16, (8 * n).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        for b in blocks:
            self.bits[(b.stream & self.mask).astype(np.int64)] = True
        self.bits = np.packbits(self.bits, bitorder="little")
        self.shortest = min((int(b.lengths.min()) for b in blocks if len(b.lengths)), default=0)

    def _holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & self.mask
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def runs(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of words of the vocabulary begin and end that lie in one text (which begin at `starts`) and are long enough."""
        mine = self._holds(hashes)
        edge = np.zeros(len(hashes) + 1, bool)
        edge[starts] = edge[-1] = True
        begins = np.flatnonzero(mine & (edge[:-1] | ~np.concatenate([[False], mine[:-1]])))
        ends = np.flatnonzero(mine & (edge[1:] | ~np.concatenate([mine[1:], [False]]))) + 1
        enough = ends - begins >= self.shortest
        return begins[enough], ends[enough]


def search(texts: list[str], vocabulary: Vocabulary, blocks: list[Phrases]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text of a shard the number of its words, the merged spans of words that are hit, and the items that hit."""
    hashes, at = word_hashes(texts, _BETWEEN)
    sizes, starts = np.diff(at), at[:-1]
    out: list[tuple[int, list[tuple[int, int]], set[str]]] = [(n, [], set()) for n in sizes.tolist()]
    if not vocabulary.shortest or not len(hashes):
        return out
    begins, ends = vocabulary.runs(hashes, starts[sizes > 0])
    if not len(begins):
        return out
    spans = ends - begins + 1  # and a closing 0
    stops = np.cumsum(spans)
    place = np.repeat(begins - stops + spans, spans) + np.arange(stops[-1])
    closing = stops - 1
    place[closing] = ends - 1
    own, symbols = np.unique(hashes[place], return_inverse=True)
    symbols = symbols + 1
    symbols[closing] = 0
    index = FMIndex(symbols)
    cover = np.zeros(len(symbols) + 1, np.int64)
    for block in blocks:
        near = np.minimum(np.searchsorted(own, block.stream), len(own) - 1)
        stream = np.where(own[near] == block.stream, near + 1, 0)
        missing = np.concatenate([[0], np.cumsum(stream == 0)])
        here = np.flatnonzero(missing[block.starts + block.lengths] == missing[block.starts])
        which, low, high = index.search(stream, block.starts[here], block.lengths[here])
        if not len(which):
            continue
        many = high - low
        before = np.cumsum(many) - many
        found, which = index.locate(np.repeat(low - before, many) + np.arange(many.sum())), np.repeat(here[which], many)
        np.add.at(cover, found, 1)
        np.add.at(cover, found + block.lengths[which], -1)
        text = np.searchsorted(starts, place[found], side="right") - 1
        for t, p in set(zip(text.tolist(), which.tolist(), strict=True)):
            out[t][2].update(block.items_of(p))
    hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    for a, b in zip(np.flatnonzero(hit[1:] & ~hit[:-1]).tolist(), np.flatnonzero(hit[:-1] & ~hit[1:]).tolist(), strict=True):
        t = int(np.searchsorted(starts, place[a], side="right")) - 1
        first = int(place[a] - starts[t])
        out[t][1].append((first, first + b - a))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_places(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    if not spans:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [{"first": a, "last": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in spans]


def _items(benchmark: DataFrame) -> DataFrame:
    """Items without an id or text are left out."""
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")


def _block_count(items: DataFrame, block_words: int) -> int:
    return max(1, -(-items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n // (6 * block_words)))


def _block(items: DataFrame, k: int, n: int) -> Phrases:
    part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return Phrases([(r["item"], r["text"]) for r in part.collect()])


def with_hits(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns `keep` of docs, and _n_words, _hits (spans of words and of characters) and _items of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    result = docs.select(*dict.fromkeys([*keep, text_col]))
    items = _items(benchmark)
    blocks = _block_count(items, block_words)
    for k in range(0, blocks, BLOCKS):
        held = [_block(items, i, blocks) for i in range(k, min(k + BLOCKS, blocks))]
        shared = spark.sparkContext.broadcast(Vocabulary(held)), [spark.sparkContext.broadcast(b) for b in held]
        carried = [c for c in result.columns if c not in ("_n_words", "_hits", "_items")]
        out = [c for c in carried if c in keep] if k + BLOCKS >= blocks else carried
        schema = T.StructType([*(result.schema[c] for c in out), *T._parse_datatype_string("_n_words long, _hits " + HITS + ", _items array<string>").fields])
        result = result.mapInArrow(_pass(*shared, carried.index(text_col), [carried.index(c) for c in out], len(carried) if k else None), schema)
        if k + BLOCKS < blocks:
            result = settle(result)
    return result


def _pass(vocabulary, phrases, text_at: int, out: list[int], before: int | None):
    hits_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        blocks = [b.value for b in phrases]
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            found, begin, size = [], 0, 0
            for i, t in enumerate(texts):  # shards of a bounded number of characters
                if size and size + len(t) > CHUNK_CHARS:
                    found += search(texts[begin:i], vocabulary.value, blocks)
                    begin, size = i, 0
                size += len(t)
            found += search(texts[begin:], vocabulary.value, blocks)
            if before is not None:
                hits, items = batch.column(before + 1).to_pylist(), batch.column(before + 2).to_pylist()
                found = [(n, _merged([*spans, *((h["first"], h["last"]) for h in old)]), own | set(was)) for (n, spans, own), old, was in zip(found, hits, items, strict=True)]
            columns = [batch.column(i) for i in out]
            columns += [pa.array([n for n, _, _ in found], pa.int64()), pa.array([_with_places(t, spans) for t, (_, spans, _) in zip(texts, found, strict=True)], hits_type), pa.array([sorted(x) for *_, x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in out), "_n_words", "_hits", "_items"])

    return run


def _n_hit() -> Column:
    return F.aggregate("_hits", F.lit(0).cast("long"), lambda n, h: n + (h["last"] - h["first"]).cast("long"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination_digest(docs: DataFrame, benchmark: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row.

    Null and empty texts have no words; items without words or id hit nothing; rows with the same id are judged each;
    further columns are not read.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = with_hits(own, benchmark, keep=["doc_id"], block_words=block_words)
    found = found.select("doc_id", F.col("_n_words").alias("n_words"), _n_hit().alias("n_hit"), "_items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without contaminated rows; in the others, spans that are hit are cut out of the text. Clean rows stay as they are.

    Null and empty texts have no words and stay; rows that repeat are judged each; other columns, whatever their names,
    stay as they are; without items nothing is hit.
    """
    rows = whole_rows(docs, text_col, text=F.col(text_col).cast("string"))
    found = with_hits(rows, benchmark, keep=["row", "text"], block_words=block_words)
    kept = found.where(~is_contaminated(_n_hit(), F.col("_n_words")))
    cuts = F.transform("_hits", lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("minus"), F.lit("").alias("put")))
    return unfolded(kept, docs.columns, **{text_col: replaced(F.col("text"), cuts)})
