"""How many of a query's tokens URLs hold: many patterns at once, by an automaton over the tokens of a block of queries.

Queries are a stated set and are taken in blocks of bounded size. A block's tokens become one automaton a worker, which walks
over each URL once; what it finds is summed by query on the spot. So nothing but scores leaves a task: no grams of URLs are
made or shuffled, and all tokens of a query meet a URL in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as E
from factloom.sources.storage import bounded_batches, settled

#: Bytes of the tokens of a block of queries; pairs of queries and URLs that a worker makes at a time; scores that a worker holds to put them in order, and queries of a slice
#: up to which a URL takes scores along instead of tokens; pairs that Spark sorts in one partition where URLs and their tokens have more bytes than a worker may hold.
BLOCK_BYTES = 2**20
PAIRS = 2**18
SLICE_PAIRS = 2**25
SLICE_QUERIES = 16
SORTED_PAIRS = 4_000_000
URL_BYTES = 2**27
_SCORES = "query_id long, url string, score long"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("url", pa.string()), ("score", pa.int64())])


def query_blocks(queries: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """(query_id, tokens) of the queries that have tokens, block by block."""
    own = settled(queries.select("query_id", E.search_tokens(F.col("query")).alias("tokens")).where(F.size("tokens") > 0))
    size = own.agg(F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8)).alias("n")).first().n or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.orderBy("query_id").toArrow()
        if len(rows):
            yield list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


class Matcher:
    """An automaton over the tokens of a block, and which queries ask for each."""

    def __init__(self, block: list[tuple[int, list[str]]]):
        self.ids = np.array([i for i, _ in block], np.int64)
        askers: dict[str, list[int]] = {}
        for q, (_, tokens) in enumerate(block):
            for token in tokens:
                askers.setdefault(token, []).append(q)
        self.askers = [np.array(x, np.int64) for x in askers.values()]
        self.automaton = ahocorasick.Automaton()
        for k, token in enumerate(askers):
            self.automaton.add_word(token, k)
        self.automaton.make_automaton()

    def tokens(self, folded: str) -> list[int]:
        """The tokens that a URL holds, by place in the block."""
        return sorted({k for _, k in self.automaton.iter(folded)})

    def scores(self, folded: str) -> tuple[np.ndarray, np.ndarray]:
        """The queries that share a token with a URL, by place in the block, and how many tokens."""
        found = {k for _, k in self.automaton.iter(folded)}
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique(np.concatenate([self.askers[k] for k in found]), return_counts=True)


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query by score and URL (in order of its bytes)."""
    rows = rows.sort_by([("query_id", "ascending"), ("score", "descending"), ("url", "ascending")])
    query = rows.column("query_id").to_numpy()
    first = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return rows.filter(pa.array(place < k))


def _pairs(batches: Iterator[pa.RecordBatch], matcher: Matcher) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(urls, place of the URL, place of the query in the block, score) of pairs that score, about PAIRS at a time: a URL may meet all queries."""
    for batch in batches:
        met, size, begin, last = [], 0, 0, batch.num_rows - 1
        for i, folded in enumerate(batch.column(1).to_pylist()):
            met.append(matcher.scores(folded or ""))
            size += len(met[-1][0])
            if size and (size >= PAIRS or i == last):
                at = np.repeat(np.arange(begin, i + 1), [len(q) for q, _ in met])
                yield batch.column(0), at, *(np.concatenate([x[c] for x in met]) for c in (0, 1))
                met, size, begin = [], 0, i + 1


def _scored(urls: DataFrame, block: list[tuple[int, list[str]]], k: int | None) -> DataFrame:
    """urls: url, folded. Scores of a block, of each query the k best a task where k is given."""
    shared = urls.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        matcher, kept, waiting, n = Matcher(shared.value), _SCHEMA.empty_table(), [], 0
        for texts, at, queries, scores in _pairs(batches, matcher):
            rows = pa.RecordBatch.from_arrays([pa.array(matcher.ids[queries]), texts.take(pa.array(at)), pa.array(scores.astype(np.int64))], schema=_SCHEMA)
            if k is None:
                yield rows
                continue
            waiting.append(rows)
            n += rows.num_rows
            if n >= max(PAIRS, kept.num_rows):
                kept, waiting, n = _best(pa.Table.from_batches([*waiting, *kept.to_batches()], _SCHEMA), k), [], 0
        if k is not None:
            yield from _best(pa.Table.from_batches([*waiting, *kept.to_batches()], _SCHEMA), k).to_batches()

    return urls.mapInArrow(run, _SCORES)


def _listed(urls: DataFrame, block: list[tuple[int, list[str]]], cuts: np.ndarray) -> DataFrame:
    """Scores of a block as a row a URL and slice of queries; cuts: the first query of each slice but the first."""
    shared = urls.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        matcher = Matcher(shared.value)
        slices = np.searchsorted(cuts, matcher.ids, "right").astype(np.int32)
        for texts, at, queries, scores in _pairs(batches, matcher):
            own = slices[queries]
            first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
            ends = pa.array(np.append(first, len(at)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (matcher.ids[queries], scores.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(own[first]), texts.take(pa.array(at[first])), *lists], ["slice", "url", "queries", "scores"])

    return urls.mapInArrow(run, "slice int, url string, queries array<long>, scores array<int>")


def url_scores(urls: DataFrame, queries: DataFrame, *, k: int | None = None) -> DataFrame:
    """query_id, url and score wherever a query shares a token with a distinct URL; with k a superset of each query's k best by score and URL.

    A token counts where the URL holds it anywhere, in either case. Null and empty queries and URLs match nothing.
    """
    own = _folded(urls)
    blocks = [_scored(own, block, k) for block in query_blocks(queries)]
    return reduce(DataFrame.unionByName, blocks) if blocks else urls.sparkSession.createDataFrame([], _SCORES)


def _folded(urls: DataFrame) -> DataFrame:
    bounded_batches(urls.sparkSession)
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # many small rows cost much each, so tasks are not merged by size
    return urls.select("url").where("url is not null").repartition(parts, "url").distinct().select("url", E.casefold(F.col("url")).alias("folded"))


def _rated(urls: DataFrame, block: list[tuple[int, list[str]]], places: np.ndarray, width: int, kind: np.dtype) -> DataFrame:
    """Scores of a block as a row a URL and slice of width queries: a number of a kind for each query of the slice, 0 where they share no token. places: those of the block's queries in their order."""
    shared = urls.sparkSession.sparkContext.broadcast(block)
    step = max(1, SLICE_PAIRS // (4 * width))

    def run(batches):
        matcher = Matcher(shared.value)
        for texts, at, queries, scores in _pairs(batches, matcher):
            slices, column = np.divmod(places[queries], width)
            rows, row = np.unique(slices * len(texts) + at, return_inverse=True)
            for k in range(0, len(rows), step):
                own, here = rows[k : k + step], (row >= k) & (row < k + step)
                rated = np.zeros((len(own), width), kind)
                rated[row[here] - k, column[here]] = scores[here]
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * rated[0].nbytes)
                packed = pa.Array.from_buffers(pa.binary(), len(own), [None, ends.buffers()[1], pa.py_buffer(rated.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array((own // len(texts)).astype(np.int32)), texts.take(pa.array(own % len(texts))), packed], ["slice", "url", "scores"])

    return urls.mapInArrow(run, "slice int, url string, scores binary")


def token_places(blocks: list[list[tuple[int, list[str]]]]) -> tuple[list[int], list[np.ndarray]]:
    """The number of each block's first token, as a Matcher numbers them, block after block; and the tokens of each query, over all blocks."""
    firsts, asked, n = [], [], 0
    for block in blocks:
        firsts.append(n)
        own: dict[str, int] = {}
        asked += [np.array([n + own.setdefault(token, len(own)) for token in tokens], np.int32) for _, tokens in block]
        n += len(own)
    return firsts, asked


def _held_tokens(urls: DataFrame, block: list[tuple[int, list[str]]], first: int) -> DataFrame:
    """URLs that hold tokens of a block, with the tokens' numbers from first on."""
    shared = urls.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            held = [matcher.tokens(folded or "") for folded in batch.column(1).to_pylist()]
            some = np.flatnonzero([len(tokens) > 0 for tokens in held])
            tokens = pa.array([[first + k for k in held[i]] for i in some], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), tokens], ["url", "tokens"])

    return urls.mapInArrow(run, "url string, tokens array<int>")


def _asked_tokens(held: DataFrame, asked: list[np.ndarray], width: int) -> DataFrame:
    """URLs with their tokens as a row a URL and slice of width queries: the tokens that a query of the slice asks for. asked: the tokens of the queries in their order."""
    shared = held.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        asked = shared.value
        total = 1 + max(int(tokens.max()) for tokens in asked)
        slices = [np.unique(np.concatenate(asked[k : k + width])) for k in range(0, len(asked), width)]
        for batch in batches:
            tokens, row = batch.column(1).flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
            for s, own in enumerate(slices):
                wanted = np.zeros(total, bool)
                wanted[own] = True
                at = np.flatnonzero(wanted[tokens])
                rows, first = np.unique(row[at], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(tokens[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), s, np.int32)), batch.column(0).take(pa.array(rows)), lists], ["slice", "url", "tokens"])

    return held.mapInArrow(run, "slice int, url string, tokens array<int>")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows in order of their slice, slice by slice."""
    now, waiting = -1, []
    for batch in batches:
        own = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)] if len(own) else []
        for begin, end in pairwise(cuts):
            if waiting and own[begin] != now:
                yield now, waiting
                waiting = []
            now = int(own[begin])
            waiting.append(batch.slice(begin, end - begin))
    if waiting:
        yield now, waiting


def _best_first(query: int, urls: pa.Array, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of a query with URLs that lie in their order, best score first: sorted by score alone, stably."""
    met = np.flatnonzero(scores)
    order = met[np.argsort(np.iinfo(scores.dtype).max - scores[met], kind="stable")]
    for k in range(0, len(order), PAIRS):
        part = order[k : k + PAIRS]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), query)), urls.take(pa.array(part)), pa.array(scores[part].astype(np.int64))], schema=_SCHEMA)


def _unpacked(rows: DataFrame, ids: np.ndarray, width: int, kind: np.dtype) -> DataFrame:
    """The pairs of rows of _rated that lie in order of slice and URL, in order of query_id, best score and url."""

    def run(batches):
        for s, found in _slices(batches):
            rated = np.concatenate([np.frombuffer(b"".join(batch.column(2).to_pylist()), kind) for batch in found]).reshape(-1, width)
            urls = pa.concat_arrays([batch.column(1) for batch in found])
            found.clear()
            for place, query in enumerate(ids[s * width : (s + 1) * width]):
                yield from _best_first(query, urls, rated[:, place])

    return rows.mapInArrow(run, _SCORES)


def _counted(rows: DataFrame, ids: np.ndarray, asked: list[np.ndarray], width: int, kind: np.dtype) -> DataFrame:
    """The same of rows of _asked_tokens: the URLs of each token are listed, and a query counts those of its tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for s, found in _slices(batches):
            tokens = np.concatenate([batch.column(2).flatten().to_numpy() for batch in found])
            sizes = np.concatenate([batch.column(2).value_lengths().to_numpy() for batch in found])
            urls = pa.concat_arrays([batch.column(1) for batch in found])
            found.clear()
            own = shared.value[s * width : (s + 1) * width]
            order = np.argsort(tokens, kind="stable")
            row, tokens = np.repeat(np.arange(len(urls), dtype=np.int32), sizes)[order], tokens[order]
            for query, wanted in zip(ids[s * width : (s + 1) * width], own, strict=True):
                scores = np.zeros(len(urls), kind)
                for begin, end in zip(np.searchsorted(tokens, wanted), np.searchsorted(tokens, wanted, "right"), strict=True):
                    scores[row[begin:end]] += 1
                yield from _best_first(query, urls, scores)

    return rows.mapInArrow(run, _SCORES)


def slice_width(urls: int, queries: int, tasks: int) -> int:
    """Queries of a slice: two slices a task that runs at a time, but no more than SLICE_PAIRS scores in one."""
    return max(1, min(SLICE_PAIRS // max(1, urls), -(-queries // (2 * tasks))))


def ordered_scores(urls: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of url_scores in order of query_id, best score and url.

    Queries are cut into slices in order of their ids, a partition each, and pairs are made where they are in order. A URL
    goes to a slice once, with the tokens that queries of the slice ask for, so what is shuffled grows with the URLs and
    not with the pairs; few queries a slice get a number each instead. A worker holds the URLs of a slice with either.
    URLs and tokens of more than URL_BYTES are not held: there Spark sorts the pairs.
    """
    spark = urls.sparkSession
    own, blocks = settled(_folded(urls).sortWithinPartitions("url")), list(query_blocks(queries))
    ids = np.array([i for block in blocks for i, _ in block], np.int64)
    if not len(ids):
        return spark.createDataFrame([], _SCORES)
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("url")), F.lit(0))).first()
    if size * len(blocks) > URL_BYTES:
        return _sorted_pairs(own, n, blocks, np.sort(ids))
    tasks = spark.sparkContext.defaultParallelism
    width = slice_width(n * len(blocks), len(ids), tasks)
    kind = np.min_scalar_type(max(len(tokens) for block in blocks for _, tokens in block))
    order = np.argsort(ids, kind="stable")
    even = -(-len(ids) // (2 * tasks))
    if width < even or width > SLICE_QUERIES:
        firsts, asked = token_places(blocks)
        held = settled(reduce(DataFrame.unionByName, [_held_tokens(own, block, first) for block, first in zip(blocks, firsts, strict=True)]))
        size = held.agg(F.coalesce(F.sum(F.octet_length("url") + 4 * F.size("tokens")), F.lit(0))).first()[0]
        if size > URL_BYTES:
            return _sorted_pairs(own, n, blocks, np.sort(ids))
        asked = [asked[i] for i in order]
        dealt = _asked_tokens(held, asked, even).repartitionById(-(-len(ids) // even), "slice").sortWithinPartitions("slice", "url")
        return _counted(dealt, ids[order], asked, even, kind)
    places = np.split(np.argsort(order, kind="stable"), np.cumsum([len(block) for block in blocks])[:-1])
    rated = reduce(DataFrame.unionByName, [_rated(own, block, at, width, kind) for block, at in zip(blocks, places, strict=True)])
    dealt = rated.repartitionById(-(-len(ids) // width), "slice").sortWithinPartitions("slice", "url")
    return _unpacked(dealt, ids[order], width, kind)


def _sorted_pairs(urls: DataFrame, n: int, blocks: list[list[tuple[int, list[str]]]], ids: np.ndarray) -> DataFrame:
    """The same for n URLs that are too many for a worker: a URL goes to a slice with the list of its queries, and Spark sorts the pairs, about SORTED_PAIRS in a slice or those of one query."""
    width = max(1, min(SORTED_PAIRS // max(1, n), -(-len(ids) // int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    listed = reduce(DataFrame.unionByName, [_listed(urls, block, ids[width::width]) for block in blocks])
    dealt = listed.repartitionById(-(-len(ids) // width), "slice")
    pairs = dealt.select("url", F.explode(F.arrays_zip("queries", "scores")).alias("p"))
    scores = pairs.select(F.col("p.queries").alias("query_id"), "url", F.col("p.scores").cast("long").alias("score"))
    return scores.sortWithinPartitions("query_id", F.desc("score"), "url")
