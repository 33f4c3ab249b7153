"""Phrase collocation mining by set-oriented relations (SETM).

R_k is the relation of all occurrences of frequent k-word phrases: (piece, position, group). It is persisted in order of
piece and position, as blocks of whole texts: of each row its group and its distance from the row before it, which is
1 just where both lie in one piece at adjacent positions. A round, for each length:

1. merge_join: R_k with itself on (piece, position + 1). Both sides lie in that order, so the join is one walk over a
   block; it gives the occurrences of (k+1)-word phrases whose first and last k words are frequent.
2. group_counts: how often each pair of groups meets, counted a worker, then summed by Spark; pairs below the
   support go, the others are numbered.
3. semi_join: of the join's rows those of frequent groups stay, as R_(k+1).

Phrases meet by exact numbers of exact words, never by hashes alone. Frequent groups up to a stated number are broadcast
for the third step; more are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import LARGE_ROWS, as_batch, bounded_batches, drop_settled, settle

#: Frequent words (of at most WORD_BYTES in all) and groups that a worker holds; with more, the semi-join is a shuffle.
BROADCAST_WORDS, WORD_BYTES = 500_000, 16 * 2**20
BROADCAST_GROUPS = 1_000_000
#: Pairs of groups that a worker counts before it hands the counts on.
TALLY = 1_000_000
#: Bins in which groups are numbered; the driver and windows see one number a bin.
NUMBER_BINS = 4096
#: Parts of a language that are ranked apart before they are ranked together.
RANK_PARTS = 64

#: Bytes of the texts that give a block; a longer text is a block alone.
BLOCK_BYTES = 2**20

# gaps and groups: 32-bit numbers, one a row of the relation
_BLOCKS = "block long, lang string, gaps binary, groups binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("gaps", pa.binary()), ("groups", pa.binary())])


def _tokens(texts: pa.Array) -> pa.Array:
    """All words of the texts, A-Z lower-cased, one after the other, and a line feed where a piece or a text ends."""
    ended = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=r"[.,;:!?\x0A-\x0D]+", replacement=" \n ")
    words = pc.list_flatten(pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(ended, "\n", " "), "\t", " "), " "))
    return words.filter(pc.not_equal(words, ""))


def _by_lang(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, pa.Array]]:
    """Languages and the tokens of some of their texts, of at most `limit` bytes or one text."""
    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
            part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // limit
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield lang, _tokens(texts.slice(a, b - a))


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word and a: the occurrences of every word. Settled."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("a", pa.int64())])

    def count(batches):
        for lang, tokens in _by_lang(batches, 8 * BLOCK_BYTES):
            found = tokens.filter(pc.not_equal(tokens, "\n")).value_counts()
            yield as_batch([[lang] * len(found), found.field(0), found.field(1)], schema)

    return settle(texts.mapInArrow(count, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a")))


def numbered(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with numbers id from 1 on, without gaps: by bins of hashed keys, so that no task sees more than a bin's share. Settled."""
    binned = settle(groups.withColumn("bin", F.pmod(F.xxhash64(*keys), F.lit(NUMBER_BINS))))
    sizes = binned.groupBy("bin").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("bin", F.coalesce(before, F.lit(0)).alias("before"))  # at most NUMBER_BINS rows
    place = F.row_number().over(Window.partitionBy("bin").orderBy(*keys))
    return settle(binned.join(F.broadcast(starts), "bin").withColumn("id", (F.col("before") + place).cast("long")).drop("bin", "before"))


def _block_ids() -> Iterator[int]:
    context, n = TaskContext.get(), 0
    first = (context.partitionId() if context else 0) << 32
    while True:
        yield first + n
        n += 1


def _block(block: int, lang: str, places: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    gaps = np.diff(places, prepend=np.int64(-1)).astype(np.int32)
    return as_batch([[block], [lang], [gaps.tobytes()], [groups.astype(np.int32).tobytes()]], _BLOCK_SCHEMA)


def occurrences(texts: DataFrame, words: DataFrame) -> DataFrame:
    """R_1 of the frequent words (lang, word, id). Settled."""
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    if size.n > BROADCAST_WORDS or size.bytes > WORD_BYTES:
        return _occurrences_by_shuffle(texts, words)
    table = words.select("lang", "word", "id").toArrow().combine_chunks()
    known = {}
    for lang in pc.unique(table["lang"]).to_pylist():
        own = table.filter(pc.equal(table["lang"], lang))
        known[lang] = own["word"].combine_chunks(), own["id"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        ids = _block_ids()
        for lang, tokens in _by_lang(batches, BLOCK_BYTES):
            if lang in shared.value:
                own, numbers = shared.value[lang]
                found = tokens.dictionary_encode()
                at = pc.index_in(found.dictionary, value_set=own)
                group = np.append(numbers, 0)[pc.fill_null(at, len(own)).to_numpy(zero_copy_only=False)][found.indices.to_numpy()]
                places = np.flatnonzero(group)
                if len(places):
                    yield _block(next(ids), lang, places, group[places])

    return settle(texts.mapInArrow(run, _BLOCKS), **LARGE_ROWS)


def _occurrences_by_shuffle(texts: DataFrame, words: DataFrame) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("place", pa.int32()), ("word", pa.string())])

    def run(batches):
        ids = _block_ids()
        for lang, tokens in _by_lang(batches, BLOCK_BYTES):
            places = np.flatnonzero(pc.not_equal(tokens, "\n").to_numpy(zero_copy_only=False))
            yield as_batch([[next(ids)] * len(places), [lang] * len(places), places.astype(np.int32), tokens.take(pa.array(places))], schema)

    rows = settle(texts.mapInArrow(run, "block long, lang string, place int, word string"))
    return _in_order(rows.join(words.select("lang", "word", "id").hint("merge"), ["lang", "word"]))


def _in_order(rows: DataFrame) -> DataFrame:
    """block, lang, place and id as blocks in order of place; a block holds some texts of one batch. Settled."""
    gathered = rows.groupBy("block", "lang").agg(F.array_sort(F.collect_list(F.struct("place", F.col("id").cast("int").alias("id")))).alias("rows"))

    def run(batches):
        for batch in batches:
            for block, lang, places, groups in zip(*[batch.column(i) for i in range(4)], strict=True):
                yield _block(block.as_py(), lang.as_py(), places.values.to_numpy(), groups.values.to_numpy())

    return settle(gathered.select("block", "lang", "rows.place", "rows.id").mapInArrow(run, _BLOCKS), **LARGE_ROWS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in zip(*[batch.column(i) for i in range(4)], strict=True):
            yield row[0].as_py(), row[1].as_py(), *(np.frombuffer(x.as_buffer(), np.int32) for x in row[2:])


def merge_join(gaps: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block with itself on (piece, position + 1): which rows have such a neighbour, and the two groups as one number."""
    at = np.flatnonzero(gaps[1:] == 1)
    return at, groups[at].astype(np.int64) << 32 | groups[at + 1].astype(np.int64)


def group_counts(relation: DataFrame, support: int) -> DataFrame:
    """lang, left, right and a of the pairs of groups that meet `support` times or more."""
    schema = pa.schema([("lang", pa.string()), ("pair", pa.int64()), ("a", pa.int64())])

    def count(batches):
        tally: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def summed(parts):
            pairs, own = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
            values, at = np.unique(pairs, return_inverse=True)
            return values, np.bincount(at, own, len(values)).astype(np.int64)

        def handed_on():
            for lang, parts in tally.items():
                pairs, counts = summed(parts)
                for i in range(0, len(pairs), 100_000):
                    yield as_batch([[lang] * len(pairs[i : i + 100_000]), pairs[i : i + 100_000], counts[i : i + 100_000]], schema)
            tally.clear()

        for _, lang, gaps, groups in _blocks(batches):
            found = np.unique(merge_join(gaps, groups)[1], return_counts=True)
            tally.setdefault(lang, []).append(found)
            held += len(found[0])
            if held > 2 * TALLY:
                tally = {x: [summed(parts)] for x, parts in tally.items()}
                held = sum(len(parts[0][0]) for parts in tally.values())
                if held > TALLY:
                    yield from handed_on()
                    held = 0
        yield from handed_on()

    counted = relation.select("block", "lang", "gaps", "groups").mapInArrow(count, "lang string, pair long, a long").groupBy("lang", "pair").agg(F.sum("a").alias("a"))
    return counted.where(F.col("a") >= support).select("lang", F.shiftright("pair", 32).alias("left"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("right"), "a")


def semi_join(relation: DataFrame, groups: DataFrame) -> DataFrame:
    """R_(k+1): what the merge join of R_k gives, less the groups that are not among the frequent ones (lang, left, right, id). Settled."""
    if groups.count() > BROADCAST_GROUPS:
        return _semi_join_by_shuffle(relation, groups)
    table = groups.select("lang", (F.shiftleft("left", 32) + F.col("right")).alias("pair"), "id").toArrow().combine_chunks()
    known = {}
    for lang in pc.unique(table["lang"]).to_pylist():
        own = table.filter(pc.equal(table["lang"], lang)).sort_by("pair")
        known[lang] = own["pair"].to_numpy(), own["id"].to_numpy().astype(np.int32)
    shared = relation.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for block, lang, gaps, groups in _blocks(batches):
            if lang in shared.value:
                pairs, numbers = shared.value[lang]
                at, own = merge_join(gaps, groups)
                found = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
                same = pairs[found] == own
                if same.any():
                    places = np.cumsum(gaps, dtype=np.int64)[at[same]] - 1
                    yield _block(block, lang, places, numbers[found[same]])

    return settle(relation.mapInArrow(run, _BLOCKS), **LARGE_ROWS)


def _semi_join_by_shuffle(relation: DataFrame, groups: DataFrame) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("place", pa.int32()), ("left", pa.int64()), ("right", pa.int64())])

    def run(batches):
        for block, lang, gaps, groups in _blocks(batches):
            at, own = merge_join(gaps, groups)
            places = np.cumsum(gaps, dtype=np.int64)[at] - 1
            yield as_batch([[block] * len(at), [lang] * len(at), places.astype(np.int32), own >> 32, own & 0xFFFFFFFF], schema)

    rows = settle(relation.mapInArrow(run, "block long, lang string, place int, left long, right long"))
    return _in_order(rows.join(groups.select("lang", "left", "right", "id").hint("merge"), ["lang", "left", "right"]))


def frequent_phrases(texts: DataFrame, *, support: int, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """texts: lang, text, no nulls. lang and n (all words), and for each length the frequent phrases, settled.

    A phrase's row: id, lang, a, phrase (words), heads and tails (how often its first and its last 1, 2, ... words occur), and
    from the second length on left and right, the ids of what it is without its last and its first word.
    """
    words = word_counts(texts)
    totals = settle(words.groupBy("lang").agg(F.sum("a").alias("n")))
    single = numbered(words.where(F.col("a") >= support), ["lang", "word"])
    relation = occurrences(texts, single)
    levels = [settle(single.select("id", "lang", "a", F.array("word").alias("phrase"), F.array("a").alias("heads"), F.array("a").alias("tails")))]
    while len(levels) < longest:
        own = numbered(group_counts(relation, support), ["lang", "left", "right"])
        if own.isEmpty():
            break
        first = levels[-1].select(F.col("id").alias("left"), "phrase", "heads")
        last = levels[-1].select(F.col("id").alias("right"), F.col("phrase").alias("end"), "tails")
        met = own.join(first.hint("merge"), "left").join(last.hint("merge"), "right")
        grown = lambda c: F.concat(c, F.array("a")).alias(c)
        levels.append(settle(met.select("id", "lang", "a", F.concat("phrase", F.slice("end", -1, 1)).alias("phrase"), grown("heads"), grown("tails"), "left", "right")))
        if len(levels) < longest:
            following = semi_join(relation, own)
            drop_settled(relation)
            relation = following
    drop_settled(relation)
    return totals, levels


def _uncovered(level: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """Phrases less those that a phrase of one word more holds and that occurs percent / 100 times as often. One of still more words does so only with one of these."""
    within = longer.select(F.col("left").alias("id"), "a").unionByName(longer.select(F.col("right").alias("id"), "a"))
    most = within.groupBy("id").agg(F.max("a").alias("most"))
    return level.join(most.hint("merge"), "id", "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")


#: Scores of all cuts with the cut's place, the least first. Decimals of 38 digits hold these products up to 10^12 occurrences a language and far beyond.
_CUTS = """array_min(transform(sequence(1, size(phrase) - 1), k -> named_struct(
 'score', (1000 * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(heads[k - 1] as decimal(19, 0)) * cast(tails[size(phrase) - k - 1] as decimal(19, 0))),
 'k', k, 'l', heads[k - 1], 'r', tails[size(phrase) - k - 1])))"""


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", support: int = 100, longest: int = 5, covered_percent: int = 100, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: of each language the `first` phrases of 2 to `longest` words by score, a (both descending) and phrase.

    a, l and r: occurrences of the phrase and of the two parts of its lowest-scoring cut; n: of all words. Null texts are
    empty, a null language is 'und'; texts that repeat count each; an empty table, or one without frequent phrases, gives
    no rows; a word or text may be of any length; further columns are not read.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    totals, levels = frequent_phrases(texts, support=support, longest=longest)
    kept = None
    for i, level in enumerate(levels[1:], 1):
        own = _uncovered(level, levels[i + 1], covered_percent) if i + 1 < len(levels) else level
        own = own.select("lang", "phrase", "a", "heads", "tails")
        kept = own if kept is None else kept.unionByName(own)
    if kept is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    # a language may hold any share of the phrases, so it meets its total, and is ranked, in parts first
    parts = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(RANK_PARTS - 1))))
    scored = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).cast("int")).join(parts.hint("merge"), ["lang", "part"])
    scored = scored.withColumn("cut", F.expr(_CUTS)).select("lang", "part", F.array_join("phrase", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
