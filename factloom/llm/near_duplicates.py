"""Near duplicates by fast similarity sketching, banding and exact verification.

1. A text's distinct word shingles are hashed to 64 bits. Rounds of hashed bin placement fill COORDINATES bins: in round
   i every shingle goes to one bin with a value in [i, i+1); after COORDINATES rounds, round COORDINATES + j puts all of
   them in bin j, so every bin fills; a bin keeps its least value.
2. Texts of equal shingle sets are one class from here on. Bands of four coordinates give buckets of classes.
3. In each bucket every class is compared, on full sets, with the bucket's hub: the class that shares most buckets with
   others, so in a group of edited copies the one that they were made from. What the links so found connect needs no
   further comparison. Two classes around a hub that are not connected differ from each other just where one of them
   differs from the hub and the other doesn't, or not alike. So they are joined on the rarest shingles of their differences
   from the hub, as many as a linked pair must share one of, and what meets is verified on full sets. A large group of
   copies costs a comparison a member; no link between groups is lost.
4. Connected components.

At similarity 0.8 all 32 bands miss a pair with probability (1 - 0.8^4)^32, below 1e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import as_batch, bounded_batches, chunks, settle, unfolded, whole_rows
from .components import components
from .words import between, mix, rolled, word_hashes

COORDINATES = 128
BANDS = 32
#: Classes around a hub whose differences from it steer the order of shingles there.
ORDER_SAMPLE = 64
#: Bits of the filter that spares texts without candidates the way to verification: 8 MB, whatever the input.
FILTER_BITS = 1 << 26

#: What stands between words.
_BETWEEN = between(32, range(9, 14))
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; of fewer words than that, all of them are one shingle."""
    hashes, at = word_hashes(texts, _BETWEEN)
    shingles = rolled(hashes, width)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(shingles[a : b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least value of each bin; shingles must not be empty."""
    empty = np.uint64(2**64 - 1)
    bins = np.full(COORDINATES, empty, np.uint64)
    i, m = 0, len(shingles)
    while i < COORDINATES:
        rounds = min(max(1, 1024 // m), COORDINATES - i)
        h = mix(shingles[None, :] ^ _SEEDS[i : i + rounds, None])
        value = (h >> np.uint64(16)) | (np.arange(i, i + rounds, dtype=np.uint64) << np.uint64(48))[:, None]
        np.minimum.at(bins, (h & np.uint64(COORDINATES - 1)).ravel().astype(np.int64), value.ravel())
        i += rounds
        if (bins != empty).all():
            return bins
    for j in np.flatnonzero(bins == empty).tolist():
        least = mix(shingles ^ _SEEDS[COORDINATES + j]).min()
        bins[j] = (least >> np.uint64(16)) | np.uint64((COORDINATES + j) << 48)
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """A bucket key of each band of consecutive coordinates."""
    rows = bins.reshape(BANDS, -1)
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """docs: doc_id, text. doc_id, n_shingles, set_hash (null: no shingles) and bands of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for ids, texts in chunks(batches):
            sets = shingle_sets([t or "" for t in texts], width)
            known: dict[bytes | None, np.ndarray | None] = {None: None}
            hashes = []
            for s in sets:
                h = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if h is not None and h not in known:
                    known[h] = band_keys(sketch(s))
                hashes.append(h)
            yield as_batch([ids, [len(s) for s in sets], hashes, [known[h] for h in hashes]], schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def _filter(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed places of ids; at most FILTER_BITS / 64 rows come to the driver."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and shingles of the texts of ids (and of a few others, whose hash falls on a bit of theirs). Settled."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(ids))
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            place = batch.column(2).to_numpy()
            wanted = (bits.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            for own, texts in chunks([batch.filter(pa.array(wanted.astype(bool)))]):
                yield as_batch([own, [s.view(np.int64) for s in shingle_sets(texts, width)]], schema)

    placed = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("place"))
    return settle(placed.mapInArrow(run, "id long, shingles array<long>"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of both full sets and of what they share."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
    return both.select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"))


def _links_of(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def _as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _with_root(df: DataFrame, roots: DataFrame, column: str, as_: str) -> DataFrame:
    joined = df.join(roots.select(F.col("node").alias(column), F.col("root").alias("_r")).hint("merge"), column, "left")
    return joined.withColumn(as_, F.coalesce("_r", column)).drop("_r")


def _differences(stars: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """hub, id, root, out, n, weight, least and delta of every class around a hub that some class around it isn't connected with. Settled.

    delta: the shingles that only one of the class and its hub has. out: not connected with the hub. weight:
    (100 + percent) * size of delta - (100 - percent) * n. least: the least weight of those around the hub that are out.
    """
    own = _with_root(_with_root(stars, roots, "a", "root"), roots, "b", "hub_root").withColumn("out", F.col("root") != F.col("hub_root"))
    size = F.col("na") + F.col("nb") - 2 * F.col("shared")
    own = settle(own.select(F.col("a").alias("id"), F.col("b").alias("hub"), "root", "out", F.col("na").alias("n"), ((100 + percent) * size - (100 - percent) * F.col("na")).alias("weight")))
    open_hubs = settle(own.groupBy("hub").agg(F.min(F.when(F.col("out"), F.col("weight"))).alias("least"), F.count("*").alias("m")).where("least is not null and m > 1").drop("m"))
    left = own.join(open_hubs.hint("merge"), "hub").join(sets.select("id", F.col("shingles").alias("own")).hint("merge"), "id")
    both = left.join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("theirs")).hint("merge"), "hub")
    return settle(both.select("hub", "id", "root", "out", "n", "weight", "least", F.concat(F.array_except("own", "theirs"), F.array_except("theirs", "own")).alias("delta")))


def _common(differences: DataFrame) -> DataFrame:
    """hub, common: what several of at most ORDER_SAMPLE classes around a hub differ in from it, the most frequent last. It only steers an order."""
    nth = F.row_number().over(Window.partitionBy("hub").orderBy(F.xxhash64("id"), "id"))
    some = differences.withColumn("nth", nth).where(F.col("nth") <= ORDER_SAMPLE).select("hub", F.explode("delta").alias("e"))
    counts = some.groupBy("hub", "e").agg(F.count("*").alias("c")).where("c > 1")
    return settle(counts.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("c", "e")))["e"].alias("common")))


def _prefixes(differences: DataFrame, percent: int) -> DataFrame:
    """A row for each of the rarest shingles in a class's difference from its hub that a class linked with it must share one of.

    Around one hub the sets x and y differ in |dx| + |dy| - 2o shingles, o of which both deltas hold; a link needs
    o >= (weight_x + weight_y) / (2 * (100 + percent)). So of a delta in any order that holds around the hub, the first
    |d| - o + 1 suffice, with the least o that a partner can ask for. Partners that are out weigh `least` or more, and any
    partner's delta is not much smaller than one's own. at: the place in that order; for_out: whether it is among
    those that suffice for partners that are out.
    """
    schema = pa.schema([(c, pa.bool_() if c in ("out", "for_out") else pa.int64()) for c in ("hub", "e", "id", "root", "out", "weight", "size", "at", "for_out")])
    whole, rest = 100 + percent, 100 - percent

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(len(schema))]
            for r in batch.to_pylist():
                delta = np.array(r["delta"], np.int64)
                place = np.zeros(len(delta), np.int64)
                if r["common"]:
                    common = np.array(r["common"], np.int64)
                    order = np.argsort(common, kind="stable")
                    found = np.minimum(np.searchsorted(common, delta, sorter=order), len(common) - 1)
                    same = common[order[found]] == delta
                    place[same] = order[found[same]] + 1
                delta = delta[np.lexsort((delta, place))]
                size = len(delta)
                any_partner = whole * size - rest * r["n"] * (percent + 200) // percent - 1
                needs = lambda least: max(1, -(-(r["weight"] + least) // (2 * whole)))  # noqa: B023, E731
                for_out = size - needs(max(any_partner, r["least"])) + 1
                upto = max(size - needs(any_partner) + 1, for_out) if r["out"] else for_out
                at = range(max(0, min(size, upto)))
                k = len(at)
                for column, value in zip(rows, ([r["hub"]] * k, delta[:k].tolist(), [r["id"]] * k, [r["root"]] * k, [r["out"]] * k, [r["weight"]] * k, [size] * k, list(at), [i < for_out for i in at]), strict=True):
                    column += value
            yield as_batch(rows, schema)

    columns = "hub long, e long, id long, root long, out boolean, weight long, size long, at long, for_out boolean"
    return settle(differences.join(_common(differences).hint("merge"), "hub", "left").select("hub", "id", "root", "out", "n", "weight", "least", "delta", "common").mapInArrow(cut, columns))


def _pairs_around_hubs(stars: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) around the same hub that may be linked and are not connected yet: they meet by a rare shingle of their differences from the hub.

    Where they meet first, what follows in both orders bounds what they share; pairs that can't share enough don't leave the join.
    """
    rows = _prefixes(_differences(stars, sets, roots, percent), percent)
    x, y = (rows.select("hub", "e", *[F.col(c).alias(f"{c}_{i}") for c in ("id", "root", "out", "weight", "size", "at", "for_out")]) for i in "xy")
    after = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
    both_out = F.col("out_y") & F.col("for_out_x") & F.col("for_out_y") & (F.col("id_x") < F.col("id_y"))
    may = (F.col("root_x") != F.col("root_y")) & (both_out | ~F.col("out_y")) & (2 * (100 + percent) * after >= F.col("weight_x") + F.col("weight_y"))
    met = x.where("out_x").join(y.hint("merge"), ["hub", "e"]).where(may)
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_duplicate_links(docs: DataFrame, classes: DataFrame, *, width: int, percent: int) -> DataFrame:
    """Links a, b between classes (id, n_shingles, bands) that connect all that are linked."""
    buckets = classes.select(F.explode("bands").alias("key"), "id")
    shared = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = settle(buckets.join(shared.hint("merge"), "key"))
    sets = _sets_of(docs, members.select("id").distinct(), width)
    scores = members.groupBy("id").agg(F.sum("m").alias("score"))
    scored = settle(members.join(scores.hint("merge"), "id").select("key", "id", "score"))
    hubs = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("hub"))
    around = settle(scored.join(hubs.hint("merge"), "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    stars = settle(_compared(settle(around.distinct()), sets))
    roots = components(_links_of(stars, percent))
    pairs = settle(_pairs_around_hubs(stars, sets, roots, percent))
    found = _as_links(roots).unionByName(_links_of(_compared(pairs, sets), percent))
    return settle(found)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Null and empty texts, and those of white space, have no shingles and no links. Rows with the same id are one
    document; a row without an id is linked with nothing, and kept. Further columns are not read.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = settle(sketches(own, width))
    linked = rows.where("set_hash is not null and doc_id is not null")
    classes = settle(linked.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    links = near_duplicate_links(own, classes, width=width, percent=percent)
    of_class = linked.select("set_hash", "doc_id").join(classes.select("set_hash", "id").hint("merge"), "set_hash")
    several = of_class.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b < top").select("doc_id", "b")
    if not several.isEmpty():  # an id that different texts share links their classes
        several = settle(several)
        links = links.unionByName(of_class.join(several.hint("merge"), "doc_id").select(F.col("id").alias("a"), "b"))
    roots = components(links)
    rooted = settle(_with_root(classes.select("set_hash", "id"), roots, "id", "root"))
    found = rows.join(rooted.select("set_hash", "root").hint("merge"), "set_hash", "left")
    found = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, that stay when of each group of near duplicates the smallest id stays.

    What goes is joined out by id; of rows that share an id one stays, and all without an id. Texts without words are
    linked with nothing and stay; other columns, whatever their names, stay as they are; an empty table stays empty.
    """
    groups = settle(near_duplicates(docs, width=width, percent=percent))
    rows = whole_rows(docs, id=F.col("doc_id").cast("long"))
    gone = settle(groups.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct())
    kept = rows.join(gone.hint("merge"), "id", "left_anti")
    twice = settle(groups.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")))
    if twice.take(1):
        once = kept.join(twice.hint("merge"), "id", "left_anti")
        kept = once.unionByName(kept.join(twice.hint("merge"), "id", "left_semi").dropDuplicates(["id"]))
    return unfolded(kept, docs.columns)
