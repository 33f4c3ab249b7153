"""Joins, nests, numbering and conflict handling that the other operators share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined_text(values: Column, separator: str = ",") -> Column:
    """The values of an array as one string."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), separator)


def nest_children(parent: DataFrame, child: DataFrame, *, key: str, order_by: Sequence[str], fields: Sequence[str], as_: str) -> DataFrame:
    """Each parent row with its children as an ordered array of structs; [] where there are none."""
    nested = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order_by, *[f for f in fields if f not in order_by]))).alias(as_))
    shape = nested.schema[as_].dataType
    return parent.join(nested, key, "left").withColumn(as_, F.coalesce(as_, F.array().cast(shape)))


def attach_parent(child: DataFrame, parent: DataFrame, on: str | Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Many-to-one load: the parent's fields beside the child's, null where there is no parent."""
    keys = [on] if isinstance(on, str) else list(on)
    return child.join(parent.select(*keys, *fields), keys, "left")


def numbered(df: DataFrame, parent: str | Sequence[str], order_by: Sequence, as_: str = "position") -> DataFrame:
    """0-based dense position within each parent."""
    return df.withColumn(as_, (F.row_number().over(Window.partitionBy(parent).orderBy(*order_by)) - 1).cast("long"))


def top_of(df: DataFrame, group: str | Sequence[str], order_by: Sequence, k: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order_by))).where(F.col("_rank") <= k).drop("_rank")


def latest_by(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The fields of the row that is last in order, a row a key; a partial aggregate, so no key is sorted."""
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_last")).select(key, *[F.col(f"_last.{f}").alias(f) for f in fields])


#: Bits of the filter that an append holds against its target: at most FILTER_BITS / 64 rows of 16 bytes are broadcast, whatever is appended.
FILTER_BITS = 1 << 24


def _place(key: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))


def possible_members(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The keys of target that may be in new: all that are, and few others, so that what meets new in a shuffle is about as much as new itself.

    new's hashed keys set bits; target's keys are looked up in them where they are read. A key with a null is in nothing.
    """
    there = new.dropna(subset=list(key)).select(_place(key).alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_bits"))
    own = target.select(*key).dropna().withColumn("_p", _place(key)).withColumn("_word", F.shiftright("_p", 6))
    return own.join(F.broadcast(there), "_word").where(F.expr("(shiftrightunsigned(_bits, cast(_p & 63 as int)) & 1) = 1")).select(*key)


def append(new: DataFrame, target: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What an idempotent append writes, and what it refuses, with the reason: NULL_KEY, EXISTS (in target), or REPEATED (in new, but for the first by order).

    The target is read once and not shuffled as a whole; rows that are equal in key and order are told apart by nothing, so
    one of them is written.
    """
    keys = list(key)
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    known = possible_members(target, new, keys).distinct().withColumn("_there", F.lit(True))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    judged = new.where(~null).withColumn("_nth", nth).join(known.hint("merge"), keys, "left")
    reason = F.when(F.col("_there").isNotNull(), "EXISTS").when(F.col("_nth") > 1, "REPEATED")
    coded = judged.withColumn("reason", reason).drop("_nth", "_there").unionByName(new.where(null).withColumn("reason", F.lit("NULL_KEY")))
    return coded.where("reason is null").drop("reason").select(*new.columns), coded.where("reason is not null").select(*new.columns, "reason")


def append_if_absent(new: DataFrame, target: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Rows of new whose key is not in target, one a key: what an idempotent append writes. Of target only keys that may be in new are shuffled."""
    return new.dropDuplicates(list(key)).join(possible_members(target, new, key).hint("merge"), list(key), "left_anti")


def conflicts(new: DataFrame, target: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Keys of new that an append refuses: already there, or there twice in new."""
    twice = duplicate_keys(new, key).select(*key)
    there = new.select(*key).join(possible_members(target, new, key).hint("merge"), list(key), "left_semi")
    return twice.unionByName(there).distinct()


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of work whose key has no row in done yet."""
    return work.join(done.select(key), key, "left_anti")


def first_failure(failures: DataFrame, key: str, order: str, code: str = "code") -> DataFrame:
    """The code of the first failure of each key."""
    return failures.groupBy(key).agg(F.min_by(code, F.struct(order, code)).alias(code))
