"""Audits of declared checks, keys and references, and deletion along references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.storage import settled


def audit_checks(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, violations: all rules in one pass over the table. A rule that gives null holds, as in SQL."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(r), F.lit(True))).alias(name) for name, r in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in rules]), F.array(*[F.col(f"`{n}`") for n in rules]))).alias("rule", "violations"))


def _key(columns: Sequence[str]) -> Column:
    """A key as one value: an array of its columns as text, so keys of any columns meet in one shuffle and only equal ones are equal."""
    return F.array(*[F.col(c).cast("string") for c in columns])


def _exploded(df: DataFrame, keys: Sequence[tuple[Sequence[str], dict[str, int]]]) -> DataFrame:
    """A row for each key of each row that has no null in it, with the key's numbers: one pass over the table, whatever the number of keys."""
    each = [F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]), F.struct(*[F.lit(n).alias(name) for name, n in numbers.items()], _key(columns).alias("key"))) for columns, numbers in keys]
    return df.select(F.explode(F.array_compact(F.array(*each))).alias("k")).select("k.*")


def _named(spark: SparkSession, rules: Sequence[str], counted: DataFrame, **zeros: int) -> DataFrame:
    """Every rule with its counts, which are a row a rule at most."""
    names = spark.createDataFrame(list(enumerate(rules)), "n int, rule string")
    return names.join(F.broadcast(counted), "n", "left").select("rule", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros])


def audit_unique(tables: Sequence[tuple[DataFrame, dict[str, Sequence[str]]]]) -> DataFrame:
    """rule, groups and rows of keys that stand more than once, of all rules of all tables; a key with a null never does.

    tables: frames with their rules' columns. Each table is read once and all keys are counted in one shuffle, after partial
    sums, so that a key that very many rows share is no hot one.
    """
    rules = [name for _, keys in tables for name in keys]
    at = {name: n for n, name in enumerate(rules)}
    rows = reduce(DataFrame.unionByName, [_exploded(df, [(columns, {"n": at[name]}) for name, columns in keys.items()]) for df, keys in tables if keys])
    twice = rows.groupBy("n", "key").agg(F.count("*").alias("c")).where("c > 1")
    counted = twice.groupBy("n").agg(F.count("*").alias("groups"), F.sum("c").alias("rows"))
    return _named(rows.sparkSession, rules, counted, groups=0, rows=0)


def audit_foreign_keys(tables: Mapping[str, DataFrame], references: Sequence[tuple[str, str, Sequence[str], str, Sequence[str]]]) -> DataFrame:
    """rule and orphans: how many rows of each reference refer to nothing. A null in any of its columns passes.

    references: rule, child, its columns, parent and its columns. Each table is read once and gives the keys that it has
    and those that it refers to; they meet in one shuffle by (parent's columns, key), after partial sums, so that what
    very many rows refer to is no hot key.
    """
    sets = {k: i for i, k in enumerate(dict.fromkeys((parent, tuple(keys)) for _, _, _, parent, keys in references))}
    places: list[tuple[int, int]] = []
    for _, _, _, parent, keys in references:
        places.append((sets[parent, tuple(keys)], sum(s == sets[parent, tuple(keys)] for s, _ in places)))
    slots = 1 + max(slot for _, slot in places)
    wanted: dict[str, list] = {}
    for (parent, keys), n in sets.items():
        wanted.setdefault(parent, []).append((keys, {"parent": n, "slot": -1}))
    for (_, child, columns, _, _), (n, slot) in zip(references, places, strict=True):
        wanted.setdefault(child, []).append((columns, {"parent": n, "slot": slot}))
    rows = reduce(DataFrame.unionByName, [_exploded(tables[name], keys) for name, keys in wanted.items()])
    met = rows.groupBy("parent", "key").agg(F.max(F.col("slot") == -1).alias("there"), *[F.count_if(F.col("slot") == i).alias(f"c{i}") for i in range(slots)])
    counts = met.where(~F.col("there")).groupBy("parent").agg(F.array(*[F.sum(f"c{i}") for i in range(slots)]).alias("c"))
    number = F.create_map(*[F.lit(x) for n, place in enumerate(places) for x in (place[0] * slots + place[1], n)])
    counted = counts.select("parent", F.posexplode("c").alias("slot", "orphans")).select(F.try_element_at(number, F.col("parent") * slots + F.col("slot")).alias("n"), "orphans").where("n is not null")
    return _named(rows.sparkSession, [r[0] for r in references], counted, orphans=0)


def _columns(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def propagate_deletes(tables: Mapping[str, tuple[DataFrame, str | Sequence[str]]], references: Sequence[tuple], seed_table: str, seeds: DataFrame) -> DataFrame:
    """table, id (its key's columns, joined by colons) and action of a deletion of seeds, which hold the key's columns.

    tables: name to (frame, key columns); references: (child, columns, parent, its columns, CASCADE | SET_NULL | RESTRICT), of
    any number of columns, of a table to itself too. What each seed takes with it along CASCADE is found in rounds, each from
    what the one before added, until nothing is new. A seed that so reaches a row which a RESTRICT reference uses, from a
    row that does not go with the same seed, stays with all that only it reaches (BLOCKED). What the others reach goes
    (DELETE), and where they go references from rows that stay are cleared (SET_NULL).
    """
    keys = {name: _columns(key) for name, (_, key) in tables.items()}
    links = [(child, _columns(columns), parent, _columns(own), action) for child, columns, parent, own, action in references if child in tables and parent in tables]
    text = lambda name: F.concat_ws(":", *[F.col(c).cast("string") for c in keys[name]])

    def users(link: tuple, reached: DataFrame) -> DataFrame:
        """seed and key of the child's rows that refer to what is reached in the parent."""
        child, columns, parent, own, _ = link
        if not set(own) <= set(keys[parent]):
            reached = reached.join(tables[parent][0].select(*dict.fromkeys([*keys[parent], *own])).hint("merge"), keys[parent])
        target = reached.select("seed", *[F.col(c).alias(f"_r{i}") for i, c in enumerate(own)]).distinct()
        refs = tables[child][0].select(*keys[child], *[F.col(c).alias(f"_r{i}") for i, c in enumerate(columns)]).dropna(subset=[f"_r{i}" for i in range(len(columns))])
        return refs.join(target.hint("merge"), [f"_r{i}" for i in range(len(columns))]).select("seed", *keys[child]).distinct()

    first = settled(seeds.select(text(seed_table).alias("seed"), *keys[seed_table]).distinct())
    reached, added = {seed_table: first}, {seed_table: first}
    while added:
        hits: dict[str, DataFrame] = {}
        for link in links:
            if link[-1] == "CASCADE" and link[2] in added:
                found = users(link, added[link[2]])
                hits[link[0]] = hits[link[0]].unionByName(found).distinct() if link[0] in hits else found
        added = {}
        for child, found in hits.items():
            new = settled(found.join(reached[child].hint("merge"), ["seed", *keys[child]], "left_anti") if child in reached else found)
            if not new.isEmpty():
                added[child] = new
                reached[child] = reached[child].unionByName(new) if child in reached else new

    def left(link: tuple, rows: dict[str, DataFrame], on: list[str]) -> DataFrame:
        """Users of a link's reached rows that do not go themselves."""
        found = users(link, reached[link[2]])
        return found.join(rows[link[0]].hint("merge"), [*on, *keys[link[0]]], "left_anti") if link[0] in rows else found

    stops = [left(link, reached, ["seed"]).select("seed") for link in links if link[-1] == "RESTRICT" and link[2] in reached]
    blocked = settled(reduce(DataFrame.unionByName, stops, first.limit(0).select("seed")).distinct())
    going = {name: settled(rows.join(blocked.hint("merge"), "seed", "left_anti").select(*keys[name]).distinct()) for name, rows in reached.items()}
    out = [blocked.select(F.lit(seed_table).alias("table"), F.col("seed").alias("id"), F.lit("BLOCKED").alias("action"))]
    out += [rows.select(F.lit(name).alias("table"), text(name).alias("id"), F.lit("DELETE").alias("action")) for name, rows in going.items()]
    for link in links:
        if link[-1] == "SET_NULL" and link[2] in going:
            cleared = users(link, going[link[2]].withColumn("seed", F.lit(""))).drop("seed")
            cleared = cleared.join(going[link[0]].hint("merge"), keys[link[0]], "left_anti") if link[0] in going else cleared
            out.append(cleared.select(F.lit(link[0]).alias("table"), text(link[0]).alias("id"), F.lit("SET_NULL").alias("action")))
    return reduce(DataFrame.unionByName, out)
