"""Spans of regular expressions in whole texts, with DataFrame functions only.

A text is split at a pattern's matches; start and end of a match follow from the lengths of the pieces. Positions count
code points, the end is exclusive. Work is linear in the text: matches are folded in blocks, so that a text with very
many of them costs no more a match than one with few.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
#: How many characters before a match its context has.
NEARBY = 40

SPAN = "struct<kind:string,start:int,end:int,score:double>"


@dataclass(frozen=True)
class Kind:
    """What to look for. keep(match, before) decides on a match; score(match, before) rates it; before: the NEARBY characters before it, other matches included."""

    name: str
    pattern: str
    keep: Callable[[Column, Column], Column] = lambda match, before: F.lit(True)
    score: Callable[[Column, Column], Column] = lambda match, before: F.lit(1.0)
    needs: Callable[[Column], Column] | None = None


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _last(*parts: Column) -> Column:
    """The last NEARBY characters of strings in a row."""
    return F.substring(F.concat(*[F.substring(p, -NEARBY, NEARBY) for p in parts]), -NEARBY, NEARBY)


def _fold(kind: Kind, pieces: Column) -> Column:
    """pieces: array<struct<before, match>>, null as the last match. The fold carries the end of the text so far, so that no match costs a search of the text."""

    def step(acc: Column, x: Column) -> Column:
        return F.transform(F.array(_last(acc["near"], x["before"])), lambda near: judged(acc, x, near))[0]

    def judged(acc: Column, x: Column, near: Column) -> Column:
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"), end.alias("end"), kind.score(x["match"], near).cast("double").alias("score"))
        hit = x["match"].isNotNull() & F.coalesce(kind.keep(x["match"], near), F.lit(False))
        upto = _last(near, F.coalesce(x["match"], F.lit("")))
        return F.struct(end.alias("at"), upto.alias("near"), F.when(hit, F.concat(acc["out"], F.array(one).cast(f"array<{SPAN}>"))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), acc["near"].alias("near"), _empty(SPAN).alias("out"))
        inner = F.aggregate(F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)), start, step)
        return F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), i["near"].alias("near"), F.concat(acc["out"], F.array(i["out"])).alias("out")))[0]

    blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.lit("").alias("near"), _empty(f"array<{SPAN}>").alias("out")), block, lambda acc: acc["out"])
    return F.flatten(whole)


def with_spans(df: DataFrame, text: str, kinds: list[Kind], prefix: str = "_spans_") -> DataFrame:
    """Add one array of spans a kind, in columns prefix + name. A null text has none."""
    found = {
        f"_m_{k.name}": F.when(k.needs(F.col(text)) if k.needs else F.lit(True), F.regexp_extract_all(F.col(text), F.lit(k.pattern), F.lit(0))) for k in kinds
    }
    some = lambda k: F.size(F.col(f"_m_{k.name}")) > 0
    pieces = {
        f"_p_{k.name}": F.when(some(k), F.arrays_zip(F.split(F.col(text), k.pattern, -1).alias("before"), F.col(f"_m_{k.name}").alias("match"))) for k in kinds
    }
    spans = {f"{prefix}{k.name}": F.when(F.col(f"_p_{k.name}").isNotNull(), _fold(k, F.col(f"_p_{k.name}"))).otherwise(_empty(SPAN)) for k in kinds}
    return df.withColumns(found).withColumns(pieces).drop(*found).withColumns(spans).drop(*pieces)


def rendered(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced. spans: structs of start, minus (minus its end) and put; of overlapping ones, which count as one, the first is put.

    Spans are taken in blocks in their order. Only a block searches the text for its own part, and its spans search that
    part only, so that a text with very many spans costs no more a span than one with few.
    """

    def bind(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)[0]

    def block(ordered: Column, acc: Column, b: Column) -> Column:
        def of(own: Column) -> Column:
            upto = F.greatest(F.get(own, F.size(own) - 1)["start"], acc["at"])
            return bind(F.substring(text, acc["at"] + 1, upto - acc["at"]), lambda part: folded(acc, own, part))

        return bind(F.slice(ordered, b * BLOCK + 1, F.lit(BLOCK)), of)

    def folded(acc: Column, own: Column, part: Column) -> Column:
        def step(inner: Column, s: Column) -> Column:
            kept = F.substring(part, inner["at"] - acc["at"] + 1, s["start"] - inner["at"])
            out = F.when(s["start"] >= inner["at"], F.concat(inner["out"], F.array(kept, s["put"]))).otherwise(inner["out"])
            return F.struct(F.greatest(inner["at"], -s["minus"]).alias("at"), out.alias("out"))

        inner = F.aggregate(own, F.struct(acc["at"].alias("at"), _empty("string").alias("out")), step)
        return bind(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(i["out"], ""))).alias("out")))

    def whole(ordered: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / BLOCK).cast("int"))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), _empty("string").alias("out")), lambda acc, b: block(ordered, acc, b))

    done = bind(bind(F.array_sort(spans), whole), lambda w: F.concat(F.array_join(w["out"], ""), F.substring(text, w["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by its first kind in angle brackets."""
    return replaced(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("put"))))
