"""Review and release: an append-only log of decisions folded into current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.storage import settled

from .relational import numbered

_REFUSED = "array<struct<seq:bigint,decision:string,reason:string,approval:string,release:string>>"


def approval_state(decisions: DataFrame) -> DataFrame:
    """The last of DRAFT, APPROVED and REJECTED decides; DRAFT clears note and time. No guard, so a partial aggregate is enough."""
    last = decisions.where("decision in ('DRAFT', 'APPROVED', 'REJECTED')").groupBy("asset").agg(F.max_by(F.struct("decision", "note", "ts"), F.struct("ts", "seq")).alias("d"))
    kept = F.col("d.decision") != "DRAFT"
    return last.select("asset", F.col("d.decision").alias("approval_status"), F.when(kept, F.col("d.note")).alias("reviewer_note"), F.when(kept, F.col("d.ts")).alias("decided_at"))


def refusal(kind: Column, guard_ok: Column, approval: Column, release: Column, decision: Column) -> Column:
    """Why a decision is refused in a state, else null.

    What is released keeps its approval until withdrawn. Release needs an approved asset that was never released, and its
    kind's guard: a note's content version, an item's completeness (also to be approved), a package's members.
    """
    return (
        F.when(decision.isin("DRAFT", "REJECTED") & (release == "RELEASED"), "MUST_BE_WITHDRAWN")
        .when((decision == "APPROVED") & (kind == "item") & ~guard_ok, "INCOMPLETE")
        .when((decision == "RELEASE") & (release != "UNRELEASED"), "BAD_TRANSITION")
        .when((decision == "RELEASE") & (approval != "APPROVED"), "NOT_APPROVED")
        .when((decision == "RELEASE") & kind.isin("note", "item", "package") & ~guard_ok, "GUARD_FAILED")
        .when((decision == "WITHDRAW") & (release != "RELEASED"), "BAD_TRANSITION")
    )


def refused(kind: str, guard_ok: bool | None, approval: str, release: str, decision: str) -> str | None:
    """The same for one decision in Python, where state is kept by a stream."""
    rules = {
        "DRAFT": [("MUST_BE_WITHDRAWN", release == "RELEASED")],
        "REJECTED": [("MUST_BE_WITHDRAWN", release == "RELEASED")],
        "APPROVED": [("INCOMPLETE", kind == "item" and guard_ok is False)],
        "RELEASE": [("BAD_TRANSITION", release != "UNRELEASED"), ("NOT_APPROVED", approval != "APPROVED"), ("GUARD_FAILED", kind in ("note", "item", "package") and guard_ok is False)],
        "WITHDRAW": [("BAD_TRANSITION", release != "RELEASED")],
    }
    return next((reason for reason, broken in rules.get(decision, []) if broken), None)


def with_guards(decisions: DataFrame, guards: DataFrame) -> DataFrame:
    """Decisions (asset_kind, asset_id, ...) with guard_ok as the tables give it (asset_kind, asset_id, guard_ok); documents have no guard, and what is in no table fails its own.

    guards hold an asset once at most after this; decisions may be a stream, guards are then those at its start.
    """
    known = guards.groupBy("asset_kind", "asset_id").agg(F.bool_and("guard_ok").alias("guard_ok"))
    met = decisions.drop("guard_ok").join(known.hint("merge"), ["asset_kind", "asset_id"], "left")
    return met.withColumn("guard_ok", F.coalesce("guard_ok", F.col("asset_kind") == "document")).drop("asset_id")


#: Decisions that one row folds.
BUCKET = 1_000
APPROVALS, RELEASES = ["DRAFT", "APPROVED", "REJECTED"], ["UNRELEASED", "RELEASED", "WITHDRAWN"]


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _moved(kind: Column, state: Column, e: Column) -> Column:
    """The number of the state (3 * approval + release) that a decision leads to from another."""
    d = e["decision"]
    approval, release = F.floor(state / 3).cast("int"), state % 3
    ok = refusal(kind, e["guard_ok"], F.get(_names(APPROVALS), approval), F.get(_names(RELEASES), release), d).isNull()
    to = F.when(ok & d.isin(APPROVALS), F.array_position(_names(APPROVALS), d).cast("int") - 1).otherwise(approval)
    return (3 * to + F.when(ok & (d == "RELEASE"), 1).when(ok & (d == "WITHDRAW"), 2).otherwise(release)).cast("int")


def _number(approval: Column, release: Column) -> Column:
    return (3 * (F.array_position(_names(APPROVALS), approval) - 1) + F.array_position(_names(RELEASES), release) - 1).cast("int")


def _ranged(decisions: DataFrame, bucket: int) -> DataFrame:
    """decisions with `part` and `bucket`: parts are ranges of (asset, kind, time), of even size whatever an asset's share, and buckets of at most so many rows follow one another within a part."""
    parts = int(decisions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["asset", "asset_kind", "ts", "seq"]
    row = F.monotonically_increasing_id()  # the part, and below it the number within it
    ranged = decisions.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", row)
    return ranged.withColumn("part", F.shiftright("_row", 33).cast("int")).withColumn("bucket", F.floor(F.col("_row").bitwiseAND((1 << 33) - 1) / bucket).cast("int")).drop("_row")


def _walked(maps: Column, first: Column) -> Column:
    """The state in which each of consecutive maps of states begins."""
    begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(maps, begin, lambda acc, m: F.struct(F.get(m["map"], acc["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _starts(buckets: DataFrame) -> DataFrame:
    """asset, asset_kind, part, bucket and start (the number of a state) of every bucket of assets that have several. buckets: with the state `first` that the asset begins in.

    A parallel prefix. A bucket's decisions map each of the nine states to another; the maps of an asset's buckets are
    composed a part; the parts' maps, as many as there are parts, are walked an asset; and from the state in which a part
    begins its own buckets are. No step gathers more than a part's buckets or the parts.
    """
    asset, place = ["asset", "asset_kind"], ["part", "bucket"]
    several = buckets.groupBy(*asset).agg(F.count("*").alias("n")).where("n > 1").select(*asset)
    own = buckets.join(several.hint("merge"), asset, "left_semi")
    every = F.array(*[F.lit(i) for i in range(9)])
    maps = settled(own.select(*asset, *place, "first", F.aggregate("events", every, lambda states, e: F.transform(states, lambda s: _moved(F.col("asset_kind"), s, e))).alias("map")))
    by_part = maps.groupBy(*asset, "part").agg(F.array_sort(F.collect_list(F.struct("bucket", "map"))).alias("maps"), F.min("first").alias("first"))
    through = F.aggregate("maps", every, lambda states, m: F.transform(states, lambda s: F.get(m["map"], s)))
    parts = settled(by_part.select(*asset, "part", "first", "maps", through.alias("map")))
    chains = parts.groupBy(*asset).agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("maps"), F.min("first").alias("first"))
    begins = chains.select(*asset, F.explode(F.arrays_zip(F.col("maps.part").alias("part"), _walked(F.col("maps"), F.col("first")).alias("start"))).alias("p")).select(*asset, "p.part", "p.start")
    within = parts.select(*asset, "part", "maps").join(begins.hint("merge"), [*asset, "part"])
    return within.select(*asset, "part", F.explode(F.arrays_zip(F.col("maps.bucket").alias("bucket"), _walked(F.col("maps"), F.col("start")).alias("start"))).alias("b")).select(*asset, "part", "b.bucket", "b.start")


def release_state(decisions: DataFrame, *, bucket: int = BUCKET, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """decisions: asset, asset_kind, ts, seq, decision, note, guard_ok. State of each asset that they decide on, and the refused decisions.

    The order of decisions matters. They are dealt by ranges of asset and time and folded in buckets, so that no row and no
    task grows with an asset; a later bucket begins in the state that the maps of those before lead to. before: states
    that earlier decisions led to, in the form that this returns.
    """
    placed = _ranged(decisions, bucket)
    buckets = settled(placed.groupBy("asset", "asset_kind", "part", "bucket").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "decision", "note", "guard_ok"))).alias("events")))
    if before is None:
        buckets = buckets.withColumn("first", F.lit(0))
    else:
        known = before.select("asset", "asset_kind", _number(F.col("approval_status"), F.col("release_status")).alias("first"))
        buckets = settled(buckets.join(known.hint("merge"), ["asset", "asset_kind"], "left").withColumn("first", F.coalesce("first", F.lit(0))))
    begun = buckets.join(settled(_starts(buckets)).hint("merge"), ["asset", "asset_kind", "part", "bucket"], "left").withColumn("start", F.coalesce("start", "first"))
    when = decisions.schema["ts"].dataType.simpleString()
    start = F.struct(
        F.get(_names(APPROVALS), F.floor(F.col("start") / 3).cast("int")).alias("approval"), F.get(_names(RELEASES), F.col("start") % 3).alias("release"), F.lit(False).alias("reviewed"), F.lit(None).cast("string").alias("reviewer_note"), F.lit(None).cast(when).alias("decided_at"),
        F.lit(None).cast(when).alias("released_at"), F.lit(None).cast(when).alias("withdrawn_at"), F.lit(False).alias("noted"), F.lit(None).cast("string").alias("release_note"), F.array().cast(_REFUSED).alias("refused"),
    )

    def step(s: Column, e: Column) -> Column:
        d = e["decision"]
        reason = refusal(F.col("asset_kind"), e["guard_ok"], s["approval"], s["release"], d)
        ok = reason.isNull()
        review, undo = ok & d.isin(APPROVALS), ok & (d == "DRAFT")
        out, back = ok & (d == "RELEASE"), ok & (d == "WITHDRAW")
        no = F.struct(e["seq"].alias("seq"), d.alias("decision"), reason.alias("reason"), s["approval"].alias("approval"), s["release"].alias("release"))
        return F.struct(
            F.when(review, d).otherwise(s["approval"]).alias("approval"),
            F.when(out, "RELEASED").when(back, "WITHDRAWN").otherwise(s["release"]).alias("release"),
            (s["reviewed"] | review).alias("reviewed"),
            F.when(undo, None).when(review, e["note"]).otherwise(s["reviewer_note"]).alias("reviewer_note"),
            F.when(undo, None).when(review, e["ts"]).otherwise(s["decided_at"]).alias("decided_at"),
            F.when(out, e["ts"]).otherwise(s["released_at"]).alias("released_at"),
            F.when(back, e["ts"]).otherwise(s["withdrawn_at"]).alias("withdrawn_at"),
            (s["noted"] | out | back).alias("noted"),
            F.when(out | back, e["note"]).otherwise(s["release_note"]).alias("release_note"),
            F.when(ok, s["refused"]).otherwise(F.concat(s["refused"], F.array(no).cast(_REFUSED))).alias("refused"),
        )

    folded = begun.select("asset", "asset_kind", F.struct("part", "bucket").alias("place"), F.aggregate("events", start, step).alias("s"))
    last = lambda value, where: F.max_by(value, F.when(where, F.col("place")))
    state = folded.groupBy("asset", "asset_kind").agg(
        last(F.col("s.approval"), F.lit(True)).alias("approval_status"), last(F.struct("s.reviewer_note", "s.decided_at"), F.col("s.reviewed")).alias("review"), last(F.col("s.release"), F.lit(True)).alias("release_status"),
        F.max("s.released_at").alias("released_at"), F.max("s.withdrawn_at").alias("withdrawn_at"), last(F.struct("s.release_note"), F.col("s.noted")).alias("noted"), F.sum(F.size("s.refused")).cast("long").alias("n_refused"),
    )
    if before is not None:
        old = before.select("asset", "asset_kind", F.struct("reviewer_note", "decided_at").alias("_review"), F.col("released_at").alias("_out"), F.col("withdrawn_at").alias("_back"), F.struct("release_note").alias("_noted"), F.col("n_refused").alias("_n"))
        both = state.join(old.hint("merge"), ["asset", "asset_kind"], "left")
        state = both.withColumns({"review": F.coalesce("review", "_review"), "released_at": F.coalesce("released_at", "_out"), "withdrawn_at": F.coalesce("withdrawn_at", "_back"), "noted": F.coalesce("noted", "_noted"), "n_refused": F.col("n_refused") + F.coalesce("_n", F.lit(0))})
    state = state.select("asset", "asset_kind", "approval_status", F.col("review.reviewer_note").alias("reviewer_note"), F.col("review.decided_at").alias("decided_at"), "release_status", "released_at", "withdrawn_at", F.col("noted.release_note").alias("release_note"), "n_refused")
    refused = folded.select("asset", "asset_kind", F.explode("s.refused").alias("r")).select("asset", "asset_kind", "r.*")
    return state, refused


def lifecycle_checks(state: DataFrame) -> DataFrame:
    """Assets whose stored state no sequence of decisions could give, with the first broken rule."""
    released = F.col("released_at").isNotNull()
    rule = (
        F.when((F.col("approval_status") == "DRAFT") & F.col("decided_at").isNotNull(), "DRAFT_HAS_DECISION")
        .when((F.col("approval_status") != "DRAFT") & F.col("decided_at").isNull(), "DECISION_MISSING")
        .when((F.col("release_status") == "UNRELEASED") & released, "UNRELEASED_HAS_TIME")
        .when((F.col("release_status") == "RELEASED") & (~released | (F.col("approval_status") != "APPROVED") | F.col("withdrawn_at").isNotNull()), "RELEASED_INCONSISTENT")
        .when((F.col("release_status") == "WITHDRAWN") & (~released | F.col("withdrawn_at").isNull()), "WITHDRAWN_INCONSISTENT")
    )
    return state.withColumn("rule", rule).where("rule is not null").select("asset", "rule")


def build_packages(versions: DataFrame, notes: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages with a member, their members (kind, id, position), and versions in conflict for want of any."""
    own_notes = notes.where("release_status = 'RELEASED'").select("content_version_id", F.lit("note").alias("kind"), F.col("note_id").alias("member_id"))
    own_items = items.where("release_status = 'RELEASED'").select("content_version_id", F.lit("item").alias("kind"), F.col("item_id").alias("member_id"))
    members = own_notes.unionByName(own_items).join(versions.select("content_version_id"), "content_version_id")
    members = numbered(members, ["content_version_id", "kind"], ["member_id"])
    filled = members.select("content_version_id").distinct()
    return filled, members, versions.select("content_version_id").join(filled, "content_version_id", "left_anti")
