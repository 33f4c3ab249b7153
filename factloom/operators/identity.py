"""Recorded identities of what a later step relies on, against the tables as they are now."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns that must all be as recorded, the key first.
IDENTITIES = {
    "snapshot": ["snapshot_id", "source_id", "content_type", "byte_size", "sha256"],
    "prompt": ["prompt_id", "prompt_key", "version", "checksum"],
    "execution": ["execution_id", "prompt_id", "prompt_key", "prompt_version", "prompt_checksum", "provider_key", "model_id", "status"],
    "extraction": ["run_id", "snapshot_id", "source_id", "snapshot_sha256", "status", "chunks"],
}
#: What of a chunk belongs to its extraction's identity.
CHUNK = ["chunk_id", "position", "run_id", "char_start", "char_end", "text", "sha256"]


def chunks_digest(chunks: DataFrame, fields: Sequence[str] = tuple(CHUNK)) -> DataFrame:
    """run_id and chunks: one digest of all of a run's chunks in order of position, over each one's own digest.

    So an extraction with all its chunks is one value to compare; texts do not leave the task that reads them.
    """
    own = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    ordered = F.array_sort(F.collect_list(F.struct("position", own.alias("digest"))))["digest"]  # a run has at most some thousand chunks
    return chunks.groupBy("run_id").agg(F.sha2(F.array_join(ordered, ","), 256).alias("chunks"))


def revalidate(recorded: DataFrame, current: DataFrame, kind: str) -> DataFrame:
    """id, state (OK, CHANGED or MISSING) and changed (columns that differ, in order) of every recorded identity of a kind.

    Whole rows are compared; a null, recorded or current, equals nothing. Of current rows that share a key the one with
    the fewest differences counts. A row recorded twice is judged once.
    """
    key, *others = IDENTITIES[kind]
    now = current.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in others])
    differs = lambda c: F.coalesce(F.col(c) != F.col(f"_{c}"), F.lit(True))
    changed = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in others]))
    own = recorded.select(F.col(key).alias("id"), *others).distinct()
    met = own.join(now.hint("merge"), F.col("id") == F.col("_key"), "left")
    judged = met.select("id", *others, F.when(F.col("_key").isNotNull(), changed).alias("changed"))
    fewest = judged.groupBy("id", *others).agg(F.min_by("changed", F.struct(F.size("changed"), "changed")).alias("changed"))
    state = F.when(F.col("changed").isNull(), "MISSING").when(F.size("changed") > 0, "CHANGED").otherwise("OK")
    return fewest.select("id", state.alias("state"), F.coalesce("changed", F.array().cast("array<string>")).alias("changed"))


def revalidate_all(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """kind, id, state and changed over several kinds: recorded and current of each."""
    return reduce(DataFrame.unionByName, [revalidate(*frames, kind).withColumn("kind", F.lit(kind)) for kind, frames in pairs.items()])
