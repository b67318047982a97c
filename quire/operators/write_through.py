"""Writes carried through to the index and the vectors (D3, M4, M5).

``changes`` tells what a consolidated batch did to the live entries, as rows
to insert, update and delete; ``apply_changes`` brings a segmented index and a
vector table in step with them, by key, at the cost of the changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import segments, vectors
from quire.operators.consolidate import Consolidation
from quire.operators.vectors import Embedder
from quire.session import cut_lineage

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def changes(seed: DataFrame | None, result: Consolidation) -> DataFrame:
    """(entry_id, topic, seq, change, line, reinforce_count, old_line) of every
    live entry that a fold of a batch onto ``seed`` added, changed or removed;
    a write added and removed by the same batch is none of them. Only rows that
    the outcomes name (as write or match) are compared."""
    named = result.outcomes.select("seq").unionByName(
        result.outcomes.where("match_seq is not null").select(F.col("match_seq").alias("seq"))).distinct()
    new = result.live.join(named, "seq", "left_semi").select("seq", "entry_id", "topic", "line", "reinforce_count")
    if seed is None:
        return new.select("entry_id", "topic", "seq", F.lit(INSERT).alias("change"), "line", "reinforce_count",
                          F.lit(None).cast("string").alias("old_line"))
    old = seed.join(named, "seq", "left_semi").select(
        "seq", *[F.col(c).alias(f"old_{c}") for c in ("entry_id", "topic", "line", "reinforce_count")])
    change = F.when(F.col("line").isNull(), DELETE).when(F.col("old_line").isNull(), INSERT).otherwise(UPDATE)
    return new.join(old, "seq", "full").where("not (line <=> old_line)").select(
        F.coalesce("entry_id", "old_entry_id").alias("entry_id"), F.coalesce("topic", "old_topic").alias("topic"), "seq",
        change.alias("change"), "line", F.coalesce("reinforce_count", "old_reinforce_count").alias("reinforce_count"),
        "old_line")


def apply_changes(changed: DataFrame, version: str, vector_table: DataFrame, embed: Embedder | None = None,
                  **embed_args) -> tuple[str, DataFrame]:
    """(index version, vector table) after ``changed``: the index gets a
    segment, the vectors of removed entries go and those of new and changed
    lines are embedded, nothing else."""
    spark = changed.sparkSession
    changed = cut_lineage(changed, "changes")
    gone = changed.where(F.col("change") == DELETE)
    put = changed.where(F.col("change") != DELETE).select("entry_id", "topic", "line", "seq")
    version = segments.refresh(spark, version, gone.select("entry_id"), put)
    kept = vectors.delete(vector_table, gone)
    return version, vectors.upsert(kept, vectors.embed_entries(put, embed, **embed_args))
