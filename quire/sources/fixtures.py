"""Input tables derived from the driver's parquet tables.

The same derivations are written as SQL in ``quire.plans.oracle`` so the
DuckDB oracle sees identical inputs. Whole texts are used everywhere:
no prefixes, no id subsets.

entries        documents -> (entry_id, topic, entry_date, body, reinforce_count, line, seq)
search_queries benchmark -> (query_id, query)   whole item text
writes         entries in arrival order -> (seq, entry_id, topic, body, written_on, force)
new_writes     conversations -> writes of new notes (topic = role), dated as_of
note_lines     documents split into lines, one topic per document (for line edits)
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import flatten_newlines, render_entry

# --- fixture parameters -----------------------------------------------------
AS_OF = _dt.date(2026, 1, 1)
ENTRY_EPOCH = _dt.date(2024, 1, 1)
DATE_SPAN_DAYS = 731
COUNT_SPAN = 4
# New notes (from conversations) get ids above every document id.
NEW_ID_BASE = 1_000_000_000_000
TURN_STRIDE = 1000
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has
    cores (a single-row-group file is one task). CPU-heavy per-row work
    (tokenizing, hashing) then runs in parallel. On a large table the scan
    already has thousands of splits and this is a no-op."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def entries_from_documents(documents: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id")
    entry_date = F.date_add(F.lit(ENTRY_EPOCH), (doc_id % DATE_SPAN_DAYS).cast("int"))
    body = flatten_newlines("text")
    count = (F.lit(1) + doc_id % COUNT_SPAN).cast("bigint")
    return (
        documents.select(
            doc_id.alias("entry_id"),
            F.col("lang").alias("topic"),
            entry_date.alias("entry_date"),
            body.alias("body"),
            count.alias("reinforce_count"),
        )
        .withColumn("line", render_entry("entry_date", "body", "reinforce_count"))
        .withColumn("seq", F.col("entry_id"))
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_from_documents(spread(table(spark, sf_dir, "documents")))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def writes_from_entries(ents: DataFrame, force: bool = False) -> DataFrame:
    """Each entry replayed as a write, in ``seq`` order, dated by its entry date."""
    return ents.select(
        "seq", "entry_id", "topic", "body",
        F.col("entry_date").alias("written_on"),
        F.lit(force).alias("force"),
    )


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes_from_entries(entries(spark, sf_dir))


def new_writes(spark: SparkSession, sf_dir: str, as_of: _dt.date = AS_OF) -> DataFrame:
    """Conversation turns as raw write requests (topic = role)."""
    conv = table(spark, sf_dir, "conversations")
    seq = (F.lit(NEW_ID_BASE) + F.col("conv_id") * TURN_STRIDE + F.col("turn")).cast("bigint")
    return conv.select(
        seq.alias("seq"),
        seq.alias("entry_id"),
        F.col("role").alias("topic_raw"),
        F.col("text").alias("body_raw"),
        F.lit(as_of).alias("written_on"),
        F.lit(False).alias("force"),
    )


def note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a topic file: one row per text line, ``seq`` = line
    number (0-based). Used by the first-match line edits."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("topic"),
        F.posexplode(F.split(F.col("text"), "\n")).alias("seq", "line"),
    ).select("topic", F.col("seq").cast("bigint").alias("seq"),
             F.regexp_replace("line", "\r$", "").alias("line"))
