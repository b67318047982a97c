"""Topic notebooks as text files: scan (R1/P1/P3) and export (R9).

Two layouts:

* ``files`` — the reference's: one ``<topic>.md`` per topic in one folder
  (header ``# topic``, a blank line, then ``- `` entry lines). Dot-files
  and other extensions are skipped; Spark also skips ``_``-prefixed files.
* ``partitioned`` — the scalable one written by ``export_notes``:
  ``topic=<t>/part-*`` files, lines range-partitioned by (topic, seq), so a
  large topic is written by many tasks and its part files, read in name
  order, give the notebook in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import is_entry_line

HEADER_PREFIX = "# "


def scan_entries(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """(topic, line, file, block_start, row_id) for every entry line.

    Lines are split on LF only and a trailing CR is dropped (CRLF files
    read like LF files). Order inside a file is (block_start, row_id).
    """
    reader = spark.read.option("lineSep", "\n")
    if layout == "files":
        df = reader.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "false").text(path)
        topic = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1)
    elif layout == "partitioned":
        df = reader.schema("value string, topic string").text(path)  # topics stay strings
        topic = F.col("topic")
    else:
        raise ValueError("layout must be 'files' or 'partitioned'")
    line = F.regexp_replace("value", "\r$", "")
    return (df.select(topic.alias("topic"), line.alias("line"),
                      F.col("_metadata.file_name").alias("file"),
                      F.col("_metadata.file_block_start").alias("block_start"),
                      F.monotonically_increasing_id().alias("row_id"))
            .where(is_entry_line("line")))


def notebook_lines(entries: DataFrame) -> DataFrame:
    """(topic, seq, value): header, blank line, then the entry lines."""
    topics = entries.select("topic").distinct()
    header = topics.select("topic", F.lit(-2).cast("bigint").alias("seq"),
                           F.concat(F.lit(HEADER_PREFIX), F.col("topic")).alias("value"))
    blank = topics.select("topic", F.lit(-1).cast("bigint").alias("seq"), F.lit("").alias("value"))
    body = entries.select("topic", "seq", F.col("line").alias("value"))
    return header.unionByName(blank).unionByName(body)


def export_notes(entries: DataFrame, path: str, n_parts: int | None = None) -> str:
    """Write every topic's notebook under ``path/topic=<t>/`` in order."""
    spark = entries.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (notebook_lines(entries).repartitionByRange(n, "topic", "seq")
     .sortWithinPartitions("topic", "seq")
     .select("topic", "value")
     .write.mode("overwrite").partitionBy("topic").text(path))
    return path


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """(topic, line_no, value) of an exported folder, all lines; ``line_no``
    (from 0) is the line's place in its topic's notebook: part files in name
    order, blocks in file order. Lines are numbered within a block, and blocks
    by the counts of those before them, so a large topic is never sorted in
    one task."""
    block = ["topic", "file", "block_start"]
    lines = spark.read.option("lineSep", "\n").schema("value string, topic string").text(path).select(
        "topic", "value", F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"))
    sizes = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("topic").orderBy("file", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*block).orderBy("row_id")
    return lines.withColumn("i", F.row_number().over(inside) - 1).join(offsets, block) \
        .select("topic", (F.col("i") + F.col("offset")).cast("bigint").alias("line_no"), "value")
