"""Small in-test tables (tests only; registered queries read the driver's tables)."""

import datetime as dt

from pyspark.sql import functions as F

from quire.functions.text import render_entry_str


def entries_df(spark, rows):
    """rows: (entry_id, topic, line) -> entries table with parsed columns."""
    df = spark.createDataFrame(rows, "entry_id bigint, topic string, line string")
    return df.withColumn("seq", F.col("entry_id"))


def dated_entries(spark, rows):
    """rows: (entry_id, topic, date 'YYYY-MM-DD', body, count)."""
    df = spark.createDataFrame(rows, "entry_id bigint, topic string, d string, body string, reinforce_count bigint")
    return df.select("entry_id", "topic", F.to_date("d").alias("entry_date"), "body", "reinforce_count",
                     render_entry_str("d", "body", "reinforce_count").alias("line"),
                     F.col("entry_id").alias("seq"))


def queries_df(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, query string")


def writes_df(spark, rows):
    """rows: (seq, topic, body, 'YYYY-MM-DD', force)."""
    data = [(s, s, t, b, dt.date.fromisoformat(d), f) for s, t, b, d, f in rows]
    return spark.createDataFrame(
        data, "seq bigint, entry_id bigint, topic string, body string, written_on date, force boolean")
