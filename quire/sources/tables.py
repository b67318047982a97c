"""Table sinks: snapshots and appends as Parquet under the shared work
folder. Every snapshot goes to a fresh path, so a re-run or a retried job
never reads the table it is overwriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def append_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Append rows (R4). Readers see the new files after the job commits."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table as it was written: partition folders read back as strings, so
    that a topic named ``007`` or ``2024`` keeps its name."""
    found = spark.read.parquet(path).schema
    if "topic" not in found.names:
        return spark.read.parquet(path)
    kept = T.StructType([T.StructField(f.name, T.StringType() if f.name == "topic" else f.dataType) for f in found])
    return spark.read.schema(kept).parquet(path)
