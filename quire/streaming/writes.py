"""Structured Streaming over the write feed (S1-S3).

The reference's ``write`` command is one event per call; here a stream of
write requests (seq, entry_id, topic_raw, body_raw, written_on, force)
arrives as files.

* ``stream_append`` (S1): validate, keep accepted, append to the entries
  table (file sink; exactly-once through the sink's commit log).
* ``stream_consolidate`` (S2): ``foreachBatch`` folds each micro-batch in
  ``seq`` order against the live entries of its topics. Every batch writes
  those topics to new versioned folders (``batch=<id>``) and never overwrites
  what it reads, so a re-run of a batch after a failure is idempotent.
* ``stream_topic_counts`` (S3): running count of accepted writes per topic
  (complete mode; each batch overwrites a fresh snapshot folder).

Writes are assumed to arrive in ``seq`` order across batches (a late
write with a lower seq is still folded when it arrives, against the live
table of that moment).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import consolidate, notes
from quire.operators.sizing import bounded_broadcast
from quire.session import cut_lineage

WRITE_SCHEMA = ("seq bigint, entry_id bigint, topic_raw string, body_raw string, "
                "written_on date, force boolean")
LIVE_SCHEMA = ("entry_id bigint, topic string, seq bigint, entry_date date, reinforce_count bigint, body string, "
               "line string, embedding array<float>")
LIVE_COLS = ["entry_id", "topic", "seq", "entry_date", "reinforce_count", "body", "line", "embedding"]


def read_write_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(WRITE_SCHEMA)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def stream_append(writes: DataFrame, out_path: str, checkpoint: str) -> None:
    """Validated, accepted writes appended to ``out_path`` (partitioned by
    topic). Runs all available input, then stops."""
    accepted = notes.writes_to_entries(notes.validate_writes(writes).where("accepted"))
    q = (accepted.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .partitionBy("topic").outputMode("append").trigger(availableNow=True).start(out_path))
    q.awaitTermination()


def stream_topic_counts(writes: DataFrame, out_path: str, checkpoint: str) -> None:
    """Running per-topic counts; each batch writes the full table to
    ``out_path/batch=<id>`` (fresh folder per batch)."""
    counts = notes.validate_writes(writes).where("accepted").groupBy("topic") \
        .agg(F.count(F.lit(1)).alias("n_entries"))

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    q = (counts.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def batches(spark: SparkSession, root: str, before: int | None = None) -> list[int]:
    """Complete ``batch=<id>`` folders under ``root`` (below ``before``)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    ids = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("batch=") and \
                fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            b = int(name.split("=", 1)[1])
            if before is None or b < before:
                ids.append(b)
    return sorted(ids)


def latest_batch(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """Highest complete ``batch=<id>`` folder under ``root`` (below ``before``)."""
    return max(batches(spark, root, before), default=None)


def live_entries(spark: SparkSession, root: str, seed_path: str | None = None, before: int | None = None,
                 topics: DataFrame | None = None) -> DataFrame:
    """The live entries (of ``topics``) after the batches below ``before``. A
    batch writes the topics it holds, one folder each; a topic's entries are
    those of its latest batch, or of the seed if no batch has held it."""
    done = batches(spark, f"{root}/live", before)
    found = spark.createDataFrame([], LIVE_SCHEMA)
    heads = spark.createDataFrame([], "topic string, batch int")
    if done:
        written = spark.read.schema(LIVE_SCHEMA + ", batch int").option("basePath", f"{root}/live") \
            .parquet(*[f"{root}/live/batch={b}" for b in done])
        mine = written if topics is None else written.join(topics, "topic", "left_semi")
        # small: one row a topic; broadcast, it prunes the folders of other batches and topics
        heads = mine.groupBy("topic").agg(F.max("batch").alias("batch"))
        found = written.join(bounded_broadcast(heads), ["topic", "batch"], "left_semi").select(*LIVE_COLS)
    if seed_path is None:
        return found
    seed = spark.read.parquet(seed_path)
    if topics is not None:
        seed = seed.join(topics, "topic", "left_semi")
    return found.unionByName(seed.join(heads, "topic", "left_anti").select(*LIVE_COLS))


def stream_consolidate(writes: DataFrame, root: str, checkpoint: str,
                       seed_path: str | None = None, **fold_args) -> None:
    """Fold each micro-batch against the live entries of its topics. Output
    folders under ``root``: ``live/batch=<id>/topic=<t>``,
    ``outcomes/batch=<id>``, ``tombstones/batch=<id>``; a batch reads and writes
    its own topics only (:func:`live_entries` gives the whole)."""
    spark = writes.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        raw = notes.validate_writes(batch).where("accepted")
        w = cut_lineage(raw.select("seq", "entry_id", "topic", "body", "written_on", "force"), "batch-writes")
        topics = w.select("topic").distinct()
        seed = None
        if seed_path is not None or batches(spark, f"{root}/live", batch_id):
            seed = live_entries(spark, root, seed_path, batch_id, bounded_broadcast(topics))
        res = consolidate.fold(w, seed=seed, **fold_args)
        res.outcomes.write.mode("overwrite").parquet(f"{root}/outcomes/batch={batch_id}")
        res.tombstones.write.mode("overwrite").parquet(f"{root}/tombstones/batch={batch_id}")
        res.live.select(*LIVE_COLS).write.mode("overwrite").partitionBy("topic").parquet(f"{root}/live/batch={batch_id}")

    q = (writes.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
