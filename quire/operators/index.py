"""BM25 inverted index as flat tables.

postings   (term, entry_id, tf, dl)      one row per distinct term of an entry;
                                         ``dl`` is carried so scoring needs no
                                         join back to the documents
docs       (entry_id, topic, dl, line)   every entry, token-less ones included;
                                         the indexed text is kept, as the
                                         reference's index keeps it, so a
                                         search can render and boost its
                                         hits without the entries table
term_stats (term, df, first_bucket, last_bucket)  posting-list lengths and places
stats      (n_docs, total_tokens, avg_dl) one row

A written index is clustered by term: postings are range-partitioned by
(term, entry_id) into ``bucket`` folders, a hot term over several of them.
A search joins its terms with ``term_stats`` and reads only their buckets,
once; the two statistics tables are written with the index. An index that
is not written (fresh from ``build_index`` or ``refresh_index``) derives them.

Building is narrow up to the one shuffle that clusters the postings: tokens are
counted within their row, and the shuffle carries distinct (entry, term) pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import token_slices, token_text, tokenize
from quire.session import discard, fresh_path

BUCKET_ROWS = 2_000_000     # postings of a bucket, where the session's partitions would hold more
POSTINGS_SCHEMA = "term string, entry_id bigint, tf bigint, dl bigint, bucket int"


@dataclass(frozen=True)
class Bm25Index:
    postings: DataFrame
    docs: DataFrame
    stored_stats: DataFrame | None = None
    stored_terms: DataFrame | None = None
    term_parts: DataFrame | None = None   # (term, df, buckets), several rows a term that add up
    counts: DataFrame | None = None       # the postings before rows of one (term, entry) are added up

    @property
    def stats(self) -> DataFrame:
        return corpus_stats(self.docs) if self.stored_stats is None else self.stored_stats

    @property
    def term_stats(self) -> DataFrame:
        if self.term_parts is not None:
            return self.term_parts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return term_stats(self.postings) if self.stored_terms is None else self.stored_terms


def term_counts(entries: DataFrame, text_col: str = "line") -> DataFrame:
    """(term, entry_id, tf, dl) by row of ``entries``: a row's tokens are counted
    where they are, without a shuffle. Rows of one entry_id are not added up."""
    def fn(batches):
        for rows, lens, codes, distinct in token_slices(batches, "_toks"):
            width = max(1, len(distinct))
            key, tf = np.unique(np.repeat(np.arange(len(lens)) * width, lens) + codes, return_counts=True)
            row, code = key // width, key % width
            yield pa.RecordBatch.from_arrays(
                [distinct.take(pa.array(code)), rows.column(0).take(pa.array(row)), pa.array(tf.astype(np.int64)),
                 pa.array(lens[row])], names=["term", "entry_id", "tf", "dl"])

    id_type = entries.schema["entry_id"].dataType.simpleString()
    return entries.select("entry_id", token_text(text_col).alias("_toks")) \
        .mapInArrow(fn, f"term string, entry_id {id_type}, tf bigint, dl bigint")


def _added_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term", "entry_id", "dl").agg(F.sum("tf").alias("tf")).select("term", "entry_id", "tf", "dl")


def term_frequencies(entries: DataFrame, text_col: str = "line") -> DataFrame:
    """(term, entry_id, tf, dl)."""
    return _added_up(term_counts(entries, text_col))


def doc_stats(entries: DataFrame, text_col: str = "line") -> DataFrame:
    return entries.select("entry_id", "topic", F.size(tokenize(text_col)).cast("bigint").alias("dl"),
                          F.col(text_col).alias("line"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row. Entries with no tokens still count in N; avg_dl is 0.0 on
    an empty corpus."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total_tokens"),
    ).select(
        "n_docs", "total_tokens",
        F.when(F.col("n_docs") > 0, F.col("total_tokens") / F.col("n_docs"))
        .otherwise(F.lit(0.0)).alias("avg_dl"),
    )


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def build_index(entries: DataFrame, text_col: str = "line") -> Bm25Index:
    """Lazy index over an entry snapshot (nothing is computed yet)."""
    counts = term_counts(entries, text_col)
    return Bm25Index(_added_up(counts), doc_stats(entries, text_col), counts=counts)


def write_index(index: Bm25Index, path: str) -> Bm25Index:
    """Persist the index as Parquet and return it read back.

    The counted postings are written once before they are range-partitioned,
    because choosing the ranges samples its input and would otherwise run the
    tokenizer twice; that table is deleted once the clustered one is written.
    Where an entry_id occurs twice, counts of a fresh index are added up after
    that one shuffle, whose ranges keep the rows of a (term, entry) together; where
    every id is one row's there is nothing to add up."""
    spark = index.postings.sparkSession
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    counted = fresh_path(spark, "postings")
    fresh = index.counts is not None
    (index.counts if fresh else index.postings).select("term", "entry_id", "tf", "dl").write.parquet(counted)
    counts = spark.read.parquet(counted)
    n = -(-counts.count() // BUCKET_ROWS)   # from the files' footers
    few = n <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange("term", "entry_id") if few else counts.repartitionByRange(n, "term", "entry_id")
    repeated = fresh and not _ids_unique(spark.read.parquet(f"{path}/docs"))
    ((_added_up(ranged) if repeated else ranged)
     .withColumn("bucket", F.spark_partition_id()).sortWithinPartitions("term", "entry_id")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings"))
    discard(spark, counted)
    written = read_index(spark, path, stored=False)
    corpus_stats(written.docs).write.mode("overwrite").parquet(f"{path}/stats")
    (written.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("bucket").alias("first_bucket"),
                                          F.max("bucket").alias("last_bucket"))
     .write.mode("overwrite").parquet(f"{path}/term_stats"))
    return read_index(spark, path)


def _ids_unique(docs: DataFrame) -> bool:
    return docs.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def read_index(spark, path: str, stored: bool = True) -> Bm25Index:
    postings = spark.read.schema(POSTINGS_SCHEMA).parquet(f"{path}/postings")
    docs = spark.read.parquet(f"{path}/docs")
    if not stored:
        return Bm25Index(postings, docs)
    return Bm25Index(postings, docs, spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/term_stats"))


def refresh_index(index: Bm25Index, removed_ids: DataFrame, added_entries: DataFrame,
                  text_col: str = "line") -> Bm25Index:
    """Refresh of an index that is not written: drop postings/docs of changed
    or removed entries (anti-join on entry_id) and add those of new entries;
    statistics are derived from the result. A written index is refreshed by
    adding a segment (:mod:`quire.operators.segments`). An entry whose line
    changed is passed both as removed (old id) and added (new line)."""
    gone = removed_ids.select("entry_id").union(added_entries.select("entry_id")).distinct()
    kept_post = index.postings.join(gone, "entry_id", "left_anti")
    kept_docs = index.docs.join(gone, "entry_id", "left_anti")
    new = build_index(added_entries, text_col)
    return Bm25Index(
        kept_post.select("term", "entry_id", "tf", "dl").unionByName(new.postings),
        kept_docs.select("entry_id", "topic", "dl", "line").unionByName(new.docs),
    )
