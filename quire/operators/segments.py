"""The BM25 index as immutable segments (R8, D11).

A segment is a written index (:func:`quire.operators.index.write_index`). A
refresh writes one more segment with the added entries and a table of the
entries that are gone, with what they take from the statistics; nothing that
exists is read in full, sorted or written again. A version folder names its
segments and removals; a new version appears when its manifest is written, so a
refresh that fails leaves the old one as it was. ``merge`` rewrites a version
as one segment.

Searches read a version as a :class:`~quire.operators.index.Bm25Index`: postings
of all segments without removed entries, document frequencies as sums of the
segments' less the removed, for the terms of the queries only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import index as ix
from quire.operators.sizing import bounded_broadcast
from quire.session import cut_lineage, fresh_path

STRIDE = 1 << 20        # bucket numbers of one segment
MAX_SEGMENTS = 16       # a refresh beyond merges first

_REMOVED = "segment int, entry_id bigint, dl bigint"
_REMOVED_TERMS = "term string, df bigint"
_MANIFEST = "segment int, path string, removed string, removed_terms string"


def create(spark: SparkSession, base_path: str, root: str | None = None) -> str:
    """A version with one segment, the written index at ``base_path``; returns
    the version's folder."""
    return _commit(spark, [(0, base_path, None, None)], root)


def _commit(spark: SparkSession, rows: list[tuple], root: str | None = None) -> str:
    version = root or fresh_path(spark, "index-version")
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{version}/manifest")
    return version


def _manifest(spark: SparkSession, version: str) -> list[tuple]:
    """At most ``MAX_SEGMENTS`` + 1 rows."""
    return sorted(tuple(r) for r in spark.read.schema(_MANIFEST).parquet(f"{version}/manifest").collect())


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _removed(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return _union([spark.read.schema(_REMOVED).parquet(r[2]) for r in rows if r[2]], spark, _REMOVED)


def _docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Live documents with their segment."""
    docs = _union([ix.read_index(spark, r[1]).docs.withColumn("segment", F.lit(r[0])) for r in rows], spark,
                  "entry_id bigint, topic string, dl bigint, line string, segment int")
    if not any(r[2] for r in rows):
        return docs
    gone = bounded_broadcast(_removed(spark, rows).select("segment", "entry_id"))
    return docs.join(gone, ["segment", "entry_id"], "left_anti")


def read(spark: SparkSession, version: str) -> ix.Bm25Index:
    """The version as one index."""
    rows = _manifest(spark, version)
    segments = [(r[0], ix.read_index(spark, r[1])) for r in rows]
    postings = _union([s.postings.withColumn("segment", F.lit(k))
                       .withColumn("bucket", F.col("bucket") + F.lit(k * STRIDE)) for k, s in segments], spark, "")
    removed = _removed(spark, rows)
    if any(r[2] for r in rows):
        postings = postings.join(bounded_broadcast(removed.select("segment", "entry_id")), ["segment", "entry_id"], "left_anti")
    parts = [s.stored_terms.select("term", "df", F.sequence(F.col("first_bucket") + k * STRIDE,
                                                            F.col("last_bucket") + k * STRIDE).alias("buckets"))
             for k, s in segments]
    parts += [spark.read.schema(_REMOVED_TERMS).parquet(r[3]).select(
        "term", (-F.col("df")).alias("df"), F.array().cast("array<int>").alias("buckets")) for r in rows if r[3]]
    totals = _union([s.stored_stats.select("n_docs", "total_tokens") for _, s in segments], spark, "") \
        .unionByName(removed.select(F.lit(-1).cast("bigint").alias("n_docs"), (-F.col("dl")).alias("total_tokens"))) \
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("total_tokens").alias("total_tokens"))
    stats = cut_lineage(totals.select("n_docs", "total_tokens", F.when(
        F.col("n_docs") > 0, F.col("total_tokens") / F.col("n_docs")).otherwise(F.lit(0.0)).alias("avg_dl")), "stats")
    return ix.Bm25Index(postings.drop("segment"), _docs(spark, rows).drop("segment"), stats,
                        term_parts=_union(parts, spark, ""))


def refresh(spark: SparkSession, version: str, removed_ids: DataFrame, added: DataFrame,
            text_col: str = "line") -> str:
    """A new version without ``removed_ids`` (entry_id) and with the ``added``
    entries, which replace entries of the same id; returns its folder. The work
    is that of the changes, and one pass over the documents' ids to find them."""
    rows = _manifest(spark, version)
    if len(rows) >= MAX_SEGMENTS:
        version = merge(spark, version)
        rows = _manifest(spark, version)
    added = cut_lineage(added, "added-entries")
    gone = cut_lineage(removed_ids.select("entry_id").unionByName(added.select("entry_id")).distinct(), "removed-ids")
    found = cut_lineage(_docs(spark, rows).join(bounded_broadcast(gone), "entry_id", "left_semi"), "removed-docs")
    n = rows[-1][0] + 1
    folder = fresh_path(spark, "segment")
    found.select("segment", "entry_id", "dl").write.parquet(f"{folder}/removed")
    ix.term_stats(ix.term_frequencies(found, "line")).write.parquet(f"{folder}/removed_terms")
    ix.write_index(ix.build_index(added, text_col), f"{folder}/index")
    return _commit(spark, [*rows, (n, f"{folder}/index", f"{folder}/removed", f"{folder}/removed_terms")])


def merge(spark: SparkSession, version: str) -> str:
    """The version rewritten as one segment."""
    path = fresh_path(spark, "bm25-index")
    ix.write_index(read(spark, version), path)
    return create(spark, path)
