"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (or tables Spark derives from them)
in full. Column names match the DuckDB oracle in ``quire.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.dates import epoch_day
from quire.functions.scoring import SCORE_DIGITS, boost, idf
from quire.functions.text import normalize_topic, parse_entry, render_entry, tokenize
from quire.functions.scoring import cosine
from quire.operators import consolidate, edits, notes, search, segments, similarity, similarity_join, vectors, write_through
from quire.operators.sizing import bounded_broadcast
from quire.sources import notes_files, tables
from quire.streaming import writes as streams

from quire.functions.dates import as_of_day
from quire.operators import index as ix
from quire.operators import lexical
from quire.session import cut_lineage, fresh_path
from quire.sources import fixtures as fx

QueryFn = Callable[[SparkSession, str], DataFrame]
AS_OF_DAY = as_of_day(fx.AS_OF)


# Written index per (application, input dir): queries search a persisted
# index, as the reference searches its cached one; inputs are read-only.
_INDEX_PATHS: dict[tuple[str, str, str], str] = {}


def persisted_index(spark: SparkSession, sf_dir: str, text_col: str = "line") -> ix.Bm25Index:
    key = (spark.sparkContext.applicationId, sf_dir, text_col)
    path = _INDEX_PATHS.get(key)
    if path is None:
        path = fresh_path(spark, "bm25-index")
        ix.write_index(ix.build_index(fx.entries(spark, sf_dir), text_col), path)
        _INDEX_PATHS[key] = path
    return ix.read_index(spark, path)


def index_version(spark: SparkSession, sf_dir: str) -> str:
    """The persisted index as a version of one segment."""
    persisted_index(spark, sf_dir)
    return segments.create(spark, _INDEX_PATHS[spark.sparkContext.applicationId, sf_dir, "line"])


_VECTOR_PATHS: dict[tuple[str, str], str] = {}


def persisted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector table of the entries (hashed line vectors), written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _VECTOR_PATHS.get(key)
    if path is None:
        path = fresh_path(spark, "vectors")
        tables.write_table(vectors.embed_entries(fx.entries(spark, sf_dir)), path)
        _VECTOR_PATHS[key] = path
    return tables.read_table(spark, path)


def q_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = persisted_index(spark, sf_dir)
    return lexical.bm25_topk(index, fx.search_queries(spark, sf_dir)).drop("line")


def q_bm25_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = persisted_index(spark, sf_dir)
    return lexical.bm25_boosted(index, None, fx.search_queries(spark, sf_dir), AS_OF_DAY)


# --- query parameters (a user's arguments) ----------------------------------
READ_TOPIC = "En"          # normalised to 'en'
FORGET_TOPIC = "EN"
FORGET_SEARCH = "2024-03-"  # literal, case-insensitive, over the whole line
# ---------------------------------------------------------------------------


def q_normalize_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.table(spark, sf_dir, "events")
    return ev.select("event_id", normalize_topic("event_type").alias("topic"),
                     normalize_topic("props").alias("props_topic"))


def q_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.spread(fx.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(tokenize("text")).alias("pos", "token")) \
        .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


def q_parse_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse_entry("line")
    return fx.entries(spark, sf_dir).select(
        "entry_id", p["date"].alias("parsed_date"), p["body"].alias("parsed_body"),
        p["count"].alias("parsed_count"))


def q_render_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.entries(spark, sf_dir).select(
        "entry_id", render_entry("entry_date", "body", "reinforce_count").alias("line"))


def q_entry_epoch_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return ev.select("event_id", day.alias("day_str"), epoch_day(day).alias("epoch_day"))


def q_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.entries(spark, sf_dir).select(
        "entry_id", F.round(boost("line", AS_OF_DAY), SCORE_DIGITS).alias("boost"))


def q_term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persisted_index(spark, sf_dir).postings.select("term", "entry_id", "tf")


def q_term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = persisted_index(spark, sf_dir)
    n_docs = index.stats.select("n_docs").scalar()
    return index.term_stats.select(
        "term", "df", F.round(idf(n_docs, "df"), SCORE_DIGITS).alias("idf"))


def q_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persisted_index(spark, sf_dir).stats.select(
        "n_docs", "total_tokens", F.round("avg_dl", SCORE_DIGITS).alias("avg_dl"))


def q_build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = ix.write_index(ix.build_index(fx.entries(spark, sf_dir)), fresh_path(spark, "bm25-index"))
    return built.postings.select("term", "entry_id", "tf")


def accepted_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = notes.validate_writes(fx.new_writes(spark, sf_dir))
    return notes.writes_to_entries(v.where("accepted"))


def q_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents = fx.entries(spark, sf_dir)
    _, removed = notes.forget(ents, FORGET_TOPIC, FORGET_SEARCH)
    version = segments.refresh(spark, index_version(spark, sf_dir), removed.select("entry_id"),
                               accepted_new_entries(spark, sf_dir))
    return segments.read(spark, version).postings.select("term", "entry_id", "tf")


def q_refreshed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over a refreshed index: its statistics are those of a rebuild."""
    _, removed = notes.forget(fx.entries(spark, sf_dir), FORGET_TOPIC, FORGET_SEARCH)
    version = segments.refresh(spark, index_version(spark, sf_dir), removed.select("entry_id"),
                               accepted_new_entries(spark, sf_dir))
    top = lexical.bm25_topk(segments.read(spark, version), fx.search_queries(spark, sf_dir))
    return top.drop("line")


def q_read_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.read_topic(fx.entries(spark, sf_dir), READ_TOPIC).select("entry_id", "seq", "line")


def q_topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.topic_counts(fx.entries(spark, sf_dir))


def q_forget_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, removed = notes.forget(fx.entries(spark, sf_dir), FORGET_TOPIC, FORGET_SEARCH)
    return removed.select("entry_id", "topic", "line")


def q_forget_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = notes.forget(fx.entries(spark, sf_dir), FORGET_TOPIC, FORGET_SEARCH)
    return kept.select("entry_id", "topic")


def q_validate_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.validate_writes(fx.new_writes(spark, sf_dir)).select(
        "seq", "topic", "accepted", "reason")


ENTRY_COLS = ["entry_id", "topic", "entry_date", "body", "reinforce_count", "line", "seq"]


def q_append_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "entries")
    tables.write_table(fx.entries(spark, sf_dir).select(*ENTRY_COLS), path, ("topic",))
    tables.append_table(accepted_new_entries(spark, sf_dir).select(*ENTRY_COLS), path, ("topic",))
    return tables.read_table(spark, path).select("entry_id", "topic", "line", "seq")


def q_reaffirm_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.reaffirm_rollup(fx.entries(spark, sf_dir)).select(
        "topic", "seq", "entry_date", "reinforce_count", "n_merged", "line")


def duplicate_line_requests(lines: DataFrame) -> DataFrame:
    """Every line that occurs more than once in its topic, with its first
    copy to be rewritten as ``line [×n]``."""
    return lines.groupBy("topic", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2") \
        .select("topic", F.col("line").alias("old_line"),
                F.concat("line", F.lit(" [×"), F.col("n").cast("string"), F.lit("]")).alias("new_line"))


def q_replace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.note_lines(spark, sf_dir)
    return notes.replace_first(lines, duplicate_line_requests(lines)).select("topic", "seq", "line")


def q_remove_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.note_lines(spark, sf_dir)
    return notes.remove_first(lines, duplicate_line_requests(lines)).select("topic", "seq", "line")


def edit_requests(lines: DataFrame) -> DataFrame:
    """For every line that occurs n > 1 times in its topic: n requests that mark
    the copies ``[a]``, then one that turns the first of them to ``[b]``, then
    one that removes the next, then one that finds nothing."""
    many = lines.groupBy("topic", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    a, b = F.concat("line", F.lit(" [a]")), F.concat("line", F.lit(" [b]"))
    marks = many.select("topic", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("req_seq"),
                        F.col("line").alias("old_line"), a.alias("new_line"))
    none = F.lit(None).cast("string")
    return marks.unionByName(many.select("topic", (F.col("n") + 1).alias("req_seq"), a.alias("old_line"), b.alias("new_line"))) \
        .unionByName(many.select("topic", (F.col("n") + 2).alias("req_seq"), a.alias("old_line"), none.alias("new_line"))) \
        .unionByName(many.select("topic", (F.col("n") + 3).alias("req_seq"), F.col("line").alias("old_line"), b.alias("new_line")))


def q_edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and chained line edits, replayed in order."""
    lines = fx.note_lines(spark, sf_dir)
    after, _ = edits.replay_edits(lines, edit_requests(lines))
    return after.select("topic", "seq", "line")


def q_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.hash_embed_sparse(fx.entries(spark, sf_dir), "line")


def q_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    qv = search.query_vectors(fx.search_queries(spark, sf_dir))
    top = similarity.topk_cosine(persisted_vectors(spark, sf_dir), qv)
    return top.select("query_id", "rank", "entry_id", "topic",
                      F.round("sim", SCORE_DIGITS).alias("sim"))


def q_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding against the centroid of its label (F7 over whole table)."""
    emb = fx.table(spark, sf_dir, "embeddings")
    cells = emb.select("label", F.posexplode("embedding").alias("i", "x")) \
        .groupBy("label", "i").agg(F.avg("x").alias("m"))
    cent = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")) \
        .select("label", F.transform("c", lambda s: s["m"]).alias("centroid"))
    return emb.join(bounded_broadcast(cent), "label").select(
        "vec_id", "label", F.round(cosine("embedding", "centroid"), SCORE_DIGITS).alias("cos"))


def q_rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = persisted_index(spark, sf_dir)
    queries = fx.search_queries(spark, sf_dir)
    lex = lexical.bm25_candidates(index, queries, with_info=False)
    vec = similarity.topk_cosine(persisted_vectors(spark, sf_dir), search.query_vectors(queries))
    fused = search.rrf_merge([lex.select("query_id", "rank", "entry_id"),
                              vec.select("query_id", "rank", "entry_id")])
    return fused.select("query_id", "entry_id", F.round("rrf", SCORE_DIGITS).alias("rrf"))


def q_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = persisted_index(spark, sf_dir)
    return search.hybrid_search(index, None, persisted_vectors(spark, sf_dir),
                                fx.search_queries(spark, sf_dir), AS_OF_DAY)


def q_search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``auto`` mode with no vector table: the lexical path runs."""
    index = persisted_index(spark, sf_dir)
    return search.search(index, None, fx.search_queries(spark, sf_dir), AS_OF_DAY,
                         vectors=None, mode="auto")


def _vec_out(v: DataFrame, with_line: bool = False) -> DataFrame:
    cols = ["entry_id", "topic"] + (["line"] if with_line else [])
    return v.select(*cols, F.round(vectors.vector_signature("embedding"), SCORE_DIGITS).alias("vec_sig"))


def q_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = persisted_vectors(spark, sf_dir)
    rolled = notes.reaffirm_rollup(fx.entries(spark, sf_dir)).where("n_merged >= 2") \
        .select(F.col("seq").alias("entry_id"), "topic", "line")
    changes = rolled.unionByName(accepted_new_entries(spark, sf_dir).select("entry_id", "topic", "line"))
    out_path = fresh_path(spark, "vectors")
    tables.write_table(vectors.upsert(base, vectors.embed_entries(changes)), out_path)
    return _vec_out(tables.read_table(spark, out_path), with_line=True)


def q_vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, removed = notes.forget(fx.entries(spark, sf_dir), FORGET_TOPIC, FORGET_SEARCH)
    out_path = fresh_path(spark, "vectors")
    tables.write_table(vectors.delete(persisted_vectors(spark, sf_dir), removed), out_path)
    return _vec_out(tables.read_table(spark, out_path))


def q_embed_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_entries = fx.entries(spark, sf_dir).select(*ENTRY_COLS).unionByName(
        accepted_new_entries(spark, sf_dir).select(*ENTRY_COLS))
    out_path = fresh_path(spark, "vectors")
    tables.write_table(vectors.backfill(all_entries, persisted_vectors(spark, sf_dir)), out_path)
    return _vec_out(tables.read_table(spark, out_path))


def q_forget_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forget end to end: entries snapshot, index refresh and vector delete,
    summarised per topic."""
    ents = fx.entries(spark, sf_dir)
    kept, removed = notes.forget(ents, FORGET_TOPIC, FORGET_SEARCH)
    removed = cut_lineage(removed.select("entry_id", "topic"), "removed")  # read by each of the steps below
    kept_path = tables.write_table(kept.select(*ENTRY_COLS), fresh_path(spark, "entries"), ("topic",))
    index = segments.read(spark, segments.refresh(spark, index_version(spark, sf_dir), removed, kept.limit(0)))
    vec_path = tables.write_table(vectors.delete(persisted_vectors(spark, sf_dir), removed),
                                  fresh_path(spark, "vectors"))
    n_ent = tables.read_table(spark, kept_path).groupBy("topic").agg(F.count(F.lit(1)).alias("n_entries"))
    n_idx = index.docs.groupBy("topic").agg(F.count(F.lit(1)).alias("n_indexed"))
    n_vec = tables.read_table(spark, vec_path).groupBy("topic").agg(F.count(F.lit(1)).alias("n_vectors"))
    n_rm = removed.groupBy("topic").agg(F.count(F.lit(1)).alias("n_removed"))
    return n_ent.join(n_idx, "topic", "full").join(n_vec, "topic", "full").join(n_rm, "topic", "left") \
        .select("topic", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                           for c in ("n_entries", "n_indexed", "n_vectors", "n_removed")])


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.writes_from_entries(fx.entries(spark, sf_dir))


def q_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    bm = consolidate.best_match(_writes(spark, sf_dir))
    return bm.select("entry_id", "match_id", F.round("sim", SCORE_DIGITS).alias("sim"))


def q_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate join: every pair of entries of a topic at or above
    the supersede threshold, with its similarity."""
    w = consolidate.prepare_writes(_writes(spark, sf_dir))
    q = cut_lineage(vectors.embed_frame(w, "body", ["topic", "seq", "entry_id"]), "vectors")
    pairs = similarity_join.row_pairs(q, consolidate.SUPERSEDE_THRESHOLD)
    return pairs.select("topic", F.col("id_a").alias("entry_a"), F.col("id_b").alias("entry_b"),
                        F.round("sim", SCORE_DIGITS).alias("sim"))


def q_consolidate_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = consolidate.classify(_writes(spark, sf_dir))
    return c.select("entry_id", "topic", "outcome", "match_id",
                    F.round("sim", SCORE_DIGITS).alias("sim"), "new_count")


def q_classify_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the writes judged against the first half of the
    entries as stored."""
    entries = cut_lineage(fx.entries(spark, sf_dir), "entries")
    cut = entries.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).first()[0]
    later = fx.writes_from_entries(entries.where(F.col("seq") > cut))
    c = consolidate.classify(later, live=entries.where(F.col("seq") <= cut))
    return c.select("entry_id", "topic", "outcome", "match_id", F.round("sim", SCORE_DIGITS).alias("sim"), "new_count")


def q_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _writes(spark, sf_dir)
    t = consolidate.classify_tombstones(w, consolidate.classify(w))
    return t.select("logged_on", "topic", "kind", "old_line", "new_line")


def q_consolidate_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered consolidation of every entry replayed as a write."""
    res = consolidate.fold(_writes(spark, sf_dir))
    return res.outcomes.select("seq", "entry_id", "topic", "outcome", "match_seq", "new_count")


def q_write_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second half of the writes changes in the entries that the
    first half left live."""
    w = cut_lineage(_writes(spark, sf_dir), "writes")
    cut = w.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).first()[0]
    before = consolidate.fold(w.where(F.col("seq") <= cut)).live
    after = consolidate.fold(w.where(F.col("seq") > cut), seed=before)
    return write_through.changes(before, after).select("entry_id", "topic", "change", "reinforce_count")


def q_export_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = notes_files.export_notes(fx.entries(spark, sf_dir), fresh_path(spark, "notes"))
    return notes_files.read_notebooks(spark, path)


def q_scan_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported notebooks scanned back, entry lines only."""
    path = notes_files.export_notes(fx.entries(spark, sf_dir), fresh_path(spark, "notes"))
    return notes_files.scan_entries(spark, path, layout="partitioned").select("topic", "line")


# The feed arrives in this many deliveries, in ``seq`` order.
DELIVERIES = 4


def deliver(spark: SparkSession, raw: DataFrame, run: Callable[[DataFrame], None],
            deliveries: int = DELIVERIES) -> None:
    """Land the write requests in a folder delivery by delivery (each written
    by all its tasks) and let the stream catch up after each one. The stream's
    checkpoint carries on, so every delivery is the next micro-batch."""
    path = fresh_path(spark, "feed")
    bounds = raw.approxQuantile("seq", [i / deliveries for i in range(1, deliveries)], 0.0001)
    edges = [None] + sorted(set(bounds)) + [None]
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = raw
        if lo is not None:
            part = part.where(F.col("seq") > lo)
        if hi is not None:
            part = part.where(F.col("seq") <= hi)
        part.select(*[c.split()[0] for c in streams.WRITE_SCHEMA.split(", ")]).write.mode("append").parquet(path)
        run(streams.read_write_stream(spark, path))


def _entry_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.entries(spark, sf_dir).select(
        "seq", "entry_id", F.col("topic").alias("topic_raw"), F.col("body").alias("body_raw"),
        F.col("entry_date").alias("written_on"), F.lit(False).alias("force"))


def q_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, ck = fresh_path(spark, "stream-entries"), fresh_path(spark, "stream-ckpt")
    deliver(spark, fx.new_writes(spark, sf_dir), lambda feed: streams.stream_append(feed, out, ck))
    return tables.read_table(spark, out).select("entry_id", "topic", "line", "seq")


def q_stream_topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, ck = fresh_path(spark, "stream-counts"), fresh_path(spark, "stream-ckpt")
    deliver(spark, fx.new_writes(spark, sf_dir), lambda feed: streams.stream_topic_counts(feed, out, ck))
    last = streams.latest_batch(spark, out)
    return tables.read_table(spark, f"{out}/batch={last}").select("topic", "n_entries")


def q_stream_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, ck = fresh_path(spark, "stream-fold"), fresh_path(spark, "stream-ckpt")
    deliver(spark, _entry_feed(spark, sf_dir), lambda feed: streams.stream_consolidate(feed, root, ck))
    return tables.read_table(spark, f"{root}/outcomes").select(
        "seq", "entry_id", "topic", "outcome", "match_seq", "new_count")


QUERIES: dict[str, QueryFn] = {
    "export_notes": q_export_notes,
    "scan_entries": q_scan_entries,
    "stream_append": q_stream_append,
    "stream_topic_counts": q_stream_topic_counts,
    "stream_consolidate": q_stream_consolidate,
    "best_match": q_best_match,
    "near_pairs": q_near_pairs,
    "consolidate_classify": q_consolidate_classify,
    "classify_live": q_classify_live,
    "tombstones": q_tombstones,
    "consolidate_fold": q_consolidate_fold,
    "write_changes": q_write_changes,
    "hash_embed": q_hash_embed,
    "cosine_topk": q_cosine_topk,
    "cosine_pairs": q_cosine_pairs,
    "rrf_merge": q_rrf_merge,
    "hybrid_search": q_hybrid_search,
    "search_fallback": q_search_fallback,
    "vector_upsert": q_vector_upsert,
    "vector_delete": q_vector_delete,
    "embed_backfill": q_embed_backfill,
    "forget_vectors": q_forget_vectors,
    "normalize_topic": q_normalize_topic,
    "tokenize": q_tokenize,
    "parse_entry": q_parse_entry,
    "render_entry": q_render_entry,
    "entry_epoch_day": q_entry_epoch_day,
    "boost": q_boost,
    "term_frequencies": q_term_frequencies,
    "term_idf": q_term_idf,
    "corpus_stats": q_corpus_stats,
    "build_index": q_build_index,
    "refresh_index": q_refresh_index,
    "refreshed_search": q_refreshed_search,
    "read_topic": q_read_topic,
    "topic_counts": q_topic_counts,
    "forget_removed": q_forget_removed,
    "forget_kept": q_forget_kept,
    "validate_writes": q_validate_writes,
    "append_entries": q_append_entries,
    "reaffirm_rollup": q_reaffirm_rollup,
    "replace_first": q_replace_first,
    "remove_first": q_remove_first,
    "edit_log": q_edit_log,
    "bm25_topk": q_bm25_topk,
    "bm25_boosted": q_bm25_boosted,
}
FLAGSHIP = "hybrid_search"
