"""Hybrid search: reciprocal-rank fusion of the lexical and vector top lists,
times the recency x reinforcement boost (D8), with the lexical fallback
(D9) and an explicit ``mode``.

Fusion is a union of two small ranked lists (at most queries x 2 x
candidates rows) followed by a sum per (query, entry): no join between the
lists is needed, so a key present in only one list simply contributes one
term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scoring import CANDIDATE_DEPTH, DEFAULT_LIMIT, RRF_K, SCORE_DIGITS, boost, rrf
from quire.operators import lexical, similarity
from quire.operators.index import Bm25Index
from quire.operators.vectors import Embedder, embed_frame, live_vectors
from quire.session import cut_lineage

MODES = ("auto", "lexical", "vector", "hybrid")


def rrf_merge(lists: list[DataFrame], key: tuple[str, ...] = ("entry_id",),
              k: float = RRF_K) -> DataFrame:
    """Each list has (query_id, rank[1-based], *key). Returns
    (query_id, *key, rrf) with rrf = sum over lists of 1/(rank0 + k)."""
    terms = [df.select("query_id", *key, rrf(F.col("rank") - 1, k).alias("t")) for df in lists]
    u = terms[0]
    for t in terms[1:]:
        u = u.unionByName(t)
    return u.groupBy("query_id", *key).agg(F.sum("t").alias("rrf"))


def query_vectors(queries: DataFrame, embed: Embedder | None = None, text_col: str = "query",
                  dim: int = 64) -> DataFrame:
    return embed_frame(queries, text_col, ["query_id"], embed, dim)


def _check_limits(limit: int, candidates: int) -> None:
    for name, value in (("limit", limit), ("candidates", candidates)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise ValueError(f"{name} must be a non-negative integer")


def hybrid_search(index: Bm25Index, entries: DataFrame | None, vectors: DataFrame, queries: DataFrame,
                  as_of_epoch_day: int, limit: int = DEFAULT_LIMIT,
                  candidates: int = CANDIDATE_DEPTH, embed: Embedder | None = None,
                  dim: int = 64) -> DataFrame:
    """(query_id, rank, entry_id, topic, score): fused, boosted, top ``limit``."""
    _check_limits(limit, candidates)
    lex = lexical.bm25_candidates(index, queries, candidates, with_info=False)
    qstats: dict = {}
    vectors = live_vectors(vectors, index.docs)  # a vector whose entry is gone must not fill the candidate list
    vec = similarity.topk_cosine(vectors, query_vectors(queries, embed, dim=dim), candidates,
                                 keep=("topic",), stats=qstats)
    # The two candidate lists are small (queries x candidates rows each):
    # write them once, so fusion, boost and ranking are planned over two
    # small scans instead of re-analysing the whole search plan per step.
    lex = cut_lineage(lex.select("query_id", "rank", "entry_id"), "lexical-candidates")
    vec = cut_lineage(vec.select("query_id", "rank", "entry_id"), "vector-candidates")
    fused = rrf_merge([lex, vec])
    # The fused list holds at most queries x 2 x candidates rows: attach the
    # line (for the boost) by broadcasting it, never the entries table.
    bound = 2 * qstats["n_queries"] * candidates
    with_line = lexical.with_doc_info(fused, index.docs, entries, bound)
    scored = with_line.select("query_id", "entry_id", "topic",
                              (F.col("rrf") * boost("line", as_of_epoch_day)).alias("score"))
    return lexical.ranked(scored, "score", limit).select(
        "query_id", "rank", "entry_id", "topic", F.round("score", SCORE_DIGITS).alias("score"))


def search(index: Bm25Index, entries: DataFrame | None, queries: DataFrame, as_of_epoch_day: int,
           vectors: DataFrame | None = None, mode: str = "auto", limit: int = DEFAULT_LIMIT,
           candidates: int = CANDIDATE_DEPTH, embed: Embedder | None = None,
           dim: int = 64) -> DataFrame:
    """``auto`` = hybrid when a vector table is given, else lexical (the
    reference's fallback). Output adds ``mode``, the path that ran."""
    _check_limits(limit, candidates)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "auto":
        mode = "hybrid" if vectors is not None else "lexical"
    if mode in ("hybrid", "vector") and vectors is None:
        raise ValueError(f"mode '{mode}' needs a vector table")
    if mode == "lexical":
        out = lexical.bm25_boosted(index, entries, queries, as_of_epoch_day, limit, candidates)
    elif mode == "hybrid":
        out = hybrid_search(index, entries, vectors, queries, as_of_epoch_day, limit, candidates,
                            embed, dim)
    else:
        top = similarity.topk_cosine(live_vectors(vectors, index.docs), query_vectors(queries, embed, dim=dim),
                                     candidates)
        info = lexical.with_doc_info(top.drop("topic"), index.docs, entries,
                                     queries.count() * candidates)
        scored = info.select("query_id", "entry_id", "topic",
                             (F.col("sim") * boost("line", as_of_epoch_day)).alias("score"))
        out = lexical.ranked(scored, "score", limit).select(
            "query_id", "rank", "entry_id", "topic", F.round("score", SCORE_DIGITS).alias("score"))
    return out.withColumn("mode", F.lit(mode))
