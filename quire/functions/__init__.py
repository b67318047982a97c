"""Column functions (all JVM-side expressions)."""

from quire.functions.dates import as_of_day, epoch_day
from quire.functions.hashing import DEFAULT_DIM, token_bin
from quire.functions.scoring import (
    BM25_B, BM25_K1, CANDIDATE_DEPTH, DEFAULT_LIMIT, REAFFIRM_THRESHOLD, RRF_K,
    SCORE_DIGITS, SUPERSEDE_THRESHOLD, bm25_weight, boost, cosine, idf, rounded, rrf,
)
from quire.functions.text import (
    contains_ci, flatten_newlines, is_entry_line, normalize_topic, parse_entry,
    render_entry, render_entry_str, tokenize, vector_key,
)

__all__ = [
    "as_of_day", "epoch_day", "DEFAULT_DIM", "token_bin",
    "BM25_B", "BM25_K1", "CANDIDATE_DEPTH", "DEFAULT_LIMIT", "REAFFIRM_THRESHOLD", "RRF_K",
    "SCORE_DIGITS", "SUPERSEDE_THRESHOLD", "bm25_weight", "boost", "cosine", "idf", "rounded", "rrf",
    "contains_ci", "flatten_newlines", "is_entry_line", "normalize_topic", "parse_entry",
    "render_entry", "render_entry_str", "tokenize", "vector_key",
]
