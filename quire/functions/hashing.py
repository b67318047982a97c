"""Hashed bag-of-words embedding: the self-contained default embedder.

Each token is hashed over its UTF-8 bytes with an FNV-style fold and the
vector counts tokens per bin. The reference folds in wrapping 64-bit
arithmetic and keeps ``h mod dim``; for a power-of-two ``dim`` only the low
bits matter, and the low bits of a product depend only on the low bits of
its factors, so folding modulo ``dim`` gives the same bin without 64-bit
overflow (ANSI mode raises on overflow).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
HASH_OFFSET = 1469598103934665603
HASH_PRIME = 1099511628211
DEFAULT_DIM = 64
# ---------------------------------------------------------------------------


def check_dim(dim: int) -> int:
    if dim <= 0 or dim & (dim - 1) or dim > (1 << 31):
        raise ValueError(f"dim must be a power of two <= 2^31, got {dim}")
    return dim


def hash_params(dim: int = DEFAULT_DIM) -> tuple[int, int]:
    """(seed, multiplier) reduced modulo ``dim``."""
    check_dim(dim)
    return HASH_OFFSET % dim, HASH_PRIME % dim


def token_bin(token: Column | str, dim: int = DEFAULT_DIM) -> Column:
    """Bin (0..dim-1) of one token; BIGINT."""
    seed, mult = hash_params(dim)
    tok = F.col(token) if isinstance(token, str) else token
    hx = F.hex(tok)  # hex of the UTF-8 bytes
    n_bytes = (F.length(hx) / 2).cast("int")

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(hx.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
        return (h.bitwiseXOR(byte) * F.lit(mult)) % F.lit(dim)

    return F.aggregate(F.sequence(F.lit(0), n_bytes - 1), F.lit(seed).cast("bigint"), step)
