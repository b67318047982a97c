"""Plain-Python models of the reference behaviour, for checking operators
whose results have no SQL oracle (ordered fold, streams, files)."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import regex

# fixed values of the reference helper embedder
OFFSET, PRIME, MASK = 1469598103934665603, 1099511628211, (1 << 64) - 1
SPLIT = regex.compile(r"[^\p{Alphabetic}\p{N}]+")


def tokenize(text: str) -> list[str]:
    return [t for t in SPLIT.split(text.lower()) if t]


def fnv_bin(tok: str, dim: int = 64) -> int:
    h = OFFSET
    for b in tok.encode():
        h = ((h ^ b) * PRIME) & MASK
    return h % dim


def embed(text: str, dim: int = 64) -> np.ndarray:
    v = np.zeros(dim)
    for t in tokenize(text):
        v[fnv_bin(t, dim)] += 1
    return v


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    na, nb = math.sqrt(float(a @ a)), math.sqrt(float(b @ b))
    if len(a) != len(b) or len(a) == 0 or na == 0 or nb == 0:
        return 0.0
    return float(a @ b) / (na * nb)


def parse_line(line: str):
    if not line.startswith("- "):
        return None
    rest = line[2:]
    if len(rest.encode()) < 12 or rest[10:12] != ": ":
        return None
    if not all(c.isdigit() and c.isascii() or c == "-" for c in rest[:10]):
        return None
    date, body = rest[:10], rest[12:]
    if body.endswith("]"):
        i = body.rfind(" [×")
        if i >= 0:
            cs = body[i + 3:-1]
            if cs.lstrip("+").isdigit() and cs.count("+") <= 1 and (cs[0] == "+" or cs.isdigit()):
                n = int(cs)
                if n <= 4294967295:
                    return date, body[:i], n
    return date, body, 1


def render(date: str, body: str, count: int) -> str:
    return f"- {date}: {body}" if count <= 1 else f"- {date}: {body} [×{count}]"


def fold(writes: list[dict], reaffirm: float = 0.95, supersede: float = 0.85,
         seed: dict[str, list[dict]] | None = None, dim: int = 64):
    """Direct quadratic fold, one write at a time, as the reference does.
    writes: dicts with seq, topic, body, written_on (date), force.
    Returns (outcomes by seq, topic -> live entries in file order)."""
    files: dict[str, list[dict]] = {k: [dict(e) for e in v] for k, v in (seed or {}).items()}
    out = {}
    for w in sorted(writes, key=lambda r: r["seq"]):
        f = files.setdefault(w["topic"], [])
        d = w["written_on"].isoformat()
        new_line = f"- {d}: {w['body']}"
        pd_ = parse_line(new_line)
        entry = {"seq": w["seq"], "body": pd_[1], "count": pd_[2], "date": d}
        if w.get("force"):
            f.append(entry)
            out[w["seq"]] = ("append", None, entry["count"])
            continue
        q = embed(w["body"], dim)
        best = None
        for pos, e in enumerate(f):
            s = cosine(q, embed(e["body"], dim))
            key = np.round(s, 12)
            if best is None or key > best[2]:
                best = (pos, s, key)
        if best is not None and best[1] >= reaffirm:
            e = f[best[0]]
            e["count"] += 1
            e["date"] = d
            out[w["seq"]] = ("reaffirm", e["seq"], e["count"])
        elif best is not None and best[1] >= supersede:
            old = f.pop(best[0])
            f.append(entry)
            out[w["seq"]] = ("supersede", old["seq"], entry["count"])
        else:
            f.append(entry)
            out[w["seq"]] = ("append", None, entry["count"])
    return out, files


def epoch_day(s: str):
    if len(s.encode()) != 10 or s[4] != "-" or s[7] != "-":
        return None
    y, m, d = s[0:4], s[5:7], s[8:10]
    try:
        yi = int(y)
        mi = int(m) if (m.isdigit() or (m[0] == "+" and m[1:].isdigit())) else None
        di = int(d) if (d.isdigit() or (d[0] == "+" and d[1:].isdigit())) else None
    except ValueError:
        return None
    if mi is None or di is None or not (1 <= mi <= 12) or not (1 <= di <= 31) or yi < 1970:
        return None
    return (dt.date(yi, mi, 1) - dt.date(1970, 1, 1)).days + di - 1
