"""Column functions against the values pinned by the reference's tests."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from model import fnv_bin, parse_line
from quire.functions import (
    as_of_day, boost, cosine, epoch_day, normalize_topic, parse_entry, render_entry_str, token_bin,
    tokenize,
)

TODAY = "2026-04-28"


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("raw,want", [
    ("Preferences", "preferences"), ("my topic", "my-topic"), ("-foo-", "foo"), ("foo!bar", "foo-bar"),
    ("My  Topic!", "my--topic"), ("Éa_b", "éa-b"), ("___", ""),
])
def test_normalize_topic(spark, raw, want):
    assert one(spark, normalize_topic, raw) == want


def test_tokenize(spark):
    got = one(spark, tokenize, "Hello, World! hello  2026-04-28 [×3] Ünïcode_x")
    assert got == ["hello", "world", "hello", "2026", "04", "28", "3", "ünïcode", "x"]
    assert one(spark, tokenize, "") == []
    assert one(spark, tokenize, "!!!") == []


@pytest.mark.parametrize("s,want", [
    ("1970-01-01", 0), ("1970-01-02", 1), ("1971-01-01", 365), ("2000-03-01", 11017),
    ("2026-02-31", (dt.date(2026, 3, 3) - dt.date(1970, 1, 1)).days),
    ("2024-+1-05", (dt.date(2024, 1, 5) - dt.date(1970, 1, 1)).days),
    ("2026-13-01", None), ("2026-01-32", None), ("1969-12-31", None), ("2026/01/01", None),
    ("", None), ("not a date", None), ("2026-00-10", None),
])
def test_epoch_day(spark, s, want):
    assert one(spark, epoch_day, s) == want


@pytest.mark.parametrize("line", [
    "- 2026-04-28: river stones", "- 2026-04-28: likes tea [×3]", "- 2026-04-28: lamp [×7]",
    "- 2026-04-28: a [×2] b [×x]", "- 2026-04-28: a [×2] [×03]", "- 2026-04-28:  [×4]",
    "- 2026-04-28: ", "- 2026-04-28: big [×99999999999]", "- 2026-04-28: plus [×+5]",
    "# header", "", "- some day: lost", "-2026-04-28: x", "- 2026-04-28 x",
])
def test_parse_entry_matches_model(spark, line):
    got = one(spark, parse_entry, line)
    want = parse_line(line)
    if want is None:
        assert got is None
    else:
        assert (got["date"], got["body"], got["count"]) == want


def test_render_and_roundtrip(spark):
    df = spark.createDataFrame([("2026-04-28", "lamp", 1), ("2026-04-28", "lamp", 5)], "d string, b string, c bigint")
    got = [r.l for r in df.select(render_entry_str("d", "b", "c").alias("l")).collect()]
    assert got == ["- 2026-04-28: lamp", "- 2026-04-28: lamp [×5]"]
    p = one(spark, parse_entry, "- 2026-04-28: lamp [×7]")
    back = spark.createDataFrame([(p["date"], p["body"], p["count"])], "d string, b string, c bigint") \
        .select(render_entry_str("d", "b", "c").alias("l")).first().l
    assert back == "- 2026-04-28: lamp [×7]"


def b(spark, line, today):
    return one(spark, lambda c: boost(c, as_of_day(today)), line)


def test_boost_golden(spark):
    assert b(spark, f"- {TODAY}: lamp", TODAY) == pytest.approx(1.0, abs=1e-9)
    assert b(spark, "- 2025-04-28: lamp", "2026-04-28") == pytest.approx(0.5, abs=1e-6)
    b1, b3, b10 = (b(spark, f"- {TODAY}: lamp" + s, TODAY) for s in ("", " [×3]", " [×10]"))
    assert b1 < b3 < b10
    assert b3 == pytest.approx(1 + 0.5 * math.log(3)) and b3 == pytest.approx(1.55, abs=0.01)
    assert b10 == pytest.approx(2.15, abs=0.01)
    two_years = b(spark, "- 2024-04-28: lamp", "2026-04-28")
    assert two_years == pytest.approx(0.25, abs=0.002)
    assert b(spark, "not an entry", "1970-01-01") == 1.0
    assert b(spark, "", "1970-01-01") == 1.0
    assert b(spark, "- 2088-07-09: later", "1970-01-01") == pytest.approx(1.0, abs=1e-9)
    # unparseable date: neutral, and the counter is ignored too
    assert b(spark, "- 2026-13-01: x [×9]", TODAY) == 1.0
    # counter 0 parses, and is clamped to 1
    assert b(spark, f"- {TODAY}: x [×0]", TODAY) == pytest.approx(1.0)


def test_token_bin_matches_64bit_hash(spark):
    toks = ["hello", "é", "rust", "a", "ünïcode", "2026", "日本語", "x" * 50]
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    for dim in (64, 1024, 1 << 20):
        got = [r.b for r in df.select(token_bin("t", dim).alias("b")).collect()]
        assert got == [fnv_bin(t, dim) for t in toks]


def test_cosine_edges(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [1.0]),
         ([], []), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [4.0, 3.0])],
        "a array<float>, b array<float>")
    got = [r.c for r in df.select(cosine("a", "b").alias("c")).collect()]
    assert got[:5] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert got[5] == pytest.approx(24 / 25)


@pytest.mark.parametrize("dim", [64, 4096])
def test_hash_tokens_of_mixed_lengths(spark, dim):
    """The vectorised hash equals the column expression, very long tokens included."""
    from quire.operators.vectors import hash_tokens
    toks = ["a", "é", "漢字", "b" * 3000, "c" * 40] + [f"t{i}" * (i % 5 + 1) for i in range(60)]
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    want = {r.t: r.b for r in df.select("t", token_bin("t", dim).alias("b")).collect()}
    assert hash_tokens(toks, dim).tolist() == [want[t] for t in toks]


def test_token_slices_keep_every_token(spark, monkeypatch):
    """Small slices of a batch, with null, empty and long texts, hold the same tokens as ``tokenize``."""
    import pyarrow as pa
    from quire.functions import text
    docs = [None, "", "--", "One two, TWO", "x" * 300] + [f"w{i} " * (i % 9) + "é漢" for i in range(200)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").coalesce(1)
    rows = df.select("i", text.tokenize("d").alias("t"), text.joined_tokens("d").alias("j")).orderBy("i").collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r.i for r in rows]), pa.array([r.j for r in rows])], names=["i", "j"])
    for size, most in ((64, 1 << 30), (1 << 20, 7), (1 << 20, 1 << 30)):
        monkeypatch.setattr(text, "TOKEN_BYTES", size)
        got, slices = [], 0
        for part, lens, codes, distinct in text.token_slices([batch], "j", most):
            words = [distinct[int(c)].as_py() for c in codes]
            ends = lens.cumsum()
            got += [words[e - n:e] for e, n in zip(ends, lens)]
            slices += 1
            assert part.num_rows == len(lens) <= most
        assert got == [r.t or [] for r in rows] and (slices > 1) == (size == 64 or most == 7)
