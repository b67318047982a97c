"""Note tables and files: read, counts, forget, first-match edits, write
validation, scan and export (mirrors the reference's store tests)."""

import os

from pyspark.sql import functions as F

from helpers import entries_df
from quire.operators import notes
from quire.sources import notes_files


def test_read_topic_normalises_and_orders(spark):
    e = entries_df(spark, [(3, "my-topic", "- 2026-01-01: c"), (1, "my-topic", "- 2026-01-01: a"),
                           (2, "other", "- 2026-01-01: b")])
    got = [r.line for r in notes.read_topic(e, "My Topic").collect()]
    assert got == ["- 2026-01-01: a", "- 2026-01-01: c"]
    assert notes.read_topic(e, "missing").count() == 0


def test_topic_counts_keep_zero(spark):
    e = entries_df(spark, [(1, "b", "- 2026-01-01: x"), (2, "a", "- 2026-01-01: y"), (3, "a", "# a")])
    topics = spark.createDataFrame([("a",), ("b",), ("empty",)], "topic string")
    got = [(r.topic, r.n_entries) for r in notes.topic_counts(e, topics).collect()]
    assert got == [("a", 1), ("b", 1), ("empty", 0)]


def test_forget_case_insensitive_literal(spark):
    e = entries_df(spark, [(1, "prefs", "- 2026-01-01: Loves RUST"), (2, "prefs", "- 2026-01-01: likes go"),
                           (3, "other", "- 2026-01-01: loves rust"), (4, "prefs", "- 2026-01-01: a.b (x)")])
    kept, removed = notes.forget(e, "Prefs", "rust")
    assert sorted(r.entry_id for r in removed.collect()) == [1]
    assert sorted(r.entry_id for r in kept.collect()) == [2, 3, 4]
    _, rm2 = notes.forget(e, "prefs", "A.B (X")  # literal, not a pattern
    assert [r.entry_id for r in rm2.collect()] == [4]
    _, rm3 = notes.forget(e, "missing", "rust")
    assert rm3.count() == 0
    _, rm4 = notes.forget(e, "prefs", "")  # empty search matches every entry of the topic
    assert rm4.count() == 3


def test_replace_and_remove_first_only(spark):
    lines = spark.createDataFrame([("t", 0, "# t"), ("t", 1, "x"), ("t", 2, "y"), ("t", 3, "x"), ("u", 0, "x")],
                                  "topic string, seq bigint, line string")
    req = spark.createDataFrame([("t", "x", "X")], "topic string, old_line string, new_line string")
    rep = [(r.topic, r.seq, r.line) for r in notes.replace_first(lines, req).orderBy("topic", "seq").collect()]
    assert rep == [("t", 0, "# t"), ("t", 1, "X"), ("t", 2, "y"), ("t", 3, "x"), ("u", 0, "x")]
    rem = [(r.topic, r.seq) for r in notes.remove_first(lines, req).orderBy("topic", "seq").collect()]
    assert rem == [("t", 0), ("t", 2), ("t", 3), ("u", 0)]
    missing = spark.createDataFrame([("t", "zzz", "Z")], "topic string, old_line string, new_line string")
    assert notes.first_matches(lines, missing).count() == 0


def test_validate_writes(spark):
    raw = spark.createDataFrame([(1, "Prefs", "hello"), (2, "!!!", "x"), (3, "ok", " \t　 "), (4, "ok", "a\nb")],
                                "seq bigint, topic_raw string, body_raw string")
    got = {r.seq: (r.topic, r.accepted, r.reason, r.body) for r in notes.validate_writes(raw).collect()}
    assert got[1][:3] == ("prefs", True, None)
    assert got[2][1] is False and "topic" in got[2][2]
    assert got[3][1] is False and "entry" in got[3][2]
    assert got[4][3] == "a b"


def test_scan_files_layout(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "prefs.md"), "w") as f:
        f.write("# prefs\n\n- 2026-01-01: one\n- 2026-01-02: two\r\nnot an entry\n")
    with open(os.path.join(tmp_dir, "tech.md"), "w") as f:
        f.write("# tech\n\n- 2026-01-03: three\n")
    with open(os.path.join(tmp_dir, ".tombstones.md"), "w") as f:
        f.write("- 2026-01-01: hidden\n")
    with open(os.path.join(tmp_dir, "notes.txt"), "w") as f:
        f.write("- 2026-01-01: wrong extension\n")
    got = sorted((r.topic, r.line) for r in notes_files.scan_entries(spark, tmp_dir).collect())
    assert got == [("prefs", "- 2026-01-01: one"), ("prefs", "- 2026-01-02: two"), ("tech", "- 2026-01-03: three")]


def test_export_scan_roundtrip(spark, tmp_dir):
    e = entries_df(spark, [(i, "t" if i % 3 else "u", f"- 2026-01-01: line {i}") for i in range(50)])
    path = notes_files.export_notes(e, tmp_dir + "/out", n_parts=4)
    text = notes_files.read_notebooks(spark, path)
    for topic in ("t", "u"):
        files = sorted(f for f in os.listdir(f"{path}/topic={topic}") if f.startswith("part-"))
        content = []
        for fn in files:
            with open(f"{path}/topic={topic}/{fn}") as fh:
                content.extend(fh.read().splitlines())
        want = [f"# {topic}", ""] + [f"- 2026-01-01: line {i}" for i in range(50) if (i % 3 != 0) == (topic == "t")]
        assert content == want
    scanned = notes_files.scan_entries(spark, path, layout="partitioned")
    assert scanned.count() == 50 and text.count() == 54
    numbered = {(r.topic, r.line_no): r.value for r in text.collect()}
    assert all(numbered["t", i] == v for i, v in enumerate(want if topic == "t" else [])) and len(numbered) == 54
    assert numbered["u", 0] == "# u" and numbered["u", 2] == "- 2026-01-01: line 0"
