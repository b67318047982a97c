"""Note-table operators: read a topic, topic counts, forget, first-match
line edits, write validation, append, exact-duplicate roll-up.

Entries live in one table ``(entry_id, topic, entry_date, body,
reinforce_count, line, seq)``; ``seq`` is arrival order and replaces the
position of a line in a topic file. Edits return a new snapshot; callers
write it to a fresh path (see ``quire.sources.tables``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.edits import replay_edits
from quire.functions.text import (
    contains_ci, flatten_newlines, is_entry_line, normalize_topic, render_entry,
)

# --- fixed values (must equal the reference's behaviour) -------------------
# Unicode White_Space, the set a blank-entry check trims.
WHITE_SPACE = (r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# ---------------------------------------------------------------------------


REASON_EMPTY_TOPIC = "blank_topic"
REASON_EMPTY_ENTRY = "blank_entry"


def topic_literal(name: str) -> Column:
    """A user-typed topic name normalised by the same column function
    (Catalyst folds it to a literal, so the filter still pushes down)."""
    return normalize_topic(F.lit(name))


def read_topic(entries: DataFrame, topic: str) -> DataFrame:
    """Entries of one topic in arrival order. Empty result = topic not
    found. With a topic-partitioned table this is a partition-pruned scan."""
    return entries.where(F.col("topic") == topic_literal(topic)) \
        .where(is_entry_line("line")).orderBy("seq")


def topic_counts(entries: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(topic, n_entries) sorted by topic. Lines that are not entries count 0;
    topics in ``topics`` that have no entries are kept with 0."""
    counts = entries.groupBy("topic").agg(
        F.count_if(is_entry_line("line")).cast("bigint").alias("n_entries"))
    if topics is not None:
        counts = topics.select("topic").distinct().join(counts, "topic", "left") \
            .select("topic", F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"))
    return counts.orderBy("topic")


def forget_mask(topic: str, search: str) -> Column:
    """Lines of ``topic`` that are entries and contain ``search`` (case
    folded, literal substring over the whole line; empty search matches all)."""
    return ((F.col("topic") == topic_literal(topic)) & is_entry_line("line")
            & contains_ci("line", search))


def forget(entries: DataFrame, topic: str, search: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed). Both come from one predicate, so kept + removed is
    exactly the input. Writes no audit (as the reference)."""
    hit = F.coalesce(forget_mask(topic, search), F.lit(False))
    return entries.where(~hit), entries.where(hit)


def first_matches(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """(topic, seq) of the first line (lowest seq) of each topic equal to a
    requested ``old_line``.

    Uses min(seq) per (topic, line) — a partial aggregate, so a line repeated
    millions of times is reduced map-side rather than sorted in one task.
    """
    req = requests.select("topic", F.col("old_line").alias("line")).distinct()
    first = lines.groupBy("topic", "line").agg(F.min("seq").alias("seq"))
    return first.join(req, ["topic", "line"]).select("topic", "seq")


def replace_first(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request replaces the first line then equal to its ``old_line``
    with ``new_line``, one after the other by ``req_seq`` (by old and new line
    where there is none); see :func:`quire.operators.edits.replay_edits`."""
    if "req_seq" not in requests.columns:
        requests = requests.withColumn("req_seq", F.lit(0))
    return replay_edits(lines, requests)[0]


def remove_first(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request removes the first line then equal to its ``old_line``."""
    if "req_seq" not in requests.columns:
        requests = requests.withColumn("req_seq", F.lit(0))
    return replay_edits(lines, requests.withColumn("new_line", F.lit(None).cast("string")))[0]


def is_blank(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, f"{WHITE_SPACE}+", "") == ""


def validate_writes(raw: DataFrame) -> DataFrame:
    """Raw requests (seq, topic_raw, body_raw, ...) -> adds ``topic``
    (normalised), ``body`` (newline runs flattened), ``accepted`` and
    ``reason`` (NULL when accepted)."""
    topic = normalize_topic("topic_raw")
    reason = (F.when(F.col("topic_raw").isNull() | (topic == ""), F.lit(REASON_EMPTY_TOPIC))
              .when(F.col("body_raw").isNull() | is_blank("body_raw"), F.lit(REASON_EMPTY_ENTRY)))
    return raw.withColumn("topic", topic).withColumn("body", flatten_newlines("body_raw")) \
        .withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def writes_to_entries(accepted: DataFrame) -> DataFrame:
    """Accepted writes -> entry rows dated ``written_on`` with count 1."""
    return accepted.select(
        "entry_id", "topic", F.col("written_on").alias("entry_date"), "body",
        F.lit(1).cast("bigint").alias("reinforce_count"),
        render_entry("written_on", "body", F.lit(1)).alias("line"), "seq")


def reaffirm_rollup(entries: DataFrame) -> DataFrame:
    """Exact restatements folded: one row per (topic, body) with the latest
    date, summed counters, the first position and the rendered line."""
    g = entries.groupBy("topic", "body").agg(
        F.min("seq").alias("seq"), F.max("entry_date").alias("entry_date"),
        F.sum("reinforce_count").cast("bigint").alias("reinforce_count"),
        F.count(F.lit(1)).alias("n_merged"))
    return g.withColumn("line", render_entry("entry_date", "body", "reinforce_count")).drop("body")


def as_date(d: str | _dt.date) -> _dt.date:
    return _dt.date.fromisoformat(d) if isinstance(d, str) else d
