"""Quality rules: shape of the text, and lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, row_key, whole_row

_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8
    text. Words are runs without ASCII white space; word_chars counts their
    code points; a line is a duplicate if it has a word and equals an earlier
    line; n_repeat_words counts the words in 3-word windows that occur twice
    or more, the first occurrence included."""
    words = text.split()
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))
    solid = text.translate(None, _SPACES)
    word_chars = len(solid.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    n, repeat = len(words), 0
    if n >= 4:  # two windows at least
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        size = len(number)
        if size < 1 << 21:
            window = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:
            pair = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1]
            window = pair * size + ids[2:]
        _, at, times = np.unique(window, return_inverse=True, return_counts=True)
        again = times[at] >= 2
        covered = np.zeros(n, dtype=bool)
        covered[:-2] |= again
        covered[1:-1] |= again
        covered[2:] |= again
        repeat = int(covered.sum())
    return n, word_chars, n_symbols, dup, repeat


def normal_line(line: Column) -> Column:
    """A line's normal form: lower case, white-space runs as one space, none
    at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _words_in(line: Column) -> Column:
    """Words of a normal line that has some."""
    return F.length(line) - F.length(F.translate(line, " ", "")) + 1


def line_counts(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, line_key, n_docs): in how many distinct texts of a host each
    normal line occurs. Copies of one text count once: they are a matter for
    deduplication, not boilerplate. Repeats within a text and copies collapse
    before the count, by keys that no single line or host can make hot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(_host(host_col), F.md5(text).alias("text_key"), F.explode(F.split(text, "\n")).alias("line")) \
        .select("host", "text_key", normal_line(F.col("line")).alias("line")).where("line <> ''") \
        .select("host", F.unhex(F.md5("line")).alias("line_key"), F.unhex("text_key").alias("text_key")).distinct() \
        .groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("n_docs"))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
           min_words: int = 50, max_repeat_pct: int = 50, min_line_docs: int = 20, line_share: float = 0.01,
           min_left: float = 0.3) -> DataFrame:
    """(row_key, doc_id, the features, n_words_left, base_failed, kept) of every row.

    Base rules: at least ``min_words`` words, of which at most
    ``max_repeat_pct`` per cent in repeated windows. Line rule: a normal line
    found in more than ``max(min_line_docs, line_share * documents of the
    host)`` distinct texts of its host is removed, and a document of which
    less than ``min_left`` of the words remain is rejected as depleted.

    The lines above the limit are joined to the documents' lines by host and
    line as an equality join, so hot lines are split by adaptive execution,
    and summed per document before and after the shuffle.

    Edge cases: a null text is empty and fails the base rules; a null host is
    the host named ''; repeated rows get equal results; a null doc_id stays
    null; an empty table gives an empty result; other columns are not read."""
    return _assess(docs, id_col, text_col, host_col, min_words, max_repeat_pct, min_line_docs, line_share,
                   min_left).drop("host", "cuts")


def _assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
            min_words: int = 50, max_repeat_pct: int = 50, min_line_docs: int = 20, line_share: float = 0.01,
            min_left: float = 0.3) -> DataFrame:
    """:func:`assess` with the row's ``host`` and ``cuts``, the places (from 0,
    ascending) of its lines above the limit, null where it has none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([features(t) for t in b.column("raw").to_pylist()], dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [b.column("row_key"), b.column("doc_id"), b.column("host"), *(pa.array(c) for c in got.T)],
                names=["row_key", "doc_id", "host", *_FEATURES])

    base = docs.select(row_key(doc_id, text), doc_id.alias("doc_id"), _host(host_col),
                       text.cast("binary").alias("raw")) \
        .mapInArrow(run, "row_key binary, doc_id bigint, host string, "
                    + ", ".join(f"{c} bigint" for c in _FEATURES))
    limits = docs.select(_host(host_col), F.md5(text).alias("text_key")).distinct() \
        .groupBy("host").agg(F.greatest(F.lit(float(min_line_docs)),
                                        F.lit(line_share) * F.count(F.lit(1))).alias("limit"))
    common = materialise(line_counts(docs, text_col, host_col).where(F.col("n_docs") > min_line_docs)
                         .join(limits, "host").where(F.col("n_docs") > F.col("limit")).select("host", "line_key"),
                         "common-lines")
    lines = docs.select(_host(host_col), row_key(doc_id, text),
                        F.posexplode(F.split(text, "\n")).alias("place", "line")) \
        .select("host", "row_key", "place", normal_line(F.col("line")).alias("line")).where("line <> ''") \
        .select("host", "row_key", "place", F.unhex(F.md5("line")).alias("line_key"),
                _words_in(F.col("line")).alias("words"))
    gone = lines.join(common, ["host", "line_key"]).groupBy("row_key", "host") \
        .agg(F.sum("words").alias("gone"), F.sort_array(F.collect_set("place")).alias("cuts"))
    # a row that occurs k times has each of its lines k times: take the share of one
    copies = docs.select(row_key(doc_id, text), _host(host_col)).groupBy("row_key", "host") \
        .agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    gone = gone.join(copies, ["row_key", "host"], "left") \
        .select("row_key", "host", (F.col("gone") / F.coalesce("copies", F.lit(1))).cast("bigint").alias("gone"), "cuts")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return base.join(gone, ["row_key", "host"], "left") \
        .select("row_key", "doc_id", *_FEATURES, left.alias("n_words_left"), failed.alias("base_failed"), "host", "cuts") \
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= F.lit(min_left) * F.col("n_words")))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  **rules) -> DataFrame:
    """The rows of ``docs`` that :func:`assess` keeps, all columns, their texts
    without the lines above the limit; repeated rows stay repeated. Only the
    places of such lines are gathered, and only for rows that have some."""
    marks = _assess(docs, id_col, text_col, host_col, **rules).where("not kept or cuts is not null") \
        .select("row_key", "host", "kept", "cuts").dropDuplicates(["row_key", "host"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    packed = docs.select(whole_row(docs), _host(host_col),
                         row_key(F.col(id_col).cast("bigint"), text))
    left = packed.join(marks, ["row_key", "host"], "left").where("kept is null or kept") \
        .withColumn("lines", F.when(F.col("cuts").isNotNull(), F.split(F.col("row")[text_col], "\n")))
    between = F.expr("transform(cuts, (c, i) -> slice(lines, if(i = 0, -1, cuts[i - 1]) + 2, "
                     "c - if(i = 0, -1, cuts[i - 1]) - 1))")
    tail = F.expr("slice(lines, cuts[size(cuts) - 1] + 2, size(lines))")
    rest = F.array_join(F.concat(F.flatten(between), tail), "\n")
    return left.select(
        [(F.when(F.col("cuts").isNotNull(), rest).otherwise(F.col("row")[c]) if c == text_col else F.col("row")[c])
         .alias(c) for c in docs.columns])
