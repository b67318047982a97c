"""Text column functions: topic names, tokens, entry lines.

Functions of a ``Column`` stay inside Catalyst and whole-stage codegen;
``token_slices`` takes tokens apart inside Arrow batches. Nothing here runs
Python per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# Alphanumeric = Unicode Alphabetic or Numeric, as in the reference's char test.
NON_ALNUM_RUN = r"[^\p{IsAlphabetic}\p{N}]+"
NON_ASCII_NON_ALNUM = r"[^\x00-\x7F\p{IsAlphabetic}\p{N}]+"
TOPIC_BAD_CHAR = r"[^\p{IsAlphabetic}\p{N}-]"
# Entry line: "- YYYY-MM-DD: body" with an optional trailing " [×N]" counter.
# Group 1 = date (10 chars of digits/dashes), 2 = body, 3 = counter digits.
ENTRY_LINE = r"(?s)\A- ([0-9-]{10}): (.*?)(?: \[×\+?([0-9]+)\])?\z"
ENTRY_HEAD = r"\A- ([0-9-]{10}): \z"          # the first 14 characters
COUNTER_SUFFIX = r" \[×\+?([0-9]+)\]\z"      # the trailing counter
ENTRY_PREFIX = "- "
COUNTER_OPEN = " [×"
COUNTER_CLOSE = "]"
U32_MAX = 4294967295
# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_topic(name: Column | str) -> Column:
    """Lowercase; every char that is not alphanumeric or '-' becomes '-';
    strip '-' from both ends. Runs of '-' are kept."""
    return F.btrim(F.regexp_replace(F.lower(_col(name)), TOPIC_BAD_CHAR, "-"), F.lit("-"))


def tokenize(text: Column | str) -> Column:
    """Lowercase and split on non-alphanumeric runs; empties dropped,
    duplicates and order kept. Returns ARRAY<STRING>."""
    return F.filter(F.split(F.lower(_col(text)), NON_ALNUM_RUN), lambda t: t != "")


def joined_tokens(text: Column | str) -> Column:
    """The tokens as one string, separated by spaces (no token holds one)."""
    return F.array_join(tokenize(text), " ")


def token_text(text: Column | str) -> Column:
    """The text in lower case, a space for each character beyond ASCII that no
    token holds; ``token_slices`` takes it apart. ASCII, most of any text, is left
    to its byte table, and texts of ASCII alone see no regex."""
    low = F.lower(_col(text))
    return F.when(F.length(low) == F.octet_length(low), low).otherwise(F.regexp_replace(low, NON_ASCII_NON_ALNUM, " "))


TOKEN_BYTES = 4 << 20   # of text that is taken apart at once
_IN_TOKEN = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def _tokens(rows: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """(tokens per row, all tokens) of strings as ``token_text`` makes them; a
    null has none."""
    rows = pc.fill_null(rows, "")
    wide = pa.types.is_large_string(rows.type)
    ends = np.frombuffer(rows.buffers()[1], dtype=np.int64 if wide else np.int32)[rows.offset:rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2] or b"", dtype=np.uint8)[int(ends[0]):int(ends[-1])]
    inside = _IN_TOKEN[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    bounds = ends.astype(np.int64) - int(ends[0])
    heads = bounds[:-1][bounds[:-1] < len(data)]
    opens[heads] = inside[heads]      # a token ends with its row
    starts = np.flatnonzero(opens)
    lens = np.diff(np.searchsorted(starts, bounds))
    kept = data[inside]
    at = np.cumsum(inside)[starts] - 1
    offsets = np.append(at, len(kept)).astype(np.int32)
    return lens, pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))


def token_slices(batches, col: str, most: int = 1 << 30):
    """(rows, tokens per row, code of every token, distinct tokens) by slices of
    the record batches, each of about TOKEN_BYTES of ``col`` and at most ``most``
    rows (one row at least). No token is a Python object."""
    for batch in batches:
        at = batch.schema.get_field_index(col)
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(before, before[lo] + TOKEN_BYTES, side="right")) - 1
            hi = min(max(hi, lo + 1), lo + most, batch.num_rows)
            rows = batch.slice(lo, hi - lo)
            lens, tokens = _tokens(rows.column(at))
            found = tokens.dictionary_encode()
            yield rows, lens, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
            lo = hi


def flatten_newlines(text: Column | str) -> Column:
    """A body must stay on one line: each run of CR/LF becomes one space."""
    return F.regexp_replace(_col(text), r"[\r\n]+", " ")


def is_entry_line(line: Column | str) -> Column:
    return _col(line).startswith(ENTRY_PREFIX)


def entry_date_part(line: Column | str) -> Column:
    """The 10-character date of an entry line, NULL when the line is not an
    entry (whether it is depends only on its first 14 characters)."""
    d = F.regexp_extract(F.substring(_col(line), 1, 14), ENTRY_HEAD, 1)
    return F.when(d != "", d)


def _counter(line: Column) -> tuple[Column, Column]:
    """(has_counter, suffix): a trailing `` [×N]`` with N a u32, starting
    after the ``- YYYY-MM-DD:`` prefix."""
    suffix = F.regexp_extract(line, COUNTER_SUFFIX, 0)
    digits = F.regexp_extract(line, COUNTER_SUFFIX, 1)
    stripped = F.ltrim(digits, F.lit("0"))
    fits_u32 = (F.length(stripped) <= 10) & (
        (stripped == "") | (stripped.try_cast("bigint") <= F.lit(U32_MAX)))
    has = (digits != "") & fits_u32 & (F.length(line) - F.length(suffix) >= 14)
    return has, suffix


def entry_count(line: Column | str) -> Column:
    """The counter of an entry line (1 when absent or not a u32)."""
    line = _col(line)
    has, _ = _counter(line)
    stripped = F.ltrim(F.regexp_extract(line, COUNTER_SUFFIX, 1), F.lit("0"))
    return F.when(has, F.coalesce(stripped.try_cast("bigint"), F.lit(0)).cast("bigint")) \
        .otherwise(F.lit(1).cast("bigint"))


def parse_entry(line: Column | str) -> Column:
    """Parse an entry line into STRUCT<date STRING, body STRING, count BIGINT>.

    NULL when the line is not an entry. The counter is the trailing
    ``[×N]`` only when N is a valid unsigned 32-bit number; otherwise the
    whole rest of the line is the body and the count is 1.

    Whether a line is an entry depends only on its first 14 characters, and
    the counter only on its end, so neither regex scans the body from the
    start. Equivalent to matching ``ENTRY_LINE`` as a whole.
    """
    line = _col(line)
    date = entry_date_part(line)
    has, suffix = _counter(line)
    rest = F.substring(line, 15, 1 << 30)
    body = F.when(has, rest.substr(F.lit(1), F.length(line) - 14 - F.length(suffix))).otherwise(rest)
    return F.when(date.isNotNull(), F.struct(date.alias("date"), body.alias("body"),
                                             entry_count(line).alias("count")))


def render_entry_str(date_str: Column | str, body: Column | str, count: Column | str) -> Column:
    """'- {date}: {body}' plus ' [×N]' only when N > 1; date is a 10-char string."""
    date_str, body, count = _col(date_str), _col(body), _col(count)
    return F.concat(
        F.lit(ENTRY_PREFIX), date_str, F.lit(": "), body,
        F.when(count > 1, F.concat(F.lit(COUNTER_OPEN), count.cast("string"), F.lit(COUNTER_CLOSE)))
        .otherwise(F.lit("")),
    )


def render_entry(date: Column | str, body: Column | str, count: Column | str) -> Column:
    """As ``render_entry_str`` for a DATE column."""
    return render_entry_str(F.date_format(_col(date), "yyyy-MM-dd"), body, count)


def vector_key(topic: Column | str, line: Column | str) -> Column:
    """The reference's vector identity ``topic::line`` (F11). Vector tables
    here are keyed by ``entry_id``; this key is kept for interchange."""
    return F.concat_ws("::", _col(topic), _col(line))


def contains_ci(text: Column | str, needle: str) -> Column:
    """Case-insensitive literal substring test (never a regex or LIKE)."""
    return F.contains(F.lower(_col(text)), F.lower(F.lit(needle)))
