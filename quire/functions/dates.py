"""Calendar helpers. Operators take an explicit ``as_of`` date; nothing here
reads the clock, so results are reproducible."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_day(date_str: Column | str) -> Column:
    """'YYYY-MM-DD' -> days since 1970-01-01, or NULL.

    Month must be 1..12 and day 1..31; the day may exceed the month's length
    and rolls into the next month (2026-02-31 is 3 March). Years before 1970
    are rejected. Month/day parse as unsigned numbers, so '+1' is accepted.
    """
    s = _col(date_str)
    y_s, m_s, d_s = F.substring(s, 1, 4), F.substring(s, 6, 2), F.substring(s, 9, 2)
    shape = (
        (F.octet_length(s) == 10)
        & (F.substring(s, 5, 1) == "-")
        & (F.substring(s, 8, 1) == "-")
        & y_s.rlike(r"^[0-9]{4}$")
        & m_s.rlike(r"^(\+[0-9]|[0-9]{2})$")
        & d_s.rlike(r"^(\+[0-9]|[0-9]{2})$")
    )
    y = F.when(shape, y_s.cast("int"))
    m = F.when(shape, F.regexp_replace(m_s, r"^\+", "").cast("int"))
    d = F.when(shape, F.regexp_replace(d_s, r"^\+", "").cast("int"))
    ok = shape & (y >= 1970) & m.between(1, 12) & d.between(1, 31)
    first = F.make_date(F.when(ok, y), F.when(ok, m), F.when(ok, F.lit(1)))
    return F.when(ok, (F.unix_date(first) + d - 1).cast("bigint"))


def as_of_day(as_of: str | _dt.date) -> int:
    """Epoch day of a fixed ``as_of`` date (a plain Python int, used as a
    literal so Catalyst folds it)."""
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return (as_of - _dt.date(1970, 1, 1)).days
