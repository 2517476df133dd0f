"""Time functions: truncation, literals, RFC 3339 text, parameter rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime or ISO text (constant-folded,
    so range predicates on it still reach the Parquet scan)."""
    return F.lit(parse_ts(value).isoformat(sep=" ")).cast("timestamp_ntz")


def utcnow() -> dt.datetime:
    """Current UTC wall-clock time (naive, like the canonical timestamps)."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def parse_ts(value) -> dt.datetime | None:
    """A parameter as naive UTC: RFC 3339 text (``Z`` or an offset) or a zoned
    datetime is converted, a naive one is taken to be UTC."""
    if value is None:
        return None
    v = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    return v if v.tzinfo is None else v.astimezone(dt.timezone.utc).replace(tzinfo=None)


# A date, a time with optional fraction, and a zone; all three are required.
_RFC3339 = (r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")


def utc_from_rfc3339(c) -> Column:
    """RFC 3339 text to UTC as TIMESTAMP_NTZ; null for anything else, a time
    without a zone included. Digits beyond microseconds are cut."""
    col = F.upper(F.col(c) if isinstance(c, str) else c)
    parsed = F.try_to_timestamp(F.replace(col, F.lit("T"), F.lit(" ")))
    return F.when(col.rlike(_RFC3339), parsed.cast("timestamp_ntz"))


def trunc(unit: str, c) -> Column:
    """``date_trunc`` that keeps TIMESTAMP_NTZ (F1, F3): the built-in returns
    TIMESTAMP, so the result is cast back to the wall-clock type."""
    col = F.col(c) if isinstance(c, str) else c
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def floor_hour(value) -> dt.datetime | None:
    """Parameter rule of the report (F2): drop minutes, seconds, fractions."""
    v = parse_ts(value)
    return None if v is None else v.replace(minute=0, second=0, microsecond=0)


def rfc3339(c) -> Column:
    """RFC 3339 text with an explicit +00:00 offset (F12): no fraction, or as
    many groups of three digits as it needs."""
    t = (F.col(c) if isinstance(c, str) else c).cast("timestamp")
    micros = F.unix_micros(t)
    form = (F.when(micros % 1_000_000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx"))
            .when(micros % 1_000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx"))
            .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")))
    return form


def lookback_start(as_of, days: int = 30) -> dt.datetime:
    """``as_of - days``."""
    return parse_ts(as_of) - dt.timedelta(days=days)


def range_issue(frm, to) -> Column:
    """The same rule for a table of ranges: ``from_not_before_to`` or null."""
    f, t = (F.col(c) if isinstance(c, str) else c for c in (frm, to))
    return F.when(f >= t, F.lit("from_not_before_to"))


def check_range(frm, to) -> None:
    """Range validation (P13): from must be before to when both are given."""
    f, t = parse_ts(frm), parse_ts(to)
    if f is not None and t is not None and not f < t:
        raise ValueError(f"'from' ({f}) must be before 'to' ({t})")
