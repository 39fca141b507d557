"""Timestamps in texts, and relative times as arguments."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: RFC 3339 with a fraction of any length.
RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})\z"

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_rfc3339(col: Column) -> Column:
    """Timestamp of an RFC 3339 text, cut to microseconds; null if it is none."""
    cut = F.regexp_replace(F.regexp_replace(col, ",", "."), r"(\.[0-9]{6})[0-9]+", "$1")
    return F.when(col.rlike(RFC3339), cut.try_cast("timestamp"))


def epoch_seconds(number: Column) -> Column:
    """Timestamp of seconds since 1970, fractions dropped; null outside the years 1 to 9999 and for what is no number."""
    inside = number.between(-62_135_596_800, 253_402_300_799)
    return F.timestamp_seconds(F.when(inside, number).try_cast("bigint"))


def parse_epoch(col: Column) -> Column:
    """Timestamp of a number in a text: milliseconds from 1e12 on, else seconds; fractions are dropped, and a number out of range is no time."""
    number = col.try_cast("double")
    millis = F.timestamp_millis(F.when(number.between(1e12, 253_402_300_799_999), number).try_cast("bigint"))
    return F.when(number >= 1e12, millis).otherwise(epoch_seconds(number))


def parse_since(text: str, now: datetime) -> datetime | None:
    """A relative time (``24h``, ``7d``, ``1h30m``) before ``now``, or an RFC 3339 time; None for an empty text, an error otherwise."""
    text = text.strip()
    if not text:
        return None
    if m := re.fullmatch(r"([0-9]+)d", text):
        return now - timedelta(days=int(m[1]))
    if re.fullmatch(r"(?:[0-9]+(?:\.[0-9]+)?(?:ns|us|µs|ms|s|m|h))+", text):
        return now - timedelta(seconds=sum(float(n) * _UNITS[u] for n, u in re.findall(r"([0-9.]+)(ns|us|µs|ms|s|m|h)", text)))
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)
