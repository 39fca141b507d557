"""Severity levels: TRACE 0 to FATAL 5."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACE, DEBUG, INFO, WARN, ERROR, FATAL = range(6)
NAMES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
# The names a severity can be given by.
ALIASES = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "warning": 3, "error": 4, "err": 4, "fatal": 5, "panic": 5, "critical": 5}
#: The least OTLP severity number of each level above TRACE.
OTLP_BANDS = ((21, FATAL), (17, ERROR), (13, WARN), (9, INFO), (5, DEBUG), (1, TRACE))
SPACE = r"[\t-\r \x85\xa0  -     　]"


def trimmed(col: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(col, rf"\A{SPACE}+|{SPACE}+\z", "")


def severity_of_number(number: Column) -> Column:
    """OTLP numbers 1-4 TRACE, 5-8 DEBUG, 9-12 INFO, 13-16 WARN, 17-20 ERROR, 21 and more FATAL; else null."""
    out = F.lit(None).cast("int")
    for least, level in reversed(OTLP_BANDS):
        out = F.when(number >= least, F.lit(level)).otherwise(out)
    return out


def parse_severity(col: Column) -> Column:
    """A name in any case, trimmed, or an OTLP number, untrimmed; INFO for all else."""
    name = F.lower(trimmed(col))
    number = F.when(col.rlike(r"\A[+-]?[0-9]+\z"), col.try_cast("bigint"))
    out = F.coalesce(severity_of_number(number), F.lit(INFO))
    for level in range(6):
        out = F.when(name.isin([k for k, v in ALIASES.items() if v == level]), F.lit(level)).otherwise(out)
    return out


def severity_of(text: str) -> int:
    """As :func:`parse_severity`, for a text in a task's own code."""
    name = re.sub(rf"\A{SPACE}+|{SPACE}+\Z", "", text).lower()
    if name in ALIASES:
        return ALIASES[name]
    number = int(text) if re.fullmatch("[+-]?[0-9]{1,18}", text) else 0
    return next((level for least, level in OTLP_BANDS if number >= least), INFO)


def parse_severity_strict(name: str) -> int:
    """A severity by name only, for rule tables: empty means TRACE, any other unknown name is an error."""
    key = name.strip().lower()
    if not key:
        return TRACE
    if key not in ALIASES:
        raise ValueError(f"unknown severity {name!r}")
    return ALIASES[key]


def severity_name(col: Column) -> Column:
    out = F.lit("UNKNOWN")
    for level, name in enumerate(NAMES):
        out = F.when(col == level, F.lit(name)).otherwise(out)
    return out
