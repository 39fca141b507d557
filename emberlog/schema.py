"""Schemas of the log model, and validators of rule rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.functions.severity import INFO, parse_severity_strict

LOGS = (
    "log_id long, project_id long, ts timestamp, severity int, body string, service string, "
    "environment string, release string, trace_id string, attrs map<string,string>"
)
PROJECTS = "id long, name string, slug string, retention_days int, parse_bodies boolean"
NOISE_RULES = "id long, project_id long, kind string, service string, severity int, pattern string, n int, enabled boolean, dropped_count long"
SEVERITY_RULES = "id long, project_id long, service string, pattern string, severity int, enabled boolean, lifted_count long"
ALERT_RULES = (
    "id long, project_id long, name string, kind string, service string, environment string, min_severity int, n int, "
    "window_minutes int, cooldown_seconds int, url string, headers map<string,string>, enabled boolean, last_fired timestamp, last_error string"
)
ISSUE_ACTIONS = "project_id long, fingerprint string, status string, seq long"
LINES = "source string, service string, seq long, ts timestamp, text string"
ROLLUPS = "project_id long, service string, severity int, hour timestamp, logs long, events long"

NOISE_KINDS = ("severity_floor", "drop_match", "sample")
ALERT_KINDS = ("new_issue", "regression", "threshold")
STATUSES = ("open", "resolved", "ignored")
DEFAULT_COOLDOWN = 900
MAX_HEADERS, MAX_HEADER_BYTES = 32, 4096

# Constructs whose meaning differs between regular expression dialects, or that linear-time engines lack.
_UNPORTABLE = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|(?<!\\)[*+?}]\+")


def check_pattern(pattern: str) -> None:
    """Refuses patterns that don't compile, or mean different things in different dialects (lookaround, back-references, possessive repeats)."""
    if not pattern:
        raise ValueError("a pattern is needed")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"pattern does not compile: {e}") from e
    if _UNPORTABLE.search(pattern):
        raise ValueError("lookaround, back-references and possessive repeats are not supported")


def check_noise_rule(rule: Mapping) -> None:
    kind = rule.get("kind")
    if kind not in NOISE_KINDS:
        raise ValueError(f"unknown noise rule kind {kind!r}")
    if kind in ("severity_floor", "sample") and rule.get("severity") is None:
        raise ValueError(f"{kind} needs a severity")
    if kind == "drop_match" and not rule.get("pattern"):
        raise ValueError("drop_match needs a pattern")
    if kind == "sample" and (rule.get("n") or 0) < 2:
        raise ValueError("sample needs n of 2 or more")


def check_severity_rule(rule: Mapping) -> None:
    check_pattern(rule.get("pattern") or "")
    level = rule.get("severity")
    level = parse_severity_strict(level) if isinstance(level, str) else level
    if level is None or not INFO < level <= 5:
        raise ValueError("a severity above INFO is needed")


def check_alert_rule(rule: Mapping) -> None:
    kind = rule.get("kind")
    if kind not in ALERT_KINDS:
        raise ValueError(f"unknown alert rule kind {kind!r}")
    url = urlparse(rule.get("url") or "")
    if url.scheme not in ("http", "https") or not url.netloc:
        raise ValueError("an http or https url is needed")
    if kind == "threshold" and ((rule.get("n") or 0) < 1 or (rule.get("window_minutes") or 0) < 1):
        raise ValueError("threshold needs n and window_minutes of 1 or more")
    if (rule.get("cooldown_seconds", DEFAULT_COOLDOWN) or 0) < 0:
        raise ValueError("cooldown_seconds must not be negative")
    headers = rule.get("headers") or {}
    if len(headers) > MAX_HEADERS or sum(len(k.encode()) + len(v.encode()) for k, v in headers.items()) > MAX_HEADER_BYTES:
        raise ValueError("too many headers")


def rejections(rules: DataFrame, check: Callable[[Mapping], None], key: str = "id") -> DataFrame:
    """``(key, reason)`` of every row of an imported rule table that ``check`` refuses; checked where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refused: list[tuple] = []
            for row in batch.to_pylist():
                try:
                    check(row)
                except ValueError as e:
                    refused.append((row[key], str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in refused], batch.schema.field(key).type), pa.array([r[1] for r in refused], pa.string())], [key, "reason"])

    return rules.mapInArrow(run, f"{key} {rules.schema[key].dataType.simpleString()}, reason string")
