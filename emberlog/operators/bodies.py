"""Structured bodies: fields lifted out of bodies that are one JSON object or a logfmt line.

Native expressions find the bodies that may hold fields; only these are parsed, JSON and
logfmt alike, in one Arrow pass that returns what is lifted. No row is shuffled.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.severity import INFO, severity_of, trimmed
from emberlog.functions.times import parse_epoch, parse_rfc3339
from emberlog.operators.rules import MAX_RULES

# The keys that are recognised, first one first.
MESSAGE_KEYS = ("msg", "message")
LEVEL_KEYS = ("level", "severity", "lvl")
TIME_KEYS = ("time", "ts", "timestamp")
#: Attributes lifted from a body, at most, and bytes of a lifted value.
MAX_LIFTED, MAX_VALUE_BYTES = 50, 2000
#: A time in a body counts only this near to the record's own.
TIME_WINDOW = "INTERVAL 48 HOURS"

# A token of a logfmt line, and how such a line and its recognised keys begin.
_TOKEN = re.compile(r'([^ \t"=\n\r]+)=(?:"((?:[^"\\\n\r]|\\[^\n\r])*)"|([^ \t"\n\r][^ \t\n\r]*|))(?:[ \t]+|\Z)')
_LOGFMT_START = r'\A[^ \t"=\n\r]+='
_LOGFMT_KEY = r"(?:\A|[ \t])(?:" + "|".join((*MESSAGE_KEYS, *LEVEL_KEYS)) + ")="

_LIFTED = "message string, level int, time string, digits boolean, service string, trace string, attrs array<struct<key:string,value:string>>"
_LIFTED_ARROW = pa.struct([
    ("message", pa.string()), ("level", pa.int32()), ("time", pa.string()), ("digits", pa.bool_()), ("service", pa.string()), ("trace", pa.string()),
    ("attrs", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))),
])
_SURROGATE = re.compile("[\ud800-\udfff]")


class _Number(str):
    """A JSON number's literal text."""


def _compact(value) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_compact(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_compact, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _not_a_constant(name: str):
    raise ValueError(name)


def _plain(text: str) -> str:
    """Without lone surrogates, which no text column can hold."""
    return _SURROGATE.sub("\ufffd", text)


def json_fields(body: str) -> dict | None:
    """The fields of a body that is exactly one JSON object, numbers as their literal text; None otherwise."""
    try:
        found = json.loads(body, parse_int=_Number, parse_float=_Number, parse_constant=_not_a_constant)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def logfmt_fields(body: str) -> dict | None:
    """The fields of a trimmed logfmt line of two different keys or more, the last of equal keys counting; None otherwise."""
    at, out = 0, {}
    while at < len(body):
        token = _TOKEN.match(body, at)
        if not token:
            return None
        key, quoted, bare = token.groups()
        out[key] = re.sub(r"(?s)\\(.)", r"\1", quoted) if quoted is not None else bare
        at = token.end()
    return out if len(out) >= 2 else None


def lift(body: str, known: set[str]) -> dict | None:
    """What a trimmed body gives: message, time, service and trace as texts, level as a severity (null: nothing taken), and attributes but for ``known`` keys; None if it isn't structured or holds neither message nor level key."""
    fields = json_fields(body) if body.startswith("{") else logfmt_fields(body)
    if not fields or not any(k in fields for k in (*MESSAGE_KEYS, *LEVEL_KEYS)):
        return None
    used, out = set(), dict.fromkeys(("message", "level", "time", "service", "trace"))
    # Message keys are used up to the one that is taken, all if none is; of the others only the first present.
    for key in MESSAGE_KEYS:
        used.add(key)
        if type(fields.get(key)) is str and fields[key]:
            out["message"] = fields[key]
            break
    for name, keys, kinds in (("level", LEVEL_KEYS, (str, _Number)), ("time", TIME_KEYS, (str, _Number)), ("service", ("service",), (str,)), ("trace", ("trace_id",), (str,))):
        key = next((k for k in keys if k in fields), None)
        used.add(key)
        if type(fields.get(key)) in kinds:
            out[name] = severity_of(str(fields[key])) if name == "level" else str(fields[key])
            out["digits"] = out.get("digits") or name == "time" and (type(fields[key]) is _Number or bool(re.fullmatch("[0-9]+", fields[key])))
    attrs = {}
    for key in sorted(fields.keys() - used):
        nested = fields[key] if isinstance(fields[key], dict) else None
        for name, value in [(f"{key}.{k}", nested[k]) for k in sorted(nested)] if nested is not None else [(key, fields[key])]:
            name = _plain(name)
            if name not in known and name not in attrs and len(attrs) < MAX_LIFTED:
                text = _plain(value if type(value) is str else _compact(value))
                attrs[name] = text if len(text) * 4 <= MAX_VALUE_BYTES else text.encode()[:MAX_VALUE_BYTES].decode(errors="ignore")
    texts = {k: _plain(v) if type(v) is str else v for k, v in out.items()}
    return texts | {"attrs": [{"key": k, "value": v} for k, v in attrs.items()]}


def _lifted(body: Column, keys: Column) -> Column:
    @F.arrow_udf(_LIFTED)
    def of(bodies: pa.Array, known: pa.Array) -> pa.Array:
        rows = (None if b is None else lift(b, set(k or ())) for b, k in zip(bodies.to_pylist(), known.to_pylist()))
        return pa.array([r or {} for r in rows], _LIFTED_ARROW)

    return of(body, keys)


def _switched_on(logs: DataFrame, projects: DataFrame | None) -> DataFrame:
    """``logs`` with ``__parse``: false for projects that have parsing switched off. Their ids are a literal list; of more than ``MAX_RULES`` a join."""
    if projects is None:
        return logs.withColumn("__parse", F.lit(True))
    off = projects.where(~F.col("parse_bodies")).select(F.col("id").alias("project_id")).distinct()
    ids = [r["project_id"] for r in off.limit(MAX_RULES + 1).collect()]
    if len(ids) <= MAX_RULES:
        return logs.withColumn("__parse", ~F.coalesce(F.col("project_id").isin(ids), F.lit(False)) if ids else F.lit(True))
    return logs.join(off.withColumn("__off", F.lit(True)), "project_id", "left").withColumn("__parse", F.col("__off").isNull()).drop("__off")


def parse_bodies(logs: DataFrame, projects: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """Lifts message, level, time, service, trace id and attributes out of structured bodies.

    A body counts if, trimmed, it is one JSON object or a logfmt line and holds a message or
    level key. The message replaces the body; the level only a severity of INFO; the time
    only one within 48 hours; service and trace id only empty ones. Keys so recognised are
    used up, with what is nested in them; the rest become attributes, nested ones one level
    down as ``key.nested``, existing ones winning, at most ``MAX_LIFTED``. ``projects`` can turn
    this off for single projects; unknown projects are parsed. Times out of range are no
    times, lone surrogates become U+FFFD: no body makes the job fail.
    """
    if not enabled:
        return logs
    columns = logs.columns
    logs = _switched_on(logs, projects)
    body = trimmed(F.col("body"))
    json_key = '"(?:' + "|".join((*MESSAGE_KEYS, *LEVEL_KEYS)) + r')"|\\u'
    braced = F.startswith(body, F.lit("{"))
    gate = F.when(braced, F.endswith(body, F.lit("}")) & body.rlike(json_key)).otherwise(body.rlike(_LOGFMT_START) & body.rlike(_LOGFMT_KEY))
    attrs = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    logs = logs.withColumn("__lift", _lifted(F.when(F.col("__parse") & gate, body), F.map_keys(attrs)))

    got = F.col("__lift")
    time = F.coalesce(parse_rfc3339(got["time"]), F.when(got["digits"], parse_epoch(got["time"])))
    own = F.col("ts").cast("timestamp")
    near = (time > own - F.expr(TIME_WINDOW)) & (time < own + F.expr(TIME_WINDOW))
    changed = {
        "body": F.coalesce(got["message"], F.col("body")),
        "severity": F.when((F.col("severity") == INFO) & got["level"].isNotNull(), got["level"]).otherwise(F.col("severity")),
        "ts": F.when(near, time.cast(logs.schema["ts"].dataType)).otherwise(F.col("ts")),
        "service": F.when((F.col("service") == "") & got["service"].isNotNull(), got["service"]).otherwise(F.col("service")),
        "trace_id": F.when((F.col("trace_id") == "") & got["trace"].isNotNull(), got["trace"]).otherwise(F.col("trace_id")),
        "attrs": F.when(F.size(F.coalesce(got["attrs"], F.array().cast("array<struct<key:string,value:string>>"))) > 0, F.map_concat(attrs, F.map_from_entries(got["attrs"]))).otherwise(F.col("attrs")),
    }
    return logs.withColumns(changed).select(*columns)
