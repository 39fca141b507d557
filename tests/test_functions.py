"""Golden cases of the column functions, body parsing and sources."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions import severity as sev
from emberlog.functions import text as txt
from emberlog.functions.times import parse_since
from emberlog.operators import bodies, normalize, tables
from emberlog.sources import readers, writers

NOW = datetime(2024, 5, 1, 12, 0, 0)
LOG = "log_id long, project_id long, ts timestamp, severity int, body string, service string, trace_id string, attrs map<string,string>"

# Message, normal form.
MESSAGES = [
    ("user 4812 not found", "user <n> not found"),
    ('open "/tmp/f83a.txt": no such file', "open <str>: no such file"),
    ("conn to 10.0.3.7:5432 refused", "conn to <ip>:<n> refused"),
    ("req 550e8400-e29b-41d4-a716-446655440000 failed", "req <uuid> failed"),
    ("token deadbeefcafe1234 expired", "token <hex> expired"),
    ("ts 1722945600 fired", "ts <n> fired"),
    ("id 12345678 done", "id <n> done"),
    ("id deadbeef01 done", "id <hex> done"),
    ("ü8 and 8ü", "ü<n> and <n>ü"),
    ("a_8 `x 9` v2", "a_8 <str> v2"),
]

# Raw text, without escapes, whether red.
ESCAPES = [
    ("plain log line", "plain log line", False),
    ("\x1b[91merror\x1b[0m done", "error done", True),
    ("t \x1b[31;1mred \x1b[35;1mnot", "t red not", True),
    ("\x1b[35;1mrecord not found", "record not found", False),
    ("\x1b[131mx\x1b[315my", "xy", False),
    ("\x1b[2Jcleared\x1b[10;20H", "cleared", False),
    ("tail\x1b[31;1", "tail", False),
    ("a\x1bcb", "ab", False),
    ("x\x1b", "x", False),
    ("", "", False),
]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_messages(spark):
    assert column(spark, [m for m, _ in MESSAGES], txt.normalize_message) == [n for _, n in MESSAGES]


def test_escapes(spark):
    assert column(spark, [e[0] for e in ESCAPES], txt.strip_ansi) == [e[1] for e in ESCAPES]
    logs = spark.createDataFrame([(i, e[0], {"k": "v"}) for i, e in enumerate(ESCAPES)], "i int, body string, attrs map<string,string>")
    got = [(r.body, r.attrs.get("ansi.red") == "true") for r in normalize.clean_bodies(logs).orderBy("i").collect()]
    assert got == [(e[1], e[2]) for e in ESCAPES]
    assert column(spark, ["\x1b[31mx\x1bc"], txt.strip_csi) == ["x\x1bc"]


def test_severities(spark):
    cases = {"trace": 0, " Debug ": 1, "INFO": 2, "warning": 3, "err": 4, "panic": 5, "critical": 5, "1": 0, "8": 1, "9": 2, "13": 3, "+17": 4, "24": 5, " 17 ": 2, "0": 2, "-3": 2, "x": 2, "": 2, "99999999999999999999": 2}
    assert column(spark, list(cases), sev.parse_severity) == list(cases.values())
    assert column(spark, [0, 5, 6], sev.severity_name, "int") == ["TRACE", "FATAL", "UNKNOWN"]
    assert sev.parse_severity_strict(" Err ") == 4 and sev.parse_severity_strict("") == 0
    with pytest.raises(ValueError):
        sev.parse_severity_strict("17")


def test_events_titles_fingerprints(spark):
    rows = [
        (1, 1, 4, "\tuser 4812 not found \nmore", {}),
        (2, 1, 4, "user 99 not found", {}),
        (3, 2, 4, "user 99 not found", {}),
        (4, 1, 2, "x", {"exception.type": "E", "exception.message": "id 7"}),
        (5, 1, 2, "", {"exception.type": "E", "exception.message": "id 8"}),
        (6, 1, 2, "x", {"exception.message": ""}),
        (7, 1, 5, "y" * 300, {txt.FINGERPRINT_KEY: "own"}),
        (8, 1, 5, "z", {txt.FINGERPRINT_KEY: "own"}),
    ]
    logs = spark.createDataFrame(rows, "log_id long, project_id long, severity int, body string, attrs map<string,string>")
    got = {r.log_id: r for r in normalize.annotate_events(logs).collect()}
    assert [got[i].is_event for i in range(1, 9)] == [True] * 5 + [False, True, True]
    assert got[1].title == "user 4812 not found" and got[4].title == "E: x" and got[5].title == "E" and len(got[7].title) == 200 and got[6].title == ""
    assert got[2].fingerprint != got[3].fingerprint and got[4].fingerprint == got[5].fingerprint and got[7].fingerprint == got[8].fingerprint


def test_panics(spark):
    logs = spark.createDataFrame([(2, " \tpanic: x"), (2, "fatal error: y"), (3, "panic: x"), (2, "a panic: x"), (2, "\npanic: x")], "severity int, body string")
    assert [r.severity for r in normalize.detect_panic_severity(logs).collect()] == [5, 5, 3, 2, 2]


def lifted(spark, body, severity=2, service="", attrs=None, trace="", project=1, projects=None):
    logs = spark.createDataFrame([(1, project, NOW, severity, body, service, trace, attrs)], LOG)
    return bodies.parse_bodies(logs, projects).head()


def test_json_bodies(spark):
    r = lifted(spark, ' {"msg":"hi","level":"error","time":"2024-05-01T13:00:00.5Z","service":"api","trace_id":"t","n":1.50,"e":1e3,"b":true,"z":null,"o":{"y":{"c":1,"a":[2]},"x":"s"}} ')
    assert (r.body, r.severity, r.service, r.trace_id) == ("hi", 4, "api", "t") and r.ts == datetime(2024, 5, 1, 13, 0, 0, 500000)
    assert r.attrs == {"n": "1.50", "e": "1e3", "b": "true", "z": "null", "o.x": "s", "o.y": '{"a":[2],"c":1}'}
    r = lifted(spark, '{"msg":"","message":"hi","level":17,"lvl":"x"}', attrs={"lvl": "own"})
    assert (r.body, r.severity, r.attrs) == ("hi", 4, {"lvl": "own"})
    r = lifted(spark, '{"msg":"a","message":"b","time":"2024-05-04T13:00:00Z","ts":5}')
    assert (r.body, r.ts, r.attrs) == ("a", NOW, {"message": "b", "ts": "5"})
    assert lifted(spark, '{"msg":7,"ts":1714568400000}').ts == datetime(2024, 5, 1, 13, 0, 0)
    assert lifted(spark, '{"level":"error","n":1}', severity=3).severity == 3
    assert lifted(spark, '{"msg":"x","service":"new"}', service="old").service == "old"
    r = lifted(spark, '{"msg":"x","level":{"a":1},"a":{"b":1},"a.b":2}')
    assert r.severity == 2 and r.attrs == {"a.b": "1"}
    for body in ('{"msg":"a"} {"msg":"b"}', '{"msg":"a"}x', '{"n":1}', "{}", '{"msg":NaN}', "{msg=a level=b}", "plain", '["msg"]'):
        assert lifted(spark, body).body == body
    many = {f"k{i:03d}": i for i in range(80)} | {"msg": "m", "long": "é" * 1500}
    r = lifted(spark, json.dumps(many), attrs={"k000": "own"})
    assert len(r.attrs) == 51 and r.attrs["k000"] == "own" and "k050" in r.attrs and "k051" not in r.attrs
    assert len(lifted(spark, json.dumps({"msg": "m", "long": "é" * 1500})).attrs["long"].encode()) == 2000


def test_logfmt_bodies(spark):
    r = lifted(spark, 'level=warn msg="slow \\"one\\"" user=5 user=6 empty=')
    assert (r.body, r.severity, r.attrs) == ('slow "one"', 3, {"user": "6", "empty": ""})
    assert lifted(spark, 'msg="a" level=error\t').severity == 4
    for body in ("msg=a", "msg=a msg=b", "msg=a word", 'msg=a level="x', "a=1 b=2", "msg=a\nlevel=error", 'ms"g=a level=b'):
        assert lifted(spark, body).body == body


def test_parse_gate(spark):
    projects = spark.createDataFrame([(1, False), (2, True)], "id long, parse_bodies boolean")
    body = '{"msg":"hi"}'
    assert [lifted(spark, body, project=p, projects=projects).body for p in (1, 2, 3)] == [body, "hi", "hi"]
    assert bodies.parse_bodies(spark.createDataFrame([(body,)], "body string"), enabled=False).head().body == body


def test_json_source(spark, tmp_path):
    rows = [
        {"message": "", "msg": "m", "severity": "ERR", "timestamp": "bad", "time": "2024-05-01T10:00:00.123456789+02:00", "service": "s", "attributes": {"a": 1, "b": "x", "c": True}},
        {"body": "b", "ts": 1714557600.9},
        {"severity": "nope"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"msg": "single", "severity": "17"}))
    got = {r.body: r for r in readers.read_json_logs(spark, str(tmp_path), 7, NOW).collect()}
    assert got["m"].severity == 4 and got["m"].ts == datetime(2024, 5, 1, 8, 0, 0, 123456) and got["m"].attrs == {"a": "1", "b": "x", "c": "true"}
    assert got["b"].ts == datetime(2024, 5, 1, 10, 0) and got[""].ts == NOW and got[""].severity == 2 and got["single"].severity == 4
    assert {r.project_id for r in got.values()} == {7}


def test_otlp_source(spark, tmp_path):
    text = lambda v: {"stringValue": v}
    record = {"timeUnixNano": "1714557600123456789", "severityNumber": 17, "severityText": "info", "body": text("boom"), "attributes": [{"key": "k", "value": {"intValue": "5"}}, {"key": "host", "value": text("own")}], "traceId": "00AB"}
    bare = {"severityText": "WARN", "body": {"arrayValue": {"values": [{"intValue": "1"}]}}, "traceId": "0000"}
    resource = {"attributes": [{"key": "service.name", "value": text("api")}, {"key": "service.version", "value": text("v1")}, {"key": "deployment.environment", "value": text("old")}, {"key": "deployment.environment.name", "value": text("prod")}, {"key": "host", "value": text("h")}]}
    (tmp_path / "a.json").write_text(json.dumps({"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": [record]}, {"logRecords": [bare]}]}, {"scopeLogs": [{"logRecords": [{"body": text("none")}]}]}]}))
    got = {r.severity: r for r in readers.read_otlp_json(spark, str(tmp_path), 3, NOW).collect()}
    assert got[4].ts == datetime(2024, 5, 1, 10, 0, 0, 123456) and (got[4].service, got[4].release, got[4].environment, got[4].trace_id) == ("api", "v1", "prod", "00ab")
    assert got[4].attrs == {"k": "5", "host": "own"} and got[4].body == "boom"
    assert got[3].body == '{"values":[{"intValue":"1"}]}' and got[3].trace_id == "" and got[3].ts == NOW and got[3].attrs == {"host": "h"}
    assert got[2].body == "none" and got[2].service == ""


def test_container_lines(spark):
    lines = spark.createDataFrame([("2024-05-01T10:00:00.5Z hello there",), ("hello there",), ("alone",), ("2024-05-01T10:00:00Z ",)], "text string")
    got = [(r.text, r.ts, r.unparsed) for r in readers.parse_container_lines(lines, NOW).collect()]
    assert got == [("hello there", datetime(2024, 5, 1, 10, 0, 0, 500000), False), ("hello there", NOW, True), ("alone", NOW, True), ("", datetime(2024, 5, 1, 10, 0, 0), False)]
    named = spark.createDataFrame([({"com.docker.swarm.service.name": "a.b"}, "n"), ({"com.docker.compose.service": "c d"}, "n"), ({}, "x/y"), (None, "ü")], "labels map<string,string>, name string")
    assert [r[0] for r in named.select(readers.container_service(F.col("labels"), F.col("name"))).collect()] == ["a_b", "c_d", "x_y", "_"]
    df = spark.createDataFrame([("a", {}), ("b", {}), ("c", {readers.IGNORE_LABEL: "true"})], "service string, labels map<string,string>")
    pick = lambda **k: sorted(r.service for r in readers.select_services(df, labels="labels", **k).collect())
    assert pick() == ["a", "b"] and pick(only=["a", "b", "c"], exclude=["b"]) == ["a"] and pick(exclude=["a"]) == ["b"]


def test_lines_corpus_and_sinks(spark, tmp_path):
    (tmp_path / "x.log").write_text("one\ntwo\n")
    assert sorted((r.text, r.service) for r in readers.read_lines(spark, str(tmp_path / "*.log"), "app").collect()) == [("one", "app"), ("two", "app")]
    (tmp_path / "c.json").write_text(json.dumps([{"ts": "2024-05-01T10:00:00Z", "severity": "ERROR", "service": "s", "body": "b", "attrs": '{"k":"v"}'}, {"ts": "?", "severity": "", "body": "c"}]))
    rows = {r.body: r for r in readers.read_corpus(spark, str(tmp_path / "c.json")).collect()}
    assert rows["b"].attrs == {"k": "v"} and rows["b"].severity == 4 and rows["c"].ts == datetime(1970, 1, 1)
    logs = readers.number_logs(readers.read_corpus(spark, str(tmp_path / "c.json"))).withColumn("project_id", F.lit(1))
    writers.write_logs(logs, str(tmp_path / "logs"))
    writers.write_logs(logs, str(tmp_path / "logs"))
    assert writers.read_logs(spark, str(tmp_path / "logs")).where("day = '2024-05-01'").count() == 2
    record = writers.to_ship_records(spark.createDataFrame([(NOW, "s", "a\nb")], "ts timestamp, service string, text string")).head().value
    assert json.loads(record) == {"timestamp": "2024-05-01T12:00:00.000000Z", "service": "s", "message": "a\nb"}


def test_since():
    now = datetime(2024, 5, 2, tzinfo=timezone.utc)
    assert parse_since("24h", now) == datetime(2024, 5, 1, tzinfo=timezone.utc) == parse_since("1d", now)
    assert parse_since("1h30m", now).hour == 22 and parse_since("", now) is None and parse_since("2024-05-01T02:00:00+02:00", now) == datetime(2024, 5, 1, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        parse_since("soon", now)


def test_rule_tables(spark):
    rules = spark.createDataFrame([], schema.NOISE_RULES)
    one = {"project_id": 1, "kind": "sample", "service": "", "severity": 1, "n": 3, "pattern": ""}
    rules = tables.upsert_rule(rules, one, schema.check_noise_rule)
    rules = tables.upsert_rule(rules, one | {"id": 1, "n": 5, "enabled": False}, schema.check_noise_rule)
    rules = tables.upsert_rule(rules, one | {"id": 1, "n": 6}, schema.check_noise_rule)
    rules = tables.upsert_rule(rules, one, schema.check_noise_rule)
    assert [(r.id, r.n, r.enabled, r.dropped_count) for r in rules.orderBy("id").collect()] == [(1, 6, False, 0), (2, 3, True, 0)]
    assert [r.id for r in tables.delete_rule(rules, 1).collect()] == [2]
    for bad in (lambda: tables.delete_rule(rules, 9), lambda: tables.upsert_rule(rules, one | {"id": 9})):
        with pytest.raises(LookupError):
            bad()
    projects = tables.create_project(spark.createDataFrame([], schema.PROJECTS), " My Shop ")
    assert projects.head().slug == "my-shop-1" and not tables.set_project_parse(projects, 1, False).head().parse_bodies


@pytest.mark.parametrize(
    ("check", "rule"),
    [
        (schema.check_noise_rule, {"kind": "severity_floor"}),
        (schema.check_noise_rule, {"kind": "drop_match", "pattern": ""}),
        (schema.check_noise_rule, {"kind": "sample", "severity": 1, "n": 1}),
        (schema.check_noise_rule, {"kind": "other"}),
        (schema.check_severity_rule, {"pattern": "(", "severity": 4}),
        (schema.check_severity_rule, {"pattern": "(?=x)", "severity": 4}),
        (schema.check_severity_rule, {"pattern": r"(a)\1", "severity": 4}),
        (schema.check_severity_rule, {"pattern": "a++", "severity": 4}),
        (schema.check_severity_rule, {"pattern": "a", "severity": 2}),
        (schema.check_alert_rule, {"kind": "new_issue", "url": "ftp://x"}),
        (schema.check_alert_rule, {"kind": "threshold", "url": "http://x", "n": 0, "window_minutes": 1}),
        (schema.check_alert_rule, {"kind": "new_issue", "url": "http://x", "cooldown_seconds": -1}),
        (schema.check_alert_rule, {"kind": "new_issue", "url": "http://x", "headers": {str(i): "" for i in range(33)}}),
    ],
)
def test_bad_rules(check, rule):
    with pytest.raises(ValueError):
        check(rule)


def test_good_rules():
    schema.check_noise_rule({"kind": "sample", "severity": 1, "n": 2})
    schema.check_severity_rule({"pattern": "a+?|[0-9]{2}", "severity": "error"})
    schema.check_alert_rule({"kind": "threshold", "url": "https://x/y", "n": 1, "window_minutes": 1})
