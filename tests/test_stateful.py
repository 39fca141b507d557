"""Order-dependent operators, batch and streaming, against folds one row at a time."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.operators import alerts, issues, multiline, normalize, retention, rollups, rules, search, templates
from emberlog.plans import views
from emberlog.streaming import state

START = datetime(2024, 5, 1, 10, 0, 0)
SLIM = "log_id long, project_id long, ts timestamp, severity int, body string, service string, environment string"


def some_logs(spark, rng, n, first=1):
    rows = [(first + i, rng.randint(1, 2), START + timedelta(seconds=rng.randint(0, 50) + 20 * i), rng.randint(0, 5), rng.choice(["alpha beta", "gamma 7", "delta"]), rng.choice(["a", "b"]), "prod") for i in range(n)]
    return rows, spark.createDataFrame(rows, SLIM).repartition(3)


NOISE = [
    (1, 1, "severity_floor", "a", 1, "", 0, True, 0),
    (2, 0, "sample", "", 3, "", 3, True, 0),
    (3, 1, "drop_match", "", None, "gamma", 0, True, 0),
    (4, 2, "sample", "b", 5, "", 2, True, 0),
    (5, 1, "sample", "", 5, "", 1, True, 0),
    (6, 2, "drop_match", "", None, "delta", 0, False, 0),
    (7, 2, "strange", "", None, "delta", 0, True, 0),
    (8, 1, "sample", "", 5, "", 4, True, 0),
]


def plain_noise(rows, by_project=False):
    seen, out = {}, {}
    for r in sorted(rows):
        out[r[0]] = None
        for i, project, kind, service, level, pattern, n, on, _ in NOISE:
            if not on or (project and project != r[1]) or (service and service != r[5]):
                continue
            if kind == "severity_floor" and r[3] < level or kind == "drop_match" and pattern in r[4]:
                out[r[0]] = i
            elif kind == "sample" and n > 1 and r[3] <= level:
                key = (i, r[1]) if by_project else i
                seen[key] = seen.get(key, -1) + 1
                if seen[key] % n:
                    out[r[0]] = i
            if out[r[0]]:
                break
    return out


def test_noise_rules(spark):
    rng = random.Random(1)
    rows, logs = some_logs(spark, rng, 300)
    rows += [(r[0] + 200_000, *r[1:]) for r in rows]
    logs = logs.unionByName(logs.withColumn("log_id", F.col("log_id") + 200_000))
    table = spark.createDataFrame(NOISE, schema.NOISE_RULES)
    assert {r.log_id: r.drop_rule_id for r in rules.mark_noise(logs, table).collect()} == plain_noise(rows)
    kept, drops = rules.apply_noise_rules(logs, table)
    dropped = [v for v in plain_noise(rows).values() if v]
    assert kept.count() == len(rows) - len(dropped) and {r.rule_id: r.dropped for r in drops.collect()} == {k: dropped.count(k) for k in set(dropped)}
    counted = rules.add_counts(table, drops.union(spark.createDataFrame([(99, 5)], "rule_id long, dropped long")), "dropped_count")
    assert sum(r.dropped_count for r in counted.collect()) == len(dropped) and counted.count() == len(NOISE)


def test_noise_rules_that_sample_out_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(rules, "MAX_IDS", 0)
    rows, logs = some_logs(spark, random.Random(3), 300)
    found = rules.mark_noise(logs, spark.createDataFrame(NOISE, schema.NOISE_RULES))
    assert sorted((r.log_id, r.drop_rule_id or 0) for r in found.collect()) == sorted((k, v or 0) for k, v in plain_noise(rows).items())


def test_sample_keeps_first_and_every_nth(spark):
    logs = spark.createDataFrame([(i, 1, START, 1, f"r{i}", "a", "") for i in range(9)], SLIM)
    table = spark.createDataFrame([(1, 1, "sample", "", 1, "", 3, True, 0)], schema.NOISE_RULES)
    assert sorted(r.body for r in rules.apply_noise_rules(logs, table)[0].collect()) == ["r0", "r3", "r6"]


def test_severity_rules(spark):
    logs = spark.createDataFrame([(1, 1, START, 2, "disk full", "a", ""), (2, 1, START, 3, "disk full", "a", ""), (3, 2, START, 0, "disk full", "a", ""), (4, 1, START, 2, "ok", "b", "")], SLIM)
    table = spark.createDataFrame([(2, 0, "", "disk", 5, True, 0), (1, 1, "a", "full$", 4, True, 0), (3, 1, "b", "(", 5, True, 0)], schema.SEVERITY_RULES)
    out, lifts = rules.apply_severity_rules(logs, table)
    assert {r.log_id: (r.severity, r.lift_rule_id) for r in out.collect()} == {1: (4, 1), 2: (3, None), 3: (5, 2), 4: (2, None)}
    assert {r.rule_id: r.lifted for r in lifts.collect()} == {1: 1, 2: 1}


def history(rng, n):
    """Random events and actions of a few issues, on one scale."""
    events, actions, last = [], [], {}
    for seq in range(1, n):
        key = (1, f"f{rng.randint(0, 5)}")
        if rng.random() < 0.6:
            events.append((*key, seq, START + timedelta(seconds=rng.randint(0, 500)), f"t{seq}", 4, rng.choice(["prod", "dev"]), "v1"))
            last[key] = seq
        else:
            actions.append((*key, rng.choice(schema.STATUSES), seq))
    return events, actions


def plain_issues(events, actions):
    issue, outcome = {}, {}
    merged = sorted([(e[2], 0, e) for e in events] + [(a[3], 1, a) for a in actions], key=lambda x: x[:2])
    for _, kind, x in merged:
        key = x[:2]
        if kind:
            if key in issue:
                issue[key]["status"] = x[2]
            continue
        old = issue.get(key)
        outcome[x[2]] = (old is None, bool(old) and old["status"] == "resolved")
        if old is None:
            issue[key] = {"status": "open", "count": 1, "first": x[3], "last": x[3], "title": x[4]}
        else:
            old.update(status="open" if old["status"] == "resolved" else old["status"], count=old["count"] + 1, last=x[3])
    return issue, outcome


EVENTS = "project_id long, fingerprint string, log_id long, ts timestamp, title string, severity int, environment string, release string"


def test_issues(spark):
    for seed in range(3):
        events, actions = history(random.Random(seed), 120)
        df, acts = spark.createDataFrame(events, EVENTS).repartition(3), spark.createDataFrame(actions, schema.ISSUE_ACTIONS)
        expected, outcome = plain_issues(events, actions)
        got = {(r.project_id, r.fingerprint): {"status": r.status, "count": r["count"], "first": r.first_seen, "last": r.last_seen, "title": r.title} for r in issues.build_issues(df, acts).collect()}
        assert got == expected
        assert {r.log_id: (r.is_new, r.is_reopened) for r in issues.issue_outcomes(df, acts).collect()} == outcome
    with pytest.raises(ValueError):
        issues.set_issue_status(acts, 1, "f1", "shut", 9)
    assert issues.set_issue_status(acts, 1, "f1", "resolved", 999).count() == len(actions) + 1


def test_samples_and_detail(spark):
    rows = [(1, "f", i, START + timedelta(minutes=i // 2), "t", 4, "dev" if i == 9 else "prod", f"v{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, EVENTS)
    samples = issues.issue_samples(df)
    assert sorted(r.log_id for r in samples.collect()) == list(range(10, 60))
    found = issues.build_issues(df)
    assert issues.list_issues(found, samples, env="prod").count() == 1 and issues.list_issues(found, samples, env="dev").count() == 0
    assert issues.list_issues(found, status="resolved").count() == 0 and issues.list_issues(found, project=2).count() == 0
    logs = df.where("log_id < 58").select("log_id", "ts", "title", F.lit("b").alias("body"), F.lit("s").alias("service"), "environment", "release")
    detail = issues.issue_detail(found, samples, logs, 1, "f").collect()
    assert len(detail) == 50 and detail[0].log_id == 59 and detail[0].body is None and detail[2].body == "b"
    with pytest.raises(LookupError):
        issues.issue_detail(found, samples, logs, 1, "g")
    tags = issues.issue_tags(samples).head()
    assert tags.environments == ["prod"] and tags.releases == ["v0", "v1"]
    assert [r.n for r in issues.issue_histogram(samples, "2024-05-02").orderBy("day").collect()] == [0, 0, 0, 0, 0, 50, 0]
    assert issues.newest_sample(samples.withColumn("body", F.lit("b"))).head().log_id == 59 and issues.prune_samples(samples, START + timedelta(minutes=20)).count() == 20


RULES = [
    (1, 1, "t", "threshold", "", "", 0, 3, 1, 0, "", None, True, None, ""),
    (2, 1, "n", "new_issue", "", "", 0, 1, 1, 0, "", None, True, None, ""),
    (3, 1, "r", "regression", "", "prod", 0, 1, 1, 60, "", None, True, None, ""),
    (4, 1, "w", "threshold", "", "", 4, 2, 5, 120, "", None, True, START, ""),
    (5, 1, "off", "new_issue", "", "", 0, 1, 1, 0, "", None, False, None, ""),
    (6, 2, "p", "new_issue", "", "", 0, 1, 1, 0, "", None, True, None, ""),
]


def plain_alerts(events):
    fires = []
    for rule in (r for r in RULES if r[12]):
        last, minutes = rule[13], {}
        for e in sorted(events, key=lambda e: e["log_id"]):
            if e["project_id"] != rule[1] or (rule[5] and rule[5] != e["environment"]) or e["severity"] < rule[6]:
                continue
            minute = int(e["ts"].timestamp()) // 60
            if rule[3] == "threshold":
                minutes[minute] = minutes.get(minute, 0) + 1
                due = sum(n for m, n in minutes.items() if minute - rule[8] < m <= minute) >= rule[7]
            else:
                due = e["is_new"] if rule[3] == "new_issue" else e["is_reopened"]
            if due and (last is None or (e["ts"] - last).total_seconds() >= rule[9]):
                last = e["ts"]
                fires.append((rule[0], e["log_id"]))
    return sorted(fires)


def alert_events(rng, n):
    t, out = START, []
    for i in range(n):
        t += timedelta(seconds=rng.choice([0, 1, 10, 40, 200]))
        out.append({"log_id": i, "project_id": 1, "fingerprint": f"f{i % 7}", "title": "t", "severity": rng.randint(3, 5), "ts": t, "service": "s", "environment": rng.choice(["prod", "dev"]), "is_event": True, "is_new": rng.random() < 0.2, "is_reopened": rng.random() < 0.3})
    return out


OUTCOMES = "log_id long, project_id long, fingerprint string, title string, severity int, ts timestamp, service string, environment string, is_event boolean, is_new boolean, is_reopened boolean"


def test_alerts(spark):
    table = spark.createDataFrame(RULES, schema.ALERT_RULES)
    for seed in range(3):
        events = alert_events(random.Random(seed), 120)
        fires = alerts.evaluate_alerts(spark.createDataFrame(events, OUTCOMES).repartition(3), table)
        assert sorted((r.rule_id, r.log_id) for r in fires.collect()) == plain_alerts(events)
    payloads = alerts.alert_payloads(fires, START).collect()
    assert '"fired_at":"2024-05-01T10:00:00Z"' in payloads[0].payload and '"severity":"' in payloads[0].payload
    assert all(('"event_count"' in p.payload) == (p.rule_id in (1, 4)) for p in payloads)
    assert '"test":true' in alerts.test_payload(spark, table.where("id = 1").head(), START).head().payload

    def send(rule, payload):
        if rule == 2:
            raise RuntimeError("refused")

    results = alerts.deliver(alerts.alert_payloads(fires, START), send)
    assert {(r.rule_id == 2) == (r.error == "refused") for r in results.collect()} == {True}
    after = {r.id: r for r in alerts.record_deliveries(table, results, fires).collect()}
    assert after[2].last_error == "refused" and after[1].last_error == "" and after[1].last_fired > START and after[6].last_fired is None


@pytest.mark.parametrize("late", [0, 40, 100_000])
def test_cooldown_of_one_busy_rule(spark, late, monkeypatch):
    """Against the fold, with candidates out of order by up to ``late`` seconds, chunks and slices smaller than a cooldown's worth."""
    rng = random.Random(late)
    monkeypatch.setattr(alerts, "SLICE", 50)
    rows, last = [], {1: None, 2: START - timedelta(seconds=100), 3: START + timedelta(seconds=5_000)}
    for rule in (1, 2, 3):
        at = 0
        for i in range(400):
            at += rng.choice([0, 1, 1, 5, 30, 700])
            rows.append((rule, 1000 * rule + i, START + timedelta(seconds=at - rng.randint(0, late)), {1: 60, 2: 90, 3: 4_000}[rule], last[rule]))
    want = []
    for rule in (1, 2, 3):
        fired = last[rule]
        for _, log_id, ts, cooldown, _ in (r for r in rows if r[0] == rule):
            if fired is None or ts - fired >= timedelta(seconds=cooldown):
                fired = ts
                want.append((rule, log_id))
    rows += [(4, 9_000 + i, START, 0, None) for i in range(3)]
    table = spark.createDataFrame(rows, "rule_id long, log_id long, ts timestamp, rule_cooldown int, rule_last_fired timestamp").repartition(3)
    for span in (60, 3600):
        got = alerts.apply_cooldown(table, span).collect()
        assert sorted((r.rule_id, r.log_id) for r in got) == want + [(4, 9_000), (4, 9_001), (4, 9_002)]


def test_threshold_and_cooldown_goldens(spark):
    at = [0, 10, 20, 300]
    events = [dict(alert_events(random.Random(0), 1)[0], log_id=i, severity=5, ts=START + timedelta(seconds=s), is_new=False, is_reopened=False) for i, s in enumerate(at)]
    table = spark.createDataFrame([(1, 1, "t", "threshold", "", "", 0, 3, 1, 0, "", None, True, None, "")], schema.ALERT_RULES)
    assert [r.log_id for r in alerts.evaluate_alerts(spark.createDataFrame(events, OUTCOMES), table).collect()] == [2]
    events = [dict(e, ts=START + timedelta(seconds=s), is_new=True) for e, s in zip(events, [0, 30, 61])]
    table = spark.createDataFrame([(1, 1, "n", "new_issue", "", "", 0, 1, 1, 60, "", None, True, None, "")], schema.ALERT_RULES)
    assert sorted(r.log_id for r in alerts.evaluate_alerts(spark.createDataFrame(events, OUTCOMES), table).collect()) == [0, 2]


def plain_join(lines, cap):
    """Records of one session."""
    records, crashing, size = [], False, 0
    for text in lines:
        header = bool(re.match(multiline.CRASH, text))
        joins = bool(records) and not header and (crashing or bool(re.match(multiline.CONTINUATION, text)))
        if joins and size + 1 + len(text.encode()) > cap:
            joins, header = False, False
        if joins:
            records[-1].append(text)
            size += 1 + len(text.encode())
        else:
            records.append([text])
            crashing, size = header, len(text.encode())
    return ["\n".join(r) for r in records]


@pytest.mark.parametrize("cap", [10**6, 40])
def test_multiline(spark, tmp_path, cap):
    rng = random.Random(cap)
    kinds = ["plain line", "  indented", "\ttab", "at com.x.Y", "Caused by: z", "... 12 more", "panic: boom", "fatal error: x", "goroutine 7 [running]:", "main.go:5 +0x1", "", "atlas"]
    rows, expected = [], []
    for source in range(12):
        lines = [rng.choice(kinds) for _ in range(rng.randint(1, 25))]
        gaps = [i for i in range(1, len(lines)) if rng.random() < 0.15]
        seconds, cut = 0, 0
        for i, line in enumerate(lines):
            seconds += 5 if i in gaps else 1
            rows.append((f"s{source}", "svc", i, START + timedelta(seconds=seconds), line))
        for end in [*gaps, len(lines)]:
            expected += [(f"s{source}", r) for r in plain_join(lines[cut:end], cap)]
            cut = end
    lines = spark.createDataFrame(rows, schema.LINES).repartition(3)
    for slice_size in (multiline.SLICE, 3):
        got = multiline.join_multiline(lines, max_bytes=cap, slice_size=slice_size).collect()
        assert sorted((r.source, r.text) for r in got) == sorted(expected)
        assert sum(r.lines for r in got) == len(rows)
    # The same lines as a stream, whose batches cut records.
    for k in range(4):
        lines.where(f"seq div 7 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert multiline.stream_records(spark, f"{tmp_path}/out").count() == 0
    into = multiline.join_stream(f"{tmp_path}/out", max_bytes=cap)
    stream.writeStream.foreachBatch(into).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    again = lines.where("seq div 7 = 3")
    into(again, 3)  # as after a failure
    assert sorted((r.source, r.text) for r in multiline.stream_records(spark, f"{tmp_path}/out").collect()) == sorted(expected)
    complete = multiline.stream_records(spark, f"{tmp_path}/out", with_open=False)
    assert complete.count() == len(expected) - 12


def test_multiline_odd_lines(spark, tmp_path):
    rows = [(None, "a", 1, START, "x"), (None, "b", 2, START, "  y"), ("s", "a", 5, START, None), ("s", "a", 6, None, " z"), ("s", "a", 90_000, START, "\tw"), ("t", "a", 1, START, "panic: " + "p" * 60), ("t", "a", 2, START, " q"), ("t", "a", 3, START, "r")]
    lines = spark.createDataFrame(rows, schema.LINES)
    got = sorted(((r.source, r.service, r.seq, r.text, r.lines) for r in multiline.join_multiline(lines, max_bytes=50).collect()), key=repr)
    assert got == sorted([(None, "a", 1, "x\n  y", 2), ("s", "a", 5, "\n z\n\tw", 3), ("t", "a", 1, rows[5][4], 1), ("t", "a", 2, " q", 1), ("t", "a", 3, "r", 1)], key=repr)
    assert multiline.join_multiline(lines.limit(0)).count() == 0
    # A source that is silent for long is complete without a further line.
    into = multiline.join_stream(str(tmp_path), idle="10 seconds")
    into(lines.where("source = 't'"), 0)
    assert multiline.stream_records(spark, str(tmp_path), with_open=False).count() == 0
    into(spark.createDataFrame([("u", "a", 1, START + timedelta(seconds=60), "new")], schema.LINES), 1)
    assert [r.source for r in multiline.stream_records(spark, str(tmp_path), with_open=False).collect()] == ["t"]
    assert sorted(r.source for r in multiline.stream_records(spark, str(tmp_path)).collect()) == ["t", "u"]


def plain_templates(bodies):
    """Templates in order of arrival, and each body's template."""
    held, out = {}, []
    for body in bodies:
        if not body or "\n" in body or "\0" in body or len(body.split(" ")) > 200:
            out.append(None)
            continue
        tokens = body.split(" ")
        key = (len(tokens), "\0" if re.search("[0-9]", tokens[0]) else tokens[0])
        best, score = None, 0
        for t in held.setdefault(key, []):
            same = sum(a in ("\0", b) for a, b in zip(t, tokens))
            if same > score:
                best, score = t, same
        if best is None or score / len(tokens) < 0.5:
            held[key].append(best := list(tokens))
        elif score < len(tokens):
            held[key].append(best := [a if a == b else "\0" for a, b in zip(best, tokens)])
        out.append(best)
    return out


def test_templates(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    bodies = [" ".join(rng.choice(["get", "put", "user", f"{rng.randint(0, 9)}", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(250)] + ["", "a\nb", "nul\0", " ".join(["w"] * 201), "get  two", None]
    logs = spark.createDataFrame([(i, 1 + i % 2, b) for i, b in enumerate(bodies)], "log_id long, project_id long, body string").repartition(3)
    mined, encoded = templates.mine_templates(logs)
    tokens = {(r.project_id, r.template_id): r.tokens for r in mined.collect()}
    got = {r.log_id: r for r in encoded.collect()}
    for project in (1, 2):
        mine = [i for i in range(len(bodies)) if 1 + i % 2 == project]
        for i, expected in zip(mine, plain_templates([bodies[i] for i in mine])):
            assert tokens.get((project, got[i].template_id)) == expected
    assert {r.log_id: r.body for r in templates.reconstruct(encoded, mined).collect()} == dict(enumerate(bodies))
    for q in ("get", "er 3", "t p", "b"):
        assert sorted(r.log_id for r in templates.search_encoded(encoded, mined, q).collect()) == [i for i, b in enumerate(bodies) if b and q in b]
    templates.append_templates(logs, f"{tmp_path}/search", 0)
    for q in ("get", "er 3", "t p", "get  two", "user get x", "b", "a\nb", "zz zz"):
        assert sorted(r.log_id for r in templates.search_stored(spark, f"{tmp_path}/search", q).collect()) == [i for i, b in enumerate(bodies) if b and q in b], q
    may = {(r.project_id, r.template_id): r.sure for r in templates.templates_that_may_hold(mined, "user get x").collect()}
    assert 0 < len(may) < len(tokens)
    sure = {(r.project_id, r.template_id) for r in templates.templates_containing(mined, "get").collect()}
    assert sure == {k for k, t in tokens.items() if any("get" in run for run in " ".join(t).split("\0"))}
    # In rounds, in batches in turn and in a stream: row for row the same.
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = rows_of(mined), rows_of(encoded)
    monkeypatch.setattr(templates, "TOGETHER", 7)
    for in_order in (1, 4, 20):
        again = templates.mine_templates(logs, in_order=in_order)
        assert (rows_of(again[0]), rows_of(again[1])) == whole
    path = str(tmp_path)
    for epoch, (low, high) in enumerate([(0, 60), (60, 61), (61, 61), (61, 400)]):
        batch = logs.where(f"log_id >= {low} and log_id < {high}")
        templates.append_templates(batch, f"{path}/turns", epoch)
        templates.append_templates(batch, f"{path}/turns", epoch)  # as after a failure
    assert (rows_of(templates.stored_templates(spark, f"{path}/turns")), rows_of(templates.encoded_logs(spark, f"{path}/turns"))) == whole
    for k in range(3):
        logs.where(f"log_id % 300 div 100 = {k}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream.writeStream.foreachBatch(templates.mine_stream(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    assert (rows_of(templates.stored_templates(spark, f"{path}/out")), rows_of(templates.encoded_logs(spark, f"{path}/out"))) == whole
    first, _ = templates.mine_templates(logs.where("log_id < 60"), cap=4)
    both, _ = templates.mine_templates(logs.where("log_id >= 60"), cap=4, stored=first)
    assert rows_of(first.unionByName(both)) == rows_of(templates.mine_templates(logs, cap=4)[0])
    few, capped = templates.mine_templates(logs, cap=3)
    assert few.count() == 6 and {r.log_id: r.body for r in templates.reconstruct(capped, few).collect()} == dict(enumerate(bodies))
    report = templates.template_report(encoded, mined).head()
    assert report.rows == len(bodies) and report.raw_rows == 5 and report.templates == len(tokens)


def test_rollup_bounds(spark):
    at = lambda h, m: datetime(2024, 5, 1, h, m)
    logs = spark.createDataFrame([(1, t, s, 4) for t, s in ((at(10, 15), "api"), (at(10, 45), "api"), (at(12, 30), "web"), (at(13, 5), "web"))], "project_id long, ts timestamp, service string, severity int")
    rolled = rollups.rollup(logs)
    assert sum(r.logs for r in rollups.aggregate(rolled, 1, "service", at(10, 30), at(12, 10)).collect()) == 3
    assert [r.key for r in rollups.aggregate(rolled, 1, "hour").collect()] == ["2024-05-01T10", "2024-05-01T12", "2024-05-01T13"]
    for bad in (lambda: rollups.aggregate(rolled, 1, "body"), lambda: rollups.aggregate(rolled, 0, "day")):
        with pytest.raises(ValueError):
            bad()


def test_context(spark):
    logs = spark.createDataFrame([(i, 1, START + timedelta(seconds=i // 3), 1, "b", "a", "") for i in range(40)], SLIM)
    assert [r.log_id for r in search.log_context(logs, 20, 3).collect()] == list(range(17, 24))
    assert [r.log_id for r in search.log_context(logs, 0, 0).collect()] == [0]
    assert [r.log_id for r in search.log_context(logs, 39, 2).collect()] == [37, 38, 39]
    with pytest.raises(LookupError):
        search.log_context(logs, 99)
    assert search.search_logs(logs).count() == 50 - 10 and search.search_logs(logs, query="%").count() == 0


def test_compaction(spark, tmp_path):
    logs = spark.createDataFrame([(i, START + timedelta(seconds=(i * 7) % 50)) for i in range(50)], "log_id long, ts timestamp").repartition(9)
    logs.write.parquet(str(tmp_path / "day"))
    assert retention.compact_day(spark, str(tmp_path / "day"), str(tmp_path / "new"), 20) == 3
    assert len(list((tmp_path / "new").glob("*.parquet"))) == 3 and spark.read.parquet(str(tmp_path / "new")).count() == 50
    assert retention.table_bytes(spark, str(tmp_path / "new")) > 0
    partitions = spark.createDataFrame([(1, "2024-04-01"), (1, "2024-05-01"), (2, "2020-01-01")], "project_id long, day string")
    projects = spark.createDataFrame([(1, 7), (2, 0)], "id long, retention_days int")
    assert [(r.project_id, r.day) for r in retention.expired_days(partitions, projects, START).collect()] == [(1, "2024-04-01")]


def streamed(spark, df, tmp_path, name, build, parts=3):
    """``build`` over ``df`` as a stream of files in order of log_id."""
    rows = df.orderBy("log_id").collect()
    size = -(-len(rows) // parts)
    source = tmp_path / name
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(source))
        target = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
        query = target.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).option("path", str(tmp_path / f"{name}-out")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def in_batches(spark, df, path, into, parts=3):
    """``df`` as a stream of so many batches by log_id."""
    last = df.agg(F.max("log_id")).head()[0] + 1
    for k in range(parts):
        df.where(f"log_id * {parts} div {last} = {k}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream.writeStream.foreachBatch(into).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def test_streaming_noise(spark, tmp_path):
    rows, logs = some_logs(spark, random.Random(11), 120)
    into = state.noise_stream(f"{tmp_path}/out", spark.createDataFrame(NOISE, schema.NOISE_RULES))
    in_batches(spark, logs, tmp_path, into)
    last = logs.agg(F.max("log_id")).head()[0] + 1
    into(logs.where(f"log_id * 3 div {last} = 2"), 2)  # as after a failure
    assert {r.log_id: r.drop_rule_id for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()} == plain_noise(rows)


def test_streaming_samples(spark, tmp_path):
    events, _ = history(random.Random(14), 300)
    df = spark.createDataFrame(events, EVENTS)
    want = sorted((r.project_id, r.fingerprint, r.log_id, r["rank"]) for r in issues.issue_samples(df, 7).collect())
    in_batches(spark, df, tmp_path, state.samples_stream(f"{tmp_path}/out", 7), 4)
    found = lambda: sorted((r.project_id, r.fingerprint, r.log_id, r["rank"]) for r in state.stream_samples(spark, f"{tmp_path}/out", 7).collect())
    assert found() == want
    state.merge_samples(spark, f"{tmp_path}/out", 2, 7)
    assert found() == want and len(list((tmp_path / "out").glob("epoch=*"))) == 2
    middle = sorted(e[-1] if isinstance(e[-1], datetime) else START for e in events)[150]
    kept = state.stream_samples(spark, f"{tmp_path}/out", 7, cutoff=middle)
    assert kept.count() == issues.prune_samples(issues.issue_samples(df, 7), middle).count()


def test_streaming_issues(spark, tmp_path):
    events, _ = history(random.Random(12), 100)
    df = spark.createDataFrame(events, EVENTS)
    got = streamed(spark, df, tmp_path, "issues", state.stream_issues).collect()
    _, outcome = plain_issues(events, [])
    assert {r.log_id: (r.is_new, r.is_reopened) for r in got} == outcome
    assert max(r["count"] for r in got) == max(sum(e[1] == f"f{k}" for e in events) for k in range(6))


def test_streaming_alerts(spark, tmp_path):
    events = alert_events(random.Random(13), 90)
    table = spark.createDataFrame(RULES, schema.ALERT_RULES)
    got = streamed(spark, spark.createDataFrame(events, OUTCOMES), tmp_path, "alerts", lambda s: state.stream_alerts(s, table))
    assert sorted((r.rule_id, r.log_id) for r in got.collect()) == plain_alerts(events)


def test_streaming_rollups(spark, small, tmp_path):
    logs = views.logs_with_attrs(spark, small).withColumn("ts", F.col("ts").cast("timestamp"))
    logs.repartition(3).write.parquet(str(tmp_path / "src"))
    source = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    run = state.append_and_roll(str(tmp_path / "logs"), str(tmp_path / "rollups"))
    query = state.stream_normalize(source).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    rolled = spark.read.parquet(str(tmp_path / "rollups")).drop("epoch")
    merged = rollups.merge_rollups(rolled.limit(0), rolled)
    direct = rollups.rollup(normalize.normalize(logs))
    assert sorted(map(tuple, merged.select(direct.columns).collect())) == sorted(map(tuple, direct.collect()))
    assert spark.read.parquet(str(tmp_path / "logs")).count() == logs.count()
    again = logs.limit(5)
    for _ in range(2):  # a batch that is tried twice is stored once
        run(normalize.normalize(again), 900)
    assert spark.read.parquet(str(tmp_path / "logs")).count() == logs.count() + 5
    assert spark.read.parquet(str(tmp_path / "rollups")).where("epoch = 900").agg({"logs": "sum"}).head()[0] == 5
