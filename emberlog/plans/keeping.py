"""Queries on what is kept: rule and project tables, deliveries, stored logs and rollups, streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from emberlog.operators import alerts, bodies, issues, normalize, retention, rollups, rules, tables
from emberlog.plans import views
from emberlog.plans.intake import _STREAM_CHAIN
from emberlog.plans.queries import _FOLD, _LIFT, _NOISE, _WITH, ORACLES, SINCE, UNTIL, _events, _fires, query
from emberlog.schema import check_alert_rule, check_noise_rule, check_severity_rule, rejections
from emberlog.sources import logtable, readers, writers
from emberlog.streaming import state

# --- tables edited by hand, and what they then do ----------------------------------------

_EDITED = _NOISE.replace("WHEN project_id = 1 AND service = 'svc1' AND severity < 2 THEN 1 WHEN project_id = 2 AND contains(body, '/items/1') THEN 2 END", "WHEN project_id = 2 AND contains(body, '/items/2') THEN 2 END")


@query(_EDITED + """SELECT drop_rule_id AS rule_id, count(*) AS dropped FROM marked WHERE drop_rule_id IS NOT NULL GROUP BY 1
UNION ALL SELECT 6, count(*) FROM logs WHERE project_id = 1 AND contains(body, 'signup')""")
def noise_rules_edited(spark, sf_dir):
    """A noise rule deleted, one changed, one added; then the records each drops."""
    table = tables.delete_rule(views.noise_rules(spark), 1)
    table = tables.upsert_rule(table, {"id": 2, "project_id": 2, "kind": "drop_match", "service": "", "pattern": "/items/2"}, check_noise_rule)
    table = tables.upsert_rule(table, {"project_id": 1, "kind": "drop_match", "service": "", "pattern": "signup"}, check_noise_rule)
    return rules.apply_noise_rules(views.logs(spark, sf_dir), table)[1]


_LIFT_EDITED = _LIFT.replace(" END", " WHEN project_id = 1 AND regexp_matches(body, '[0-9]') THEN 3 END")


@query(f"SELECT cast(lift AS bigint) AS rule_id, count(*) AS lifted FROM (SELECT {_LIFT_EDITED} AS lift FROM logs) WHERE lift IS NOT NULL GROUP BY 1")
def severity_rules_edited(spark, sf_dir):
    """A severity rule switched on; then the records each lifts."""
    table = tables.upsert_rule(views.severity_rules(spark), {"id": 3, "project_id": 1, "pattern": "[0-9]", "severity": 5, "enabled": True}, check_severity_rule)
    return rules.apply_severity_rules(views.logs(spark, sf_dir), table)[1]


@query("SELECT cast(2 AS bigint) AS rule_id, first_id AS log_id, 'renamed' AS name FROM groups WHERE project_id = 2")
def alert_rules_edited(spark, sf_dir):
    """One alert rule renamed, the others deleted; then its fires."""
    table = views.alert_rules(spark)
    for rule_id in (1, 3, 4):
        table = tables.delete_rule(table, rule_id)
    table = tables.upsert_rule(table, {"id": 2, "project_id": 2, "name": "renamed", "kind": "new_issue", "service": "", "environment": "", "min_severity": 4, "n": 1, "window_minutes": 1, "cooldown_seconds": 0, "url": "https://example.org/hook"}, check_alert_rule)
    return alerts.evaluate_alerts(issues.issue_outcomes(_events(spark, sf_dir)), table).select("rule_id", "log_id", F.col("rule_name").alias("name"))


@query("SELECT project_id, count(*) AS parsed FROM logs WHERE project_id = 3 AND (body LIKE 'level=warn%' OR body LIKE '{%') GROUP BY 1")
def projects_edited(spark, sf_dir):
    """A project added, parsing switched off for another; then the bodies that were lifted."""
    table = tables.set_project_parse(tables.create_project(views.projects(spark), "New One"), 1, False)
    logs = views.logs_with_attrs(spark, sf_dir).withColumn("before", F.col("body"))
    return bodies.parse_bodies(logs, table).where("body <> before").groupBy("project_id").agg(F.count("*").alias("parsed"))


@query(""", top AS (SELECT project_id, fingerprint FROM groups ORDER BY count DESC, project_id, fingerprint LIMIT 1)
SELECT s.project_id, s.fingerprint, CASE WHEN top.fingerprint IS NULL THEN status ELSE 'ignored' END AS status FROM states s LEFT JOIN top USING (project_id, fingerprint)""")
def issue_status_set(spark, sf_dir):
    """The largest issue set to ignored after its last event; all statuses."""
    events = _events(spark, sf_dir)
    groups = issues.issue_groups(events)
    top = groups.orderBy(F.desc("count"), "project_id", "fingerprint").head()
    actions = issues.set_issue_status(views.actions(groups), top["project_id"], top["fingerprint"], "ignored", top["last_id"])
    return issues.build_issues(events, actions).select("project_id", "fingerprint", "status")


@query("SELECT project_id, fingerprint, log_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY ts DESC, log_id DESC) AS rank FROM ev) WHERE rank <= 50 AND ts >= timestamp '2024-01-25 00:00:00'")
def pruned_samples(spark, sf_dir):
    samples = issues.issue_samples(_events(spark, sf_dir))
    return issues.prune_samples(samples, "2024-01-25 00:00:00").select("project_id", "fingerprint", "log_id")


# --- deliveries --------------------------------------------------------------------------


def _send(rule_id: int, payload: str) -> None:
    """A transport that refuses one rule's payloads."""
    if rule_id == 3:
        raise OSError("refused")


@query()
def delivered_alerts(spark, sf_dir):
    """All fires delivered, and what the rule table then says."""
    table, fires = views.alert_rules(spark), _fires(spark, sf_dir)
    results = alerts.deliver(alerts.alert_payloads(fires, "2024-02-01 00:00:00"), _send)
    recorded = alerts.record_deliveries(table, results, fires)
    return recorded.select("id", "last_error", F.date_format("last_fired", "yyyy-MM-dd HH:mm:ss").alias("last_fired"))


def _recursive(sql: str) -> str:
    return (_WITH + sql).replace("WITH logs", "WITH RECURSIVE logs", 1)


_FIRED = _FOLD.replace("SELECT cast(rule_id AS bigint) AS rule_id, log_id FROM f WHERE fired", "")
ORACLES["delivered_alerts"] = _recursive(_FIRED + "SELECT r.rule_id::bigint AS id, CASE WHEN r.rule_id = 3 AND max(f.last) IS NOT NULL THEN 'refused' ELSE '' END AS last_error, strftime(max(f.last), '%Y-%m-%d %H:%M:%S') AS last_fired FROM rule r LEFT JOIN (SELECT * FROM f WHERE fired) f ON f.rule_id = r.rule_id GROUP BY r.rule_id")
_SEVERITY = "CASE e.severity WHEN 4 THEN 'ERROR' WHEN 5 THEN 'FATAL' END"
_AT = "strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ')"
ORACLES["alert_payloads"] = _recursive(_FIRED + f"""SELECT f.rule_id::bigint AS rule_id, f.log_id, concat('{{"rule":{{"id":', f.rule_id, ',"name":"', n.name, '","kind":"', r.kind, '"}},"project_id":', e.project_id,
',"issue":{{"id":"', e.fingerprint, '","title":"', replace(e.title, '"', '\\"'), '","severity":"', {_SEVERITY}, '"', CASE WHEN r.kind = 'threshold' THEN concat(',"count":', t.event_count) ELSE '' END,
',"first_seen":"', {_AT}, '","last_seen":"', {_AT}, '"}}', CASE WHEN r.kind = 'threshold' THEN concat(',"event_count":', t.event_count, ',"window_minutes":', r.w) ELSE '' END, ',"fired_at":"2024-02-01T00:00:00Z","test":false}}') AS payload
FROM f JOIN rule r USING (rule_id) JOIN (VALUES (1, 'burst'), (2, 'new'), (3, 'back'), (4, 'staging burst')) n(rule_id, name) USING (rule_id) JOIN ev e USING (log_id) LEFT JOIN t ON t.rule_id = f.rule_id AND t.log_id = f.log_id WHERE f.fired""")


# --- stored logs and rollups -------------------------------------------------------------


@query("SELECT project_id::bigint AS project_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, min(log_id) AS first, max(log_id) AS last, true AS sized FROM logs WHERE project_id = 2 AND ts >= timestamp '2024-01-20 00:00:00' GROUP BY 1, 2")
def stored_logs(spark, sf_dir):
    """The logs table written and read again: two partitions' worth of filters, and its size by record."""
    path = views.scratch(spark)
    writers.write_logs(views.logs(spark, sf_dir), path)
    kept = writers.read_logs(spark, path).where("project_id = 2 and day >= '2024-01-20'")
    sized = retention.storage_stats(spark, path).select((F.col("bytes_per_record") > 0).alias("sized"))
    counted = kept.groupBy(F.col("project_id").cast("bigint").alias("project_id"), F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows"), F.min("log_id").alias("first"), F.max("log_id").alias("last"))
    return counted.withColumn("sized", F.lit(sized.head()["sized"]))


@query("SELECT log_id, body FROM logs WHERE project_id = 1 AND strftime(ts, '%Y-%m-%d') = '2024-01-10'")
def compacted_day(spark, sf_dir):
    """A day's files of one project rewritten as sorted ones."""
    path = views.scratch(spark)
    writers.write_logs(views.logs(spark, sf_dir), path)
    retention.compact_day(spark, f"{path}/project_id=1/day=2024-01-10", f"{path}-compact")
    return spark.read.parquet(f"{path}-compact").select("log_id", "body")


_SUMS = f"cast(sum(logs) AS bigint) AS logs, cast(sum(events) AS bigint) AS events FROM rollups WHERE project_id = 1 AND hour BETWEEN date_trunc('hour', timestamp '{SINCE}') AND date_trunc('hour', timestamp '{UNTIL}') GROUP BY 1"


@query(f"SELECT service AS key, {_SUMS}")
def aggregate_stored(spark, sf_dir):
    """The aggregate by service, from a stored rollup table rather than from logs."""
    path = views.scratch(spark)
    rollups.rollup(views.logs(spark, sf_dir)).write.parquet(path)
    return rollups.aggregate(spark.read.parquet(path), 1, "service", SINCE, UNTIL)


# Rule rows by the part table, some of them wrong in one way or another.
_NOISE_ROWS = (
    "cast(p_partkey AS bigint) AS id",
    "CASE p_partkey % 5 WHEN 0 THEN 'severity_floor' WHEN 1 THEN 'drop_match' WHEN 2 THEN 'sample' WHEN 3 THEN 'unknown' ELSE 'sample' END AS kind",
    "CASE WHEN p_partkey % 7 <> 0 THEN 2 END AS severity",
    "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS pattern",
    "p_partkey % 4 AS n",
)
_SEVERITY_ROWS = (
    "cast(p_partkey AS bigint) AS id",
    "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat(p_name, '(?=x)') ELSE p_name END AS pattern",
    "CASE p_partkey % 3 WHEN 0 THEN 'warn' WHEN 1 THEN '' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'error' ELSE 'loud' END END AS severity",
)
_ALERT_ROWS = (
    "cast(p_partkey AS bigint) AS id",
    "CASE p_partkey % 4 WHEN 0 THEN 'new_issue' WHEN 1 THEN 'threshold' WHEN 2 THEN 'none' ELSE 'regression' END AS kind",
    "CASE WHEN p_partkey % 5 = 0 THEN 'ftp://x/y' ELSE 'https://example.org/h' END AS url",
    "p_partkey % 3 AS n",
    "p_partkey % 7 AS window_minutes",
    "p_partkey % 11 - 1 AS cooldown_seconds",
)


def _refused(reason: str, rows: tuple[str, ...]) -> str:
    return f"SELECT id, reason FROM (SELECT *, CASE {reason} END AS reason FROM (SELECT {', '.join(rows)} FROM part)) WHERE reason IS NOT NULL"


def _part_rules(spark, sf_dir, rows):
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*rows)


@query(_refused("""WHEN kind = 'unknown' THEN concat('unknown noise rule kind ', chr(39), kind, chr(39)) WHEN kind IN ('severity_floor', 'sample') AND severity IS NULL THEN concat(kind, ' needs a severity')
WHEN kind = 'drop_match' AND pattern = '' THEN 'drop_match needs a pattern' WHEN kind = 'sample' AND n < 2 THEN 'sample needs n of 2 or more'""", _NOISE_ROWS), plain=True)
def rejected_noise_rules(spark, sf_dir):
    """Noise rules that are refused, and why."""
    return rejections(_part_rules(spark, sf_dir, _NOISE_ROWS), check_noise_rule)


@query(_refused("""WHEN pattern = '' THEN 'a pattern is needed' WHEN contains(pattern, '(?=') THEN 'lookaround, back-references and possessive repeats are not supported'
WHEN severity = 'loud' THEN concat('unknown severity ', chr(39), severity, chr(39)) WHEN severity = '' THEN 'a severity above INFO is needed'""", _SEVERITY_ROWS), plain=True)
def rejected_severity_rules(spark, sf_dir):
    """Severity rules that are refused, their severities being names."""
    return rejections(_part_rules(spark, sf_dir, _SEVERITY_ROWS), check_severity_rule)


@query(_refused("""WHEN kind = 'none' THEN concat('unknown alert rule kind ', chr(39), kind, chr(39)) WHEN NOT starts_with(url, 'http') THEN 'an http or https url is needed'
WHEN kind = 'threshold' AND (n < 1 OR window_minutes < 1) THEN 'threshold needs n and window_minutes of 1 or more' WHEN cooldown_seconds < 0 THEN 'cooldown_seconds must not be negative'""", _ALERT_ROWS), plain=True)
def rejected_alert_rules(spark, sf_dir):
    """Alert rules that are refused, and why."""
    return rejections(_part_rules(spark, sf_dir, _ALERT_ROWS), check_alert_rule)


@query("SELECT p.id, slug, (SELECT count(*) FROM logs l WHERE l.project_id % 3 + 2 = p.id) AS logs FROM (VALUES (1::bigint, 'shop-1'), (2, 'desk-2'), (3, 'lab-3'), (4, 'new-one-4')) p(id, slug)")
def project_created(spark, sf_dir):
    """A project added, with records of its own."""
    table = tables.create_project(views.projects(spark), "New One")
    moved = views.logs(spark, sf_dir).groupBy((F.col("project_id") % 3 + 2).alias("id")).agg(F.count("*").alias("logs"))
    return table.join(moved, "id", "left").select("id", "slug", F.coalesce("logs", F.lit(0)).alias("logs"))


@query("SELECT epoch_us(ts) AS us, CASE WHEN log_id % 9 = 0 THEN 2 ELSE severity END AS severity, service, body, concat('v', log_id % 4) AS k FROM (SELECT log_id, severity, service, body, CASE WHEN log_id % 10 = 0 THEN timestamp '1970-01-01' ELSE ts END AS ts FROM logs)")
def corpus(spark, sf_dir):
    """Logs exported as JSON arrays and read again; some times and severities can't be read."""
    path, logs = views.scratch(spark), views.logs(spark, sf_dir)
    ts = F.when(F.col("log_id") % 10 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    names = F.array(*map(F.lit, ("trace", "DEBUG", "info", "warning", "err", "fatal")))
    level = F.when(F.col("log_id") % 9 == 0, "loud").otherwise(F.element_at(names, F.col("severity") + 1))
    attrs = F.concat(F.lit('{"k":"v'), (F.col("log_id") % 4).cast("string"), F.lit('"}'))
    rows = logs.select(F.struct(ts.alias("ts"), level.alias("severity"), "service", "body", attrs.alias("attrs")).alias("r"), F.floor(F.col("log_id") / 1000).alias("part"))
    # A file of the export is one array of a thousand records.
    rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("part").text(path)
    found = readers.read_corpus(spark, path)
    return found.select(F.unix_micros("ts").alias("us"), "severity", "service", "body", F.col("attrs")["k"].alias("k"))


_HEAD = """concat('{"rule":{"id":', rule_id, ',"name":"', name, '","kind":"', kind, '"},"project_id":', project_id, ',"issue":{"id":"0000000000000000","title":"Test alert","severity":"ERROR"', CASE WHEN kind = 'threshold' THEN concat(',"count":', n) ELSE '' END,
',"first_seen":"2024-02-01T00:00:00Z","last_seen":"2024-02-01T00:00:00Z"}', CASE WHEN kind = 'threshold' THEN concat(',"event_count":', n, ',"window_minutes":', w) ELSE '' END, ',"fired_at":"2024-02-01T00:00:00Z","test":true}')"""


@query(f"SELECT rule_id, {_HEAD} AS payload FROM (SELECT 1::bigint AS rule_id, 'burst' AS name, 'threshold' AS kind, 1 AS project_id, (SELECT count(*) FROM logs WHERE severity = 5) AS n, 60 AS w UNION ALL SELECT 2, 'new', 'new_issue', 2, 1, 1)")
def test_fires(spark, sf_dir):
    """Sample payloads of two rules, one of which waits for as many events as there are fatal records."""
    fatal = views.logs(spark, sf_dir).where("severity = 5").count()
    table = views.alert_rules(spark).withColumn("n", F.when(F.col("id") == 1, F.lit(fatal)).otherwise(F.col("n")).cast("int")).where("id <= 2")
    one, other = (alerts.test_payload(spark, r, datetime(2024, 2, 1)) for r in table.orderBy("id").collect())
    return one.unionByName(other).select("rule_id", "payload")


test_fires.__test__ = False


@query("SELECT project_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS records, true AS dense FROM logs GROUP BY ALL")
def stored_sizes(spark, sf_dir):
    """Records by project and day of the stored table, whose files take less room than the raw texts and what a file costs."""
    path, logs = views.scratch(spark), views.logs(spark, sf_dir)
    writers.write_logs(logs, path)
    raw = logs.agg(F.sum(F.octet_length("body") + F.octet_length("service") + F.octet_length("environment") + F.octet_length("release") + 28), F.countDistinct("project_id", F.to_date("ts")), F.count("*")).head()
    size = retention.storage_stats(spark, path).head()
    dense = size["records"] == raw[2] and size["bytes"] < (raw[0] or 0) + 6000 * raw[1]
    counted = writers.read_logs(spark, path).groupBy(F.col("project_id").cast("bigint").alias("project_id"), F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("records"))
    return counted.withColumn("dense", F.lit(dense))


_BATCH = "CASE WHEN log_id % 7 < 3 THEN 0 WHEN log_id % 7 < 5 THEN 1 WHEN log_id % 50 = 5 THEN 2 ELSE 0 END"


_TABLES: dict[tuple[str, str], str] = {}


def _read_table(spark, sf_dir):
    """The table of :func:`_kept_table`, made once in an application: for queries that only read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = _kept_table(spark, sf_dir)
    return _TABLES[key]


def _kept_table(spark, sf_dir):
    """The logs in three batches, the first two of them compacted; the third lies beside."""
    path, logs = views.scratch(spark), views.logs(spark, sf_dir).withColumn("event_id", F.col("log_id"))
    for k in range(3):
        logtable.append(logs.where(f"{_BATCH} = {k}"), path, k)
        if k == 1:
            logtable.compact(spark, path, datetime(2024, 3, 1), 1000)
    return path


@query("SELECT project_id, strftime(ts, '%Y-%m-%d') AS day, log_id AS event_id, body, service FROM logs")
def history_and_fresh(spark, sf_dir):
    """Every record of the table, rewritten or fresh, once."""
    found = logtable.read(spark, _read_table(spark, sf_dir))
    return found.select("project_id", "day", "event_id", "body", "service")


@query("SELECT cast(0 AS bigint) AS first_id, count(*) - 1 AS last_id, count(*) AS rows FROM logs")
def dense_ids(spark, sf_dir):
    """Ids go on over batches without a gap."""
    return logtable.read(spark, _read_table(spark, sf_dir)).agg(F.min("log_id").alias("first_id"), F.max("log_id").alias("last_id"), F.countDistinct("log_id").alias("rows"))


_CUTOFF = "CASE project_id WHEN 1 THEN timestamp '2024-01-23 12:00:00' WHEN 2 THEN timestamp '2024-01-10 12:00:00' ELSE timestamp '1970-01-01' END"


@query(f"SELECT log_id AS event_id FROM logs WHERE ts >= {_CUTOFF}")
def pruned_table(spark, sf_dir):
    """What is left of the table after pruning and clean-up."""
    path = _kept_table(spark, sf_dir)
    logtable.prune(spark, path, views.projects(spark), datetime(2024, 1, 30, 12))
    logtable.vacuum(spark, path, keep_versions=1)
    return logtable.read(spark, path).select("event_id")


@query(f"SELECT project_id, count(*) AS removed FROM logs WHERE ts < {_CUTOFF} GROUP BY 1")
def pruned_counts(spark, sf_dir):
    return logtable.prune(spark, _kept_table(spark, sf_dir), views.projects(spark), datetime(2024, 1, 30, 12))


@query(f"SELECT project_id, strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS rows, cast(1 AS bigint) AS shards FROM (SELECT *, {_BATCH} AS batch FROM logs) GROUP BY ALL HAVING max(batch) = 2 OR count(*) FILTER (batch < 2) > 1000")
def compaction_plan(spark, sf_dir):
    """The days to be compacted again: those with rows of the third batch, or in two shards that now fit into one."""
    return logtable.plan_compaction(spark, _read_table(spark, sf_dir), datetime(2024, 3, 1), 10_000_000).select("project_id", "bucket", "rows", "shards")


# --- streams -----------------------------------------------------------------------------


def _log_stream(spark, sf_dir):
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").createOrReplaceTempView("events")
    return spark.sql(views.LOGS_SQL)


def _run(stream, into, path):
    stream.writeStream.foreachBatch(into).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


@query("SELECT * FROM rollups")
def stream_rollup(spark, sf_dir):
    """Rollup increments of a stream's batches, added up."""
    path = views.scratch(spark)
    _run(_log_stream(spark, sf_dir), state.append_and_roll(f"{path}/logs", f"{path}/rollups"), path)
    rolled = spark.read.parquet(f"{path}/rollups").drop("epoch")
    return rollups.merge_rollups(rolled.limit(0), rolled)


@query("SELECT project_id, fingerprint, count, first_id AS new_id FROM groups")
def stream_issue_counts(spark, sf_dir):
    """Issues kept as the state of a stream: their last count, and the event that was new."""
    path = views.scratch(spark)
    events = normalize.annotate_events(_log_stream(spark, sf_dir)).where("is_event")
    _run(state.stream_issues(events), lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}"), path)
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy("project_id", "fingerprint").agg(F.max("count").alias("count"), F.min(F.when(F.col("is_new"), F.col("log_id"))).alias("new_id"))


def _in_batches(df, path, parts=3):
    """A table with ``log_id`` as a stream of batches in its order."""
    last = (df.agg(F.max("log_id")).head()[0] or 0) + 1
    for k in range(parts):
        df.where(f"log_id * {parts} div {last} = {k}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@query(_NOISE + "SELECT log_id, drop_rule_id FROM marked")
def stream_noise(spark, sf_dir):
    """Noise rules on a stream of three batches, the sampling rules counting on from batch to batch."""
    path = views.scratch(spark)
    _run(_in_batches(views.logs(spark, sf_dir), path), state.noise_stream(path, views.noise_rules(spark)), path)
    return spark.read.parquet(f"{path}/rows").select("log_id", "drop_rule_id")


@query("SELECT count(*) AS rows, count(*) FILTER (drop_rule_id IN (1, 2)) AS dropped FROM (SELECT CASE WHEN project_id = 1 AND service = 'svc1' AND severity < 2 THEN 1 WHEN project_id = 2 AND contains(body, '/items/1') THEN 2 END AS drop_rule_id FROM logs)")
def stream_noise_drops(spark, sf_dir):
    """Noise rules on a stream in one batch: the records it judges, and those the rules without a counter drop."""
    path = views.scratch(spark)
    _run(_log_stream(spark, sf_dir), state.noise_stream(path, views.noise_rules(spark)), path)
    return spark.read.parquet(f"{path}/rows").agg(F.count("*").alias("rows"), F.count_if(F.col("drop_rule_id").isin(1, 2)).alias("dropped"))


@query("SELECT project_id, fingerprint, log_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY ts DESC, log_id DESC) AS rank FROM ev) WHERE rank <= 50")
def stream_samples(spark, sf_dir):
    """The newest events of each issue, kept by a stream of three batches, two of which are merged."""
    path = views.scratch(spark)
    stream = _in_batches(_events(spark, sf_dir), path)
    _run(stream, state.samples_stream(f"{path}/samples"), path)
    state.merge_samples(spark, f"{path}/samples", 1)
    return state.stream_samples(spark, f"{path}/samples").select("project_id", "fingerprint", "log_id", "rank")


@query(ORACLES["issue_outcomes"], plain=True)
def stream_issue_outcomes(spark, sf_dir):
    """Outcomes as the state of a stream, with its actions as a second one: issues that were resolved are reopened."""
    path, events = views.scratch(spark), _events(spark, sf_dir)
    views.actions(issues.issue_groups(events)).write.parquet(f"{path}/actions")
    actions = spark.readStream.schema("project_id long, fingerprint string, status string, seq long").parquet(f"{path}/actions")
    stream = normalize.annotate_events(_log_stream(spark, sf_dir)).where("is_event")
    _run(state.stream_issues(stream, actions), lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}"), path)
    return spark.read.parquet(f"{path}/rows").select("log_id", "is_new", "is_reopened")


def _normalized_stream(spark, sf_dir):
    return state.stream_normalize(_log_stream(spark, sf_dir).withColumn("attrs", F.create_map().cast("map<string,string>")), views.projects(spark), views.severity_rules(spark))


@query(_STREAM_CHAIN)
def stream_normalize(spark, sf_dir):
    """The row-wise chain on a stream."""
    path = views.scratch(spark)
    _run(_normalized_stream(spark, sf_dir), lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}"), path)
    return spark.read.parquet(f"{path}/rows").select("log_id", "severity", "body", "is_event", "title", "fingerprint")


@query()
def stream_alerts(spark, sf_dir):
    """Alert rules on a stream of events with outcomes, a rule's window and last fire being its state."""
    path = views.scratch(spark)
    events, table = _events(spark, sf_dir), views.alert_rules(spark)
    known = issues.issue_outcomes(events, views.actions(issues.issue_groups(events)))
    stream = _in_batches(known, path)
    _run(state.stream_alerts(stream, table), lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}"), path)
    return spark.read.parquet(f"{path}/rows").select("rule_id", "log_id")


ORACLES["stream_alerts"] = ORACLES["alert_fires"]
