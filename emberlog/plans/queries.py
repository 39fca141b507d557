"""The registered log queries, each over whole tables and with its twin in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions import severity as sev
from emberlog.functions import text as txt
from emberlog.operators import alerts, bodies, issues, multiline, normalize, retention, rollups, rules, search, templates
from emberlog.plans import views
from emberlog.plans.views import ACTIONS_SQL, LOGS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Message normal form in SQL, whose word boundaries are ASCII; then fingerprint and title.
_NORM = "split_part(body, chr(10), 1)"
for _pattern, _token, _words in txt.VOLATILE:
    _NORM = f"regexp_replace({_NORM}, '" + (rf"\b{_pattern}\b" if _words else _pattern) + f"', '{_token}', 'g')"
_NAME = "CASE severity WHEN 0 THEN 'TRACE' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARN' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'FATAL' ELSE 'UNKNOWN' END"
_WITH = f"""WITH logs AS ({LOGS_SQL}),
ev AS (SELECT *, {_NORM} AS norm, substring(trim(split_part(body, chr(10), 1)), 1, 200) AS title,
  substring(sha256(concat(cast(project_id AS varchar), '|', {_NAME}, '|', {_NORM})), 1, 16) AS fingerprint FROM logs WHERE severity >= 4),
groups AS (SELECT project_id, fingerprint, arg_min(title, log_id) AS title, arg_min(severity, log_id) AS severity, arg_min(ts, log_id) AS first_seen,
  arg_max(ts, log_id) AS last_seen, count(*) AS count, min(log_id) AS first_id, max(log_id) AS last_id FROM ev GROUP BY 1, 2),
actions AS ({ACTIONS_SQL}),
states AS (SELECT g.*, CASE WHEN a.status IS NULL THEN 'open' WHEN a.status = 'resolved' AND g.last_id > a.seq THEN 'open' ELSE a.status END AS status
  FROM groups g LEFT JOIN (SELECT project_id, fingerprint, arg_max(status, seq) AS status, max(seq) AS seq FROM actions JOIN groups USING (project_id, fingerprint) WHERE seq >= first_id GROUP BY 1, 2) a USING (project_id, fingerprint)),
rollups AS (SELECT project_id, service, severity, date_trunc('hour', ts) AS hour, count(*) AS logs, count(*) FILTER (severity >= 4) AS events FROM logs GROUP BY 1, 2, 3, 4)
"""


def query(sql: str | None = None, plain: bool = False):
    """Registers a query; ``sql`` may read the relations of ``_WITH`` unless ``plain``."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if plain else f"{_WITH}{sql}"
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.annotate_events(views.logs(spark, sf_dir)).where("is_event")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return issues.build_issues(events, views.actions(issues.issue_groups(events)))


def _rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rollup(views.logs(spark, sf_dir))


def _ranked(df: DataFrame, *order) -> DataFrame:
    """A short result (a top-k or a report) with its order as a column."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


SINCE, UNTIL = "2024-01-08 10:30:00", "2024-01-20 12:10:00"


# --- normalisation -----------------------------------------------------------------------


@query("SELECT norm, count(*) AS n FROM (SELECT " + _NORM + " AS norm FROM logs) GROUP BY norm")
def normalize_message(spark, sf_dir):
    return views.logs(spark, sf_dir).groupBy(txt.normalize_message(txt.first_line(F.col("body"))).alias("norm")).agg(F.count("*").alias("n"))


@query("SELECT log_id, fingerprint, title FROM ev")
def fingerprint_title(spark, sf_dir):
    return _events(spark, sf_dir).select("log_id", "fingerprint", "title")


@query("SELECT doc_id, norm FROM (SELECT doc_id, split_part(text, chr(10), 1) AS body FROM documents) CROSS JOIN LATERAL (SELECT " + _NORM + " AS norm)")
def normalize_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", txt.normalize_message(txt.first_line(F.col("text"))).alias("norm"))


_COLOURED = "concat(chr(27), CASE WHEN log_id % 3 = 0 THEN '[31;1m' WHEN log_id % 3 = 1 THEN '[35m' ELSE '[131m' END, body, chr(27), '[0m', CASE WHEN log_id % 7 = 0 THEN concat(chr(27), '[3') ELSE '' END)"


@query(f"SELECT log_id, regexp_replace(c, '\\x1b(?:\\[[^@-~]*(?:[@-~]|\\z)|[^\\[]|\\z)', '', 'g') AS body, log_id % 3 = 0 AS red FROM (SELECT log_id, {_COLOURED} AS c FROM logs)")
def strip_ansi(spark, sf_dir):
    coloured = views.logs_with_attrs(spark, sf_dir).withColumn("body", F.expr(_COLOURED))
    return normalize.clean_bodies(coloured).select("log_id", "body", (txt.attr(F.col("attrs"), "ansi.red") == "true").alias("red"))


@query("""SELECT log_id, CASE WHEN project_id = 2 THEN severity WHEN severity = 2 AND body LIKE 'level=warn%' THEN 3 ELSE severity END AS severity,
CASE WHEN project_id = 2 THEN body WHEN body LIKE 'level=warn%' THEN 'signup slow' WHEN body LIKE '{%' THEN 'click failed' ELSE body END AS body,
CASE WHEN project_id <> 2 AND body LIKE 'level=warn%' THEN regexp_extract(body, 'took=(\\S*)', 1) ELSE '' END AS took,
CASE WHEN project_id <> 2 AND body LIKE '{%' THEN regexp_extract(body, '"n":([0-9]+)', 1) ELSE '' END AS n FROM logs""")
def parse_bodies(spark, sf_dir):
    parsed = bodies.parse_bodies(views.logs_with_attrs(spark, sf_dir), views.projects(spark))
    return parsed.select("log_id", "severity", "body", txt.attr(F.col("attrs"), "took").alias("took"), txt.attr(F.col("attrs"), "n").alias("n"))


_CRASHED = "CASE WHEN log_id % 11 = 0 THEN concat('  panic: ', body) WHEN log_id % 13 = 0 THEN concat('fatal error: ', body) WHEN log_id % 17 = 0 THEN concat('x panic: ', body) ELSE body END"


@query("SELECT log_id, CASE WHEN severity = 2 AND (log_id % 11 = 0 OR log_id % 13 = 0) THEN 5 ELSE severity END AS severity FROM logs")
def panic_severity(spark, sf_dir):
    return normalize.detect_panic_severity(views.logs(spark, sf_dir).withColumn("body", F.expr(_CRASHED))).select("log_id", "severity")


@query("""SELECT log_id, CASE WHEN lower(trim(t)) = 'warn' THEN 3 WHEN lower(trim(t)) = 'err' THEN 4 WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN
 CASE WHEN t::bigint >= 21 THEN 5 WHEN t::bigint >= 17 THEN 4 WHEN t::bigint >= 13 THEN 3 WHEN t::bigint >= 9 THEN 2 WHEN t::bigint >= 5 THEN 1 WHEN t::bigint >= 1 THEN 0 ELSE 2 END ELSE 2 END AS severity
FROM (SELECT log_id, CASE log_id % 4 WHEN 0 THEN ' Warn ' WHEN 1 THEN 'ERR' WHEN 2 THEN cast(log_id % 30 - 2 AS varchar) ELSE concat(' ', cast(log_id % 30 AS varchar), ' ') END AS t FROM logs)""")
def parse_severity(spark, sf_dir):
    t = F.expr("CASE log_id % 4 WHEN 0 THEN ' Warn ' WHEN 1 THEN 'ERR' WHEN 2 THEN cast(log_id % 30 - 2 AS string) ELSE concat(' ', cast(log_id % 30 AS string), ' ') END")
    return views.logs(spark, sf_dir).select("log_id", sev.parse_severity(t).alias("severity"))


# --- rules -------------------------------------------------------------------------------

_LIFT = "CASE WHEN severity > 2 THEN NULL WHEN project_id = 1 AND regexp_matches(body, 'signup slow|handled path=/api/v1/items/[0-9]*7 ') THEN 1 WHEN service = 'svc2' AND regexp_matches(body, '^request') THEN 2 END"


@query(f"SELECT log_id, cast(lift AS bigint) AS lift_rule_id, CASE lift WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE severity END AS severity FROM (SELECT *, {_LIFT} AS lift FROM logs)")
def severity_rules(spark, sf_dir):
    return rules.apply_severity_rules(views.logs(spark, sf_dir), views.severity_rules(spark))[0].select("log_id", "lift_rule_id", "severity")


@query(f"SELECT cast(lift AS bigint) AS rule_id, count(*) AS lifted FROM (SELECT {_LIFT} AS lift FROM logs) WHERE lift IS NOT NULL GROUP BY 1")
def lift_counts(spark, sf_dir):
    return rules.apply_severity_rules(views.logs(spark, sf_dir), views.severity_rules(spark))[1]


_NOISE = """, m1 AS (SELECT *, CASE WHEN project_id = 1 AND service = 'svc1' AND severity < 2 THEN 1 WHEN project_id = 2 AND contains(body, '/items/1') THEN 2 END AS d FROM logs),
m2 AS (SELECT *, CASE WHEN d IS NULL AND project_id = 3 AND severity <= 1 THEN row_number() OVER (PARTITION BY d IS NULL AND project_id = 3 AND severity <= 1 ORDER BY log_id) - 1 END AS r3 FROM m1),
m3 AS (SELECT * REPLACE (CASE WHEN r3 % 3 <> 0 THEN 3 ELSE d END AS d) FROM m2),
m4 AS (SELECT *, CASE WHEN d IS NULL AND project_id = 3 AND severity <= 2 THEN row_number() OVER (PARTITION BY d IS NULL AND project_id = 3 AND severity <= 2 ORDER BY log_id) - 1 END AS r5 FROM m3),
marked AS (SELECT log_id, project_id, service, cast(CASE WHEN r5 % 2 <> 0 THEN 5 ELSE d END AS bigint) AS drop_rule_id FROM m4)
"""


@query(_NOISE + "SELECT log_id, drop_rule_id FROM marked")
def noise_rules(spark, sf_dir):
    return rules.mark_noise(views.logs(spark, sf_dir), views.noise_rules(spark)).select("log_id", "drop_rule_id")


@query(_NOISE + "SELECT drop_rule_id AS rule_id, count(*) AS dropped FROM marked WHERE drop_rule_id IS NOT NULL GROUP BY 1")
def drop_counts(spark, sf_dir):
    return rules.apply_noise_rules(views.logs(spark, sf_dir), views.noise_rules(spark))[1]


@query(_NOISE + """SELECT section, name, n FROM (
SELECT 'service' AS section, service AS name, n FROM (SELECT service, count(*) AS n FROM logs WHERE project_id = 3 AND ts >= timestamp '2024-01-20 00:00:00' GROUP BY 1 ORDER BY n DESC, service LIMIT 20)
UNION ALL SELECT 'rule', cast(r AS varchar), (SELECT count(*) FROM marked WHERE drop_rule_id = r) FROM (VALUES (3), (4), (5)) t(r)
UNION ALL SELECT 'total', 'dropped', (SELECT count(*) FROM marked WHERE drop_rule_id IN (3, 4, 5)))""")
def noise_report(spark, sf_dir):
    table = views.noise_rules(spark)
    counted = rules.add_counts(table, rules.apply_noise_rules(views.logs(spark, sf_dir), table)[1], "dropped_count")
    return rollups.noise_report(_rollups(spark, sf_dir), counted, 3, "2024-01-20 00:00:00")


# --- issues ------------------------------------------------------------------------------


@query("SELECT project_id, fingerprint, title, severity, first_seen, last_seen, count, status, row_number() OVER (ORDER BY last_seen DESC, project_id, fingerprint) AS rank FROM states ORDER BY last_seen DESC, project_id, fingerprint LIMIT 50")
def list_issues(spark, sf_dir):
    found = issues.list_issues(_states(spark, sf_dir))
    return _ranked(found, F.desc("last_seen"), "project_id", "fingerprint")


@query("SELECT project_id, fingerprint, status, count FROM states s WHERE project_id = 2 AND last_seen >= timestamp '2024-01-08 10:30:00' AND EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY ts DESC, log_id DESC) AS r FROM ev) e WHERE r <= 50 AND environment = 'staging' AND e.project_id = s.project_id AND e.fingerprint = s.fingerprint)")
def issue_env_filter(spark, sf_dir):
    found = issues.list_issues(_states(spark, sf_dir), issues.issue_samples(_events(spark, sf_dir)), project=2, env="staging", since=SINCE, limit=1000)
    return found.select("project_id", "fingerprint", "status", "count")


@query("""SELECT log_id, is_new, coalesce(prev = 'resolved', false) AS is_reopened FROM (
SELECT *, lag(kind) OVER (PARTITION BY project_id, fingerprint ORDER BY seq, o) AS prev FROM (
SELECT project_id, fingerprint, log_id AS seq, 0 AS o, 'event' AS kind, log_id, log_id = min(log_id) OVER (PARTITION BY project_id, fingerprint) AS is_new FROM ev
UNION ALL SELECT project_id, fingerprint, seq, 1, status, NULL, NULL FROM actions JOIN groups USING (project_id, fingerprint) WHERE seq >= first_id)) WHERE kind = 'event'""")
def issue_outcomes(spark, sf_dir):
    events = _events(spark, sf_dir)
    return issues.issue_outcomes(events, views.actions(issues.issue_groups(events))).select("log_id", "is_new", "is_reopened")


@query("SELECT project_id, fingerprint, log_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY ts DESC, log_id DESC) AS rank FROM ev) WHERE rank <= 50")
def issue_samples(spark, sf_dir):
    return issues.issue_samples(_events(spark, sf_dir)).select("project_id", "fingerprint", "log_id", "rank")


_SAMPLES = ", samples AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY ts DESC, log_id DESC) AS rank FROM ev) WHERE rank <= 50)\n"


@query(_SAMPLES + """, d AS (SELECT DISTINCT project_id, fingerprint FROM samples), g AS (SELECT d.*, i FROM d, range(7) t(i))
SELECT project_id, fingerprint, day, n FROM (SELECT g.project_id, g.fingerprint, cast(date '2024-01-30' - cast(i AS integer) AS date) AS day,
(SELECT count(*) FROM samples s WHERE s.project_id = g.project_id AND s.fingerprint = g.fingerprint AND cast(s.ts AS date) = date '2024-01-30' - cast(i AS integer)) AS n FROM g)""")
def issue_histogram(spark, sf_dir):
    return issues.issue_histogram(issues.issue_samples(_events(spark, sf_dir)), "2024-01-30")


@query(_SAMPLES + "SELECT project_id, fingerprint, string_agg(DISTINCT environment, ',' ORDER BY environment) AS environments, string_agg(DISTINCT release, ',' ORDER BY release) AS releases FROM samples GROUP BY 1, 2")
def issue_tags(spark, sf_dir):
    tags = issues.issue_tags(issues.issue_samples(_events(spark, sf_dir)))
    return tags.select("project_id", "fingerprint", F.array_join("environments", ",").alias("environments"), F.array_join("releases", ",").alias("releases"))


@query(_SAMPLES + "SELECT project_id, fingerprint, log_id, ts, body FROM samples WHERE rank = 1")
def newest_sample(spark, sf_dir):
    return issues.newest_sample(issues.issue_samples(_events(spark, sf_dir)))


@query(_SAMPLES + ", top AS (SELECT project_id AS p, fingerprint AS f FROM groups ORDER BY count DESC, project_id, fingerprint LIMIT 1)\nSELECT title, status, issue_count, first_seen, last_seen, log_id, rank, ts, body, service, environment, release FROM (SELECT s.title AS title, s.status, s.count AS issue_count, s.first_seen, s.last_seen, e.log_id, e.rank, e.ts, e.body, e.service, e.environment, e.release FROM top JOIN states s ON s.project_id = p AND s.fingerprint = f JOIN samples e ON e.project_id = p AND e.fingerprint = f)")
def issue_detail(spark, sf_dir):
    states, events = _states(spark, sf_dir), _events(spark, sf_dir)
    top = states.orderBy(F.desc("count"), "project_id", "fingerprint").head()
    return issues.issue_detail(states, issues.issue_samples(events), views.logs(spark, sf_dir), top["project_id"], top["fingerprint"])


# --- search ------------------------------------------------------------------------------


@query("SELECT log_id, ts, severity, body, service, row_number() OVER (ORDER BY ts DESC, log_id DESC) AS rank FROM logs WHERE contains(body, 'items/1') ORDER BY ts DESC, log_id DESC LIMIT 50")
def search_logs(spark, sf_dir):
    found = search.search_logs(views.logs(spark, sf_dir), query="items/1").select("log_id", "ts", "severity", "body", "service")
    return _ranked(found, F.desc("ts"), F.desc("log_id"))


@query(f"SELECT log_id, ts, body FROM logs WHERE project_id = 2 AND contains(body, 'connection') AND severity >= 4 AND service = 'svc4' AND environment = 'prod' AND ts BETWEEN timestamp '{SINCE}' AND timestamp '{UNTIL}' ORDER BY ts DESC, log_id DESC LIMIT 100")
def search_scoped(spark, sf_dir):
    return search.search_logs(views.logs(spark, sf_dir), 2, "connection", 4, "svc4", "prod", SINCE, UNTIL, 100).select("log_id", "ts", "body")


@query("SELECT page_id AS log_id FROM pages WHERE contains(html, 'track(1')", plain=True)
def search_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("log_id"), F.col("html").alias("body"), F.lit(None).cast("timestamp").alias("ts"))
    return search.filter_logs(pages, query="track(1").select("log_id")


@query("SELECT log_id, project_id, ts, severity, body, service FROM logs WHERE log_id = 777")
def log_by_id(spark, sf_dir):
    return search.log_by_id(views.logs(spark, sf_dir), 777).select("log_id", "project_id", "ts", "severity", "body", "service")


@query("""SELECT log_id, ts, service FROM (SELECT l.*, row_number() OVER (ORDER BY l.ts, l.log_id) AS p FROM logs l, (SELECT * FROM logs WHERE log_id = 500) t WHERE l.project_id = t.project_id AND l.service = t.service)
WHERE abs(p - (SELECT count(*) FROM logs l, (SELECT * FROM logs WHERE log_id = 500) t WHERE l.project_id = t.project_id AND l.service = t.service AND (l.ts, l.log_id) <= (t.ts, t.log_id))) <= 10""")
def log_context(spark, sf_dir):
    return search.log_context(views.logs(spark, sf_dir), 500, 10).select("log_id", "ts", "service")


@query("""SELECT a.log_id, b.log_id AS target_id, cast(a.p - b.p AS integer) AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY project_id, service ORDER BY ts, log_id) AS p FROM logs) a
JOIN (SELECT *, row_number() OVER (PARTITION BY project_id, service ORDER BY ts, log_id) AS p FROM logs) b ON a.project_id = b.project_id AND a.service = b.service AND abs(a.p - b.p) <= 3 WHERE b.severity = 5""")
def log_context_many(spark, sf_dir):
    logs = views.logs(spark, sf_dir)
    return search.log_context_many(logs, logs.where("severity = 5").select("log_id"), 3).select("log_id", "target_id", "offset")


@query("SELECT log_id, ts, cast(greatest(least((SELECT count(*) FROM logs WHERE severity = 5), 500) - 20, 0) AS bigint) AS more FROM logs WHERE severity = 5 ORDER BY ts DESC, log_id DESC LIMIT 20")
def bounded_fetch(spark, sf_dir):
    found = views.logs(spark, sf_dir).where("severity = 5").orderBy(F.desc("ts"), F.desc("log_id"))
    return search.bounded_fetch(found).select("log_id", "ts", F.col("more").cast("bigint").alias("more"))


# --- rollups -----------------------------------------------------------------------------


@query("SELECT * FROM rollups")
def rollup(spark, sf_dir):
    return _rollups(spark, sf_dir)


@query("SELECT project_id, service, severity, hour, cast(2 * logs AS bigint) AS logs, cast(2 * events AS bigint) AS events FROM rollups")
def merge_rollups(spark, sf_dir):
    return rollups.merge_rollups(_rollups(spark, sf_dir), _rollups(spark, sf_dir))


_BUCKETS = f"FROM rollups WHERE project_id = 1 AND hour BETWEEN date_trunc('hour', timestamp '{SINCE}') AND date_trunc('hour', timestamp '{UNTIL}') GROUP BY 1"
_SUMS = "cast(sum(logs) AS bigint) AS logs, cast(sum(events) AS bigint) AS events"
_KEYS = {"service": "service", "severity": "cast(severity AS varchar)", "hour": "strftime(hour, '%Y-%m-%dT%H')", "day": "strftime(hour, '%Y-%m-%d')"}


def _aggregate(group_by: str) -> None:
    def run(spark, sf_dir):
        return rollups.aggregate(_rollups(spark, sf_dir), 1, group_by, SINCE, UNTIL)

    run.__name__ = f"aggregate_{group_by}"
    query(f"SELECT {_KEYS[group_by]} AS key, {_SUMS} {_BUCKETS}")(run)


for _by in rollups.GROUPS:
    _aggregate(_by)


@query("""SELECT strftime(hour, '%Y-%m-%d') AS day, cast(sum(logs) AS bigint) AS logs, cast(sum(events) AS bigint) AS events,
(SELECT cast(sum(logs) AS bigint) FROM rollups WHERE project_id = 2 AND hour >= timestamp '2024-01-08 10:00:00') AS total_logs,
(SELECT cast(sum(events) AS bigint) FROM rollups WHERE project_id = 2 AND hour >= timestamp '2024-01-08 10:00:00') AS total_events,
(SELECT count(*) FROM states WHERE project_id = 2 AND status = 'open') AS open_issues, cast(0 AS bigint) AS dropped
FROM rollups WHERE project_id = 2 AND hour >= timestamp '2024-01-08 10:00:00' GROUP BY 1""")
def stats(spark, sf_dir):
    return rollups.stats(_rollups(spark, sf_dir), _states(spark, sf_dir), views.noise_rules(spark), 2, SINCE)


@query("SELECT service, cast(sum(logs) AS bigint) AS logs, row_number() OVER (ORDER BY sum(logs) DESC, service) AS rank FROM rollups WHERE project_id = 1 GROUP BY 1 ORDER BY logs DESC, service LIMIT 20")
def service_counts(spark, sf_dir):
    return _ranked(rollups.service_counts(_rollups(spark, sf_dir), 1), F.desc("logs"), "service")


@query("""SELECT p.id, p.name, (SELECT count(*) FROM states s WHERE s.project_id = p.id AND status = 'open') AS open_issues,
(SELECT count(*) FROM logs l WHERE l.project_id = p.id AND date_trunc('hour', ts) >= timestamp '2024-01-29 06:00:00') AS logs FROM (VALUES (1::bigint, 'Shop'), (2, 'Desk'), (3, 'Lab')) p(id, name)""")
def project_overview(spark, sf_dir):
    return rollups.project_overview(_rollups(spark, sf_dir), _states(spark, sf_dir), views.projects(spark), "2024-01-29 06:40:00")


@query("""SELECT day, events, round(100.0 * (row_number() OVER (ORDER BY day) - 1) / (count(*) OVER () - 1), 6) AS x, round(20 - 20.0 * events / greatest(max(events) OVER (), 1), 6) AS y
FROM (SELECT strftime(hour, '%Y-%m-%d') AS day, cast(sum(events) AS bigint) AS events FROM rollups WHERE project_id = 3 GROUP BY 1)""")
def trend_series(spark, sf_dir):
    days = rollups.aggregate(_rollups(spark, sf_dir), 3, "day").select(F.col("key").alias("day"), "events")
    return rollups.trend_series(days).select("day", "events", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# --- alerts ------------------------------------------------------------------------------

_MATCH = """, rule(rule_id, p, kind, env, min_severity, n, w, cooldown) AS (VALUES (1, 1, 'threshold', '', 4, 3, 60, 900), (2, 2, 'new_issue', '', 4, 1, 1, 0), (3, 3, 'regression', 'prod', 0, 1, 1, 3600), (4, 3, 'threshold', 'staging', 0, 2, 120, 7200)),
outcome AS (SELECT log_id, is_new, coalesce(prev = 'resolved', false) AS is_reopened FROM (
SELECT *, lag(kind) OVER (PARTITION BY project_id, fingerprint ORDER BY seq, o) AS prev FROM (
SELECT project_id, fingerprint, log_id AS seq, 0 AS o, 'event' AS kind, log_id, log_id = min(log_id) OVER (PARTITION BY project_id, fingerprint) AS is_new FROM ev
UNION ALL SELECT project_id, fingerprint, seq, 1, status, NULL, NULL FROM actions JOIN groups USING (project_id, fingerprint) WHERE seq >= first_id)) WHERE kind = 'event'),
m AS (SELECT rule.*, ev.log_id, ev.ts, is_new, is_reopened, cast(floor(epoch(ev.ts) / 60) AS bigint) AS minute FROM ev JOIN outcome USING (log_id) JOIN rule ON project_id = p AND (env = '' OR env = environment) AND severity >= min_severity),
t AS (SELECT m.*, (SELECT count(*) FROM m o WHERE o.rule_id = m.rule_id AND o.minute > m.minute - m.w AND (o.minute, o.log_id) <= (m.minute, m.log_id)) AS event_count FROM m WHERE kind = 'threshold')
"""


@query(_MATCH + "SELECT cast(rule_id AS bigint) AS rule_id, log_id, event_count FROM t")
def threshold_counts(spark, sf_dir):
    counted = alerts.threshold_counts(alerts.match_alerts(_events(spark, sf_dir), views.alert_rules(spark)))
    return counted.select("rule_id", "log_id", "event_count")


def _fires(spark, sf_dir):
    events = _events(spark, sf_dir)
    outcomes = issues.issue_outcomes(events, views.actions(issues.issue_groups(events)))
    return alerts.evaluate_alerts(outcomes, views.alert_rules(spark))


_FOLD = _MATCH + """, c AS (SELECT rule_id, log_id, ts, cooldown FROM t WHERE event_count >= n UNION ALL SELECT rule_id, log_id, ts, cooldown FROM m WHERE (kind = 'new_issue' AND is_new) OR (kind = 'regression' AND is_reopened)),
o AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY log_id) AS k FROM c),
f AS (SELECT rule_id, k, log_id, ts AS last, true AS fired FROM o WHERE k = 1 UNION ALL
SELECT o.rule_id, o.k, o.log_id, CASE WHEN o.cooldown <= 0 OR date_diff('microsecond', f.last, o.ts) >= o.cooldown::bigint * 1000000 THEN o.ts ELSE f.last END, o.cooldown <= 0 OR date_diff('microsecond', f.last, o.ts) >= o.cooldown::bigint * 1000000 FROM f JOIN o ON o.rule_id = f.rule_id AND o.k = f.k + 1)
SELECT cast(rule_id AS bigint) AS rule_id, log_id FROM f WHERE fired"""


@query()
def alert_fires(spark, sf_dir):
    return _fires(spark, sf_dir).select("rule_id", "log_id")


ORACLES["alert_fires"] = (_WITH + _FOLD).replace("WITH logs", "WITH RECURSIVE logs", 1)


@query()
def alert_payloads(spark, sf_dir):
    return alerts.alert_payloads(_fires(spark, sf_dir), "2024-02-01 00:00:00")


# --- multi-line records ------------------------------------------------------------------

_LINES = """SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN concat('  at ', text) WHEN 2 THEN concat('Caused by: ', text) WHEN 3 THEN text ELSE CASE WHEN conv_id % 5 = 0 THEN concat('panic: ', text) ELSE text END END AS text FROM conversations"""
_CONTINUES = "regexp_matches(text, '^(?:[ \\t]|at |Caused by:|\\.\\.\\. [0-9]+ more)')"


@query(f"""WITH l AS ({_LINES}), s AS (SELECT *, regexp_matches(text, '^(?:panic:|fatal error:)') AS head, {_CONTINUES} AS more FROM l),
a AS (SELECT *, coalesce(bool_or(head) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM s),
b AS (SELECT *, sum(CASE WHEN k = 1 OR head OR (NOT seen AND NOT more) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS rec FROM a)
SELECT cast(conv_id AS varchar) AS source, min(turn) AS seq, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS lines FROM b GROUP BY conv_id, rec""", plain=True)
def multiline_join(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("conversations")
    lines = spark.sql(_LINES).select(F.col("conv_id").cast("string").alias("source"), F.lit("chat").alias("service"), F.col("turn").alias("seq"), F.timestamp_seconds("turn").alias("ts"), "text")
    return multiline.join_multiline(lines).select("source", "seq", "text", "lines")


# --- templates ---------------------------------------------------------------------------

# The fold in SQL: in each group (g) step n takes its n-th distinct body and the templates held so far, oldest first.
_SAME = "list_transform(held, lambda t: list_sum(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN t[i] = '<*>' OR t[i] = words[i] THEN 1 ELSE 0 END)))"
_MINTED = "CASE WHEN same >= 0.5 * len(words) THEN list_transform(range(1, len(words) + 1), lambda i: CASE WHEN held[best][i] = words[i] THEN words[i] ELSE '<*>' END) ELSE words END"
_MINED = f"""WITH RECURSIVE logs AS ({LOGS_SQL}),
bodies AS (SELECT project_id, body, string_split(body, ' ') AS words, min(log_id) AS arrival FROM logs WHERE body <> '' AND NOT contains(body, chr(10)) AND len(string_split(body, ' ')) <= 200 GROUP BY ALL),
grouped AS (SELECT *, dense_rank() OVER (ORDER BY project_id, len(words), CASE WHEN regexp_matches(words[1], '[0-9]') THEN '<*>' ELSE words[1] END) AS g FROM bodies),
keyed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY arrival) AS n FROM grouped),
steps AS (SELECT DISTINCT g, cast(0 AS bigint) AS n, cast([] AS varchar[][]) AS held, cast([] AS bigint[]) AS firsts, cast(NULL AS varchar[]) AS chosen, cast(NULL AS bigint) AS mint_id FROM keyed
  UNION ALL SELECT g, n, CASE WHEN covered THEN held ELSE list_append(held, minted) END, CASE WHEN covered THEN firsts ELSE list_append(firsts, arrival) END,
    CASE WHEN covered THEN held[best] ELSE minted END, CASE WHEN covered THEN firsts[best] ELSE arrival END
  FROM (SELECT *, coalesce(same = len(words), false) AS covered, {_MINTED} AS minted
  FROM (SELECT *, list_max(sames) AS same, list_position(sames, list_max(sames)) AS best
  FROM (SELECT s.g, k.n, held, firsts, words, arrival, {_SAME} AS sames FROM steps s JOIN keyed k ON k.g = s.g AND k.n = s.n + 1)))),
mined AS (SELECT k.project_id, k.body, k.words, k.arrival, s.chosen, s.mint_id FROM steps s JOIN keyed k USING (g, n)),
templates AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY arrival) AS template_id, array_to_string(chosen, ' ') AS template, arrival AS first_log_id FROM mined WHERE mint_id = arrival),
encoded AS (SELECT log_id, l.project_id, coalesce(template_id, 0) AS template_id, CASE WHEN template_id IS NULL THEN coalesce(l.body, '') ELSE
  array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: chosen[i] = '<*>'), lambda i: words[i]), '|') END AS vars, template_id IS NULL AS raw
  FROM logs l LEFT JOIN mined m ON m.project_id = l.project_id AND m.body = l.body LEFT JOIN templates t ON t.project_id = m.project_id AND t.first_log_id = m.mint_id)
"""
_TEMPLATES, _ENCODED = _MINED + "SELECT * FROM templates", _MINED + "SELECT log_id, project_id, template_id, vars FROM encoded"


def _shown(mined: DataFrame) -> DataFrame:
    wild = F.transform("tokens", lambda t: F.when(t == templates.WILD, "<*>").otherwise(t))
    return mined.select("project_id", "template_id", F.array_join(wild, " ").alias("template"), "first_log_id")


def _values(encoded: DataFrame) -> DataFrame:
    return encoded.select("log_id", "project_id", "template_id", F.coalesce("raw", F.array_join("vars", "|"), F.lit("")).alias("vars"))


def _mined_in_batches(spark: SparkSession, sf_dir: str) -> str:
    """The logs mined as five batches in turn, each after the templates that those before it have stored."""
    path, logs = views.scratch(spark), views.logs(spark, sf_dir)
    last = logs.agg(F.max("log_id")).head()[0] or 0
    for k in range(5):
        templates.append_templates(logs.where(F.floor(F.col("log_id") * 5 / (last + 1)) == k), path, k)
    return path


@query(_TEMPLATES, plain=True)
def mine_templates(spark, sf_dir):
    return _shown(templates.mine_templates(views.logs(spark, sf_dir))[0])


@query(_ENCODED, plain=True)
def encoded_bodies(spark, sf_dir):
    """Every record's template and variables."""
    return _values(templates.mine_templates(views.logs(spark, sf_dir))[1])


@query(_TEMPLATES, plain=True)
def mine_templates_in_batches(spark, sf_dir):
    return _shown(templates.stored_templates(spark, _mined_in_batches(spark, sf_dir)))


@query(_ENCODED, plain=True)
def encoded_in_batches(spark, sf_dir):
    return _values(templates.encoded_logs(spark, _mined_in_batches(spark, sf_dir)))


@query(_TEMPLATES, plain=True)
def mine_templates_in_rounds(spark, sf_dir):
    """Groups of more than 200 bodies mined in rounds, in parallel."""
    return _shown(templates.mine_templates(views.logs(spark, sf_dir), in_order=200)[0])


@query("SELECT log_id, project_id, body FROM logs")
def template_round_trip(spark, sf_dir):
    mined, encoded = templates.mine_templates(views.logs(spark, sf_dir))
    return templates.reconstruct(encoded, mined)


@query("SELECT log_id, project_id FROM logs WHERE contains(body, 'items/12')")
def search_encoded(spark, sf_dir):
    mined, encoded = templates.mine_templates(views.logs(spark, sf_dir))
    return templates.search_encoded(encoded, mined, "items/12")


@query("SELECT log_id, project_id FROM logs WHERE contains(body, 'connect: connection refused')")
def search_stored(spark, sf_dir):
    """The same search over stored records, of which only those of templates along which the words fit are read."""
    return templates.search_stored(spark, _mined_in_batches(spark, sf_dir), "connect: connection refused")


@query(_MINED + """SELECT (SELECT count(*) FROM templates) AS templates, count(*) AS rows, count(*) FILTER (raw) AS raw_rows, cast(coalesce(sum(CASE WHEN raw THEN 0 ELSE strlen(replace(vars, '|', '')) END), 0) AS bigint) AS variable_bytes,
cast(coalesce(sum(CASE WHEN raw THEN strlen(vars) ELSE 0 END), 0) AS bigint) AS raw_bytes, 100.0::double * count(*) FILTER (NOT raw) / count(*) AS templated_pct FROM encoded""", plain=True)
def template_report(spark, sf_dir):
    mined, encoded = templates.mine_templates(views.logs(spark, sf_dir))
    return templates.template_report(encoded, mined)


# --- retention ---------------------------------------------------------------------------


@query("SELECT log_id FROM logs WHERE ts >= CASE project_id WHEN 1 THEN timestamp '2024-01-23 12:00:00' WHEN 2 THEN timestamp '2024-01-10 12:00:00' ELSE timestamp '1970-01-01' END")
def retention_prune(spark, sf_dir):
    return retention.prune(views.logs(spark, sf_dir), views.projects(spark), "2024-01-30 12:00:00")[0].select("log_id")


@query("SELECT project_id, count(*) AS removed FROM logs WHERE ts < CASE project_id WHEN 1 THEN timestamp '2024-01-23 12:00:00' WHEN 2 THEN timestamp '2024-01-10 12:00:00' ELSE timestamp '1970-01-01' END GROUP BY 1")
def retention_removed(spark, sf_dir):
    return retention.prune(views.logs(spark, sf_dir), views.projects(spark), "2024-01-30 12:00:00")[1]


@query("""SELECT project_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (severity >= 4) AS events, min(ts) AS min_ts, max(ts) AS max_ts, min(log_id) AS min_id, max(log_id) AS max_id, count(*) FILTER (severity = 5) AS fatal, count(DISTINCT service) AS services FROM logs GROUP BY 1, 2""")
def partition_profile(spark, sf_dir):
    from emberlog.sources.writers import with_day

    out = retention.partition_profile(with_day(views.logs(spark, sf_dir)))
    return out.select("project_id", "day", "rows", "events", "min_ts", "max_ts", "min_id", "max_id", "fatal", F.size("services").cast("bigint").alias("services"))


@query("SELECT log_id FROM logs WHERE ts >= timestamp '2024-01-28 12:00:00'")
def size_guardrail(spark, sf_dir):
    return retention.enforce_size_cap(views.logs(spark, sf_dir), 2, 1, "2024-01-29 12:00:00").select("log_id")
