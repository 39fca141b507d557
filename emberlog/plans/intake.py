"""Queries on the way in: JSON and OTLP records, lines, odd bodies, the whole chain to events."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from emberlog.functions import text as txt
from emberlog.functions.times import parse_since
from emberlog.operators import bodies, multiline, normalize, search
from emberlog.plans import views
from emberlog.plans.queries import _COLOURED, _LIFT, _LINES, _NAME, _NOISE, _NORM, query
from emberlog.sources import readers, writers

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
_NOW_US = "epoch_us(timestamp '2024-02-01 00:00:00')"


def _micros(column: str):
    """The instant as a number, whatever the session's time zone."""
    return F.unix_micros(F.col(column)).alias("us")


# --- records -----------------------------------------------------------------------------

_JSON = """concat('{"', CASE log_id % 3 WHEN 0 THEN 'message' WHEN 1 THEN 'msg' ELSE 'body' END, '":"m', log_id, '"',
CASE log_id % 5 WHEN 0 THEN ',"severity":"warn"' WHEN 1 THEN ',"severity":"17"' WHEN 3 THEN ',"severity":" Error "' WHEN 4 THEN ',"severity":"loud"' ELSE '' END,
CASE log_id % 6 WHEN 0 THEN concat(',"timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '.25Z"') WHEN 1 THEN ',"time":1700000000.9' WHEN 2 THEN ',"ts":1e300' WHEN 3 THEN ',"time":99999999999999999999'
 WHEN 4 THEN ',"timestamp":"never","time":1700000001' ELSE '' END, ',"service":"', service, '","attrs":{"k":', log_id % 7, '}}')"""
_JSON_SQL = f"""SELECT cast(7 AS bigint) AS project_id, concat('m', log_id) AS body, CASE log_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 3 THEN 4 ELSE 2 END AS severity, service, cast(log_id % 7 AS varchar) AS k,
CASE log_id % 6 WHEN 0 THEN epoch_us(date_trunc('second', ts)) + 250000 WHEN 1 THEN 1700000000000000 WHEN 4 THEN 1700000001000000 ELSE {_NOW_US} END AS us FROM logs"""


def _json_values(spark, sf_dir):
    return views.logs(spark, sf_dir).select("log_id", F.expr(_JSON).alias("value"))


def _json_result(records):
    return records.select("project_id", "body", "severity", "service", txt.attr(F.col("attrs"), "k").alias("k"), _micros("ts"))


@query(_JSON_SQL)
def ingest_json(spark, sf_dir):
    """JSON records with every alias, severities as names and numbers, and times that can't be read."""
    rows = _json_values(spark, sf_dir).select(F.from_json("value", readers.JSON_LOG).alias("r")).select("r.*")
    return _json_result(readers.json_records(rows, 7, NOW))


@query(_JSON_SQL)
def ingest_json_files(spark, sf_dir):
    """The same from compressed files of arrays, 5000 records each."""
    path = views.scratch(spark)
    arrays = _json_values(spark, sf_dir).groupBy(F.floor(F.col("log_id") / 5000).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(path, compression="gzip")
    return _json_result(readers.read_json_logs(spark, f"{path}/*/*.gz", 7, NOW))


_OTLP = """concat('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"', service, '"}},{"key":"service.version","value":{"stringValue":"', release, '"}},
{"key":"deployment.environment","value":{"stringValue":"', environment, '"}},{"key":"host","value":{"intValue":"', log_id, '"}},{"key":"zone","value":{"doubleValue":1.5}}]},
"scopeLogs":[{"logRecords":[{"timeUnixNano":"', CASE log_id % 3 WHEN 0 THEN '0' WHEN 1 THEN concat(1700000000 + log_id, '000001999') ELSE '99999999999999999999999' END, '","severityNumber":', log_id % 26, ',"severityText":"error","body":{"stringValue":"m', log_id, '"},
"attributes":[{"key":"host","value":{"boolValue":true}},{"key":"list","value":{"arrayValue":{"values":[{"intValue":"1"}]}}}],"traceId":"', CASE log_id % 2 WHEN 0 THEN repeat('0', 32) ELSE repeat('AB01', 8) END, '"}]}]}]}')"""


@query(f"""SELECT concat('m', log_id) AS body, CASE WHEN n >= 21 THEN 5 WHEN n >= 17 OR n = 0 THEN 4 WHEN n >= 13 THEN 3 WHEN n >= 9 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END AS severity, service, environment, release,
CASE log_id % 2 WHEN 0 THEN '' ELSE repeat('ab01', 8) END AS trace_id, 'host=true;list={{"values":[{{"intValue":"1"}}]}};zone=1.5' AS attrs, CASE log_id % 3 WHEN 1 THEN (1700000000 + log_id) * 1000000 + 1 ELSE {_NOW_US} END AS us FROM (SELECT *, log_id % 26 AS n FROM logs)""")
def ingest_otlp(spark, sf_dir):
    """OTLP JSON: resource and record attributes, severity bands, typed values, absent and overlong times."""
    rows = views.logs(spark, sf_dir).select(F.from_json(F.expr(_OTLP), readers.OTLP).alias("r")).select("r.*")
    return readers.otlp_records(rows, 7, NOW).select("body", "severity", "service", "environment", "release", "trace_id", _attrs_text("attrs"), _micros("ts"))


def _attrs_text(column: str):
    """A map as one text, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attrs")


# --- lines -------------------------------------------------------------------------------


@query("SELECT body AS text, 'web' AS service, count(*) AS n FROM logs GROUP BY 1")
def text_lines(spark, sf_dir):
    path = views.scratch(spark)
    views.logs(spark, sf_dir).select("body").write.text(path)
    return readers.read_lines(spark, path, "web").groupBy("text", "service").agg(F.count("*").alias("n"))


@query(f"""SELECT log_id, body AS text, log_id % 4 = 0 AS unparsed, CASE log_id % 4 WHEN 0 THEN {_NOW_US} ELSE epoch_us(date_trunc('second', ts)) + 123456 END AS us,
CASE log_id % 3 WHEN 0 THEN 'swarm_1' WHEN 1 THEN concat(service, '_') ELSE 'web_app-x' END AS service FROM logs WHERE log_id % 3 <> 1 OR service <> 'svc4'""")
def container_lines(spark, sf_dir):
    """Lines with the time in front, names from labels, and a service kept out."""
    labels = "CASE log_id % 3 WHEN 0 THEN map('com.docker.swarm.service.name', 'swarm/1', 'com.docker.compose.service', 'x') WHEN 1 THEN map('com.docker.compose.service', concat(service, '!')) ELSE map('other', 'y') END"
    text = "CASE log_id % 4 WHEN 0 THEN body ELSE concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '.123456789Z ', body) END"
    lines = views.logs(spark, sf_dir).select("log_id", F.expr(text).alias("text"), F.expr(labels).alias("labels"))
    named = lines.withColumn("service", readers.container_service(F.col("labels"), F.lit("web.app-x")))
    return readers.parse_container_lines(readers.select_services(named, exclude=["svc4_"], labels="labels"), NOW).select("log_id", "text", "unparsed", "service", _micros("ts"))


@query("""SELECT concat('{"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '","service":"', service, '","message":"', replace(body, '"', '\\"'), '"}') AS value FROM logs""")
def ship_records(spark, sf_dir):
    return writers.to_ship_records(views.logs(spark, sf_dir).withColumnRenamed("body", "text"))


_GAPS = f"""WITH l AS ({_LINES}), s AS (SELECT *, regexp_matches(text, '^(?:panic:|fatal error:)') AS head, regexp_matches(text, '^(?:[ \\t]|at |Caused by:|\\.\\.\\. [0-9]+ more)') AS more, CASE conv_id % 3 WHEN 2 THEN turn ELSE 0 END AS session FROM l),
a AS (SELECT *, coalesce(bool_or(head) OVER (PARTITION BY conv_id, session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen, row_number() OVER (PARTITION BY conv_id, session ORDER BY turn) AS k FROM s),
b AS (SELECT *, sum(CASE WHEN k = 1 OR head OR (NOT seen AND NOT more) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, session ORDER BY turn) AS rec FROM a)
SELECT cast(conv_id AS varchar) AS source, min(turn) AS seq, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS lines FROM b GROUP BY conv_id, session, rec"""


@query(_GAPS, plain=True)
def multiline_gap(spark, sf_dir):
    """As ``multiline_join``, with lines of every third source two seconds apart, beyond the join window."""
    return multiline.join_multiline(_gap_lines(spark, sf_dir)).select("source", "seq", "text", "lines")


def _gap_lines(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("conversations")
    ts = F.timestamp_seconds(F.col("turn") * F.when(F.col("conv_id") % 3 == 2, 2).otherwise(1))
    return spark.sql(_LINES).select(F.col("conv_id").cast("string").alias("source"), F.lit("chat").alias("service"), F.col("turn").alias("seq"), ts.alias("ts"), "text")


@query(_GAPS, plain=True)
def multiline_sliced(spark, sf_dir):
    """The same with slices of two lines, so that every state goes from slice to slice."""
    return multiline.join_multiline(_gap_lines(spark, sf_dir), slice_size=2).select("source", "seq", "text", "lines")


@query(_GAPS, plain=True)
def stream_multiline(spark, sf_dir):
    """The same as a stream of three batches, each with some turns of all sources: records go on from batch to batch."""
    path, lines = views.scratch(spark), _gap_lines(spark, sf_dir).withColumn("seq", F.col("seq").cast("long"))
    for part in ("seq <= 1", "seq between 2 and 4", "seq > 4 or seq is null"):
        lines.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream.writeStream.foreachBatch(multiline.join_stream(path)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return multiline.stream_records(spark, path).select("source", "seq", "text", "lines")


# Lines of documents: most of them continuations, some of them crash headers. Records are at most 1000 bytes long beyond their first line.
_DOC_LINE = "concat(CASE WHEN seq % 37 = 5 THEN 'panic: ' WHEN seq % 11 <> 0 THEN chr(9) ELSE '' END, line)"


@query(f"""WITH RECURSIVE l AS (SELECT source, seq, {_DOC_LINE} AS text FROM (SELECT cast(doc_id AS varchar) AS source, unnest(string_split(text, chr(10))) AS line, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS bigint) AS seq FROM documents WHERE text IS NOT NULL)),
b AS (SELECT *, strlen(text) AS bytes, starts_with(text, 'panic:') AS head, starts_with(text, chr(9)) OR starts_with(text, ' ') OR starts_with(text, 'at ') OR starts_with(text, 'Caused by:') AS more FROM l),
s AS (SELECT source, seq, bytes AS size, head AS crash, seq AS record FROM b WHERE seq = 0
 UNION ALL SELECT source, seq, CASE WHEN joins AND NOT breaks THEN size + 1 + bytes ELSE bytes END, CASE WHEN joins AND NOT breaks THEN crash WHEN breaks THEN false ELSE head END, CASE WHEN joins AND NOT breaks THEN record ELSE seq END
 FROM (SELECT b.source, b.seq, bytes, head, size, crash, record, (NOT head AND (crash OR more)) AS joins, (NOT head AND (crash OR more)) AND size + 1 + bytes > 1000 AS breaks FROM s JOIN b ON b.source = s.source AND b.seq = s.seq + 1))
SELECT source, record AS seq, count(*) AS lines, string_agg(text, chr(10) ORDER BY s.seq) AS text FROM s JOIN b USING (source, seq) GROUP BY ALL""", plain=True)
def multiline_capped(spark, sf_dir):
    """Lines of documents as records under a limit that many of them reach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    lines = docs.select("source", F.lit("docs").alias("service"), "seq", F.lit(None).cast("timestamp").alias("ts"), F.expr(_DOC_LINE).alias("text"))
    return multiline.join_multiline(lines, max_bytes=1000, slice_size=16).select("source", "seq", "lines", "text")


# --- texts and bodies --------------------------------------------------------------------


@query(f"SELECT log_id, regexp_replace(c, '\\x1b\\[[0-?]*[ -/]*[@-~]', '', 'g') AS plain, CASE WHEN length(c) > 30 THEN concat(left(c, 30), '… [', length(c), ' chars]') ELSE c END AS short FROM (SELECT log_id, {_COLOURED} AS c FROM logs)")
def text_forms(spark, sf_dir):
    c = F.expr(_COLOURED)
    return views.logs(spark, sf_dir).select("log_id", txt.strip_csi(c).alias("plain"), txt.truncated(c, 30).alias("short"))


_ODD = """CASE log_id % 8
WHEN 0 THEN concat('{"msg":"a","time":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+00:00","service":"inner","trace_id":"t1","level":"error"}')
WHEN 1 THEN '{"message":"b","ts":1e300,"n":1.50}'
WHEN 2 THEN '{"msg":"c","ts":"99999999999999999999"}'
WHEN 3 THEN '{"msg":"d","ts":10000000000000000}'
WHEN 4 THEN '{"msg":"e\\\\ud800f","deep":{"x":[1,{"y":true}],"z":null},"kept":"new"}'
WHEN 5 THEN 'level=warn msg="say \\\\"hi\\\\"" path=/a took=3ms'
WHEN 6 THEN '{"level":"error","msg":{"no":"text"}}'
ELSE 'x=1 y=2' END"""


@query("""SELECT log_id, CASE log_id % 8 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' WHEN 4 THEN concat('e', chr(65533), 'f') WHEN 5 THEN 'say "hi"' WHEN 6 THEN '{"level":"error","msg":{"no":"text"}}' ELSE 'x=1 y=2' END AS body,
CASE log_id % 8 WHEN 0 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 4 ELSE 2 END AS severity, CASE log_id % 8 WHEN 0 THEN 'inner' ELSE '' END AS service, CASE log_id % 8 WHEN 0 THEN 't1' ELSE '' END AS trace_id,
CASE log_id % 8 WHEN 1 THEN 'kept=old;n=1.50' WHEN 4 THEN 'deep.x=[1,{"y":true}];deep.z=null;kept=old' WHEN 5 THEN 'kept=old;path=/a;took=3ms' ELSE 'kept=old' END AS attrs,
CASE log_id % 8 WHEN 0 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(date_trunc('second', ts)) + 3600000000 END AS us FROM logs""")
def odd_bodies(spark, sf_dir):
    """Bodies with times out of range, a lone surrogate, nested values, escapes, no message; the records are an hour later than the bodies say."""
    at = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))) + F.expr("INTERVAL 1 HOUR")
    logs = views.logs(spark, sf_dir).select("log_id", "project_id", F.expr(_ODD).alias("body"), F.lit(2).alias("severity"), F.lit("").alias("service"), F.lit("").alias("trace_id"), at.alias("ts"), F.create_map(F.lit("kept"), F.lit("old")).alias("attrs"))
    return bodies.parse_bodies(logs).select("log_id", "body", "severity", "service", "trace_id", _attrs_text("attrs"), _micros("ts"))


# --- the whole chain ---------------------------------------------------------------------

_PARSED = """, parsed AS (SELECT * REPLACE (CASE WHEN project_id = 2 THEN severity WHEN severity = 2 AND body LIKE 'level=warn%' THEN 3 ELSE severity END AS severity,
CASE WHEN project_id = 2 THEN body WHEN body LIKE 'level=warn%' THEN 'signup slow' WHEN body LIKE '{%' THEN 'click failed' ELSE body END AS body) FROM logs),
lifted AS (SELECT * EXCLUDE (lift) REPLACE (CASE lift WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE severity END AS severity) FROM (SELECT *, """ + _LIFT + """ AS lift FROM parsed))
"""
_CHAIN = _PARSED + _NOISE.replace("FROM logs)", "FROM lifted)") + ", kept AS (SELECT l.* FROM lifted l JOIN marked m USING (log_id) WHERE m.drop_rule_id IS NULL)\n"


_EVENTS = f"""SELECT log_id, severity, body, severity >= 4 AS is_event, CASE WHEN severity >= 4 THEN substring(trim(split_part(body, chr(10), 1)), 1, 200) ELSE '' END AS title,
CASE WHEN severity >= 4 THEN substring(sha256(concat(cast(project_id AS varchar), '|', {_NAME}, '|', {_NORM})), 1, 16) ELSE '' END AS fingerprint FROM """
_STREAM_CHAIN = _PARSED + _EVENTS + "lifted"


@query(_CHAIN + _EVENTS + "kept")
def normalize_chain(spark, sf_dir):
    """Escapes, bodies, panics, severity rules, noise rules, events: the chain in its order."""
    events = normalize.normalize(views.logs_with_attrs(spark, sf_dir), views.projects(spark), views.severity_rules(spark), views.noise_rules(spark))
    return events.select("log_id", "severity", "body", "is_event", "title", "fingerprint")


_ATTRS = """CASE log_id % 4 WHEN 0 THEN map('exception.type', 'ValueError', 'exception.message', concat('bad id ', log_id + 100000000)) WHEN 1 THEN map('emberlog.fingerprint', concat('mine-', log_id % 3))
WHEN 2 THEN map('exception.type', 'KeyError') ELSE map('other', 'x') END"""


@query(f"""SELECT log_id, CASE log_id % 4 WHEN 0 THEN concat('ValueError: ', line) WHEN 2 THEN CASE WHEN log_id % 8 = 2 THEN 'KeyError' ELSE concat('KeyError: ', line) END ELSE line END AS title,
substring(sha256(concat(cast(project_id AS varchar), '|', CASE log_id % 4 WHEN 0 THEN 'ValueError|bad id <n>' WHEN 1 THEN concat('mine-', log_id % 3) WHEN 2 THEN 'KeyError|' ELSE concat({_NAME}, '|', {_NORM}) END)), 1, 16) AS fingerprint
FROM (SELECT *, trim(split_part(body, chr(10), 1)) AS line FROM logs) WHERE severity >= 4 OR log_id % 4 IN (0, 2)""")
def fingerprint_attrs(spark, sf_dir):
    """Events by exception attributes and by an override of the grouping; some without a body."""
    logs = views.logs(spark, sf_dir).withColumn("attrs", F.expr(_ATTRS)).withColumn("body", F.when(F.col("log_id") % 8 == 2, "").otherwise(F.col("body")))
    return normalize.annotate_events(logs).where("is_event").select("log_id", "title", "fingerprint")


@query("SELECT log_id FROM logs WHERE severity >= 4 AND ts >= timestamp '2024-01-20 06:00:00'")
def search_since(spark, sf_dir):
    """Records since a relative time."""
    since = parse_since("306h", datetime(2024, 2, 2, tzinfo=timezone.utc))
    return search.filter_logs(views.logs(spark, sf_dir), min_severity=4, since=since.strftime("%Y-%m-%d %H:%M:%S")).select("log_id")
