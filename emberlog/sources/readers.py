"""Readers of log records: JSON, OTLP JSON, text and container lines, exported corpora."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.severity import INFO, parse_severity, severity_of_number
from emberlog.functions.times import epoch_seconds, parse_rfc3339

_TEXTS = ("severity", "message", "msg", "body", "service", "environment", "release", "trace_id", "timestamp", "time", "ts")
JSON_LOG = ", ".join(f"{c} string" for c in _TEXTS) + ", attributes map<string,string>, attrs map<string,string>"
# Fixed value: the part of the OTLP JSON log schema that is read.
_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,arrayValue:string,kvlistValue:string>>>"
OTLP = (
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<struct<logRecords:array<struct<"
    f"timeUnixNano:string,severityNumber:int,severityText:string,body:struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,arrayValue:string,kvlistValue:string>,"
    f"attributes:{_ATTRIBUTES},traceId:string>>>>>>"
)
#: Label that keeps a container's lines out.
IGNORE_LABEL = "emberlog.ignore"


def _now(now: datetime | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def _first_text(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def _one_timestamp(name: str) -> Column:
    text = F.col(name)
    return F.coalesce(parse_rfc3339(text), F.when(text.rlike(r"\A-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"), epoch_seconds(text.try_cast("double"))))


def json_records(rows: DataFrame, project_id: int, now: datetime | None = None) -> DataFrame:
    """Rows of the JSON schema to log records: aliases are resolved, a missing or unknown severity is INFO, a timestamp that can't be read is ``now``."""
    return rows.select(
        F.lit(project_id).cast("long").alias("project_id"), F.coalesce(_one_timestamp("timestamp"), _one_timestamp("time"), _one_timestamp("ts"), _now(now)).alias("ts"),
        F.when(F.col("severity").isNull(), F.lit(INFO)).otherwise(parse_severity(F.col("severity"))).cast("int").alias("severity"), _first_text("message", "msg", "body").alias("body"),
        *[_first_text(c).alias(c) for c in ("service", "environment", "release", "trace_id")],
        F.coalesce("attrs", "attributes", F.create_map().cast("map<string,string>")).alias("attrs"),
    )


def read_json_logs(spark: SparkSession, path: str, project_id: int, now: datetime | None = None) -> DataFrame:
    """Files that hold a JSON array of records, or single ones (gzip as well)."""
    return json_records(spark.read.schema(JSON_LOG).option("multiLine", True).json(path), project_id, now)


def stream_json_logs(spark: SparkSession, path: str, project_id: int, max_files: int = 100, now: datetime | None = None) -> DataFrame:
    """The same as a stream of new files."""
    return json_records(spark.readStream.schema(JSON_LOG).option("multiLine", True).option("maxFilesPerTrigger", max_files).json(path), project_id, now)


def _any_value(value: Column) -> Column:
    nested = [F.to_json(F.try_parse_json(value[k])) for k in ("arrayValue", "kvlistValue")]
    return F.coalesce(*[value[k] for k in ("stringValue", "boolValue", "intValue", "doubleValue")], *nested, F.lit(""))


def _attributes(entries: Column) -> Column:
    """The last of equal keys counts."""
    entries = F.filter(F.coalesce(entries, F.array().cast(_ATTRIBUTES)), lambda e: e["key"].isNotNull())
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], _any_value(e["value"]))))


def otlp_records(rows: DataFrame, project_id: int, now: datetime | None = None) -> DataFrame:
    """Rows of the OTLP JSON schema to log records, each with its own resource's service, release, environment and attributes; the record's attributes win."""
    resources = rows.select(F.explode("resourceLogs").alias("r")).select(_attributes(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeLogs").alias("s"))
    records = resources.select("resource", F.explode("s.logRecords").alias("l")).withColumn("own", _attributes(F.col("l.attributes")))
    named = ("service.name", "service.version", "deployment.environment.name", "deployment.environment")
    of = lambda key: F.nullif(F.try_element_at("resource", F.lit(key)), F.lit(""))
    rest = F.map_filter("resource", lambda k, _: ~k.isin(*named) & ~F.map_contains_key("own", k))
    nanos, trace = F.col("l.timeUnixNano").try_cast("decimal(20,0)"), F.lower(F.coalesce("l.traceId", F.lit("")))
    number = F.coalesce("l.severityNumber", F.lit(0))
    severity = F.when(number != 0, F.coalesce(severity_of_number(number), F.lit(INFO))).otherwise(parse_severity(F.coalesce("l.severityText", F.lit(""))))
    return records.select(
        F.lit(project_id).cast("long").alias("project_id"), F.when(nanos > 0, F.timestamp_micros(F.floor(nanos / 1000).try_cast("long"))).otherwise(_now(now)).alias("ts"), severity.cast("int").alias("severity"),
        _any_value(F.col("l.body")).alias("body"), F.coalesce(of("service.name"), F.lit("")).alias("service"), F.coalesce(of("deployment.environment.name"), of("deployment.environment"), F.lit("")).alias("environment"),
        F.coalesce(of("service.version"), F.lit("")).alias("release"), F.when(trace.rlike(r"\A0*\z"), "").otherwise(trace).alias("trace_id"), F.map_concat(rest, F.col("own")).alias("attrs"),
    )


def read_otlp_json(spark: SparkSession, path: str, project_id: int, now: datetime | None = None) -> DataFrame:
    return otlp_records(spark.read.schema(OTLP).option("multiLine", True).json(path), project_id, now)


def number_logs(logs: DataFrame, start: int = 0) -> DataFrame:
    """Log ids in order of time for records that have none yet, from ``start`` + 1 on: unique and ascending, not dense.

    Partitions are ranges of time; an id is made of the partition and the place in it.
    """
    return logs.repartitionByRange("ts").sortWithinPartitions("ts").withColumn("log_id", F.monotonically_increasing_id() + start + 1)


def read_lines(spark: SparkSession, glob: str, service: str) -> DataFrame:
    """Text files as lines ``(source, service, text)``: the source is the file, and complete lines count."""
    return spark.read.text(glob).select(F.input_file_name().alias("source"), F.lit(service).alias("service"), F.col("value").alias("text"))


def stream_lines(spark: SparkSession, glob: str, service: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(glob).select(F.col("_metadata.file_path").alias("source"), F.lit(service).alias("service"), F.col("value").alias("text"))


def parse_container_lines(df: DataFrame, now: datetime | None = None) -> DataFrame:
    """Splits the time before the first space off ``text``; a line without one keeps its text, gets ``now`` and is marked ``unparsed``."""
    ts = parse_rfc3339(F.regexp_extract("text", r"\A([^ ]*) ", 1))
    return df.withColumns({"unparsed": ts.isNull(), "ts": F.coalesce(ts, _now(now)), "text": F.when(ts.isNull(), F.col("text")).otherwise(F.regexp_replace("text", r"\A[^ ]* ", ""))})


def container_service(labels: Column, name: Column) -> Column:
    """The swarm's service label, else compose's, else the container's name; other characters than letters, digits, ``_`` and ``-`` become ``_``."""
    of = lambda key: F.nullif(F.try_element_at(labels, F.lit(key)), F.lit(""))
    return F.regexp_replace(F.coalesce(of("com.docker.swarm.service.name"), of("com.docker.compose.service"), name), "[^a-zA-Z0-9_-]", "_")


def select_services(df: DataFrame, only: Iterable[str] = (), exclude: Iterable[str] = (), labels: str | None = None, ignore_label: str = IGNORE_LABEL) -> DataFrame:
    """Lines of the chosen services: the ignore label keeps out always; then ``only`` (if any) less ``exclude``."""
    only, exclude = list(only), list(exclude)
    if labels:
        df = df.where(F.coalesce(F.try_element_at(labels, F.lit(ignore_label)), F.lit("")) != "true")
    if only:
        df = df.where(F.col("service").isin(only))
    return df.where(~F.col("service").isin(exclude)) if exclude else df


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """An exported JSON array of ts, severity, service, body and attrs (JSON text); a time that can't be read is the epoch."""
    rows = spark.read.schema("ts string, severity string, service string, body string, attrs string").option("multiLine", True).json(path)
    return rows.select(
        F.coalesce(parse_rfc3339(F.col("ts")), F.timestamp_seconds(F.lit(0))).alias("ts"), parse_severity(F.coalesce("severity", F.lit(""))).alias("severity"),
        F.coalesce("service", F.lit("")).alias("service"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce(F.from_json("attrs", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("attrs"),
    )


