"""The given ``events`` table as log records, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOGS_SQL = """
SELECT event_id AS log_id, user_id % 3 + 1 AS project_id, ts,
  CASE WHEN event_type = 'error' AND value >= 150 THEN 5
       WHEN event_type = 'error' THEN 4
       WHEN event_type = 'purchase' AND value >= 150 THEN 3
       WHEN event_type IN ('purchase', 'signup') THEN 2
       WHEN event_type = 'view' THEN 1 ELSE 0 END AS severity,
  CASE WHEN event_type = 'error' AND user_id % 4 = 0
         THEN concat('dial tcp 10.0.', cast(user_id % 256 AS string), '.',
                     cast(event_id % 200 AS string), ':5432: connect: connection refused')
       WHEN event_type = 'error' AND user_id % 4 = 1
         THEN concat('pq: duplicate key value violates unique constraint "k_',
                     cast(event_id AS string), '_key"')
       WHEN event_type = 'error' AND user_id % 4 = 2
         THEN concat('order lookup failed for order_id ', cast(event_id + 1000000000 AS string))
       WHEN event_type = 'error'
         THEN concat('GET /health 503 Service Unavailable trace=',
                     substring(md5(cast(event_id AS string)), 1, 16))
       WHEN event_type = 'signup'
         THEN concat('level=warn msg="signup slow" user=', cast(user_id AS string),
                     ' took=', cast(cast(floor(value) AS bigint) AS string), 'ms')
       WHEN event_type = 'click'
         THEN concat('{"level":"error","msg":"click failed","n":', cast(event_id AS string), '}')
       ELSE concat('request handled path=/api/v1/items/', cast(event_id AS string),
                   ' status=200 dur=', cast(cast(floor(value) AS bigint) AS string), 'ms')
  END AS body,
  concat('svc', cast(user_id % 10 AS string)) AS service,
  CASE WHEN event_id % 5 = 0 THEN 'staging' ELSE 'prod' END AS environment,
  concat('v1.', cast(event_id % 3 AS string)) AS release,
  '' AS trace_id
FROM events
"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records without attributes."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(LOGS_SQL)


def logs_with_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).withColumn("attrs", F.create_map().cast("map<string,string>"))


def projects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "Shop", "shop-1", 7, True), (2, "Desk", "desk-2", 20, False), (3, "Lab", "lab-3", 0, True)], "id long, name string, slug string, retention_days int, parse_bodies boolean")


def noise_rules(spark: SparkSession) -> DataFrame:
    rows = [
        (1, 1, "severity_floor", "svc1", 2, "", 0, True, 0),
        (2, 2, "drop_match", "", None, "/items/1", 0, True, 0),
        (3, 3, "sample", "", 1, "", 3, True, 0),
        (4, 3, "drop_match", "svc3", None, "handled", 0, False, 0),
        (5, 3, "sample", "", 2, "", 2, True, 0),
    ]
    return spark.createDataFrame(rows, "id long, project_id long, kind string, service string, severity int, pattern string, n int, enabled boolean, dropped_count long")


def severity_rules(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, "", "signup slow|handled path=/api/v1/items/[0-9]*7 ", 4, True, 0), (2, 0, "svc2", "^request", 3, True, 0), (3, 1, "", "[0-9]", 5, False, 0)]
    return spark.createDataFrame(rows, "id long, project_id long, service string, pattern string, severity int, enabled boolean, lifted_count long")


def alert_rules(spark: SparkSession) -> DataFrame:
    rows = [
        (1, 1, "burst", "threshold", "", "", 4, 3, 60, 900, "https://example.org/hook", True),
        (2, 2, "new", "new_issue", "", "", 4, 1, 1, 0, "https://example.org/hook", True),
        (3, 3, "back", "regression", "", "prod", 0, 1, 1, 3600, "https://example.org/hook", True),
        (4, 3, "staging burst", "threshold", "", "staging", 0, 2, 120, 7200, "https://example.org/hook", True),
    ]
    schema = "id long, project_id long, name string, kind string, service string, environment string, min_severity int, n int, window_minutes int, cooldown_seconds int, url string, enabled boolean"
    return spark.createDataFrame(rows, schema).withColumns({"last_fired": F.lit(None).cast("timestamp"), "last_error": F.lit("")})


def actions(issues: DataFrame) -> DataFrame:
    """Every other issue resolved half-way through its events, every third one ignored near their end."""
    half = F.floor((F.col("first_id") + F.col("last_id")) / 2)
    late = F.col("first_id") + F.floor((F.col("last_id") - F.col("first_id")) * 9 / 10)
    digit = F.substring("fingerprint", 1, 1)
    resolved = F.when(digit.isin("0", "2", "4", "6", "8", "a", "c", "e"), F.struct(F.lit("resolved").alias("status"), half.alias("seq")))
    ignored = F.when(digit.isin("0", "3", "6", "9", "c", "f"), F.struct(F.lit("ignored").alias("status"), late.alias("seq")))
    return issues.select("project_id", "fingerprint", F.explode(F.array_compact(F.array(resolved, ignored))).alias("a")).select("project_id", "fingerprint", "a.status", "a.seq")


# The same in SQL over a relation ``groups`` (project_id, fingerprint, first_id, last_id).
ACTIONS_SQL = """
SELECT project_id, fingerprint, 'resolved' AS status, cast(floor((first_id + last_id) / 2) AS bigint) AS seq FROM groups WHERE substring(fingerprint, 1, 1) IN ('0','2','4','6','8','a','c','e')
UNION ALL
SELECT project_id, fingerprint, 'ignored', first_id + cast(floor((last_id - first_id) * 9 / 10) AS bigint) FROM groups WHERE substring(fingerprint, 1, 1) IN ('0','3','6','9','c','f')
"""


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, for queries that write and read again; a local one only with a local master."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/plans/{uuid.uuid4().hex}"
