"""Retention and layout of the logs table: partitions ``project_id`` and ``day``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.severity import NAMES
from emberlog.operators.rules import MAX_RULES

SHARD_ROWS = 100_000
GUARDRAIL = timedelta(hours=24)


def prune(logs: DataFrame, projects: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)``: records from each project's cutoff on, ``now`` less its days of retention (none or 0: for ever); ``removed`` counts the rest by project.

    Cutoffs are compiled to an expression, without a join or a shuffle; in a table with a ``day``
    column it prunes whole partitions too. Beyond ``MAX_RULES`` projects with a cutoff they are
    joined.
    """
    kind = logs.schema["ts"].dataType
    limited = projects.where(F.coalesce("retention_days", F.lit(0)) > 0)
    cutoff = (F.lit(now).cast(kind) - F.make_dt_interval("retention_days")).cast(kind)
    rows = limited.select("id", cutoff.cast("string").alias("cutoff"), F.date_format(cutoff, "yyyy-MM-dd").alias("day")).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        marked = logs.join(limited.select(F.col("id").alias("project_id"), cutoff.alias("__cutoff")), "project_id", "left")
        marked = marked.withColumn("__kept", F.coalesce(F.col("ts") >= F.col("__cutoff"), F.lit(True))).drop("__cutoff")
        return marked.where("__kept").drop("__kept"), marked.where("not __kept").groupBy("project_id").agg(F.count("*").alias("removed"))
    kept, day = F.lit(True), F.lit(True)
    for r in rows:
        mine = F.col("project_id") == r["id"]
        kept = F.when(mine, F.col("ts") >= F.lit(r["cutoff"]).cast(kind)).otherwise(kept)
        day = F.when(mine, F.col("day") >= F.lit(r["day"])).otherwise(day) if "day" in logs.columns else day
    kept, day = F.coalesce(kept, F.lit(True)), F.coalesce(day, F.lit(True))
    removed = logs.where(~kept).groupBy("project_id").agg(F.count("*").alias("removed"))
    return (logs.where(day) if "day" in logs.columns else logs).where(kept), removed


def enforce_size_cap(logs: DataFrame, total_bytes: int, cap_bytes: int, now: datetime) -> DataFrame:
    """All records while the table is within its cap, else only those of the last 24 hours, in all projects."""
    if cap_bytes <= 0 or total_bytes <= cap_bytes:
        return logs
    return logs.where(F.col("ts") >= F.lit(now).cast(logs.schema["ts"].dataType) - F.lit(GUARDRAIL))


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a table's files, by Hadoop's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``records``, ``bytes`` of the table's files, and ``bytes_per_record`` (0 for an empty table)."""
    size = table_bytes(spark, path)
    per = F.when(F.col("records") > 0, F.lit(float(size)) / F.col("records")).otherwise(0.0)
    return spark.read.parquet(path).agg(F.count("*").alias("records")).select("records", F.lit(size).cast("long").alias("bytes"), per.alias("bytes_per_record"))


def expired_days(logs: DataFrame, projects: DataFrame, now: datetime) -> DataFrame:
    """``(project_id, day)`` partitions that lie wholly before the cutoff: to be dropped without reading a record."""
    cutoffs = projects.where(F.coalesce("retention_days", F.lit(0)) > 0).select(F.col("id").alias("project_id"), F.date_sub(F.lit(now).cast("date"), F.col("retention_days")).alias("__first"))
    return logs.select("project_id", "day").distinct().join(cutoffs, "project_id").where(F.col("day").cast("date") < F.col("__first")).drop("__first")


def compact_day(spark: SparkSession, source: str, target: str, shard_rows: int = SHARD_ROWS, hour_open: datetime | None = None) -> int:
    """Rewrites a day's small files to ceil(rows / ``shard_rows``) files, each sorted by (ts, log_id), at ``target``; returns their number.

    Records of the hour ``hour_open`` (still being written) are left out. The source stays as
    it is until the caller swaps the folders, so running queries keep their files.
    """
    rows = spark.read.parquet(source)
    if hour_open is not None:
        rows = rows.where(F.col("ts") < F.lit(hour_open).cast(rows.schema["ts"].dataType))
    shards = max(1, -(-rows.count() // shard_rows))
    rows.repartitionByRange(shards, "ts", "log_id").sortWithinPartitions("ts", "log_id").write.option("compression", "zstd").parquet(target)
    return shards


def partition_profile(logs: DataFrame, by: tuple[str, ...] = ("project_id", "day")) -> DataFrame:
    """Per partition: rows, events, bounds of ts and log_id, rows of each severity, services."""
    levels = [F.count_if(F.col("severity") == k).alias(name.lower()) for k, name in enumerate(NAMES)]
    event = F.col("is_event") if "is_event" in logs.columns else F.col("severity") >= 4
    bounds = [F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min("log_id").alias("min_id"), F.max("log_id").alias("max_id")]
    return logs.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(event).alias("events"), *bounds, *levels, F.array_sort(F.collect_set("service")).alias("services"))
