"""Hourly pre-aggregates, and the reports read from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.severity import ERROR

KEY = ("project_id", "service", "severity", "hour")
GROUPS = ("service", "severity", "hour", "day")


def rollup(logs: DataFrame) -> DataFrame:
    """``(project_id, service, severity, hour, logs, events)``."""
    event = F.col("is_event") if "is_event" in logs.columns else F.col("severity") >= ERROR
    return logs.groupBy("project_id", "service", "severity", F.date_trunc("hour", "ts").cast(logs.schema["ts"].dataType).alias("hour")).agg(F.count("*").alias("logs"), F.count_if(event).alias("events"))


def merge_rollups(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sums of two rollups, bucket by bucket."""
    return a.unionByName(b).groupBy(*KEY).agg(F.sum("logs").alias("logs"), F.sum("events").alias("events"))


def _hours(rollups: DataFrame, project: int, since: datetime | None, until: datetime | None) -> DataFrame:
    """A project's buckets; both bounds take their whole hour."""
    rows = rollups.where(F.col("project_id") == project)
    kind = rollups.schema["hour"].dataType
    bound = lambda t: F.date_trunc("hour", F.lit(t).cast(kind)).cast(kind)
    if since is not None:
        rows = rows.where(F.col("hour") >= bound(since))
    if until is not None:
        rows = rows.where(F.col("hour") <= bound(until))
    return rows


def _key(group_by: str) -> Column:
    return {"service": F.col("service"), "severity": F.col("severity").cast("string"), "hour": F.date_format("hour", "yyyy-MM-dd'T'HH"), "day": F.date_format("hour", "yyyy-MM-dd")}[group_by]


def aggregate(rollups: DataFrame, project: int, group_by: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """``(key, logs, events)``, hour by hour within the bounds. By service: most logs first, then by key; by severity: the most severe first; by hour and day: oldest first."""
    if group_by not in GROUPS:
        raise ValueError(f"group_by must be one of {', '.join(GROUPS)}")
    if not project:
        raise ValueError("a project is needed")
    rows = _hours(rollups, project, since, until).groupBy(_key(group_by).alias("key")).agg(F.sum("logs").alias("logs"), F.sum("events").alias("events"))
    order = {"service": (F.desc("logs"), F.asc("key")), "severity": (F.desc(F.col("key").cast("int")),)}.get(group_by, (F.asc("key"),))
    return rows.orderBy(*order)


def stats(rollups: DataFrame, issues: DataFrame, rules: DataFrame | None, project: int, since: datetime | None = None) -> DataFrame:
    """``(day, logs, events, total_logs, total_events, open_issues, dropped)``, oldest day first; totals in every row. Project 0 counts nothing."""
    days = _hours(rollups, project, since, None).groupBy(F.date_format("hour", "yyyy-MM-dd").alias("day")).agg(F.sum("logs").alias("logs"), F.sum("events").alias("events"))
    totals = days.agg(F.sum("logs").alias("total_logs"), F.sum("events").alias("total_events"))
    opened = issues.where((F.col("project_id") == project) & (F.col("status") == "open")).agg(F.count("*").alias("open_issues"))
    dropped = days.sparkSession.range(1).select(F.lit(0).cast("long").alias("dropped")) if rules is None else rules.where(F.col("project_id") == project).agg(F.coalesce(F.sum("dropped_count"), F.lit(0)).alias("dropped"))
    one = F.lit(1).alias("one")  # each of these is a single row
    row = totals.select("*", one).join(opened.select("*", one), "one").join(dropped.select("*", one), "one")
    return days.select("*", one).join(F.broadcast(row), "one").drop("one").orderBy("day")


def service_counts(rollups: DataFrame, project: int, since: datetime | None = None, k: int = 20) -> DataFrame:
    """The ``k`` services with most logs, then by name."""
    return _hours(rollups, project, since, None).groupBy("service").agg(F.sum("logs").alias("logs")).orderBy(F.desc("logs"), "service").limit(k)


def noise_report(rollups: DataFrame, rules: DataFrame, project: int, since: datetime | None = None, k: int = 20) -> DataFrame:
    """``(section, name, n)``: the noisiest services, every noise rule with its drops, and their total."""
    top = service_counts(rollups, project, since, k).select(F.lit("service").alias("section"), F.col("service").alias("name"), F.col("logs").alias("n"))
    mine = rules.where(F.col("project_id") == project)
    by_rule = mine.select(F.lit("rule").alias("section"), F.col("id").cast("string").alias("name"), F.coalesce("dropped_count", F.lit(0)).alias("n"))
    total = mine.agg(F.coalesce(F.sum("dropped_count"), F.lit(0)).alias("n")).select(F.lit("total").alias("section"), F.lit("dropped").alias("name"), "n")
    return top.unionByName(by_rule).unionByName(total)


def project_overview(rollups: DataFrame, issues: DataFrame, projects: DataFrame, since: datetime) -> DataFrame:
    """Every project with its open issues and its logs since a time (by whole hours), by id."""
    recent = rollups.where(F.col("hour") >= F.date_trunc("hour", F.lit(since).cast(rollups.schema["hour"].dataType)).cast(rollups.schema["hour"].dataType)).groupBy(F.col("project_id").alias("id")).agg(F.sum("logs").alias("logs"))
    opened = issues.where("status = 'open'").groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("open_issues"))
    out = projects.select("id", "name").join(opened, "id", "left").join(recent, "id", "left")
    return out.select("id", "name", F.coalesce("open_issues", F.lit(0)).alias("open_issues"), F.coalesce("logs", F.lit(0)).alias("logs")).orderBy("id")


def trend_series(days: DataFrame) -> DataFrame:
    """``days(day, events)`` as a curve: x from 0 to 100 by place, y 20 for no events and 0 for the most (at least 1)."""
    place, all_ = Window.orderBy("day"), Window.partitionBy()
    n, most = F.count("*").over(all_), F.greatest(F.max("events").over(all_), F.lit(1))
    x = F.when(n > 1, 100.0 * (F.row_number().over(place) - 1) / (n - 1)).otherwise(0.0)
    return days.select("day", "events", x.alias("x"), (20 - 20.0 * F.col("events") / most).alias("y"))
