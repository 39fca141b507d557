"""Queries on single records: search, lookup, neighbours."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.storage import kept

DEFAULT_LIMIT = 50
#: Projects and services that are broadcast, at most.
MAX_KEYS = 100_000
#: Targets, and neighbours of targets, that are broadcast, at most.
MAX_TARGETS = 500_000


def _few(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, computed once, to be broadcast if they are few."""
    rows = kept(rows)
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def filter_logs(logs: DataFrame, project: int = 0, query: str = "", min_severity: int = 0, service: str = "", env: str = "", since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Records that fit; 0, empty texts and None don't filter. Bounds are inclusive; a table with a ``day`` column is also pruned by it."""
    kind = logs.schema["ts"].dataType
    if project:
        logs = logs.where(F.col("project_id") == project)
    if min_severity:
        logs = logs.where(F.col("severity") >= min_severity)
    if service:
        logs = logs.where(F.col("service") == service)
    if env:
        logs = logs.where(F.col("environment") == env)
    for bound, at_least in ((since, True), (until, False)):
        if bound is not None:
            t = F.lit(bound).cast(kind)
            logs = logs.where(F.col("ts") >= t if at_least else F.col("ts") <= t)
            if "day" in logs.columns:
                day = F.lit(bound).cast("date")
                logs = logs.where(F.col("day").cast("date") >= day if at_least else F.col("day").cast("date") <= day)
    return logs.where(F.contains("body", F.lit(query))) if query else logs


def search_logs(logs: DataFrame, project: int = 0, query: str = "", min_severity: int = 0, service: str = "", env: str = "", since: datetime | None = None, until: datetime | None = None, limit: int = 0) -> DataFrame:
    """The newest fitting records (ts, then log_id, descending): a top-k, never a full sort. Limit 0 means 50."""
    found = filter_logs(logs, project, query, min_severity, service, env, since, until)
    return found.orderBy(F.desc("ts"), F.desc("log_id")).limit(limit or DEFAULT_LIMIT)


def bounded_fetch(rows: DataFrame, show: int = 20, fetch: int = 500) -> DataFrame:
    """At most ``show`` rows in their order, with ``more``: how many others there are, counted up to ``fetch``."""
    held = rows.limit(fetch)
    numbered = held.withColumn("__n", F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).withColumn("more", F.greatest(F.count("*").over(Window.partitionBy()) - show, F.lit(0)))
    return numbered.where(F.col("__n") <= show).drop("__n")


def log_by_id(logs: DataFrame, log_id: int) -> DataFrame:
    return logs.where(F.col("log_id") == log_id)


def log_context(logs: DataFrame, log_id: int, n: int = 20) -> DataFrame:
    """A record between its ``n`` neighbours before and after of the same project and service, by (ts, log_id); an unknown id is an error."""
    target = log_by_id(logs, log_id).select("project_id", "service", "ts").head()
    if target is None:
        raise LookupError(f"no log {log_id}")
    kind = logs.schema["ts"].dataType
    near = logs.where((F.col("project_id") == target["project_id"]) & (F.col("service") == target["service"]))
    place, own = F.struct("ts", "log_id"), F.struct(F.lit(target["ts"]).cast(kind).alias("ts"), F.lit(log_id).cast("long").alias("log_id"))
    before = near.where(place <= own).orderBy(F.desc("ts"), F.desc("log_id")).limit(n + 1)
    after = near.where(place > own).orderBy("ts", "log_id").limit(n)
    return before.unionByName(after).orderBy("ts", "log_id")


def log_context_many(logs: DataFrame, ids: DataFrame, n: int = 20) -> DataFrame:
    """The neighbours of every ``ids(log_id)``: rows of ``logs`` with ``target_id`` and ``offset`` (0: the target itself).

    Only the targets' projects and services are looked at, and only time and id of their
    records are put in order: by hours, whose counts give the places before each, so that no
    task orders all records of a service. Targets then meet their neighbours by an equi-join on
    the place, 2n + 1 rows for each, and whole records are fetched for these alone. Records are
    read three times: for the targets, for the order, and for the result.
    """
    key = ["project_id", "service"]
    wanted = ids.select("log_id").distinct()
    keys = kept(logs.select(*key, "log_id").join(wanted, "log_id", "left_semi"))
    near = logs.select(*key, "ts", "log_id").join(_few(keys.select(*key).distinct(), MAX_KEYS), key, "left_semi").withColumn("__hour", F.date_trunc("hour", "ts"))
    inside = Window.partitionBy(*key, "__hour").orderBy("ts", "log_id")
    ranked = kept(near.select(*key, "__hour", "log_id", F.row_number().over(inside).alias("__rank")))
    hours = ranked.groupBy(*key, "__hour").agg(F.max("__rank").alias("__n"))
    earlier = Window.partitionBy(*key).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    before = hours.select(*key, "__hour", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    placed = ranked.join(before, [*key, "__hour"]).select(*key, "log_id", (F.col("__before") + F.col("__rank")).alias("__place"))
    targets = placed.join(_few(keys.select("log_id"), MAX_TARGETS), "log_id", "left_semi").select(*key, F.col("log_id").alias("target_id"), F.col("__place").alias("__own"))
    around = targets.withColumn("offset", F.explode(F.sequence(F.lit(-n), F.lit(n)))).withColumn("__place", F.col("__own") + F.col("offset"))
    found = _few(placed.join(around.drop("__own"), [*key, "__place"]).select("log_id", "target_id", "offset"), MAX_TARGETS)
    return logs.join(found, "log_id")
