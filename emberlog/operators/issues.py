"""Issues: events of a project with one fingerprint, their state, outcomes and samples.

Everything "first" and "last" follows arrival, that is ``log_id``; actions carry a ``seq``
on the same scale: an action with ``seq`` s comes after the events with ``log_id`` <= s.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.storage import kept
from emberlog.schema import STATUSES

KEY = ("project_id", "fingerprint")
SAMPLES = 50
#: Rows of two numbers that are broadcast, at most.
MAX_FLAGS = 500_000


def issue_groups(events: DataFrame) -> DataFrame:
    """``(project_id, fingerprint, title, severity, first_seen, last_seen, count, first_id, last_id)``; title and severity are those of the first event."""
    events = events.where("is_event") if "is_event" in events.columns else events
    first = F.min_by(F.struct("title", "severity", "ts"), "log_id")
    out = events.groupBy(*KEY).agg(first.alias("f"), F.max_by("ts", "log_id").alias("last_seen"), F.count("*").alias("count"), F.min("log_id").alias("first_id"), F.max("log_id").alias("last_id"))
    return out.select(*KEY, "f.title", "f.severity", F.col("f.ts").alias("first_seen"), "last_seen", "count", "first_id", "last_id")


def build_issues(events: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Issues with their ``status``: open on first sight; the last action's otherwise, but a resolved issue is open again once an event follows."""
    groups = issue_groups(events)
    if actions is None:
        return groups.withColumn("status", F.lit("open")).drop("first_id", "last_id")
    applied = actions.select(*KEY, "status", "seq").join(groups.select(*KEY, "first_id"), list(KEY)).where(F.col("seq") >= F.col("first_id"))
    last = applied.groupBy(*KEY).agg(F.max_by("status", "seq").alias("action"), F.max("seq").alias("at"))
    status = F.when(F.col("action").isNull(), "open").when((F.col("action") == "resolved") & (F.col("last_id") > F.col("at")), "open").otherwise(F.col("action"))
    return groups.join(last, list(KEY), "left").withColumn("status", status).drop("action", "at", "first_id", "last_id")


def _narrow(flags: DataFrame) -> DataFrame:
    """``flags``, to be broadcast if they are few."""
    return F.broadcast(flags) if flags.limit(MAX_FLAGS + 1).count() <= MAX_FLAGS else flags


def issue_outcomes(events: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Events with ``is_new`` (the first of its issue) and ``is_reopened`` (its issue was resolved just before it).

    Both flags are sets of log ids, found by aggregation with partial sums; events are joined
    with them by id, never by issue, so an issue that most events belong to is no one task's.
    Events are read twice, once for their issues and ids, which are kept, and once for the result.
    """
    events = events.where("is_event") if "is_event" in events.columns else events
    keys = kept(events.select(*KEY, "log_id"), cached=True)
    first = kept(keys.groupBy(*KEY).agg(F.min("log_id").alias("__first")))
    flags = first.select(F.col("__first").alias("log_id"), F.lit(True).alias("__new"), F.lit(False).alias("__back"))
    if actions is not None:
        # A resolving action holds until the next action; the first event in between reopens the issue.
        resolved = actions.where(F.col("status").isin(*STATUSES)).select(*KEY, "status", F.col("seq").alias("__seq"))
        next_ = Window.partitionBy(*KEY).orderBy("__seq")
        spans = resolved.withColumn("__until", F.lead("__seq").over(next_)).where("status = 'resolved'").drop("status")
        spans = spans.join(first, list(KEY)).where("__seq >= __first").drop("__first")
        hits = keys.join(_narrow(kept(spans)), list(KEY)).where("log_id > __seq and (__until is null or log_id <= __until)")
        back = hits.groupBy(*KEY, "__seq").agg(F.min("log_id").alias("log_id")).select("log_id", F.lit(False).alias("__new"), F.lit(True).alias("__back"))
        flags = flags.unionByName(back).groupBy("log_id").agg(F.max("__new").alias("__new"), F.max("__back").alias("__back"))
    flagged = events.join(_narrow(kept(flags)), "log_id", "left")
    return flagged.withColumns({"is_new": F.coalesce("__new", F.lit(False)), "is_reopened": F.coalesce("__back", F.lit(False))}).select(*events.columns, "is_new", "is_reopened")


def set_issue_status(actions: DataFrame, project_id: int, fingerprint: str, status: str, seq: int) -> DataFrame:
    """``actions`` and one more."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return actions.unionByName(actions.sparkSession.createDataFrame([(project_id, fingerprint, status, seq)], "project_id long, fingerprint string, status string, seq long"))


def issue_samples(events: DataFrame, keep: int = SAMPLES) -> DataFrame:
    """The ``keep`` newest events of each issue (by ts, then log_id), with their ``rank``; cut down before the shuffle as well."""
    events = events.where("is_event") if "is_event" in events.columns else events
    newest = Window.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("log_id"))
    return events.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= keep)


def prune_samples(samples: DataFrame, cutoff: datetime) -> DataFrame:
    """Samples from the cutoff on; their issues stay."""
    return samples.where(F.col("ts") >= F.lit(cutoff))


def list_issues(issues: DataFrame, samples: DataFrame | None = None, project: int = 0, env: str = "", status: str = "", since: datetime | None = None, until: datetime | None = None, limit: int = 50) -> DataFrame:
    """Issues by ``last_seen`` descending; an environment asks for a retained sample in it. Project 0, empty texts and None don't filter."""
    if project:
        issues = issues.where(F.col("project_id") == project)
    if status:
        issues = issues.where(F.col("status") == status)
    if since is not None:
        issues = issues.where(F.col("last_seen") >= F.lit(since))
    if until is not None:
        issues = issues.where(F.col("last_seen") <= F.lit(until))
    if env:
        issues = issues.join(samples.where(F.col("environment") == env).select(*KEY), list(KEY), "left_semi")
    return issues.orderBy(F.desc("last_seen"), *KEY).limit(limit or 50)


def issue_detail(issues: DataFrame, samples: DataFrame, logs: DataFrame, project: int, fingerprint: str) -> DataFrame:
    """The issue's samples newest first, each with the issue's columns and its log record; a record that is gone keeps its id alone. An unknown issue is an error."""
    mine = (F.col("project_id") == project) & (F.col("fingerprint") == fingerprint)
    issue = issues.where(mine)
    if issue.isEmpty():
        raise LookupError(f"no issue {fingerprint} in project {project}")
    refs = samples.where(mine).select(*KEY, "log_id", "rank")
    rows = refs.join(logs.select("log_id", "ts", "body", "service", "environment", "release"), "log_id", "left")
    head = issue.select(*KEY, "title", "status", F.col("count").alias("issue_count"), "first_seen", "last_seen").limit(1)
    return rows.join(F.broadcast(head), list(KEY)).drop(*KEY).orderBy("rank")


def issue_tags(samples: DataFrame) -> DataFrame:
    """The sorted distinct environments and releases of each issue's samples (bounded by the samples kept)."""
    distinct = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c + "s")
    return samples.groupBy(*KEY).agg(distinct("environment"), distinct("release"))


def issue_histogram(samples: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """``(project_id, fingerprint, day, n)``: samples of each of the last ``days`` UTC days, oldest first, 0 included."""
    slot = F.datediff(F.lit(now).cast("date"), F.col("ts").cast("date"))
    counted = samples.withColumn("slot", slot).where(F.col("slot").between(0, days - 1)).groupBy(*KEY, "slot").agg(F.count("*").alias("n"))
    grid = samples.select(*KEY).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    filled = grid.join(counted, [*KEY, "slot"], "left")
    return filled.select(*KEY, F.date_sub(F.lit(now).cast("date"), F.col("slot")).alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def newest_sample(samples: DataFrame) -> DataFrame:
    """The newest sample of each issue."""
    return samples.groupBy(*KEY).agg(F.max_by(F.struct("log_id", "ts", "body"), F.struct("ts", "log_id")).alias("s")).select(*KEY, "s.*")
