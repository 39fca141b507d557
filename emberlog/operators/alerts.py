"""Alert rules over events with outcomes: scope, thresholds, cooldowns, payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from emberlog.functions.severity import severity_name
from emberlog.operators.rules import MAX_RULES
from emberlog.operators.storage import kept

ATTEMPTS = 3
#: Log ids in a slice; seconds in a chunk of a rule's candidates; fires that are broadcast, at most.
SLICE, CHUNK_SECONDS, MAX_FIRES = 65_536, 3600, 100_000


def match_alerts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Every event with every enabled rule of its project whose scope it is in: rule columns ``rule_*`` beside the event's.

    An equi-join on the project with the rule table, which is broadcast once its size is checked.
    """
    named = rules.where(F.coalesce("enabled", F.lit(True))).select(
        F.col("id").alias("rule_id"), F.col("project_id"), F.col("name").alias("rule_name"), F.col("kind").alias("rule_kind"), F.col("service").alias("rule_service"), F.col("environment").alias("rule_environment"),
        F.col("min_severity").alias("rule_min_severity"), F.greatest(F.col("n"), F.lit(1)).alias("rule_n"), F.greatest(F.coalesce("window_minutes", F.lit(1)), F.lit(1)).alias("rule_window"),
        F.coalesce("cooldown_seconds", F.lit(0)).alias("rule_cooldown"), F.col("last_fired").alias("rule_last_fired"),
    )
    if named.limit(MAX_RULES + 1).count() <= MAX_RULES:
        named = F.broadcast(named)
    any_ = lambda rule, own: (F.coalesce(F.col(rule), F.lit("")) == "") | (F.col(rule) == F.col(own))
    events = events.where("is_event") if "is_event" in events.columns else events
    return events.join(named, "project_id").where(any_("rule_service", "service") & any_("rule_environment", "environment") & (F.col("severity") >= F.coalesce("rule_min_severity", F.lit(0))))


def threshold_counts(matches: DataFrame) -> DataFrame:
    """Threshold matches with ``event_count``: the matching events up to it whose minute is among the rule's window of minutes that ends with the event's.

    Events are taken in order of their time, which is that of arrival unless they are late.
    They are counted by minute first, so a window runs over minutes and only the events of
    one minute are put in order: a rule that matches a third of all events is no one task's.
    """
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    hits = matches.where("rule_kind = 'threshold'").withColumn("__minute", minute)
    minutes = hits.groupBy("rule_id", "rule_window", "__minute").agg(F.count("*").alias("__n"))
    widths = sorted(r["rule_window"] for r in minutes.select("rule_window").distinct().collect())
    before = F.lit(0).cast("long")
    for width in widths:
        frame = Window.partitionBy("rule_id").orderBy("__minute").rangeBetween(-(width - 1), -1)
        before = F.when(F.col("rule_window") == width, F.coalesce(F.sum("__n").over(frame), F.lit(0))).otherwise(before)
    earlier = minutes.select("rule_id", "__minute", before.alias("__before"))
    here = Window.partitionBy("rule_id", "__minute").orderBy("log_id")
    counted = hits.withColumn("__rank", F.row_number().over(here)).join(earlier, ["rule_id", "__minute"])
    return counted.withColumn("event_count", F.col("__before") + F.col("__rank")).select(*matches.columns, "event_count")


def _records(rows: DataFrame) -> DataFrame:
    """The candidates that are later than all of their rule that arrived before them. No other can fire: the earlier, later one fired itself, or what kept it from firing keeps this one."""
    sliced = rows.withColumn("slice", F.floor(F.col("log_id") / SLICE))
    before = Window.partitionBy("rule_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    latest = sliced.groupBy("rule_id", "slice").agg(F.max("us").alias("us"))
    earlier = latest.select("rule_id", "slice", F.max("us").over(before).alias("latest"))
    here = Window.partitionBy("rule_id", "slice").orderBy("log_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.col("latest"), F.max("us").over(here))
    return sliced.join(earlier, ["rule_id", "slice"]).withColumn("seen", seen).where("seen is null or us > seen").drop("slice", "latest", "seen")


def _chunks(settle: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Streams through sorted rows. ``settle`` is given whole chunks, as many as a batch completes, and the places at which they begin."""

    def starts_of(rows: pd.DataFrame) -> np.ndarray:
        keys = rows[["rule_id", "chunk"]].to_numpy()
        return np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of one chunk, the last
        for pdf in pdfs:
            if pdf.empty:
                continue
            held.append(pdf)
            if (pdf["rule_id"].iloc[-1], pdf["chunk"].iloc[-1]) != (held[0]["rule_id"].iloc[0], held[0]["chunk"].iloc[0]):
                rows = pd.concat(held, ignore_index=True)
                *starts, last = starts_of(rows)
                yield settle(rows.iloc[:last], np.array(starts))
                held = [rows.iloc[last:]]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield settle(rows, starts_of(rows))

    return run


def _next(us: np.ndarray, cooldown: int) -> np.ndarray:
    """Of each candidate, should it fire, the next one that does; the number of candidates for none."""
    return np.searchsorted(us, us + cooldown)


def _summary(us: np.ndarray, cooldown: int) -> tuple[list[int], list[int]]:
    """What a chunk makes of the first time at which its rule may fire again: pieces of such times, by their ends, and the last fire that each leads to."""
    jump, last = _next(us, cooldown), np.arange(len(us))
    while (jump < len(us)).any():  # pointer doubling
        on = np.flatnonzero(jump < len(us))
        last[on] = last[jump[on]]
        jump = np.append(jump, len(us))[jump]
    ends = np.append(np.flatnonzero(last[1:] != last[:-1]), len(us) - 1)
    return us[ends].tolist(), us[last[ends]].tolist()


def _summaries(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    first = rows.iloc[starts][["rule_id", "chunk", "cooldown", "last"]]
    found = [_summary(us, int(c)) for us, c in zip(np.split(rows["us"].to_numpy(), starts[1:]), first["cooldown"])]
    return first.assign(upto=[u for u, _ in found], fire=[f for _, f in found])


def _fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Through a rule's chunks in order: from when on it may fire in each."""
    rule, due = None, None
    for pdf in pdfs:
        out = []
        for r in pdf.itertuples():
            if r.rule_id != rule:
                rule, due = r.rule_id, -(2**62) if pd.isna(r.last) else int(r.last) + int(r.cooldown)
            out.append(due)
            at = int(np.searchsorted(r.upto, due))
            due = int(r.fire[at]) + int(r.cooldown) if at < len(r.upto) else due
        yield pdf[["rule_id", "chunk"]].assign(due=pd.array(out, "int64"))


def _replay(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """The candidates that fire, chunk by chunk."""
    first, fired = rows.iloc[starts], []
    for start, us, cooldown, due in zip(starts, np.split(rows["us"].to_numpy(), starts[1:]), first["cooldown"], first["due"]):
        at = int(np.searchsorted(us, due))
        while at < len(us):
            fired.append(start + at)
            at = int(np.searchsorted(us, us[at] + cooldown))
    return rows.iloc[fired][["rule_id", "log_id"]]


def apply_cooldown(candidates: DataFrame, span: int = CHUNK_SECONDS) -> DataFrame:
    """The candidates that fire: in arrival order, each a cooldown or more after the rule's last fire (stored or new).

    Only candidates later than all before them can fire, so these alone are looked at. They lie in
    chunks of ``span`` seconds, or of a cooldown where that is longer. From each candidate a
    pointer leads to the one that fires next; doubled, the pointers reduce a chunk to a
    short table from the time a rule may fire again to its last fire in the chunk. A scan over
    those tables says when each chunk starts to fire, and the chunks then do so in parallel:
    no task holds a rule.
    """
    free = candidates.where("rule_cooldown <= 0")
    bound = candidates.where("rule_cooldown > 0")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = bound.select("rule_id", "log_id", us("ts").alias("us"), (F.col("rule_cooldown").cast("long") * 1_000_000).alias("cooldown"), us("rule_last_fired").alias("last"))
    chunk = F.floor(F.col("us") / F.greatest(F.col("cooldown"), F.lit(span * 1_000_000))).alias("chunk")
    records = _records(rows).select("*", chunk)
    dealt = records.repartition("rule_id", "chunk").sortWithinPartitions("rule_id", "chunk", "us")
    tables = dealt.mapInPandas(_chunks(_summaries), "rule_id long, chunk long, cooldown long, last long, upto array<long>, fire array<long>")
    due = tables.repartition("rule_id").sortWithinPartitions("rule_id", "chunk").mapInPandas(_fold, "rule_id long, chunk long, due long")
    timed = records.join(kept(due), ["rule_id", "chunk"]).repartition("rule_id", "chunk").sortWithinPartitions("rule_id", "chunk", "us")
    fired = timed.mapInPandas(_chunks(_replay), "rule_id long, log_id long")
    return free.unionByName(bound.join(fired, ["rule_id", "log_id"], "left_semi"))


def evaluate_alerts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The fires: ``new_issue`` on new issues, ``regression`` on reopened ones, ``threshold`` on enough events in the window; then the cooldown. Events count toward thresholds during cooldowns as well.

    What decides is a few narrow columns, which are read once and kept; whole events are
    fetched for the fires alone.
    """
    narrow = events.select(*dict.fromkeys(c for c in ("project_id", "log_id", "ts", "severity", "service", "environment", "is_event", "is_new", "is_reopened") if c in events.columns))
    matches = kept(match_alerts(narrow, rules), cached=True)
    simple = matches.where("(rule_kind = 'new_issue' and is_new) or (rule_kind = 'regression' and is_reopened)").withColumn("event_count", F.lit(None).cast("long"))
    counted = threshold_counts(matches).where(F.col("event_count") >= F.col("rule_n"))
    fires = kept(apply_cooldown(kept(simple.unionByName(counted))))
    added = [c for c in fires.columns if c.startswith("rule_") or c == "event_count"]
    found = fires.select("log_id", *added)
    found = F.broadcast(found) if found.limit(MAX_FIRES + 1).count() <= MAX_FIRES else found
    return events.join(found, "log_id").select(*events.columns, *added)


def _rfc3339(col):
    return F.date_format(F.date_trunc("second", col.cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def alert_payloads(fires: DataFrame, fired_at: datetime, test: bool = False) -> DataFrame:
    """``(rule_id, log_id, payload)``: the JSON to deliver. Counts are there for thresholds only; first and last seen are the event's time."""
    threshold = F.col("rule_kind") == "threshold"
    issue = F.struct(F.col("fingerprint").alias("id"), F.col("title"), severity_name(F.col("severity")).alias("severity"), F.when(threshold, F.col("event_count")).alias("count"), _rfc3339(F.col("ts")).alias("first_seen"), _rfc3339(F.col("ts")).alias("last_seen"))
    rule = F.struct(F.col("rule_id").alias("id"), F.col("rule_name").alias("name"), F.col("rule_kind").alias("kind"))
    body = F.struct(rule.alias("rule"), F.col("project_id"), issue.alias("issue"), F.when(threshold, F.col("event_count")).alias("event_count"), F.when(threshold, F.col("rule_window")).alias("window_minutes"), _rfc3339(F.lit(fired_at)).alias("fired_at"), F.lit(test).alias("test"))
    return fires.select("rule_id", "log_id", F.to_json(body).alias("payload"))


def test_payload(spark, rule: Row, now: datetime) -> DataFrame:
    """A sample payload of a rule, marked as a test."""
    row = (rule["id"], 0, rule["project_id"], "0" * 16, "Test alert", 4, now, rule["name"], rule["kind"], int(rule["n"] or 1), int(rule["window_minutes"] or 1))
    fire = spark.createDataFrame([row], "rule_id long, log_id long, project_id long, fingerprint string, title string, severity int, ts timestamp, rule_name string, rule_kind string, event_count long, rule_window int")
    return alert_payloads(fire, now, test=True)


test_payload.__test__ = False


def deliver(payloads: DataFrame, send: Callable[[int, str], None], attempts: int = ATTEMPTS) -> DataFrame:
    """``(rule_id, log_id, error)`` after ``send(rule_id, payload)`` on the executors, tried up to ``attempts`` times; error is null when it worked."""

    def run(batches):
        for pdf in batches:
            errors = []
            for rule, payload in zip(pdf["rule_id"], pdf["payload"]):
                error = None
                for _ in range(attempts):
                    try:
                        send(int(rule), payload)
                        error = None
                        break
                    except Exception as e:  # whatever the caller's transport raises is the delivery's error
                        error = str(e) or type(e).__name__
                errors.append(error)
            yield pdf[["rule_id", "log_id"]].assign(error=errors)

    return payloads.mapInPandas(run, "rule_id long, log_id long, error string")


def record_deliveries(rules: DataFrame, results: DataFrame, fires: DataFrame) -> DataFrame:
    """Rules with ``last_fired`` and ``last_error`` of their latest fire; results of unknown rules are left out."""
    latest = fires.select("rule_id", "log_id", F.col("ts").cast("timestamp").alias("__ts")).join(results, ["rule_id", "log_id"])
    latest = latest.groupBy(F.col("rule_id").alias("id")).agg(F.max("__ts").alias("__fired"), F.max_by(F.coalesce("error", F.lit("")), "log_id").alias("__error"))
    return rules.join(latest, "id", "left").withColumns({"last_fired": F.coalesce("__fired", "last_fired"), "last_error": F.coalesce("__error", "last_error")}).select(*rules.columns)
