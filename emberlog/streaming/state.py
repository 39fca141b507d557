"""Stateful streams: issue outcomes, noise sampling and alerts, in arrival order.

Issues and alerts are keyed state of bounded size: an issue's status and counts, a rule's
last fire and the minutes in its window. Rows of a micro-batch are put in order of
``log_id`` before they are folded; across batches the order is that of arrival. Sampling
counters and retained samples are small tables by batch instead, so that no rule, project
or issue is one task's. Nothing is dropped as late, and state is kept until the query is reset.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.operators.alerts import match_alerts
from emberlog.operators.issues import SAMPLES, issue_samples, prune_samples
from emberlog.operators.normalize import normalize
from emberlog.operators.rollups import rollup
from emberlog.operators.rules import in_sampling, sampled_out, settle, valid_rules
from emberlog.operators.storage import epochs, file_system, kept

OUTCOME = "project_id long, fingerprint string, log_id long, is_new boolean, is_reopened boolean, status string, count long, first_seen timestamp, last_seen timestamp"


def stream_normalize(source: DataFrame, projects: DataFrame | None = None, severity_rules: DataFrame | None = None) -> DataFrame:
    """The row-wise chain on a stream; all of it is stateless. Noise rules follow with :func:`noise_stream`."""
    return normalize(source, projects, severity_rules)


def stream_rollups(logs: DataFrame, watermark: str | None = None) -> DataFrame:
    """Hourly rollups as a stream, for complete or update mode. Without a watermark every late record still counts, and state grows with the hours."""
    return rollup(logs.withWatermark("ts", watermark) if watermark else logs)


def _issues(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(pdfs)).sort_values(["seq", "kind"], ascending=[True, False])
    status, count, first, last = state.get if state.exists else ("", 0, None, None)
    out = []
    for r in rows.itertuples():
        if r.kind == "action":
            status = r.status if status else status
            continue
        new, reopened = not status, status == "resolved"
        status = "open" if new or reopened else status
        count, first, last = count + 1, first if first is not None else r.ts, r.ts
        out.append((*key, int(r.seq), new, reopened, status, count, first, last))
    if status:
        state.update((status, count, first, last))
    yield pd.DataFrame(out, columns=["project_id", "fingerprint", "log_id", "is_new", "is_reopened", "status", "count", "first_seen", "last_seen"])


def stream_issues(events: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """A row per event with its outcome and its issue's state after it. ``actions`` is a stream of (project_id, fingerprint, status, seq)."""
    events = events.where("is_event") if "is_event" in events.columns else events
    rows = events.select("project_id", "fingerprint", F.col("log_id").alias("seq"), F.lit("event").alias("kind"), F.lit("").alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    if actions is not None:
        rows = rows.unionByName(actions.select("project_id", "fingerprint", "seq", F.lit("action").alias("kind"), "status", F.lit(None).cast("timestamp").alias("ts")))
    return rows.groupBy("project_id", "fingerprint").applyInPandasWithState(_issues, OUTCOME, "status string, count long, first timestamp, last timestamp", "append", GroupStateTimeout.NoTimeout)


def noise_stream(path: str, rules: DataFrame) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that judges a stream of logs by the noise rules, under ``path``: ``(project_id, log_id, drop_rule_id)`` in ``rows``, how many records have reached each sampling rule in ``reached``.

    Rules for all projects count over all projects, as in a batch: a batch is ranked in
    parallel, after as many records as the batches before it brought. Records arrive in order of ``log_id`` from batch to
    batch; inside one any order will do. A batch that is written again takes the place of its first attempt. The enabled ``rules`` are read
    once, when the stream starts.
    """
    rows = valid_rules(rules)
    plain = [r for r in rows if r["kind"] != "sample"]

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        logs = batch.select("project_id", "log_id", "severity", "service", "body").withColumn("drop_rule_id", F.lit(None).cast("long"))
        done = [e for e in epochs(spark, f"{path}/reached") if e < epoch]
        offsets = {r["rule_id"]: r["reached"] for r in spark.read.parquet(f"{path}/reached/epoch={max(done)}").collect()} if done else {}
        scoped = kept(in_sampling(logs, rows))
        dropped = sampled_out(scoped, rows, offsets)
        marked = settle(logs.join(dropped, "log_id", "left").withColumn("drop_rule_id", F.col("rule_id")).drop("rule_id"), plain)
        marked.select("project_id", "log_id", "drop_rule_id").write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        counts = spark.createDataFrame(sorted(offsets.items()), "rule_id long, reached long")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/reached/epoch={epoch}")

    return run


def samples_stream(path: str, keep: int = SAMPLES) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the ``keep`` newest events of each issue of every batch: increments that :func:`stream_samples` merges."""
    return lambda batch, epoch: issue_samples(batch, keep).drop("rank").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def stream_samples(spark: SparkSession, path: str, keep: int = SAMPLES, cutoff: datetime | None = None) -> DataFrame:
    """The ``keep`` newest events of each issue over all batches, with their ``rank``, from ``cutoff`` on; the newest of the newest, so no event is read again."""
    merged = issue_samples(spark.read.parquet(path).drop("epoch"), keep)
    return prune_samples(merged, cutoff) if cutoff is not None else merged


def merge_samples(spark: SparkSession, path: str, upto: int, keep: int = SAMPLES) -> None:
    """Merges the increments of batches up to ``upto`` into the folder of that batch; the others of them are deleted after it is complete."""
    parts = [e for e in epochs(spark, path) if e <= upto]
    merged = kept(issue_samples(spark.read.parquet(*(f"{path}/epoch={e}" for e in parts)), keep).drop("rank"))
    merged.write.mode("overwrite").parquet(f"{path}/epoch={upto}")
    fs, _ = file_system(spark, path)
    for e in parts:
        if e != upto:
            fs.delete(file_system(spark, f"{path}/epoch={e}")[1], True)


FIRES = "rule_id long, project_id long, fingerprint string, log_id long, title string, severity int, ts timestamp, rule_name string, rule_kind string, rule_window int, event_count long"


def _alerts(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(pdfs)).sort_values("log_id")
    last, minutes = (state.get[0], {int(k): v for k, v in json.loads(state.get[1]).items()}) if state.exists else (None, {})
    newest, held, out = max(minutes, default=None), sum(minutes.values()), []
    for r in rows.itertuples():
        us, count, due = r.ts.value // 1000, None, False
        if last is None and not pd.isna(r.rule_last_fired):
            last = r.rule_last_fired.value // 1000
        if r.rule_kind == "threshold":
            minute = us // 60_000_000
            minutes[minute] = minutes.get(minute, 0) + 1
            if newest is None or minute >= newest:
                if newest is None or minute > newest:  # once a minute: what has left the window goes
                    newest = minute if newest is None else max(newest, minute)
                    minutes = {m: n for m, n in minutes.items() if m > newest - r.rule_window}
                    held = sum(minutes.values())
                else:
                    held += 1
                count = held
            else:  # a late event counts for the window that ends with its own minute
                held += minute > newest - r.rule_window
                if minute <= newest - r.rule_window:
                    del minutes[minute]
                count = sum(n for m, n in minutes.items() if minute - r.rule_window < m <= minute)
            due = count >= r.rule_n
        else:
            due = bool(r.is_new) if r.rule_kind == "new_issue" else bool(r.is_reopened)
        if due and (last is None or r.rule_cooldown <= 0 or us - last >= r.rule_cooldown * 1_000_000):
            last = us
            out.append((key[0], r.project_id, r.fingerprint, r.log_id, r.title, r.severity, r.ts, r.rule_name, r.rule_kind, r.rule_window, count))
    state.update((last, json.dumps(minutes)))
    pdf = pd.DataFrame(out, columns=[c.split()[0] for c in FIRES.split(", ")])
    yield pdf.astype({"event_count": "Int64"})


def stream_alerts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The fires of a stream of events with outcomes; a rule's window and last fire are its state."""
    matches = match_alerts(events, rules).select(
        "rule_id", "project_id", "fingerprint", "log_id", "title", "severity", F.col("ts").cast("timestamp").alias("ts"), "is_new", "is_reopened", "rule_name", "rule_kind", "rule_n", "rule_window", "rule_cooldown", F.col("rule_last_fired").cast("timestamp").alias("rule_last_fired")
    )
    return matches.groupBy("rule_id").applyInPandasWithState(_alerts, FIRES, "last long, minutes string", "append", GroupStateTimeout.NoTimeout)


def append_and_roll(path: str, rollup_path: str):
    """A ``foreachBatch`` function that keeps normalised logs and their rollup increments; increments are added up on reading (``merge_rollups``).

    Each batch has a folder of its own in both tables, ``epoch=<number>``, and a batch that is
    retried after a failure writes the same folders again: nothing is stored twice, and logs
    and rollups agree. Small folders can be merged with ``operators.retention.compact_day``.
    """
    from emberlog.sources.writers import with_day

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        with_day(batch).write.mode("overwrite").partitionBy("project_id", "day").parquet(f"{path}/epoch={epoch}")
        rollup(batch).write.mode("overwrite").parquet(f"{rollup_path}/epoch={epoch}")
        batch.unpersist()

    return run
