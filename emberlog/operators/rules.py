"""Severity and noise rules: small tables, read once per batch and compiled to column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from emberlog.functions.severity import INFO
from emberlog.operators.storage import kept
from emberlog.schema import check_noise_rule, check_pattern

#: Rules of one kind, at most: rule tables are edited by hand and compiled into the plan.
MAX_RULES = 1000
#: Log ids in a slice; ids that are broadcast, at most.
SLICE, MAX_IDS = 65_536, 1_000_000


def rule_rows(rules: DataFrame) -> list[Row]:
    """The enabled rules by ascending id; an error beyond ``MAX_RULES``."""
    rows = rules.where(F.coalesce("enabled", F.lit(True))).orderBy("id").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return rows


def in_scope(rule: Row) -> Column:
    """The rule's project (0 or null: all) and service (empty: all)."""
    project, service = rule["project_id"], rule["service"] if "service" in rule else ""
    scope = F.col("project_id") == project if project else F.lit(True)
    return scope & (F.col("service") == service) if service else scope


def apply_severity_rules(logs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(logs, lifts)``: records of INFO or less take the severity of the first rule whose pattern is found in the body.

    ``logs`` gains ``lift_rule_id`` (null if none fired). ``lifts`` counts ``(rule_id, lifted)``
    over all records, before any noise rule drops one. Patterns are checked when rules are
    made; one that can't be compiled here never fires.
    """
    fired, level = F.lit(None).cast("long"), F.col("severity")
    for rule in reversed(rule_rows(rules)):
        try:
            check_pattern(rule["pattern"])
        except ValueError:
            continue
        hit = in_scope(rule) & F.col("body").rlike(rule["pattern"])
        fired = F.when(hit, F.lit(rule["id"]).cast("long")).otherwise(fired)
        level = F.when(hit, F.lit(rule["severity"])).otherwise(level)
    low = F.col("severity") <= INFO
    out = logs.withColumns({"lift_rule_id": F.when(low, fired), "severity": F.when(low, level).otherwise(F.col("severity")).cast("int")})
    lifts = out.where("lift_rule_id is not null").groupBy(F.col("lift_rule_id").alias("rule_id")).agg(F.count("*").alias("lifted"))
    return out, lifts


def _valid(rule: Row) -> bool:
    try:
        check_noise_rule(rule.asDict())
    except ValueError:
        return False
    return True


def _matches(rule: Row) -> Column:
    scope = in_scope(rule)
    if rule["kind"] == "severity_floor":
        return scope & (F.col("severity") < rule["severity"])
    if rule["kind"] == "drop_match":
        return scope & F.contains("body", F.lit(rule["pattern"]))
    return scope & (F.col("severity") <= rule["severity"])


def sample_scope(rows: list[Row]) -> Column:
    """The places (in ``rows``) of the sampling rules that a record reaches alive as far as rules without a counter go: those in whose scope it is, before the first such rule that drops it."""
    first = F.lit(len(rows))
    for i, rule in reversed(list(enumerate(rows))):
        if rule["kind"] != "sample":
            first = F.when(_matches(rule), i).otherwise(first)
    samples = [(i, r) for i, r in enumerate(rows) if r["kind"] == "sample"]
    return F.array_compact(F.array(*(F.when(_matches(r) & (first > i), i) for i, r in samples))) if samples else F.array().cast("array<int>")


def in_sampling(logs: DataFrame, rows: list[Row]) -> DataFrame:
    """``(log_id, reached)`` of the records in the scope of a sampling rule."""
    some = F.filter(F.array(sample_scope(rows)), lambda reached: F.size(reached) > 0)
    return logs.select("log_id", F.explode(some).alias("reached"))


def only(logs: DataFrame, test: Column) -> DataFrame:
    """The records for which ``test`` is true, by a generator: a filter would be pushed down through the steps before it, which repeats their expressions for every column it names."""
    return logs.select("*", F.explode(F.when(test, F.array(F.lit(True)))).alias("__true")).drop("__true")


def sampled_out(scoped: DataFrame, rows: list[Row], offsets: dict[int, int] | None = None) -> DataFrame:
    """``(log_id, rule_id)`` of the records that sampling rules drop: all but the 1st, (n+1)th, ... that reach each by ``log_id``.

    ``scoped(log_id, reached)`` says by :func:`sample_scope` which rules a record may reach.
    ``offsets``, by rule id, is how many had reached each before, and is counted on. A record's place is a count within its slice of the ids
    plus the counts of earlier slices, so no task sees all records of a rule; of slices there is one small row each.
    """
    samples = [(i, r) for i, r in enumerate(rows) if r["kind"] == "sample"]
    state = scoped.select("log_id", "reached", F.floor(F.col("log_id") / SLICE).alias("slice"), F.lit(None).cast("long").alias("rule_id"))
    for k, (i, rule) in enumerate(samples):
        hit = F.col("rule_id").isNull() & F.array_contains("reached", i)
        counts = state.where(hit).groupBy("slice").agg(F.count("*").alias("n"))
        before, seen = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1), 0
        if offsets is not None:
            counts = kept(counts)
            seen = offsets.get(rule["id"], 0)
            offsets[rule["id"]] = seen + (counts.agg(F.sum("n")).head()[0] or 0)
        earlier = counts.select("slice", (F.coalesce(F.sum("n").over(before), F.lit(0)) + seen).alias("before"))
        inside = Window.partitionBy("slice", "hit").orderBy("log_id")
        placed = state.withColumn("hit", hit).withColumn("rank", F.row_number().over(inside) - 1).join(earlier, "slice", "left")
        out = F.col("hit") & ((F.col("rank") + F.col("before")) % rule["n"] != 0)
        state = placed.select("log_id", "reached", "slice", F.when(out, F.lit(rule["id"]).cast("long")).otherwise(F.col("rule_id")).alias("rule_id"))
        if k % 4 == 3:
            state = kept(state)
    return state.where("rule_id is not null").select("log_id", "rule_id")


def valid_rules(rules: DataFrame) -> list[Row]:
    """The enabled noise rules that can drop something, by id."""
    return [r for r in rule_rows(rules) if _valid(r)]


def mark_noise(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """``logs`` with ``drop_rule_id``: the first rule, by ascending id, that drops the record; null keeps it.

    A sampling rule counts only the records that reach it alive, over all services; a record
    that it lets through goes on to later rules. Unknown kinds and rules without what their
    kind needs drop nothing. Rules that need no order are one expression. For sampling rules
    only ids and rule numbers are put in order; the ids they drop are joined back, and
    where they are too many to broadcast only records in a sampling rule's scope are shuffled.
    """
    rows = valid_rules(rules)
    plain = [r for r in rows if r["kind"] != "sample"]
    logs = logs.withColumn("drop_rule_id", F.lit(None).cast("long"))
    if len(plain) == len(rows):
        return settle(logs, rows)
    scoped = kept(in_sampling(logs, rows), cached=True)
    dropped = kept(sampled_out(scoped, rows).withColumnRenamed("rule_id", "__sampled"))
    # What a sampling rule drops comes before any rule without a counter that would drop it.
    finish = lambda rows_: settle(rows_.withColumn("drop_rule_id", F.col("__sampled")).drop("__sampled"), plain)
    if dropped.limit(MAX_IDS + 1).count() <= MAX_IDS:
        return finish(logs.join(F.broadcast(dropped), "log_id", "left").select(*logs.columns, "__sampled"))
    within = F.size(sample_scope(rows)) > 0
    rest, inside = settle(only(logs, ~within), plain), only(logs, within)
    return rest.unionByName(finish(inside.join(dropped, "log_id", "left").select(*logs.columns, "__sampled")))


def settle(logs: DataFrame, rules: list[Row]) -> DataFrame:
    """The first of ``rules`` that drops a record which is still alive."""
    drop = F.lit(None).cast("long")
    for rule in reversed(rules):
        drop = F.when(_matches(rule), F.lit(rule["id"]).cast("long")).otherwise(drop)
    return logs.withColumn("drop_rule_id", F.coalesce("drop_rule_id", drop)) if rules else logs


def apply_noise_rules(logs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, drops)``: the records no rule drops, and ``(rule_id, dropped)`` counts."""
    marked = mark_noise(logs, rules)
    drops = marked.where("drop_rule_id is not null").groupBy(F.col("drop_rule_id").alias("rule_id")).agg(F.count("*").alias("dropped"))
    return marked.where("drop_rule_id is null").drop("drop_rule_id"), drops


def add_counts(rules: DataFrame, counts: DataFrame, counter: str) -> DataFrame:
    """Adds ``counts(rule_id, n)`` to a rule table's counter column; counts of unknown rules are left out."""
    value = next(c for c in counts.columns if c != "rule_id")
    added = counts.select(F.col("rule_id").alias("id"), F.col(value).alias("__added"))
    return rules.join(added, "id", "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("__added", F.lit(0))).select(*rules.columns)
