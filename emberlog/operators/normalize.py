"""The row-wise chain from raw records to events, in its fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.severity import FATAL, INFO
from emberlog.functions.text import EXCEPTION_KEYS, FINGERPRINT_KEY, PANIC, ansi_red, attr, fingerprint, is_event, strip_ansi, title
from emberlog.operators.bodies import parse_bodies
from emberlog.operators.rules import apply_noise_rules, apply_severity_rules
from emberlog.operators.storage import spread


def clean_bodies(logs: DataFrame) -> DataFrame:
    """Strips terminal escapes; a body that was red keeps the attribute ``ansi.red``."""
    clean, attrs = strip_ansi(F.col("body")), F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    red = ansi_red(F.col("body")) & (clean != F.col("body"))
    marked = F.map_concat(F.map_filter(attrs, lambda k, _: k != "ansi.red"), F.create_map(F.lit("ansi.red"), F.lit("true")))
    return logs.withColumns({"body": clean, "attrs": F.when(red, marked).otherwise(F.col("attrs"))})


def detect_panic_severity(logs: DataFrame) -> DataFrame:
    """Crash reports of exactly INFO become FATAL."""
    return logs.withColumn("severity", F.when((F.col("severity") == INFO) & F.col("body").rlike(PANIC), F.lit(FATAL)).otherwise(F.col("severity")))


def annotate_events(logs: DataFrame, key: str = FINGERPRINT_KEY) -> DataFrame:
    """Adds ``is_event``, and for events ``fingerprint`` and ``title`` (empty for other records)."""
    columns, attrs = logs.columns, None
    if "attrs" in columns:
        # Each attribute is taken out of the map once.
        attrs = {name: F.col(f"__attr{i}") for i, name in enumerate((*EXCEPTION_KEYS, key))}
        logs = logs.withColumns({f"__attr{i}": attr(F.col("attrs"), name) for i, name in enumerate(attrs)})
    of = lambda value: F.when(F.col("is_event"), value).otherwise(F.lit(""))
    logs = logs.withColumn("is_event", is_event(F.col("severity"), attrs))
    found = {"fingerprint": of(fingerprint(F.col("project_id"), F.col("severity"), F.col("body"), attrs, key)), "title": of(title(F.col("body"), attrs))}
    return logs.withColumns(found).select(*(c for c in columns if c not in ("is_event", *found)), "is_event", *found)


def normalize(logs: DataFrame, projects: DataFrame | None = None, severity_rules: DataFrame | None = None, noise_rules: DataFrame | None = None, key: str = FINGERPRINT_KEY) -> DataFrame:
    """Escapes off, bodies parsed, panics and severity rules lifted, noise dropped, events annotated, in this order: noise rules see the lifted severity."""
    logs = detect_panic_severity(parse_bodies(clean_bodies(spread(logs)), projects))
    if severity_rules is not None:
        logs = apply_severity_rules(logs, severity_rules)[0].drop("lift_rule_id")
    if noise_rules is not None:
        logs = apply_noise_rules(logs, noise_rules)[0]
    return annotate_events(logs, key)
