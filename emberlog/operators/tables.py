"""Small tables edited by hand: rules, projects."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_rule(rules: DataFrame, row: Mapping, check: Callable[[Mapping], None] | None = None) -> DataFrame:
    """``rules`` with ``row``: id 0 or none inserts with the next id, another id replaces that rule, and a missing one is an error.

    ``check`` may refuse the row. An ``enabled`` that is left out keeps its value, true for a new rule; counters and last results are kept.
    """
    if check:
        check(row)
    names, rule_id = rules.columns, row.get("id") or 0
    old = rules.where(F.col("id") == rule_id).head() if rule_id else None
    if rule_id and old is None:
        raise LookupError(f"no rule {rule_id}")
    kept = old.asDict() if old else {"enabled": True, "dropped_count": 0, "lifted_count": 0, "last_error": ""}
    new = {k: kept.get(k) for k in names} | {k: v for k, v in row.items() if k in names and v is not None}
    new["id"] = rule_id or ((rules.agg(F.max("id")).head()[0] or 0) + 1)
    added = rules.sparkSession.createDataFrame([tuple(new[k] for k in names)], rules.schema)
    return rules.where(F.col("id") != new["id"]).unionByName(added)


def delete_rule(rules: DataFrame, rule_id: int) -> DataFrame:
    """``rules`` without a rule, which must be there."""
    if rules.where(F.col("id") == rule_id).isEmpty():
        raise LookupError(f"no rule {rule_id}")
    return rules.where(F.col("id") != rule_id)


def create_project(projects: DataFrame, name: str, retention_days: int = 30) -> DataFrame:
    """``projects`` with another: next id, slug from name and id."""
    number = (projects.agg(F.max("id")).head()[0] or 0) + 1
    slug = f"{name.strip().lower().replace(' ', '-')}-{number}"
    return projects.unionByName(projects.sparkSession.createDataFrame([(number, name, slug, retention_days, True)], projects.schema))


def set_project_parse(projects: DataFrame, project_id: int, parse_bodies: bool) -> DataFrame:
    """``projects`` with body parsing of one switched."""
    if projects.where(F.col("id") == project_id).isEmpty():
        raise LookupError(f"no project {project_id}")
    return projects.withColumn("parse_bodies", F.when(F.col("id") == project_id, F.lit(parse_bodies)).otherwise(F.col("parse_bodies")))
