"""The logs table: one view of rewritten and fresh rows through appends, compaction, pruning and clean-up."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.sources import logtable

NOW = datetime(2024, 5, 10, 14, 30)
COLUMNS = "project_id long, ts timestamp, body string"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "logs")


def batch(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(2)


def bodies(spark, path):
    rows = logtable.read(spark, path).select("log_id", "body").collect()
    assert sorted(r.log_id for r in rows) == sorted({r.log_id for r in rows})
    return sorted(r.body for r in rows)


def files(path):
    from pathlib import Path

    return {str(p) for p in Path(path).rglob("*.parquet") if "/manifest/" not in str(p) and "/ids/" not in str(p)}


def at(days, hours=0, minutes=0):
    return datetime(2024, 5, 10) - timedelta(days=days) + timedelta(hours=hours, minutes=minutes)


def test_ids_are_dense_over_batches(spark, path):
    for epoch, n in enumerate((5, 0, 7)):
        logtable.append(batch(spark, [(1, at(1), f"{epoch}.{i}") for i in range(n)]), path, epoch)
    logtable.append(batch(spark, [(1, at(1), f"2.{i}") for i in range(7)]), path, 2)  # as after a failure
    assert sorted(r.log_id for r in logtable.read(spark, path).collect()) == list(range(12))


def test_compaction_floor_late_rows_and_shards(spark, path):
    for epoch in range(3):
        logtable.append(batch(spark, [(1, at(2, 6, epoch), f"a{epoch}"), (1, at(2, 9), f"b{epoch}"), (2, at(2), f"c{epoch}")]), path, epoch)
    whole = bodies(spark, path)
    plan = {(r.project_id, r.bucket): (r.rows, r.shards) for r in logtable.plan_compaction(spark, path, NOW, 4).collect()}
    assert plan == {(1, "2024-05-08"): (6, 2), (2, "2024-05-08"): (3, 1)}
    assert logtable.compact(spark, path, NOW, 4) == 2 and bodies(spark, path) == whole
    day = logtable.manifest(spark, path).where("project_id = 1").head()
    assert (day.rows, day.files) == (6, 2)
    # Shards are ranges of time; a second run leaves them alone.
    shards = spark.read.parquet(f"{path}/days/gen=0/project_id=1").groupBy("shard").agg(F.min("ts"), F.max("ts"), F.count("*")).orderBy("shard").collect()
    assert [r[3] for r in shards] == [4, 2] and shards[0][2] <= shards[1][1]
    assert logtable.compact(spark, path, NOW, 4) == 0 and len(logtable.versions(spark, path)) == 1
    # A late row makes its day, and that alone, due again.
    logtable.append(batch(spark, [(2, at(2, 3), "late")]), path, 3)
    assert bodies(spark, path) == sorted([*whole, "late"])
    untouched = {f for f in files(path) if "project_id=1" in f}
    assert logtable.compact(spark, path, NOW, 4) == 1 and bodies(spark, path) == sorted([*whole, "late"])
    assert untouched <= files(path)


def test_the_open_hour_and_a_day_that_passes(spark, path):
    for epoch in range(2):
        logtable.append(batch(spark, [(1, at(0, 13, epoch), f"closed{epoch}"), (1, at(0, 14, epoch), f"open{epoch}")]), path, epoch)
    whole = bodies(spark, path)
    assert logtable.compact(spark, path, NOW) == 1
    assert [r.bucket for r in logtable.manifest(spark, path).collect()] == ["2024-05-10T13"] and bodies(spark, path) == whole
    assert logtable.compact(spark, path, NOW) == 0
    logtable.append(batch(spark, [(1, at(0, 13, 50), "late")]), path, 2)
    assert bodies(spark, path) == sorted([*whole, "late"])
    # Tomorrow the day takes in the hour, the rest of the batches and the late row.
    assert logtable.compact(spark, path, NOW + timedelta(days=1)) == 1
    assert [r.bucket for r in logtable.manifest(spark, path).collect()] == ["2024-05-10"] and bodies(spark, path) == sorted([*whole, "late"])
    assert logtable.vacuum(spark, path, keep_versions=1) > 0 and bodies(spark, path) == sorted([*whole, "late"])
    assert len(files(path)) == 1
    assert logtable.vacuum(spark, path, keep_versions=1) == 0


def test_pruning(spark, path):
    projects = spark.createDataFrame([(1, 3), (2, 0), (3, None)], "id long, retention_days int")
    for epoch in range(2):
        rows = [(p, at(d, h), f"{p}.{d}.{h}.{epoch}") for p in (1, 2, 3) for d in (1, 3, 5) for h in (2, 20)]
        logtable.append(batch(spark, rows), path, epoch)
    logtable.compact(spark, path, NOW)
    before, kept = bodies(spark, path), {f for f in files(path) if "day=2024-05-09" in f}
    removed = {r.project_id: r.removed for r in logtable.prune(spark, path, projects, NOW).collect()}
    gone = [b for b in before if b.startswith("1.5.") or b.startswith("1.3.2.")]
    assert removed == {1: len(gone)} == {1: 6}
    assert bodies(spark, path) == [b for b in before if b not in gone]
    assert kept <= files(path) and logtable.prune(spark, path, projects, NOW).count() == 0
    logtable.vacuum(spark, path, keep_versions=1)
    assert bodies(spark, path) == [b for b in before if b not in gone]
    assert not [f for f in files(path) if "project_id=1/day=2024-05-05" in f] and kept & {f for f in files(path) if "/days/" in f}


def test_filters_reach_both_kinds_of_folders(spark, path):
    for epoch in range(2):
        logtable.append(batch(spark, [(p, at(d), "x") for p in (1, 2) for d in (1, 2)]), path, epoch)
    logtable.compact(spark, path, NOW)
    logtable.append(batch(spark, [(1, at(1), "y")]), path, 2)
    found = logtable.read(spark, path).where("project_id = 1 and day = '2024-05-09'")
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and "PartitionFilters: []" not in plan
