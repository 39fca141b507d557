"""The logs table: batches as they arrive, compacted buckets, and one view of both.

``fresh/epoch=E`` holds the batches, ``days/gen=G`` what maintenance runs have rewritten,
both in folders by project and day. A bucket is a day or, today, an hour. ``manifest``, a small table written anew as
``version=N`` by each run, says for every rewritten bucket in which generation its rows lie and up to
which batch they come from; later batches count beside it. Readers take the newest complete version and see every row
once before, during and after a run; files that no version needs any more are deleted by
:func:`vacuum`. Appends and maintenance each have one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from emberlog.operators.storage import epochs, exists, file_system, kept

SHARD_ROWS = 100_000
#: The generation of a bucket whose rows are gone.
GONE = -1
MANIFEST = "project_id long, day string, bucket string, gen long, upto long, rows long, files long"
_BUCKET = ["project_id", "day", "bucket"]


def _day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def _hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def append(logs: DataFrame, path: str, epoch: int) -> None:
    """Appends a batch; its rows are numbered on from the batches before it, ``log_id`` without gaps, in any order.

    A batch that is written again takes the place of its first attempt, with the same ids in all.
    """
    spark = logs.sparkSession
    done = [e for e in epochs(spark, f"{path}/ids") if e < epoch]
    start = spark.read.parquet(f"{path}/ids/epoch={max(done)}").head()["next_id"] if done else 0
    placed = kept(logs.drop("log_id").select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept(parts.select("__part", "__first", "__n", (F.coalesce(F.sum("__n").over(before), F.lit(0)) + start).alias("__start")))
    numbered = placed.join(F.broadcast(offsets), "__part").withColumn("log_id", F.col("__start") + F.col("__at") - F.col("__first")).select("log_id", *(c for c in logs.columns if c != "log_id"), _day(F.col("ts")).alias("day"))
    numbered.hint("rebalance", F.col("project_id"), F.col("day")).sortWithinPartitions("project_id", "day", "ts", "log_id").write.mode("overwrite").option("compression", "zstd").partitionBy("project_id", "day").parquet(f"{path}/fresh/epoch={epoch}")
    schema = numbered.select(*(c for c in numbered.columns if c not in ("project_id", "day"))).schema.json()
    offsets.agg((F.coalesce(F.sum("__n"), F.lit(0)) + start).alias("next_id"), F.lit(schema).alias("schema")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ids/epoch={epoch}")


def append_stream(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends the batches of a stream."""
    return lambda batch, epoch: append(batch, path, epoch)


def versions(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, f"{path}/manifest"):
        return []
    fs, where = file_system(spark, f"{path}/manifest")
    names = [str(f.getPath()) for f in fs.listStatus(where) if "/version=" in str(f.getPath())]
    return sorted(int(n.rpartition("=")[2]) for n in names if exists(spark, f"{n}/_SUCCESS"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rewritten buckets by the newest version, or another."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={known[-1] if version is None else version}")


def _write_manifest(spark: SparkSession, path: str, rows: DataFrame) -> None:
    known = versions(spark, path)
    kept(rows.select(*(c.split()[0] for c in MANIFEST.split(", ")))).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={(known[-1] + 1) if known else 0}")


def _files(spark: SparkSession, path: str, folder: str, parts: str) -> DataFrame:
    """The rows under a folder, with the values in its subfolders' names; the newest batch says what columns there are."""
    done = epochs(spark, f"{path}/ids")
    own = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/ids/epoch={done[-1]}").head()["schema"])) if done else StructType()
    schema = StructType([*own.fields, StructField("project_id", LongType()), StructField("day", StringType()), *StructType.fromDDL(parts).fields])
    where = f"{path}/{folder}"
    if not exists(spark, where) or not file_system(spark, where)[0].listStatus(file_system(spark, where)[1]):
        return spark.createDataFrame([], schema).select("*", F.lit("").alias("file"))
    return spark.read.option("basePath", where).schema(schema).parquet(where).select("*", F.col("_metadata.file_path").alias("file"))


def _parts(spark: SparkSession, path: str, files: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The manifest, the rows that lie in its generations, and the fresh rows that none of its buckets covers, with their ``bucket`` (of the hour)."""
    known, done = kept(manifest(spark, path)), epochs(spark, f"{path}/ids")
    fresh = _files(spark, path, "fresh", "epoch bigint").where(F.col("epoch") <= (done[-1] if done else -1))
    columns = [c for c in fresh.columns if c not in ("epoch", "file")]
    # Of a day at most its own row and one for each hour: covered if either says so.
    upto = F.broadcast(known.select("project_id", "day", "bucket", "upto"))
    whole = upto.where("bucket = day").select("project_id", "day", F.col("upto").alias("day_upto"))
    hours = upto.where("bucket <> day").select("project_id", F.col("bucket").alias("hour"), F.col("upto").alias("hour_upto"))
    open_ = fresh.join(whole, ["project_id", "day"], "left").where("day_upto is null or epoch > day_upto").drop("day_upto")
    open_ = open_.withColumn("hour", _hour(F.col("ts"))).join(hours, ["project_id", "hour"], "left").where("hour_upto is null or epoch > hour_upto").drop("hour_upto").withColumnRenamed("hour", "bucket")
    names = [*columns, "bucket", *(["file"] if files else [])]
    stored = _files(spark, path, "days", "gen bigint, bucket string")
    live = stored.join(F.broadcast(known.select(*_BUCKET, "gen")), [*_BUCKET, "gen"], "left_semi")
    return known, live.select(*names), open_.select(*names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table, rewritten and fresh, each once. Filters on project and day prune both kinds of folders."""
    _, stored, fresh = _parts(spark, path)
    return stored.unionByName(fresh).drop("bucket")


def _bucketed(spark: SparkSession, path: str, now: datetime, files: bool = False) -> DataFrame:
    """Rows with the bucket they belong to at ``now``: their hour if that is today, else their day."""
    _, stored, fresh = _parts(spark, path, files)
    today = now.strftime("%Y-%m-%d")
    fresh = fresh.withColumn("bucket", F.when(F.col("day") == today, F.col("bucket")).otherwise(F.col("day")))
    return stored.withColumn("bucket", F.when(F.col("day") == today, F.col("bucket")).otherwise(F.col("day"))).unionByName(fresh)


def plan_compaction(spark: SparkSession, path: str, now: datetime, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(project_id, day, bucket, rows, files, shards)`` of the buckets to be rewritten: those of two files or more that fit into fewer, ceil(rows / ``shard_rows``). The hour still open at ``now`` is left alone.

    Rows are counted from file footers and, for what is fresh, times; no other column is read.
    """
    counted = _bucketed(spark, path, now, files=True).groupBy(*_BUCKET).agg(F.count("*").alias("rows"), F.countDistinct("file").alias("files"))
    shards = F.greatest(F.ceil(F.col("rows") / shard_rows), F.lit(1)).cast("long").alias("shards")
    return counted.where(F.col("bucket") != now.strftime("%Y-%m-%dT%H")).select("*", shards).where("files > 1 and files > shards")


def _rewrite(rows: DataFrame, path: str, gen: int, shard_rows: int) -> None:
    """Buckets as files of up to ``shard_rows`` rows, each a range of (ts, log_id). Places are counts by minute, so no task orders a bucket."""
    minute = F.date_trunc("minute", "ts")
    counts = rows.groupBy(*_BUCKET, minute.alias("minute")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*_BUCKET).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*_BUCKET, "minute", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = Window.partitionBy(*_BUCKET, "minute").orderBy("ts", "log_id")
    placed = rows.withColumn("minute", minute).withColumn("place", F.row_number().over(here) - 1).join(offsets, [*_BUCKET, "minute"])
    sharded = placed.withColumn("shard", F.floor((F.col("before") + F.col("place")) / shard_rows)).drop("minute", "place", "before")
    dealt = sharded.repartition(*_BUCKET, "shard").sortWithinPartitions(*_BUCKET, "shard", "ts", "log_id")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy(*_BUCKET, "shard").parquet(f"{path}/days/gen={gen}")


def _next_gen(spark: SparkSession, path: str) -> int:
    """A number no folder has, complete or not."""
    if not exists(spark, f"{path}/days"):
        return 0
    fs, where = file_system(spark, f"{path}/days")
    return 1 + max((int(str(f.getPath()).rpartition("gen=")[2]) for f in fs.listStatus(where) if "/gen=" in str(f.getPath())), default=-1)


def compact(spark: SparkSession, path: str, now: datetime, shard_rows: int = SHARD_ROWS) -> int:
    """Rewrites the buckets of :func:`plan_compaction` in one job; returns their number. A day that has passed takes in its hours.

    A run that fails leaves the manifest, and so the table, as it was; running again does nothing twice.
    """
    planned = kept(plan_compaction(spark, path, now, shard_rows))
    n = planned.count()
    if not n:
        return 0
    gen, last = _next_gen(spark, path), epochs(spark, f"{path}/ids")[-1]
    chosen = F.broadcast(planned.select(*_BUCKET))
    _rewrite(_bucketed(spark, path, now).join(chosen, _BUCKET, "left_semi"), path, gen, shard_rows)
    rewritten = planned.select(*_BUCKET, F.lit(gen).cast("long").alias("gen"), F.lit(last).cast("long").alias("upto"), "rows", F.col("shards").alias("files"))
    _write_manifest(spark, path, _replaced(manifest(spark, path), rewritten))
    return n


def _replaced(known: DataFrame, rewritten: DataFrame) -> DataFrame:
    """The manifest with rows for buckets that are new, or take the place of their earlier ones and, if days, of their hours."""
    days = F.broadcast(rewritten.where("bucket = day").select("project_id", "day"))
    same = F.broadcast(rewritten.select(*_BUCKET))
    return known.join(days, ["project_id", "day"], "left_anti").join(same, _BUCKET, "left_anti").select(*known.columns).unionByName(rewritten.select(*known.columns))


def prune(spark: SparkSession, path: str, projects: DataFrame, now: datetime, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Removes the rows before each project's cutoff, ``now`` less its ``retention_days`` (none or 0: for ever); ``(project_id, removed)``.

    Whole days are only marked as gone, without reading a row of them; the day that holds the
    cutoff is rewritten if it has rows before it. No other file is touched. Again, it removes nothing.
    """
    _, stored, fresh = _parts(spark, path)
    cutoff = (F.lit(now).cast("timestamp") - F.make_dt_interval("retention_days")).alias("cutoff")
    limits = F.broadcast(kept(projects.where(F.coalesce("retention_days", F.lit(0)) > 0).select(F.col("id").cast("long").alias("project_id"), cutoff, _day(cutoff).alias("cutoff_day"))))
    rows = stored.unionByName(fresh).join(limits, "project_id").where("day <= cutoff_day")
    old = F.col("ts").cast("timestamp") < F.col("cutoff")
    whole = rows.where("day < cutoff_day").groupBy("project_id", "day").agg(F.count("*").alias("removed"))
    edge = rows.where("day = cutoff_day").groupBy("project_id", "day").agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("rows")).where("removed > 0")
    found = kept(whole.select("*", F.lit(0).cast("long").alias("rows")).unionByName(edge))
    if found.isEmpty():
        return spark.createDataFrame([], "project_id long, removed long")
    gen, last = _next_gen(spark, path), epochs(spark, f"{path}/ids")[-1]
    cut = found.where("rows > 0")
    if not cut.isEmpty():
        left = rows.where(~old).join(F.broadcast(cut.select("project_id", "day")), ["project_id", "day"], "left_semi").withColumn("bucket", F.col("day"))
        _rewrite(left.drop("cutoff", "cutoff_day"), path, gen, shard_rows)
    files = F.ceil(F.col("rows") / shard_rows).cast("long")
    marked = found.select("project_id", "day", F.col("day").alias("bucket"), F.when(F.col("rows") > 0, gen).otherwise(GONE).cast("long").alias("gen"), F.lit(last).cast("long").alias("upto"), "rows", files.alias("files"))
    _write_manifest(spark, path, _replaced(manifest(spark, path), marked))
    return found.groupBy("project_id").agg(F.sum("removed").alias("removed"))


def vacuum(spark: SparkSession, path: str, keep_versions: int = 2) -> int:
    """Deletes generations that none of the newest ``keep_versions`` manifests names, and fresh folders whose rows all of them cover; returns their number. Readers that started with an older version lose their files."""
    known = versions(spark, path)
    if len(known) < keep_versions:
        return 0
    fs, _ = file_system(spark, path)
    held = [manifest(spark, path, v).select(*_BUCKET, "gen", "upto").collect() for v in known[-keep_versions:]]
    used = {(r["gen"], r["project_id"], r["day"], r["bucket"]) for rows in held for r in rows}
    covered = [{(r["project_id"], r["day"]): r["upto"] for r in rows if r["bucket"] == r["day"]} for rows in held]
    gone = 0
    for base, depth in (("days", 4), ("fresh", 3)):
        if not exists(spark, f"{path}/{base}"):
            continue
        for folder in fs.globStatus(file_system(spark, f"{path}/{base}" + "/*=*" * depth)[1]) or []:
            name = str(folder.getPath())
            values = [p.split("=", 1)[1] for p in name.rsplit("/", depth)[1:]]
            first, project, day = int(values[0]), int(values[1]), values[2]
            needed = (first, project, day, values[3]) in used if base == "days" else any(c.get((project, day), -1) < first for c in covered)
            if not needed:
                fs.delete(folder.getPath(), True)
                gone += 1
    return gone
