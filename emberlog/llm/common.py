"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows (so fewer than 1 / HOT_SHARE keys are) ...
HOT_SHARE = 1 / 400
#: ... and so many rows at least; its rows are then dealt to so many tasks.
HOT_ROWS, SALTS = 64, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one for a local master (tests), an error on a cluster: its executors share no local folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own under :func:`shared_dir`, deleted with all it holds by :func:`clean_up`."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes the tables that this application's operators have stored, once their results have been read."""
    for kind in ("tables", "pipeline"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{kind}/{spark.sparkContext.applicationId}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """As :func:`checkpointed`, but as a compressed Parquet table, for wide rows."""
    path = new_folder(df.sparkSession, "tables")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df``, to be broadcast in a join if it has at most so many (narrow) rows, else left to Spark's own choice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, in which no combination of ``on`` has many rows, whatever share of ``left`` one has.

    Rows of hot keys are dealt to ``SALTS`` tasks, each of which gets those keys' rows of
    ``right``. Only the hot keys, of which there are fewer than 1 / ``HOT_SHARE``, pass through
    the driver. Keys are counted in ``counted``, by default in ``left``, which should then be kept (a
    table or a checkpoint). ``how`` is inner or left.
    """
    sizes = (left if counted is None else counted).groupBy(*on).agg(F.count("*").alias("__n")).dropna(subset=on)
    total, most = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).head()
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    if most <= least:
        return left.join(right, on, how)
    hot = sizes.where(F.col("__n") > least).select(*on).collect()
    flags = F.broadcast(left.sparkSession.createDataFrame(hot, sizes.select(*on).schema).withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = left.join(flags, on, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(flags, on, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What is run in it sends Arrow batches of about ``size`` to Python (by default 64 MB, of which the JVM and Python hold several copies a task); the setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold(column: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``: the held-out folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def in_fold(column: str, mod: int, held_out: int) -> Column:
    """Whether a row is held out; a row without an id is not."""
    return F.coalesce(fold(column, mod) == held_out, F.lit(False))
