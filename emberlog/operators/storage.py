"""Intermediate results and files in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: A part of a file that is worth a task of its own in any case.
SPLIT_BYTES = 128 * 1024 * 1024


def kept(df: DataFrame, cached: bool = False) -> DataFrame:
    """``df`` computed once and kept in the session's checkpoint folder, its lineage cut. Where none is set, a temporary one for a local master; on a cluster that is an error, as its executors share no local folder.

    A checkpoint runs its last stage twice. ``cached`` holds the rows until they are written: for narrow rows that cost more than that.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and (sc.master.startswith("local[") or sc.master == "local"):
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        if not named:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named)
    if not cached or df.storageLevel.useMemory or df.storageLevel.useDisk:
        return df.checkpoint()
    out = df.persist().checkpoint()
    df.unpersist()
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, if it lies in fewer and small files: for work on rows that costs more than moving them. Nothing is run to find out."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    files = df._jdf.inputFiles()
    if not 0 < len(files) < cores:
        return df
    sizes = (fs.getFileStatus(where).getLen() for fs, where in (file_system(spark, f) for f in files))
    return df.repartition(cores) if sum(sizes) < cores * SPLIT_BYTES else df


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def epochs(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete ``epoch=<number>`` folders under ``path``."""
    if not exists(spark, path):
        return []
    fs, where = file_system(spark, path)
    names = [str(f.getPath()) for f in fs.listStatus(where) if "/epoch=" in str(f.getPath())]
    return sorted(int(n.rpartition("=")[2]) for n in names if exists(spark, f"{n}/_SUCCESS"))
