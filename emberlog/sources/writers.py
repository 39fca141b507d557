"""Writers: the logs table, shipped records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_day(logs: DataFrame) -> DataFrame:
    return logs.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def write_logs(logs: DataFrame, path: str) -> None:
    """Appends to the logs table, partitioned by project and day; rows of a file are in order of time, so that its statistics prune.

    Rows are brought together by project and day, and a day that is larger than Spark's
    advisory partition size is split among as many writers as that takes.
    """
    out = with_day(logs)
    out.hint("rebalance", F.col("project_id"), F.col("day")).sortWithinPartitions("project_id", "day", "ts", "log_id").write.mode("append").option("compression", "zstd").partitionBy("project_id", "day").parquet(path)


def read_logs(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_ship_records(records: DataFrame) -> DataFrame:
    """``(value)``: a JSON record of timestamp, service and message for each joined record."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return records.select(F.to_json(F.struct(ts.alias("timestamp"), F.col("service"), F.col("text").alias("message"))).alias("value"))
