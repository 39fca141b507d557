"""Lines to records: stack traces and other continuations are joined to the line they belong to.

The order inside a source matters, but no task holds a source: its lines lie in slices of
their ``seq``, and what a slice needs of those before it is one small row, the last line's
time, the bytes so far, and the last line that starts something whatever came before. These
rows are put together by a scan over slices, and joined back to the lines, which are
shuffled once for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators.storage import epochs, kept

# Lines that continue a record, and lines that begin a crash report.
CONTINUATION = r"\A(?:[ \t]|at |Caused by:|\.\.\. [0-9]+ more)"
CRASH = r"\A(?:panic:|fatal error:)"
MAX_BYTES = 64 * 1024
#: Values of ``seq`` in a slice.
SLICE = 65_536

RECORDS = "source string, service string, seq long, ts timestamp, text string, lines long"
_PARTS = "array<struct<seq:bigint,ts:timestamp,service:string,text:string>>"


def _on_slice(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right``, which has a row for each slice of each source."""
    named = right.withColumnsRenamed({"source": "of_source", "slice": "of_slice"})
    return left.join(named, left["source"].eqNullSafe(named["of_source"]) & (left["slice"] == named["of_slice"])).drop("of_source", "of_slice")


def _last_so_far(lines: DataFrame, mark: Column, name: str) -> DataFrame:
    """``lines`` with the latest non-null ``mark`` (a struct that starts with seq) of a source up to each line: in the line's slice, else of the slices before."""
    marked = lines.withColumn("mark", mark)
    inside = Window.partitionBy("source", "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy("source", "slice").agg(F.max("mark").alias("last_mark"))
    carried = ends.select("source", "slice", F.last("last_mark", ignorenulls=True).over(before).alias("carried"))
    running = marked.withColumn("running", F.last("mark", ignorenulls=True).over(inside))
    return _on_slice(running, carried).withColumn(name, F.coalesce("running", "carried")).drop("mark", "running", "carried")


def _pieces(max_bytes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Cuts what is beyond a record's limit, line by line in order: a line that would go beyond it starts a record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, size, record = None, 0, None
        for pdf in batches:
            out = []
            for source, of, seq, text in zip(pdf["source"], pdf["record"].tolist(), pdf["seq"].tolist(), pdf["text"]):
                more = len(text.encode())
                if (source, of) != last or size + 1 + more > max_bytes:
                    last, size, record = (source, of), more, seq
                else:
                    size += 1 + more
                out.append(record)
            yield pdf.assign(record=pd.array(out, "int64"))

    return run


def record_of_lines(lines: DataFrame, join_window: str = "1 second", max_bytes: int = MAX_BYTES, slice_size: int = SLICE) -> DataFrame:
    """``(source, service, seq, ts, text, record)``: each line with the ``seq`` of its record's first line, as :func:`join_multiline` describes."""
    text = F.coalesce("text", F.lit(""))
    read = lines.select("source", "service", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), text.alias("text"), F.floor(F.col("seq") / slice_size).alias("slice"))
    read = read.withColumns({"bytes": F.octet_length("text") + F.lit(1).cast("long"), "header": F.col("text").rlike(CRASH), "more": F.col("text").rlike(CONTINUATION)})
    inside, slices = Window.partitionBy("source", "slice").orderBy("seq"), Window.partitionBy("source").orderBy("slice")
    ends = read.groupBy("source", "slice").agg(F.max_by("ts", "seq").alias("last_ts"), F.sum("bytes").alias("all"))
    carried = ends.select("source", "slice", (F.row_number().over(slices) == 1).alias("first_slice"), F.lag("last_ts").over(slices).alias("last_ts"), F.coalesce(F.sum("all").over(slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    first_here = F.row_number().over(inside) == 1
    placed = _on_slice(read, carried).withColumns(
        {
            "first": first_here & F.col("first_slice"),
            "last_ts": F.when(first_here, F.col("last_ts")).otherwise(F.lag("ts").over(inside)),
            "total": F.col("before") + F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    gap = F.coalesce(F.col("ts") > F.col("last_ts") + F.expr(f"INTERVAL {join_window}"), F.lit(False))
    # A line after a gap and a crash header start a record whatever came before them.
    placed = placed.withColumn("hard", F.col("first") | gap | F.col("header")).drop("first", "first_slice", "last_ts", "before")
    start = F.struct("seq", F.col("header").alias("crash"), (F.col("total") - F.col("bytes")).alias("from"), "bytes")
    placed = _last_so_far(placed, F.when(F.col("hard"), start), "part")
    size = F.col("total") - F.col("part.from") - 1
    in_crash = F.col("part.crash") & (size <= max_bytes)
    # The line that breaks a crash report's limit starts a record, and the report is over.
    breaks = F.col("part.crash") & (size > max_bytes) & (size - F.col("bytes") <= F.greatest(F.lit(max_bytes), F.col("part.bytes") - 1))
    placed = placed.withColumn("starts", F.col("hard") | (~in_crash & (~F.col("more") | breaks))).drop("part", "hard", "header", "more")
    placed = _last_so_far(placed, F.when(F.col("starts"), F.struct("seq", (F.col("total") - F.col("bytes")).alias("from"))), "start")
    beyond = (F.col("total") - F.col("start.from") - 1 > max_bytes) & ~F.col("starts")
    out = placed.select("source", "service", "seq", "ts", "text", F.col("start.seq").alias("record"), beyond.alias("beyond"))
    rest = out.where("beyond").drop("beyond")
    cut = rest.repartition("source", "record").sortWithinPartitions("source", "record", "seq").mapInPandas(_pieces(max_bytes), rest.schema)
    return out.where("not beyond").drop("beyond").unionByName(cut)


def _records(assigned: DataFrame) -> DataFrame:
    """A row per record with its lines in order, at most as many bytes as a record may have beyond its first line."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "ts", "service", "text"))).cast(_PARTS)
    return assigned.groupBy("source", "record").agg(parts.alias("parts"))


def _joined(records: DataFrame) -> DataFrame:
    first = F.get("parts", F.lit(0))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return records.select("source", first["service"].alias("service"), first["seq"].alias("seq"), first["ts"].alias("ts"), text.alias("text"), F.size("parts").cast("long").alias("lines"))


def join_multiline(lines: DataFrame, join_window: str = "1 second", max_bytes: int = MAX_BYTES, slice_size: int = SLICE) -> DataFrame:
    """``lines(source, service, seq, ts, text)`` to records ``(source, service, seq, ts, text, lines)``.

    A session of a source ends where a line comes more than the join window after the line
    before it. In a session, a line continues a record if it begins like a continuation; after
    a crash header everything does until the next header. A line that would make a record larger than
    ``max_bytes`` starts a new one, which is not a crash report's. The first line gives seq
    and ts, lines are joined with newlines. ``seq`` is unique in a source; a null text is
    empty, a null time no gap.
    """
    return _joined(_records(record_of_lines(lines, join_window, max_bytes, slice_size)))


def join_stream(path: str, join_window: str = "1 second", max_bytes: int = MAX_BYTES, idle: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that joins a stream of lines, kept under ``path``: records that are complete, and the lines of each source's last record, which may go on.

    Lines of a source arrive in order of ``seq``; those of one batch may be in any order. A
    record is complete when a later line of its source starts another, or, with ``idle``, when
    its last line is so much older than the newest line of all sources (lines that come yet later start a new record). :func:`stream_records`
    reads the result at any time. A batch that is written again takes the place of its first attempt.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        lines = batch.select("source", "service", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "text")
        earlier = [e for e in epochs(spark, f"{path}/open") if e < epoch]
        if earlier:
            lines = lines.unionByName(_open(spark, path, max(earlier)).select("source", F.inline("parts")).select(*lines.columns))
        found = kept(_records(record_of_lines(lines, join_window, max_bytes)))
        last = found.groupBy("source").agg(F.max("record").alias("last_record")).withColumnRenamed("source", "of_source")
        marked = found.join(last, found["source"].eqNullSafe(last["of_source"])).withColumn("open", F.col("record") == F.col("last_record"))
        if idle:
            newest = found.agg(F.max(F.array_max(F.transform("parts", lambda p: p["ts"])))).head()[0]
            latest = F.get("parts", F.size("parts") - 1)["ts"]
            marked = marked.withColumn("open", F.col("open") & ~F.coalesce(latest < F.lit(newest) - F.expr(f"INTERVAL {idle}"), F.lit(False)))
        marked = kept(marked.select("source", "record", "parts", "open"))
        _joined(marked.where("not open")).write.mode("overwrite").parquet(f"{path}/records/epoch={epoch}")
        marked.where("open").drop("open").write.mode("overwrite").parquet(f"{path}/open/epoch={epoch}")

    return run


def _open(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    return spark.read.schema(f"source string, record long, parts {_PARTS}").parquet(f"{path}/open/epoch={epoch}")


def stream_records(spark: SparkSession, path: str, with_open: bool = True) -> DataFrame:
    """The records a stream has joined so far; ``with_open`` includes each source's last one as it is, which at the end of the stream is complete."""
    done = epochs(spark, f"{path}/open")
    if not done:
        return spark.createDataFrame([], RECORDS)
    complete = spark.read.schema(RECORDS + ", epoch long").parquet(f"{path}/records").where(F.col("epoch") <= done[-1]).drop("epoch")
    return complete.unionByName(_joined(_open(spark, path, done[-1]))) if with_open else complete
