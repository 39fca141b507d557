"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger, an
append-only Parquet table, says for each blob by which rules, in which version, it has been
scanned and what was found. A scan reads only the blobs that some rule's current version
has not seen, each once whatever number of paths and versions hold it, and by those rules
alone; findings are then joined back to all paths.

Texts are shuffled once, by blob, after each task has dropped what it holds twice. A
content that a third of all rows share is thus one row a task there, and rows of hot blobs
are dealt to many tasks when findings are joined back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import new_folder, skew_join

LEDGER = "blob binary, scanned array<string>, found array<struct<rule:string,version:int,start:int,end:int>>"
_SPAN = pa.struct([("rule", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``secret`` has ``least`` characters or more. ``hints``: a text without any of them, compared in lower case, holds no match (none: any may)."""

    name: str
    pattern: str
    least: int = 0
    secret: int = 0
    hints: tuple[str, ...] = ()
    version: int = 1
    base: bool = field(default=False, compare=False)

    @property
    def mark(self) -> str:
        return f"{self.name}@{self.version}"


#: The base rules, in the order in which ties are listed, then further ones. Character classes are ASCII, and so is the "either case" of (?i).
RULES = (
    Rule("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2, ("password", "passwd", "secret", "token", "apikey", "api_key"), base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, ("akia",), base=True),
    # A run of 16 or more starts where a run starts: shorter ones would be dropped.
    Rule("hex", r"[0-9a-f]{16,}", 16, base=True),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("forge_token", r"(?a)\b(?:gh[pousr]_|glpat-|xox[abprs]-)[A-Za-z0-9-]{16,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox")),
    Rule("url_password", r"(?a)\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{4,128})@", 4, 1, ("://",)),
)


def blob_of(content: Column) -> Column:
    """The address of a content: SHA-256 of its UTF-8 bytes, null as empty."""
    return F.unhex(F.sha2(F.coalesce(content.cast("string"), F.lit("")).cast("binary"), 256))


def scan_text(text: str, rules: Iterable[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int, int]]:
    """``(rule, version, start, end)`` of all findings, in code points, ends exclusive."""
    found = []
    lower = text.lower()
    for rule, pattern in rules:
        if not rule.hints or any(h in lower for h in rule.hints):
            found += [(rule.name, rule.version, m.start(), m.end()) for m in pattern.finditer(text) if m.end(rule.secret) - m.start(rule.secret) >= rule.least]
    return found


def _scanner(rules: Sequence[Rule]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, re.compile(r.pattern)) for r in rules]
        for batch in batches:
            scanned, found = [], []
            for text, seen in zip(batch.column(1), batch.column(2).to_pylist()):
                due = [(r, p) for r, p in compiled if r.mark not in (seen or ())]
                scanned.append([r.mark for r, _ in due])
                found.append([dict(zip(("rule", "version", "start", "end"), f)) for f in scan_text(text.as_py(), due)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scanned, pa.list_(pa.string())), pa.array(found, pa.list_(_SPAN))], ["blob", "scanned", "found"])

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty before the first scan."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def unscanned(contents: DataFrame, content: str, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(blob, content, seen)``: each distinct content that some rule's version has not scanned, once, with the marks of those that have."""
    marks = F.array(*(F.lit(r.mark) for r in rules))
    blobs = contents.select(blob_of(F.col(content)).alias("blob"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content")).dropDuplicates(["blob"])
    seen = ledger.select("blob", F.explode("scanned").alias("mark")).groupBy("blob").agg(F.collect_set("mark").alias("seen"))
    return blobs.join(seen, "blob", "left").where(F.size(F.array_except(marks, F.coalesce("seen", F.array().cast("array<string>")))) > 0)


def scan(contents: DataFrame, content: str, ledger_path: str, rules: Sequence[Rule] = RULES) -> None:
    """Adds to the ledger what the unseen pairs of blob and rule version of ``contents`` hold.

    A scan that fails half-way adds nothing. Scanning again, or other contents or rules, only
    looks at what is new; a rule whose pattern changes needs a new version.
    """
    if len({r.mark for r in rules}) < len(rules):
        raise ValueError("two rules have one name and version")
    spark = contents.sparkSession
    due = unscanned(contents, content, read_ledger(spark, ledger_path), rules)
    due.mapInArrow(_scanner(rules), LEDGER).write.mode("append").parquet(ledger_path)


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(blob, found)``: of blobs with findings all that the current versions of ``rules`` found, by start, then in the order of ``rules``."""
    place = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.mark, i)))
    rows = ledger.where(F.size("found") > 0).select("blob", F.inline("found")).withColumn("place", place[F.concat_ws("@", "rule", F.col("version").cast("string"))]).where("place is not null")
    # Two scans that ran at once may both have recorded a finding.
    one = F.array_sort(F.collect_set(F.struct("start", "place", "rule", "end")))
    return rows.groupBy("blob").agg(F.transform(one, lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))


def scan_versions(versions: DataFrame, content: str = "text", ledger_path: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``versions``, each row with its ``blob`` address and ``found(rule, start, end)``, instead of its content.

    Every row of ``versions`` is one version of one path, named by its other columns. The
    ledger at ``ledger_path`` (none: a new one) is brought up to date first. Whole contents are
    scanned, however long; null counts as empty; offsets are code points, ends exclusive.
    Repeated rows come back repeated, each with the findings of its content, which is scanned
    once; an empty table gives no rows. Other columns may have any names but ``blob`` and ``found``.
    """
    ledger_path = ledger_path or new_folder(versions.sparkSession, "tables")
    scan(versions, content, ledger_path, rules)
    rows = versions.select(F.struct(*(F.col(f"`{c}`") for c in versions.columns if c != content)).alias("version"), blob_of(F.col(content)).alias("blob"))
    met = skew_join(rows, findings(read_ledger(versions.sparkSession, ledger_path), rules), ["blob"], "left")
    none = F.array().cast("array<struct<rule:string,start:int,end:int>>")
    return met.select("version.*", "blob", F.coalesce("found", none).alias("found"))
