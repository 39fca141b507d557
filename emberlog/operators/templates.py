"""Templates: bodies as (template, variables), lossless, mined by first arrival.

A body of one line with at most 200 tokens belongs to the group of its token count and
first token. In a group, in order of arrival, the first template that covers the body is
used; without one a new one is minted, the generalisation of the most similar and the body
if they agree in half of the positions, else the body itself. Templates only ever get
added, so mining goes on from those stored before (:func:`mine_templates`,
:func:`append_templates`), and what one of them covers needs no order any more. That is
how a large group is mined in parallel: its first bodies are resolved in order by one
task, the rest are held against the templates this gave in any number of tasks, and only
what none of them covers goes on to the next round.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators.storage import epochs, exists, kept

WILD = "\0"
MAX_TOKENS = 200
THRESHOLD = 0.5
CAP = 100_000
#: Bodies of a group that one task resolves in order, at most, beyond one slice of log ids; by how much each round raises that.
IN_ORDER, MORE = 50_000, 4
#: Log ids in a slice; bodies of a group that one task holds against new templates, on average.
SLICE, TOGETHER = 65_536, 50_000
#: A body with more records is joined in so many tasks.
HOT_ROWS, SALTS = 1_000_000, 64
#: Bytes of a row group of stored records; templates of a project that are listed in a search's filter, at most.
ROW_GROUP, MAX_LISTED = 8 * 1024 * 1024, 2_000

GROUP = ["project_id", "width", "group_key"]
TEMPLATES = "project_id long, template_id long, tokens array<string>, first_log_id long"
ENCODED = "log_id long, project_id long, template_id long, vars array<string>, raw string"


def templatable(body: Column) -> Column:
    return F.coalesce((body != "") & ~F.contains(body, F.lit("\n")) & ~F.contains(body, F.lit(WILD)) & (F.size(F.split(body, " ")) <= MAX_TOKENS), F.lit(False))


class Group:
    """The templates of one group, oldest first."""

    def __init__(self, width: int):
        self.numbers: dict[str, int] = {}
        self.words = [WILD]
        #: A row of token numbers for each template; 0: any token.
        self.rows, self.used = np.zeros((4, width), np.int32), 0
        self.names: list[tuple] = []
        #: The cover index: by static positions, by the tokens there, the oldest such template.
        self.covers: dict[tuple[int, ...], tuple[Callable, dict]] = {}

    def add(self, tokens: list[str], name: tuple) -> None:
        for t in tokens:
            if t != WILD and t not in self.numbers:
                self.numbers[t] = len(self.words)
                self.words.append(t)
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used] = [0 if t == WILD else self.numbers[t] for t in tokens]
        static = tuple(i for i, t in enumerate(tokens) if t != WILD)
        if static not in self.covers:
            self.covers[static] = (operator.itemgetter(*static) if static else lambda _: (), {})
        at, held = self.covers[static]
        held.setdefault(at(tokens), self.used)
        self.names.append(name)
        self.used += 1

    def cover(self, tokens: list[str]) -> tuple | None:
        """The name of the oldest template that covers ``tokens``."""
        found = [i for at, held in self.covers.values() if (i := held.get(at(tokens))) is not None]
        return self.names[min(found)] if found else None

    def resolve(self, tokens: list[str], name: tuple, threshold: float) -> tuple[tuple, list[str] | None]:
        """The name of the template for ``tokens``, and its text if it is new."""
        known = self.cover(tokens)
        if known is not None:
            return known, None
        minted = tokens
        if self.used:
            x = np.array([self.numbers.get(t, -1) for t in tokens], np.int32)
            held = self.rows[: self.used]
            same = ((held == x) | (held == 0)).sum(axis=1)
            best = int(same.argmax())
            if same[best] > 0 and same[best] / len(x) >= threshold:
                minted = [t if a == b else WILD for t, a, b in zip(tokens, x, held[best])]
        self.add(minted, name)
        return name, minted


def _in_order(settle: Callable[[Group, list[str], int], tuple[tuple | None, list[str] | None]]):
    """Streams through sorted groups, in each its templates first, then the bodies that ``settle`` gives a template's name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, None
        for pdf in batches:
            rows, found = [], []
            for i, (*at, text, stored, arrival, known) in enumerate(zip(*(pdf[c].tolist() for c in (*GROUP, "part", "text", "template_id", "arrival", "known")))):
                tokens = text.split(" ")
                if tuple(at) != key:
                    key, group = tuple(at), Group(len(tokens))
                if known:
                    group.add(tokens, (stored, None) if stored else (0, arrival))
                else:
                    rows.append(i)
                    found.append(settle(group, tokens, arrival))
            out = pdf.iloc[rows][[*GROUP, "text", "arrival", "times"]]
            names = [name or (None, None) for name, _ in found]
            yield out.assign(template_id=pd.array([t or None for t, _ in names], "Int64"), mint_id=pd.array([m for _, m in names], "Int64"), tokens=pd.Series([t for _, t in found], index=out.index, dtype=object))

    return run


SETTLED = "project_id long, width int, group_key string, text string, arrival long, times long, template_id long, mint_id long, tokens array<string>"


def _grouped(first: Column) -> Column:
    return F.when(first.rlike("[0-9]"), WILD).otherwise(first).alias("group_key")


def _met(known: DataFrame, bodies: DataFrame, settle: Callable) -> DataFrame:
    """Each body (``part`` of its group) with what ``settle`` makes of it after the templates ``known(GROUP, part, text, template_id, arrival)``."""
    lines = known.select(*GROUP, "part", "text", "template_id", "arrival", F.lit(True).alias("known"), F.lit(0).cast("long").alias("times"))
    rows = bodies.select(*GROUP, "part", "text", F.lit(0).cast("long").alias("template_id"), "arrival", F.lit(False).alias("known"), "times")
    key = [*GROUP, "part"]
    # Stored templates by their number come before minted ones (number 0 here) by their arrival.
    order = [F.desc("known"), F.col("template_id") == 0, "template_id", "arrival"]
    return lines.unionByName(rows).repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(_in_order(settle), SETTLED)


def _settled(bodies: DataFrame, seeds: DataFrame, threshold: float, in_order: int) -> DataFrame:
    """Every body with its template: a stored one by ``template_id``, or one minted here by ``mint_id``, the arrival of its first body, which holds its ``tokens``."""
    resolve = lambda group, tokens, arrival: group.resolve(tokens, (0, arrival), threshold)
    cover = lambda group, tokens, arrival: (group.cover(tokens), None)
    one = F.lit(0).alias("part")
    done, known, new = [], seeds, seeds
    while True:
        ids = min(SLICE, in_order)
        sliced = bodies.groupBy(*GROUP, F.floor(F.col("arrival") / ids).alias("slice")).agg(F.count("*").alias("n"))
        whole = Window.partitionBy(*GROUP)
        counted = sliced.withColumns({"all": F.sum("n").over(whole), "upto": F.sum("n").over(whole.orderBy("slice")), "least": F.min("slice").over(whole)})
        # Groups too large for one task, of which there are fewer than bodies / in_order: how far their first bodies go.
        near = (F.col("upto") <= in_order) | (F.col("slice") == F.col("least"))
        large = counted.where(F.col("all") > in_order).groupBy(*GROUP).agg(F.max(F.when(near, F.col("slice"))).alias("last"), F.max("all").alias("all")).select(*GROUP, (F.col("last") + 1) * ids, F.ceil(F.col("all") / TOGETHER)).toDF(*GROUP, "end", "parts")
        large = kept(large)
        if large.isEmpty():
            return _union([*done, _met(known.withColumn("part", one), bodies.withColumn("part", one), resolve)])
        marked = bodies.join(F.broadcast(large), GROUP, "left")
        later = F.coalesce(F.col("arrival") >= F.col("end"), F.lit(False))
        first = kept(_met(known.withColumn("part", one), marked.where(~later).withColumn("part", one), resolve))
        minted = first.where("tokens is not null").select(*GROUP, F.array_join("tokens", " ").alias("text"), F.lit(0).cast("long").alias("template_id"), "arrival")
        part = F.pmod(F.xxhash64("text"), F.col("parts")).cast("int").alias("part")
        copies = new.unionByName(minted).join(F.broadcast(large), GROUP).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
        rest = kept(_met(copies, marked.where(later).withColumn("part", part), cover))
        done += [first, rest.where("template_id is not null or mint_id is not null")]
        bodies = rest.where("template_id is null and mint_id is null").select(*GROUP, "text", "arrival", "times")
        known, new, in_order = known.unionByName(minted), minted.limit(0), in_order * MORE


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mine_templates(logs: DataFrame, threshold: float = THRESHOLD, cap: int = CAP, stored: DataFrame | None = None, in_order: int = IN_ORDER) -> tuple[DataFrame, DataFrame]:
    """``(templates, encoded)``.

    ``templates(project_id, template_id, tokens, first_log_id)``: the new ones, numbered by arrival in
    each project after those of ``stored`` (such a table, or none), from 1 on; a project has at most
    ``cap`` of both. A wildcard is a NUL token.
    ``encoded(log_id, project_id, template_id, vars, raw)``: template 0 keeps the raw body (empty,
    null or several lines, too many tokens, or a template beyond the cap).

    Records of ``logs`` arrive in order of ``log_id``, after all that the stored templates come
    from: mining batches in turn gives what mining them together gives. Only distinct bodies
    are mined. A group of more than ``in_order`` of them is mined in rounds.
    """
    bodies = logs.where(templatable(F.col("body"))).groupBy("project_id", F.col("body").alias("text")).agg(F.min("log_id").alias("arrival"), F.count("*").alias("times"))
    keyed = bodies.select("project_id", F.size(F.split("text", " ")).alias("width"), _grouped(F.substring_index("text", " ", 1)), "text", "arrival", "times")
    stored = logs.sparkSession.createDataFrame([], TEMPLATES) if stored is None else stored.select("project_id", "template_id", "tokens", "first_log_id")
    seeds = stored.select("project_id", F.size("tokens").alias("width"), _grouped(F.get("tokens", F.lit(0))), F.array_join("tokens", " ").alias("text"), "template_id", F.col("first_log_id").alias("arrival"))
    settled = kept(_settled(kept(keyed), seeds, threshold, in_order))
    place = Window.partitionBy("project_id").orderBy("mint_id")
    numbered = settled.where("tokens is not null").select("project_id", "tokens", "mint_id").withColumn("place", F.row_number().over(place))
    held = stored.groupBy("project_id").agg(F.count("*").alias("held"), F.max("template_id").alias("last"))
    after = numbered.join(F.broadcast(held), "project_id", "left").where(F.col("place") + F.coalesce("held", F.lit(0)) <= cap)
    templates = kept(after.select("project_id", (F.col("place") + F.coalesce("last", F.lit(0))).cast("long").alias("template_id"), "tokens", F.col("mint_id").alias("first_log_id")))
    by_mint = settled.where("mint_id is not null").join(templates.select("project_id", F.col("first_log_id").alias("mint_id"), F.col("template_id").alias("id"), F.col("tokens").alias("of")), ["project_id", "mint_id"])
    by_number = settled.where("mint_id is null").join(stored.select("project_id", "template_id", F.col("tokens").alias("of")), ["project_id", "template_id"]).withColumn("id", F.col("template_id"))
    known = _union([x.select("project_id", F.col("text").alias("body"), "times", F.col("id").alias("template_id"), variables(F.col("of"), F.split("text", " ")).alias("vars")) for x in (by_mint, by_number)])
    found = _joined(logs.select("log_id", "project_id", "body"), known)
    encoded = found.select("log_id", "project_id", F.coalesce("template_id", F.lit(0)).cast("long").alias("template_id"), F.coalesce("vars", F.array().cast("array<string>")).alias("vars"), F.when(F.col("template_id").isNull(), F.col("body")).alias("raw"))
    return templates, encoded


def _joined(logs: DataFrame, known: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``logs`` left-joined with ``known`` by body; bodies of more than ``hot_rows`` records, which are few, are dealt to many tasks."""
    hot = F.broadcast(known.where(F.col("times") > hot_rows).select("project_id", "body", F.lit(SALTS).alias("salts")))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.col("log_id"), F.lit(SALTS))).cast("int")
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("times") > hot_rows, SALTS - 1).otherwise(0)))).drop("times")
    return logs.join(hot, ["project_id", "body"], "left").withColumn("salt", salt).drop("salts").join(copies, ["project_id", "body", "salt"], "left")


def stored_templates(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The templates of all batches under ``path`` (of batches before ``before``)."""
    if not exists(spark, f"{path}/templates"):
        return spark.createDataFrame([], TEMPLATES)
    read = spark.read.schema(TEMPLATES + ", epoch long").parquet(f"{path}/templates")
    return (read if before is None else read.where(F.col("epoch") < before)).drop("epoch")


def encoded_logs(spark: SparkSession, path: str) -> DataFrame:
    """The encoded records of all batches under ``path``, without one that is still being mined."""
    mined = epochs(spark, f"{path}/templates")
    if not mined:
        return spark.createDataFrame([], ENCODED)
    return spark.read.schema(ENCODED + ", epoch long").parquet(f"{path}/encoded").where(F.col("epoch") <= max(mined)).drop("epoch")


def append_templates(logs: DataFrame, path: str, epoch: int, threshold: float = THRESHOLD, cap: int = CAP) -> None:
    """Mines one batch after those before it and keeps its new templates and encoded records in folders of its own, ``epoch=<number>``.

    A batch that is written again (after a failure) takes the place of its first attempt and
    gives the same rows, as it starts from the batches before it alone. The templates are
    written last: a batch without them counts as not mined.
    """
    new, encoded = mine_templates(logs, threshold, cap, stored_templates(logs.sparkSession, path, before=epoch))
    # Rows of a template lie together, so that a file's statistics tell which templates it holds.
    together = encoded.hint("rebalance", F.col("project_id"), F.col("template_id")).sortWithinPartitions("project_id", "template_id", "log_id")
    together.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/encoded/epoch={epoch}")
    new.write.mode("overwrite").parquet(f"{path}/templates/epoch={epoch}")


def mine_stream(path: str, threshold: float = THRESHOLD, cap: int = CAP) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that mines a stream of logs batch by batch under ``path``."""
    return lambda batch, epoch: append_templates(batch, path, epoch, threshold, cap)


def variables(tokens: Column, words: Column) -> Column:
    """The words at the wildcards."""
    pairs = F.filter(F.zip_with(tokens, words, lambda t, w: F.struct(t.alias("t"), w.alias("w"))), lambda p: p["t"] == WILD)
    return F.transform(pairs, lambda p: p["w"])


def filled(tokens: Column, values: Column) -> Column:
    """The text of a template with its variables; null if their number differs."""
    wild = F.transform(tokens, lambda t: (t == WILD).cast("int"))
    nth = lambda i: F.aggregate(F.slice(wild, 1, i + 1), F.lit(0), lambda a, b: a + b)
    text = F.array_join(F.transform(tokens, lambda t, i: F.when(t == WILD, F.get(values, nth(i) - 1)).otherwise(t)), " ")
    return F.when(F.size(F.filter(tokens, lambda t: t == WILD)) == F.size(values), text)


def _with_tokens(encoded: DataFrame, templates: DataFrame) -> DataFrame:
    return encoded.join(templates.select("project_id", "template_id", "tokens"), ["project_id", "template_id"], "left")


def reconstruct(encoded: DataFrame, templates: DataFrame) -> DataFrame:
    """``(log_id, project_id, body)``; null where the template is missing or doesn't fit its variables."""
    return _with_tokens(encoded, templates).select("log_id", "project_id", F.when(F.col("template_id") == 0, F.col("raw")).otherwise(filled(F.col("tokens"), F.col("vars"))).alias("body"))


def templates_containing(templates: DataFrame, query: str) -> DataFrame:
    """``(project_id, template_id)`` of templates every text of which holds ``query``: it lies between two wildcards. None for an empty query."""
    runs = F.split(F.array_join("tokens", " "), WILD)
    return templates.where(F.lit(query != "") & F.exists(runs, lambda r: F.contains(r, F.lit(query)))).select("project_id", "template_id")


def templates_that_may_hold(templates: DataFrame, query: str) -> DataFrame:
    """``(project_id, template_id, sure)`` of templates some text of which may hold ``query``; ``sure`` if every one does.

    A wildcard stands for one token, without spaces. So a query of several tokens has to lie along a template's tokens: its
    first ends one, its last begins one, and those between are whole, each equal to the template's or at a wildcard.
    """
    parts = query.split(" ")
    at = lambda i, k: F.get("tokens", i + k)
    fits = lambda i: [
        F.coalesce((at(i, k) == WILD) | (F.endswith(at(i, k), F.lit(part)) if k == 0 else F.startswith(at(i, k), F.lit(part)) if k == len(parts) - 1 else at(i, k) == part), F.lit(False))
        for k, part in enumerate(parts)
    ]
    one = F.exists("tokens", lambda t: (t == WILD) | F.contains(t, F.lit(query)))

    def along(i: Column) -> Column:
        out = F.lit(True)
        for condition in fits(i):
            out = out & condition
        return out

    may = one if len(parts) == 1 else F.exists(F.transform("tokens", lambda t, i: along(i)), lambda x: x)
    sure = templates_containing(templates, query).withColumn("sure", F.lit(True))
    found = templates.where(may).select("project_id", "template_id").join(sure, ["project_id", "template_id"], "left")
    return found.select("project_id", "template_id", F.coalesce("sure", F.lit(False)).alias("sure"))


def search_stored(spark: SparkSession, path: str, query: str, project: int = 0) -> DataFrame:
    """``(log_id, project_id)`` of the stored records under ``path`` whose body holds ``query``, as :func:`search_encoded` finds them.

    Templates that can't hold it are left out by a filter on the template numbers, which skips the row groups
    and files that hold none of the others; where too many are left, all are read. Records of
    templates that always hold it are not put together.
    """
    known, rows = kept(stored_templates(spark, path)), encoded_logs(spark, path)
    if project:
        known, rows = known.where(F.col("project_id") == project), rows.where(F.col("project_id") == project)
    may = kept(templates_that_may_hold(known, query))
    listed = may.select("template_id").distinct().limit(MAX_LISTED + 1).collect()
    if len(listed) <= MAX_LISTED:
        rows = rows.where(F.col("template_id").isin(0, *(r["template_id"] for r in listed)))
    raw = rows.where(F.col("template_id") == 0).where(F.contains("raw", F.lit(query))).select("log_id", "project_id")
    wanted = rows.join(F.broadcast(may.join(known, ["project_id", "template_id"]).select("project_id", "template_id", "sure", "tokens")), ["project_id", "template_id"])
    return wanted.where(F.col("sure") | F.contains(filled(F.col("tokens"), F.col("vars")), F.lit(query))).select("log_id", "project_id").unionByName(raw)


def search_encoded(encoded: DataFrame, templates: DataFrame, query: str) -> DataFrame:
    """``(log_id, project_id)`` whose body holds ``query``; rows of templates that always do are not reconstructed."""
    sure = templates_containing(templates, query).withColumn("sure", F.lit(True))
    rows = _with_tokens(encoded, templates).join(sure, ["project_id", "template_id"], "left")
    body = F.when(F.col("template_id") == 0, F.col("raw")).otherwise(filled(F.col("tokens"), F.col("vars")))
    return rows.where(F.coalesce("sure", F.lit(False)) | F.contains(body, F.lit(query))).select("log_id", "project_id")


def template_report(encoded: DataFrame, templates: DataFrame) -> DataFrame:
    """One row: templates, rows, rows kept raw, share of rows with a template in percent, bytes of variables and raw bodies."""
    size = F.coalesce(F.aggregate("vars", F.lit(0), lambda a, v: a + F.octet_length(v)), F.lit(0))
    rows = encoded.agg(F.count("*").alias("rows"), F.coalesce(F.count_if(F.col("template_id") == 0), F.lit(0)).alias("raw_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("variable_bytes"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("raw_bytes"))
    minted = templates.agg(F.count("*").alias("templates"))
    both = rows.withColumn("one", F.lit(1)).join(minted.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("templated_pct", F.when(F.col("rows") > 0, 100.0 * (F.col("rows") - F.col("raw_rows")) / F.col("rows")).otherwise(0.0))
