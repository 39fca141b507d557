"""URL filters: written rules first, then a tree of path templates learnt per host.

A url's path becomes a template segment by segment. Segments that vary by nature (numbers,
long hexadecimal strings, dates; an ending such as ``.html`` stays) turn into wildcards at
once. Level by level, to the depth the urls have, a segment that too few urls of its parent
share is a wildcard as well. Then, from the deepest level up, branches of one parent that
are alike below and whose labelled shares do not differ significantly are merged. A
template is rejected if its smoothed labelled purity falls short of that of all labelled
pages by the given ratio.

Urls are counted by host and segments first. A host whose different paths are few is grown and
merged by one task, to any depth; a larger one is split level by level, by aggregation and joins, until
its branches are few enough, and merged again above them. The pages are joined once with the table of templates.
"""

from __future__ import annotations

import collections
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import checkpointed

#: Urls that share a segment, at least, for it to stay.
MIN_SUPPORT = 5
#: Pseudo-counts of labels by which purity leans to that of all labels.
PRIOR_WEIGHT = 10.0
#: Templates are rejected whose smoothed purity is below this part of the share of good pages among all labelled ones.
MIN_PURITY = 0.8
#: Standard errors within which branches count as alike.
ALIKE_Z = 1.96

WILD = "*"
#: Different paths of a branch that one task grows and merges: a part of all, between these bounds.
BRANCH_PART, LEAST_BRANCH, MOST_BRANCH = 1 / 500, 256, 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    after = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct ``(rule, verdict)`` of the longest fitting rule, null if none fits. A rule ``(verdict, host, path)`` fits its host and all subdomains, if the path starts with its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _generalised(segment: Column) -> Column:
    stem, ending = F.regexp_extract(segment, r"(?s)\A(.*?)(\.[A-Za-z0-9]{1,5})?\z", 1), F.regexp_extract(segment, r"(?s)\A(.*?)(\.[A-Za-z0-9]{1,5})?\z", 2)
    varies = stem.rlike(r"\A[0-9]+([-_.][0-9]+)*\z") | stem.rlike(r"\A[0-9a-fA-F-]{16,}\z") | stem.rlike(r"[0-9]{5,}")
    return F.when(varies, F.concat(F.lit(WILD), ending)).otherwise(segment)


def lexical_segments(path: Column) -> Column:
    """The path's segments, those that vary by nature as wildcards; a final slash is not a segment."""
    split = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(split, _generalised)


def _clusters(labelled: np.ndarray, good: np.ndarray, siblings: np.ndarray, prior: float) -> np.ndarray:
    """The cluster of each distinct pair of counts, numbered from the best share down: neighbours by share are joined, the likest first, while they do not differ significantly."""
    n, g = (labelled * siblings).astype(float), (good * siblings).astype(float)
    order = np.argsort(-(good + 2 * prior) / (labelled + 2), kind="stable")
    held = [[n[i], g[i], [i]] for i in order]

    def apart(a: list, b: list) -> float:
        if not a[0] or not b[0]:
            return 0.0  # nothing is known that sets them apart
        share, rest, pooled = (a[1] + 1) / (a[0] + 2), (b[1] + 1) / (b[0] + 2), (a[1] + b[1] + 1) / (a[0] + b[0] + 2)
        return abs(share - rest) / np.sqrt(pooled * (1 - pooled) * (1 / (a[0] + 1) + 1 / (b[0] + 1)))

    gaps = [apart(a, b) for a, b in zip(held, held[1:])]
    while gaps and (z := min(gaps)) <= ALIKE_Z:
        k = gaps.index(z)
        a, b = held[k], held.pop(k + 1)
        held[k] = [a[0] + b[0], a[1] + b[1], a[2] + b[2]]
        gaps.pop(k)
        for i in (k - 1, k):
            if 0 <= i < len(gaps):
                gaps[i] = apart(held[i], held[i + 1])
    out = np.empty(len(n), np.int64)
    for number, (*_, members) in enumerate(held):
        out[members] = number
    return out


def _grown(segments: list[list[str]], urls: list[int], start: int) -> list[list[str]]:
    """What the paths of one branch become from level ``start`` on: a segment that too few urls of its parent share is a wildcard."""
    out: list[list[str]] = [[] for _ in segments]
    parent, names = [0] * len(segments), itertools.count(1)
    level, here = start, [i for i, s in enumerate(segments) if len(s) > start]
    while here:
        support: dict[tuple[int, str], int] = collections.defaultdict(int)
        for i in here:
            support[parent[i], segments[i][level]] += urls[i]
        known: dict[tuple[int, str], int] = {}
        for i in here:
            segment = segments[i][level]
            kept = segment if support[parent[i], segment] >= MIN_SUPPORT else WILD
            out[i].append(kept)
            if (parent[i], kept) not in known:
                known[parent[i], kept] = next(names)
            parent[i] = known[parent[i], kept]
        level += 1
        here = [i for i in here if len(segments[i]) > level]
    return out


def _pools(labelled: np.ndarray, good: np.ndarray, siblings: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each distinct pair of counts among siblings (in order of the counts), and whether several are in it."""
    cluster = _clusters(labelled, good, siblings, prior)
    return cluster, np.bincount(cluster, siblings)[cluster] > 1


def _pool_name(cluster: int) -> str:
    return WILD if not cluster else f"{WILD}{cluster + 1}"


def _merged(templates: list[tuple[str, ...]], labelled: list[int], good: list[int], prior: float) -> dict[tuple[str, ...], tuple[str, ...]]:
    """Each template of one branch with what it is merged to, from the deepest level up to the branch's own."""
    counts: dict[tuple[str, ...], list[int]] = {}
    for t, n, g in zip(templates, labelled, good):
        held = counts.setdefault(t, [0, 0])
        held[0], held[1] = held[0] + n, held[1] + g
    names = {t: t for t in counts}
    for level in reversed(range(max(map(len, counts), default=0))):
        shapes: dict[tuple[str, ...], list[tuple[str, ...]]] = collections.defaultdict(list)
        for m in counts:
            if len(m) > level:
                shapes[m[:level] + (WILD,) + m[level + 1 :]].append(m)
        renamed: dict[tuple[str, ...], tuple[str, ...]] = {}
        for members in shapes.values():
            pairs = collections.Counter(tuple(counts[m]) for m in members)
            order = sorted(pairs)
            cluster, many = _pools(*(np.array(x, np.int64) for x in zip(*order)), np.array([pairs[p] for p in order], np.int64), prior)
            place = {p: k for k, p in enumerate(order)}
            for m in members:
                k = place[tuple(counts[m])]
                if many[k] or m[level] == WILD:
                    renamed[m] = m[:level] + (_pool_name(int(cluster[k])),) + m[level + 1 :]
        pooled: dict[tuple[str, ...], list[int]] = {}
        for m, (n, g) in counts.items():
            held = pooled.setdefault(renamed.get(m, m), [0, 0])
            held[0], held[1] = held[0] + n, held[1] + g
        names, counts = {t: renamed.get(m, m) for t, m in names.items()}, pooled
    return names


def _branch(prior: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Grows and merges one branch: all paths of a host with one beginning."""
        prefix, segments = tuple(pdf["template"].iloc[0]), [list(s) for s in pdf["segments"]]
        grown = [tuple(t) for t in _grown(segments, pdf["urls"].tolist(), len(prefix))]
        names = _merged(grown, pdf["labelled"].tolist(), pdf["good"].tolist(), prior)
        out = pdf[["host", "segments", "urls", "labelled", "good"]]
        return out.assign(template=[[*prefix, *t] for t in grown], merged=[[*prefix, *names[t]] for t in grown], top=len(prefix))

    return run


def _merged_at(leaves: DataFrame, level: int, prior: float) -> DataFrame:
    """``leaves`` with siblings that differ only at ``level`` of ``merged`` pooled by cluster, where their branch begins below (``top``). Pools after the first of a parent are named ``*2``, ``*3`` and so on; siblings alone in theirs keep their name.

    Siblings of equal counts are always of one cluster, so a parent sends one row for each distinct pair of counts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["labelled", "good"]).reset_index(drop=True)
        cluster, many = _pools(pdf["labelled"].to_numpy(), pdf["good"].to_numpy(), pdf["siblings"].to_numpy(), prior)
        return pdf[["host", "shape", "labelled", "good"]].assign(cluster=cluster, many=many)

    segment = F.get("merged", F.lit(level))
    inside = segment.isNotNull() & (F.col("top") > level)
    here, above = leaves.where(inside), leaves.where(~inside)
    shape = F.transform("merged", lambda s, i: F.when(i == level, F.lit(WILD)).otherwise(s))
    branches = here.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good")).withColumn("shape", shape)
    counts = branches.groupBy("host", "shape", "labelled", "good").agg(F.count("*").alias("siblings"))
    found = counts.groupBy("host", "shape").applyInPandas(run, "host string, shape array<string>, labelled long, good long, cluster long, many boolean")
    name = F.when(F.col("cluster") == 0, F.lit(WILD)).otherwise(F.concat(F.lit(WILD), (F.col("cluster") + 1).cast("string")))
    pool = F.transform("merged", lambda s, i: F.when((i == level) & (F.col("many") | (s == WILD)), name).otherwise(s))
    named = branches.join(found, ["host", "shape", "labelled", "good"]).select("host", "merged", pool.alias("pool"))
    return here.join(named, ["host", "merged"]).withColumn("merged", F.col("pool")).select(*leaves.columns).unionByName(above)


TREE = "host string, segments array<string>, urls long, labelled long, good long, template array<string>, merged array<string>, top int"


def _tree(counted: DataFrame, prior: float, most: int) -> DataFrame:
    """``counted`` with each path's ``template``, what it is ``merged`` to from level ``top`` on: branches of more than ``most`` paths are split until they are small enough."""
    growing, done, level = counted.withColumn("template", F.array().cast("array<string>")), [], 0
    while True:
        sizes = growing.groupBy("host", "template").agg(F.count("*").alias("paths"))
        large = checkpointed(sizes.where(F.col("paths") > most).select("host", "template"))  # fewer than paths / most
        if large.isEmpty():
            done.append(growing.groupBy("host", "template").applyInPandas(_branch(prior), TREE))
            break
        large = F.broadcast(large)
        small_ = growing.join(large, ["host", "template"], "left_anti")
        done.append(small_.groupBy("host", "template").applyInPandas(_branch(prior), TREE))
        split = growing.join(large, ["host", "template"], "left_semi")
        segment = F.get(F.col("segments"), F.lit(level)).alias("child")
        rare = split.groupBy("host", "template", segment).agg(F.sum("urls").alias("support")).where(F.col("support") >= MIN_SUPPORT).select("host", "template", "child", F.lit(True).alias("stays"))
        named = split.withColumn("child", segment).join(rare, ["host", "template", "child"], "left")
        kept = F.when(F.coalesce("stays", F.lit(False)), F.col("child")).otherwise(F.lit(WILD))
        grown = checkpointed(named.withColumn("template", F.concat("template", F.array(kept))).drop("child", "stays"))
        level += 1
        ended = F.size("segments") <= level
        done.append(grown.where(ended).select("*", F.col("template").alias("merged"), F.lit(level).alias("top")))
        growing = grown.where(~ended)
    out = done[0].select(*(c.split()[0] for c in TREE.split(", ")))
    for part in done[1:]:
        out = out.unionByName(part)
    return checkpointed(out)


def learn_templates(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``(host, segments, template, urls, labelled, good, purity, rejected)`` for every host and lexical template.

    ``labels`` marks pages as good (1) or not (0) by id; of several labels of an id the
    smallest counts, and unlabelled pages only give support. Purity is that of the merged
    template, smoothed toward the share of good pages among all labelled ones, and a template
    is ``rejected`` below ``MIN_PURITY`` times that share. Urls of any length and depth count
    whole, repeated rows each; without labels nothing is rejected, and an empty table gives no
    rows. Other columns are not read.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label_key).alias("key")).agg(F.min(label).alias("good"))
    read = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), lexical_segments(path_of(F.col(url))).alias("segments"))
    known = read.join(marks, "key", "left")
    counted = checkpointed(known.groupBy("host", "segments").agg(F.count("*").alias("urls"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")))

    overall = counted.agg(((F.sum("good") + 1) / (F.sum("labelled") + 1)).alias("prior"), F.count("*").alias("paths")).head()
    prior = float(overall["prior"]) if overall["prior"] is not None else 1.0
    # The root, a path without segments, is a branch of its own and has nothing to grow.
    rooted = F.size("segments") == 0
    root = counted.where(rooted).select("*", F.array().cast("array<string>").alias("template"), F.array().cast("array<string>").alias("merged"), F.lit(0).alias("top"))
    tree = _tree(counted.where(~rooted), prior, int(min(MOST_BRANCH, max(LEAST_BRANCH, overall["paths"] * BRANCH_PART)))).unionByName(root)
    leaves = tree.groupBy("host", "template", "merged", "top").agg(F.sum("urls").alias("urls"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    split = tree.agg(F.max("top").alias("top")).head()["top"] or 0
    for level in reversed(range(split)):
        leaves = checkpointed(_merged_at(leaves, level, prior))
    totals = leaves.groupBy("host", "merged").agg(F.sum("urls").alias("urls"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    purity = (F.col("good") + PRIOR_WEIGHT * F.lit(prior)) / (F.col("labelled") + PRIOR_WEIGHT)
    judged = totals.withColumn("purity", purity).withColumn("rejected", F.col("purity") < MIN_PURITY * prior)
    merged = leaves.select("host", "template", "merged").join(judged, ["host", "merged"])
    out = tree.select("host", "segments", "template").join(merged, ["host", "template"])
    return checkpointed(out.select("host", "segments", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "urls", "labelled", "good", "purity", "rejected"))


def judge(pages: DataFrame, templates: DataFrame, rules: Sequence[tuple[str, str, str]] = (), key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, ``rule`` (host and path of the deciding rule, else null), ``template``, ``purity`` and ``verdict`` (allow or block).

    A rule decides where one fits; else a rejected template blocks and all else is allowed.
    Null urls and urls without ``://`` have an empty host and path and are judged like any
    other host. Urls of any length are judged whole, repeated rows each; an empty table gives
    no rows, and other columns are not read.
    """
    read = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("segments", lexical_segments(F.col("path")))
    found = read.withColumn("ruled", rule_for(F.col("host"), F.col("path"), rules)).join(templates.select("host", "segments", "template", "purity", "rejected"), ["host", "segments"], "left")
    by_method = F.when(F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return found.select(F.col("key").alias(key), "host", "path", F.col("ruled.rule").alias("rule"), "template", "purity", F.coalesce("ruled.verdict", by_method).alias("verdict"))
