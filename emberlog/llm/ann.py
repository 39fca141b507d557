"""Approximate nearest neighbours: NN-descent builds the graph, greedy search answers queries.

Equal vectors are one node. The graph starts from exact neighbours inside small chunks of
vectors that random projections put side by side; then, round by round, a node's
neighbours and the nearest of those it is a neighbour of are compared with each other, and
each keeps the nearest it meets (neighbours of neighbours, by Spark joins). Only pairs with
a neighbour that is new since the last round are compared. Nodes are dealt to blocks in
order of a projection, and a round sends every vector once to each block that needs it,
however many neighbourhoods of the block it is in. Rounds end when few neighbour lists
still change.

A query starts at the node of its own vector and follows the graph: its nearest unvisited
candidates are expanded, their neighbours measured, the nearest kept, until no query has
a candidate left that is not expanded. Equal queries are searched once.

Nothing is collected: neighbour lists and beams have a fixed length, and vectors travel
packed, centred and scaled as 32-bit floats. Final scores are Euclidean distances in
double precision on the given vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import checkpointed, skew_join, stored

#: Neighbours of a node in the graph, and of nodes it is a neighbour of those that take part.
DEGREE, REVERSE = 24, 16
#: Projection orders the graph starts from, and vectors compared in a chunk of one.
ORDERS, CHUNK = 4, 1_000
#: Nodes of a block.
BLOCK = 4_096
#: Rounds of NN-descent, at most, and the share of changed entries that ends them.
ROUNDS, SETTLED = 8, 0.02
#: Nearest of a pair of neighbours sent on by each local join.
OFFERS = 10
#: Candidates a query keeps, and candidates it expands in a round.
BEAM, EXPAND = 160, 40
#: Narrow rows that a round of NN-descent or of the search broadcasts, at most; more are shuffled.
BROADCAST = 300_000

_NEAR = "array<struct<d:double,id:long>>"


def usable(vector: Column) -> Column:
    """Not null, of one component at least, all of them finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _centre(rows: DataFrame, vector: str) -> tuple[np.ndarray, float]:
    """The mean of the vectors and a scale that brings their components near 1: two numbers a component reach the driver."""
    parts = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.max(F.abs("x")).alias("most"), F.count("*").alias("n"))
    most = {r["pos"]: r["most"] for r in parts.collect()}
    scale = max(most.values(), default=1.0)
    means = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x") / F.lit(scale)).alias("mean")).collect()
    return np.array([r["mean"] for r in sorted(means, key=lambda r: r["pos"])]), scale


def _packed(vector: Column, mean: np.ndarray, scale: float) -> Column:
    """Little-endian 32-bit floats of the centred and scaled vector."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: (np.asarray(v, float) / scale - mean).astype("<f4").tobytes())

    return pack(vector)


def _matrix(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f4").reshape(len(packed), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def _direct(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to rows of ``y``: the same bits for a pair wherever it is met, so that repeated entries of a list are equal."""
    return np.square(x.astype(float) - y).sum(axis=-1)


def _chunk_neighbours(degree: int, chunk: int):
    """Exact neighbours within runs of ``chunk`` vectors of a range, in partitions sorted by range; runs overlap by half."""

    def nearest(ids: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
        d = _squared(vectors, vectors)
        np.fill_diagonal(d, np.inf)
        k = min(degree, len(ids) - 1)
        at = np.argpartition(d, k - 1, axis=1)[:, :k] if 0 < k < len(ids) - 1 else np.argsort(d, axis=1)[:, :k]
        return pd.DataFrame({"id": ids, "near": [list(zip(a, b)) for a, b in zip(_direct(vectors[:, None, :], vectors[at]).tolist(), ids[at].tolist())]})

    def run(batches):
        current, ids, vectors = None, np.empty(0, np.int64), []
        for pdf in batches:
            for at, part in pdf.groupby("range"):
                if at != current:
                    if len(ids) > 1:
                        yield nearest(ids, _matrix(vectors))
                    current, ids, vectors = at, np.empty(0, np.int64), []
                ids, vectors = np.concatenate([ids, part["id"].to_numpy()]), vectors + part["v"].tolist()
                while len(ids) >= 2 * chunk:
                    yield nearest(ids[:chunk], _matrix(vectors[:chunk]))
                    ids, vectors = ids[chunk // 2 :], vectors[chunk // 2 :]
        if len(ids) > 1:
            yield nearest(ids, _matrix(vectors))

    return run


def _merged(near: DataFrame, degree: int, *more: Column) -> DataFrame:
    """``(id, near)`` and ``more`` aggregates: of all lists of an id the ``degree`` nearest distinct neighbours. Each id has a bounded number of lists."""
    return near.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, degree).alias("near"), *more)


def _project(seed: int, depth: int = 12) -> callable:
    """Column of a sort key that keeps near vectors together: signs of random projections, then a projection."""

    def key(packed: Column) -> Column:
        @F.pandas_udf("double")
        def of(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=float)
            x = _matrix(values.tolist())
            planes = np.random.default_rng(seed).standard_normal((x.shape[1], depth + 1)).astype("f4")
            y = x @ planes
            code = np.zeros(len(x))
            for k in range(depth):
                code = code * 2 + (y[:, k] > 0)
            return pd.Series(code + 0.5 + np.arctan(y[:, depth]) / np.pi)

        return of(packed)

    return key


def _in_ranges(nodes: DataFrame, seed: int, parts: int, name: str) -> DataFrame:
    """``nodes(id, v)`` with their place ``at`` in a projection order and the number ``name`` of one of ``parts`` ranges of it, of about equal size however Spark deals out rows. Only the ranges' bounds reach the driver."""
    # Vectors with one projection are set apart by a hash of their ids, far below the step between codes.
    apart = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 40)
    placed = nodes.withColumn("at", _project(seed)(F.col("v")) + apart)
    if parts == 1:
        return placed.withColumn(name, F.lit(0))
    bounds = placed.approxQuantile("at", [i / parts for i in range(1, parts)], 0.1 / parts)

    @F.pandas_udf("int")
    def number(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at, side="right"))

    return placed.withColumn(name, number("at"))


def in_blocks(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``nodes(id, v)`` with the number of their ``block``: ranges of one projection order, so that neighbours often share one."""
    return stored(_in_ranges(nodes, 0, max(1, -(-nodes.count() // block)), "block").drop("at"))


def start_graph(nodes: DataFrame, degree: int = DEGREE, orders: int = ORDERS, chunk: int = CHUNK) -> DataFrame:
    """A first graph ``(id, near)`` of ``nodes(id, v)``."""
    # A range holds about two chunks, if there are as many vectors: none is left alone, however many partitions there are.
    parts = max(1, nodes.count() // (2 * chunk))
    lists = None
    for seed in range(orders):
        ordered = _in_ranges(nodes, seed, parts, "range").repartition("range").sortWithinPartitions("range", "at", "id").select("range", "id", "v")
        found = ordered.mapInPandas(_chunk_neighbours(degree, chunk), f"id long, near {_NEAR}")
        lists = found if lists is None else lists.union(found)
    return checkpointed(_merged(lists, degree))


def _local_join(offers: int, degree: int):
    """Compares the members of each neighbourhood of a block with each other; a member is offered the nearest it meets, if nearer than the last of its list."""

    def run(hoods: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("id")
        ids, x, worst = vectors["id"].to_numpy(), _matrix(vectors["v"].tolist()), vectors["worst"].to_numpy()
        # A neighbourhood's own node is one of its members; what it knows already is not new.
        centers = hoods["center"].unique()
        table = np.stack([np.concatenate([hoods["center"], centers]), np.searchsorted(ids, np.concatenate([hoods["id"], centers])), np.concatenate([hoods["fresh"].astype(int), np.zeros(len(centers), int)])])
        table = table[:, np.lexsort((-table[2], table[1], table[0]))]
        first = np.ones(table.shape[1], bool)
        first[1:] = (table[:2, 1:] != table[:2, :-1]).any(axis=0)
        table = table[:, first]
        cuts = np.concatenate([[0], np.flatnonzero(table[0, 1:] != table[0, :-1]) + 1, [table.shape[1]]])
        pairs = []
        for a, b in zip(cuts, cuts[1:]):
            at, fresh = table[1, a:b], table[2, a:b].astype(bool)
            d = _squared(x[at], x[at])
            d[~(fresh[:, None] | fresh)] = np.inf
            np.fill_diagonal(d, np.inf)
            k = min(offers, len(at) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.empty((len(at), 0), int)
            told = np.isfinite(np.take_along_axis(d, near, axis=1))
            pairs.append((at[:, None] * len(ids) + at[near])[told])
        pairs = np.unique(np.concatenate([*pairs, np.empty(0, np.int64)]))
        one, other = pairs // len(ids), pairs % len(ids)
        far = np.concatenate([_direct(x[one[i : i + 100_000]], x[other[i : i + 100_000]]) for i in range(0, len(one), 100_000)] or [np.empty(0)])
        keep = far < worst[one]
        one, other, far = one[keep], other[keep], far[keep]
        order = np.lexsort((ids[other], far, one))
        one, other, far = one[order], other[order], far[order]
        starts = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.empty(0, int)
        place = np.arange(len(one)) - np.repeat(starts, np.diff([*starts, len(one)]))
        keep = place < degree
        return pd.DataFrame({"id": ids[one[keep]], "d": far[keep], "other": ids[other[keep]]})

    return run


def _edges(graph: DataFrame, reverse: int = REVERSE) -> DataFrame:
    """``(center, id, fresh)``: each node's neighbours, and the nearest ``reverse`` nodes it is a neighbour of; ``graph(id, near, fresh)`` marks new neighbours."""
    forward = graph.select(F.col("id").alias("center"), F.explode(F.arrays_zip("near", "fresh")).alias("e")).select("center", F.col("e.near.id").alias("id"), F.col("e.near.d").alias("d"), F.col("e.fresh").alias("fresh"))
    place = Window.partitionBy("center").orderBy("d", "id")
    backward = forward.select(F.col("id").alias("center"), F.col("center").alias("id"), "d", "fresh").withColumn("r", F.row_number().over(place)).where(F.col("r") <= reverse)
    return forward.select("center", "id", "fresh").union(backward.select("center", "id", "fresh"))


def descend(nodes: DataFrame, graph: DataFrame, degree: int = DEGREE, offers: int = OFFERS, few: bool = False) -> DataFrame:
    """One round of NN-descent over ``nodes(id, v, block)`` and ``graph(id, near, fresh)``: the graph with the nearest of what neighbours of neighbours offer. ``few``: a row for each node may be broadcast."""
    sent = F.broadcast if few else lambda df: df
    edges = _edges(graph).withColumn("active", F.max("fresh").over(Window.partitionBy("center"))).where("active").drop("active")
    hoods = checkpointed(edges.join(sent(nodes.select(F.col("id").alias("center"), "block")), "center"))
    needed = hoods.select(F.col("block").alias("to"), F.col("id").alias("id")).union(hoods.select("block", "center")).distinct()
    worst = graph.select("id", F.when(F.size("near") < degree, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"]).alias("worst"))
    vectors = needed.join(nodes.select("id", "v").join(sent(worst), "id", "left"), "id").select("to", "id", "v", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    offered = hoods.groupBy("block").cogroup(vectors.groupBy("to")).applyInPandas(_local_join(offers, degree), "id long, d double, other long")
    none = F.lit(None).cast("array<long>")
    lists = offered.select("id", F.array(F.struct("d", F.col("other").alias("id"))).cast(_NEAR).alias("near"), none.alias("before")).union(graph.select("id", "near", F.col("near.id")))
    fresh = F.transform("near", lambda e: ~F.array_contains(F.coalesce("before", F.array().cast("array<long>")), e["id"]))
    return checkpointed(_merged(lists, degree, F.max("before").alias("before")).select("id", "near", fresh.alias("fresh")))


def build_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """Neighbour graph ``(id, near, fresh)`` of ``nodes(id, v)``: distinct ids, packed vectors of one length."""
    nodes = in_blocks(nodes)
    few = nodes.count() <= BROADCAST
    graph = start_graph(nodes.select("id", "v"), degree).withColumn("fresh", F.transform("near", lambda e: F.lit(True)))
    for _ in range(rounds):
        graph = descend(nodes, graph, degree, few=few)
        changed, total = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("near"))).head()
        if not total or changed <= settled * total:
            break
    return graph


def search(nodes: DataFrame, graph: DataFrame, starts: DataFrame, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """Greedy search from the nodes ``starts(id)``, for their own vectors: ``(query, near)`` with up to ``beam`` candidates each, nearest first."""

    @F.pandas_udf("double")
    def distance(q: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(_direct(_matrix(q.tolist()), _matrix(v.tolist())) if len(q) else [], dtype=float)

    entry = "array<struct<d:double,id:long,done:boolean>>"
    edges = checkpointed(_edges(graph).groupBy("center").agg(F.collect_set("id").alias("next")).withColumnRenamed("center", "id"))
    asked = checkpointed(starts.select(F.col("id").alias("query")).join(nodes.select(F.col("id").alias("query"), F.col("v").alias("q")), "query"))
    # A query's own node and its neighbours in the graph, whose distances are known.
    own = F.array(F.struct(F.lit(0.0).alias("d"), F.col("query").alias("id"), F.lit(False).alias("done"))).cast(entry)
    known = F.transform("first", lambda e: F.struct(e["d"].alias("d"), e["id"].alias("id"), F.lit(False).alias("done")))
    first = graph.select(F.col("id").alias("query"), F.col("near").alias("first"))
    state = checkpointed(asked.select("query").join(first, "query", "left").select("query", F.slice(F.concat(own, F.coalesce(known, F.array().cast(entry))), 1, beam).alias("near")))
    queries = state.count()
    sent = lambda df, each: F.broadcast(df) if queries * each <= BROADCAST else df
    while not state.where(F.exists("near", lambda e: ~e["done"])).isEmpty():
        marked = state.withColumn("now", F.slice(F.filter("near", lambda e: ~e["done"]), 1, expand))
        now = marked.select("query", F.explode("now.id").alias("id"))
        met = edges.join(sent(now, expand), "id").select("query", F.explode("next").alias("id")).groupBy("query").agg(F.collect_set("id").alias("met"))
        fresh = met.join(sent(state, beam), "query").select("query", F.explode(F.array_except("met", "near.id")).alias("id"))
        vectors = nodes.join(sent(fresh, expand * (DEGREE + REVERSE)), "id").join(sent(asked, 16), "query")
        measured = vectors.select("query", F.struct(distance("q", "v").alias("d"), "id", F.lit(False).alias("done")).alias("e")).groupBy("query").agg(F.collect_list("e").alias("more"))
        after = F.transform("near", lambda e: F.struct(e["d"].alias("d"), e["id"].alias("id"), (e["done"] | F.array_contains("now.id", e["id"])).alias("done")))
        union = F.slice(F.array_sort(F.concat(after, F.coalesce("more", F.array().cast(entry)))), 1, beam)
        # What falls out of a full beam is never measured again: it can't be nearer than the beam's last.
        state = checkpointed(marked.join(sent(measured, expand * (DEGREE + REVERSE)), "query", "left").select("query", union.alias("near")))
    return state


def nearest(vectors: DataFrame, queries: Callable[[Column], Column], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose key ``queries`` selects its ``k`` nearest other rows found.

    Nearest first, ties to the smaller id; ``score`` is the Euclidean distance in double
    precision. Rows with a null key, and vectors that are null, empty, zero, or hold a null
    or non-finite component, take no part. Vectors have a distance only to those of their own
    length: every length is searched by itself. Repeated ids with one vector count once; with
    other vectors, only the first (shortest, then smallest) vector of an id takes part. An
    empty table gives no rows; other columns are not read.
    """
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.groupBy("key").agg(F.min(F.struct(F.size("x").alias("n"), "x")).alias("r")).select("key", "r.n", "r.x")
    rows = stored(rows.withColumn("same", F.sha2(F.array_join(F.col("x").cast("array<string>"), " "), 256)))
    lengths = [r["n"] for r in rows.where(queries(F.col("key"))).select("n").distinct().orderBy("n").collect()]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        out = out.unionByName(_nearest(rows.where(F.col("n") == n), queries, k))
    return out


def _nearest(rows: DataFrame, queries: Callable[[Column], Column], k: int) -> DataFrame:
    """:func:`nearest` among ``rows(key, x, same)`` of one length."""
    # Of equal vectors only the k + 1 smallest ids can be in a result: a query's own, and k before any other tie.
    place = Window.partitionBy("same").orderBy("key")
    alike = checkpointed(rows.select("same", "key").withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1))
    mean, scale = _centre(rows, "x")
    first = rows.join(alike.where("r = 1").select("key"), "key", "left_semi")
    nodes = stored(first.select(F.col("key").alias("id"), _packed(F.col("x"), mean, scale).alias("v"), "x", "same"))
    graph = build_graph(nodes.select("id", "v"))
    asked = checkpointed(skew_join(checkpointed(rows.where(queries(F.col("key"))).select("same", F.col("key").alias("query"))), nodes.select("same", "id"), ["same"]).select("query", "id"))
    found = search(nodes.select("id", "v"), graph, asked.select("id").distinct())
    # A node's k + 1 best; a query takes those that are not itself.
    pairs = found.select("query", F.explode("near.id").alias("id"))
    exact = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    scored = pairs.join(nodes.select("id", "same", F.col("x").alias("y")), "id").join(nodes.select(F.col("id").alias("query"), "x"), "query").select(F.col("query").alias("id"), "same", exact.alias("score"))
    members = scored.join(alike.select("same", F.col("key").alias("vec_id")), "same")
    by_node = Window.partitionBy("id").orderBy("score", "vec_id")
    best = members.withColumn("r", F.row_number().over(by_node)).where(F.col("r") <= k + 1).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    taken = skew_join(asked, best, ["id"]).select("query", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query")), 1, k).alias("best"))
    return taken.select(F.col("query").alias("query_id"), F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
