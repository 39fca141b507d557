"""SimHash near-duplicates: fingerprints of whole texts and a tiled exact comparison.

A fingerprint bit is 1 where more than half of the hashes of a text's word shingles have
it set. Equal fingerprints are one node; distinct ones are sorted by the population
counts of their quarters and cut into tiles. Tile pairs are compared in full with numpy
(exclusive-or and bit counts), except pairs whose population counts differ by more than
the radius: each differing bit changes a population count by one, so these can hold no
link. A task gets the tiles of two blocks, and sends on only a spanning forest of the
links it finds, so a group of k near-copies costs k rows and not k squared.

For groups by shingle similarity (:func:`one_of_each_group`) links of a wide radius only
say which texts may belong together: what they connect is a neighbourhood. They are looked
for among texts that share a bond: two shingle hashes that are neighbours among the smallest
of both texts. Sets as alike as asked share one but for a chance of ``MISS`` (small sets always),
others rarely, so this work grows with the texts and not with their pairs. In a neighbourhood the exact
overlaps of all shingle sets are counted, tile against tile as matrix products, inside the
tasks; what leaves a task is again a spanning forest, of verified links, so neither rows nor
disk grow with the pairs that are alike or almost alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import checkpointed, skew_join, stored
from emberlog.llm.components import connected_components

SEED = 42
TILE = 512
#: Most fingerprints in a block (8 to 32 bytes each); a task holds two blocks.
BLOCK = 262_144
#: At least so many blocks, for parallel work on small inputs.
MIN_BLOCKS = 8
#: Links a task gathers before it contracts them.
PENDING = 400_000
#: Pairs of blocks are dealt to so many tasks at most; a task takes its pairs one after another.
PAIR_TASKS = 10_000
#: The chance, at most, that two sets of just the similarity asked for share no bond (64-bit hashes are as likely to clash).
MISS = 1e-16
#: Rows of bonds that are compared at a time; the texts of a bond of more than ``PAIRED`` are first compared with up to ``PIVOTS`` of them.
HELD_ROWS, PAIRED, PIVOTS = 100_000, 64, 16
#: Texts of a bond that one task compares; those of bonds with more are compared block by block, once for all such bonds.
CROWD = 65_536
#: Shingle sets and shingles in a tile of them, on average, at most (beyond one set), and shingles that a product takes at a time.
TILE_SETS, TILE_SHINGLES, COLUMNS = 128, 400_000, 8_192

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle of a text lower-cased in A-Z, repeats included; of the whole word sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits of each hash (the SplitMix64 finaliser at offset ``k``)."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint_of(text: str | None, size: int = 4, words: int = 1) -> bytes:
    """The fingerprint, most significant byte of each 64-bit word first; all zero for a text without words."""
    return _fingerprint(shingle_hashes(text, size), words)


def _fingerprint(hashes: np.ndarray, words: int) -> bytes:
    if not len(hashes):
        return bytes(8 * words)
    parts = hashes[:, None] if words == 1 else np.stack([hashes, *(_mixed(hashes, k) for k in range(1, words))], axis=1)
    bytes_ = np.ascontiguousarray(parts.astype("<u8")).view(np.uint8)
    width = bytes_.shape[1]
    counts = np.zeros(width * 256, np.int64)
    for at in range(0, len(bytes_), 65_536):
        counts += np.bincount((bytes_[at : at + 65_536] + np.arange(0, width * 256, 256)).ravel(), minlength=width * 256)
    ones = counts.reshape(width, 256).astype(np.float64) @ _BITS
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").ravel().view("<u8").astype(">u8").tobytes()


def fingerprint(text: Column, size: int = 4, words: int = 1) -> Column:
    """Binary column of 64 * ``words`` bits; null and empty texts give zero."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py(), size, words) for t in texts], pa.binary())

    return of(text.cast("string"))


def node_of(text: str | None, size: int, words: int, smallest: int) -> tuple[bytes, int, np.ndarray]:
    """The fingerprint of a text's distinct shingles with 64 bits that name their set (texts of one node hold the same shingles), their number, and their bonds."""
    hashes = np.unique(shingle_hashes(text, size))
    return _fingerprint(hashes, words) + xxhash.xxh64_digest(hashes.tobytes()), len(hashes), _bonds(hashes, smallest)


def _bonds(hashes: np.ndarray, smallest: int) -> np.ndarray:
    """64 bits for each two neighbours among the ``smallest`` of sorted hashes; if those are all, the last and the first are neighbours too."""
    if len(hashes) < 2:
        return np.empty(0, np.int64)
    low = hashes[:smallest] if len(hashes) > smallest else np.append(hashes, hashes[0])
    return (_mixed(low[:-1], 1) + low[1:]).view(np.int64)


def smallest_for(similarity: float) -> int:
    """So many of the smallest hashes hold two neighbours in common but for a chance of ``MISS``.

    The smallest hashes of both sets together are in both with a chance of ``similarity`` each; two
    of them in a row that are in both are neighbours in each set. That none of ``n`` are two in a row
    has a chance that falls with the n-th power of the root of x * x = (1 - s) * (x + s).
    """
    apart = 1 - similarity
    root = (apart + np.sqrt(apart * apart + 4 * apart * similarity)) / 2
    return int(np.ceil(np.log(MISS) / np.log(root))) + 1


def radius_for(similarity: float, bits: int, spreads: float) -> int:
    """The differing bits of two shingle sets of a Jaccard similarity: their expected number and so many standard deviations more (or less)."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + spreads * np.sqrt(bits * p * (1 - p)))


def _as_words(packed: list[bytes]) -> np.ndarray:
    """(n, words) of unsigned 64-bit integers."""
    return np.frombuffer(b"".join(packed), ">u8").astype(np.uint64).reshape(len(packed), -1)


def _quarters(fps: np.ndarray) -> np.ndarray:
    """(n, 4): the population counts of the fingerprint's quarters."""
    sixteenths = fps[:, :, None] >> np.arange(48, -1, -16, dtype=np.uint64) & np.uint64(0xFFFF)
    counts = np.bitwise_count(sixteenths).astype(np.int32)
    return counts.reshape(len(fps), 4, -1).sum(axis=2) if fps.shape[1] % 4 == 0 or fps.shape[1] == 1 else counts.sum(axis=1)


def _node(text: Column, size: int, words: int, smallest: int) -> Column:
    @F.arrow_udf("struct<fp: binary, n: int, bonds: array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        fps, n, bonds = zip(*(node_of(t.as_py(), size, words, smallest) for t in texts)) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(fps, pa.binary()), pa.array(n, pa.int32()), pa.array(bonds, pa.list_(pa.int64()))], ["fp", "n", "bonds"])

    return of(text.cast("string"))


def _tile_order(fp: Column, words: int) -> Column:
    """Fingerprints that lie together have like population counts in their quarters."""

    @F.arrow_udf("long")
    def order(fps: pa.Array) -> pa.Array:
        if not len(fps):
            return pa.array([], pa.int64())
        q = _quarters(_as_words(fps.to_pylist())[:, :words]).astype(np.int64)
        return pa.array(((q[:, 0] * 512 + q[:, 1]) * 512 + q[:, 2]) * 512 + q[:, 3], pa.int64())

    return order(fp)


def _pack(size: int, words: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block (one range of the order) as tiles, with the ranges of their quarters' population counts."""
        block, fps, tile = TaskContext.get().partitionId(), [], 0

        def row(n: int) -> pd.DataFrame:
            q = _quarters(_as_words(fps[:n])[:, :words])
            return pd.DataFrame({"block": [block], "tile": [tile], "fps": [b"".join(fps[:n])], "n": [n], "low": [q.min(axis=0)], "high": [q.max(axis=0)]})

        for pdf in batches:
            fps = fps + pdf["fp"].tolist()
            while len(fps) >= size:
                yield row(size)
                fps, tile = fps[size:], tile + 1
        if fps:
            yield row(len(fps))

    return pack


def _contract(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the ends of links in ``parent``, where each index points to the smallest one known to be connected."""
    while len(u):
        a, b = parent[u], parent[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]) is not None and (up != parent).any():
            parent[:] = up


def _forest(parent: np.ndarray, u: np.ndarray, v: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links those of a shortest spanning forest between the groups of ``parent``, which they join: round by round the shortest link out of every group (after Boruvka)."""
    order = np.argsort(far, kind="stable")
    u, v = u[order], v[order]
    us, vs = [], []
    while len(u):
        a, b = parent[u], parent[v]
        u, v, a, b = (x[a != b] for x in (u, v, a, b))
        first = np.full(len(parent), len(u))
        for ends in (a, b):
            np.minimum.at(first, ends, np.arange(len(u)))
        picked = np.unique(first[first < len(u)])
        us.append(u[picked])
        vs.append(v[picked])
        _contract(parent, u[picked], v[picked])
    return np.concatenate([*us, np.empty(0, np.int64)]), np.concatenate([*vs, np.empty(0, np.int64)])


def _close(a: np.ndarray, b: np.ndarray, radius: int, xor: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs within the radius and their differing bits, by exclusive-or and bit count over whole tiles."""
    x, n = xor[: len(a), : len(b)], ones[: len(a), : len(b)]
    np.bitwise_xor(a[:, :1], b[:, 0], out=x)
    far = np.bitwise_count(x, out=n)
    if a.shape[1] > 1:
        far = far.astype(np.uint16)
        for k in range(1, a.shape[1]):
            np.bitwise_xor(a[:, k : k + 1], b[:, k], out=x)
            far += np.bitwise_count(x, out=n)
    at = np.nonzero(far <= radius)
    return *at, far[at]


def _compare(radius: int, tile: int, words: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """A shortest spanning forest of the links between two blocks (or within one)."""
        pdf = pdf.sort_values(["run", "block", "tile"])
        width = len(pdf["fps"].iloc[0]) // int(pdf["n"].iloc[0])
        packed = b"".join(pdf["fps"])
        fps = _as_words([packed]).reshape(-1, width // 8)[:, :words]
        starts = np.concatenate([[0], np.cumsum(pdf["n"].to_numpy())])
        q = _quarters(fps)
        tiles = [(int(a), int(b), q[a:b].min(axis=0), q[a:b].max(axis=0)) for a, b in zip(starts, starts[1:])]
        sums = [(int(q[a:b].sum(axis=1).min()), int(q[a:b].sum(axis=1).max())) for a, b, *_ in tiles]
        blocks = pdf["run"].to_numpy()
        same = len(set(blocks)) == 1
        parent = np.arange(len(fps))
        xor, ones = np.empty((tile, tile), np.uint64), np.empty((tile, tile), np.uint8)
        held, pending, kept = [], 0, []
        lows, highs = np.array([t[2] for t in tiles]), np.array([t[3] for t in tiles])
        low, high = np.array(sums).T
        order = np.arange(len(tiles))

        for i, (a, b, least, most) in enumerate(tiles):
            others = order >= i if same else (blocks != blocks[i]) & (blocks[i] == blocks[0])
            gap = np.maximum(0, np.maximum(lows - most, least - highs)).sum(axis=1)
            whole = np.maximum(low - high[i], low[i] - high)
            for j in np.nonzero(others & (gap <= radius) & (whole <= radius))[0]:
                c, d = tiles[j][:2]
                x, y, far = _close(fps[a:b], fps[c:d], radius, xor, ones)
                keep = x + a < y + c
                if keep.any():
                    held.append((x[keep] + a, y[keep] + c, far[keep]))
                    pending += len(held[-1][0])
                if pending > PENDING:
                    kept.append(_forest(parent, *(np.concatenate(x) for x in zip(*held))))
                    held, pending = [], 0
        if held:
            kept.append(_forest(parent, *(np.concatenate(x) for x in zip(*held))))
        us, vs = (np.concatenate([*(k[end] for k in kept), np.empty(0, np.int64)]) for end in (0, 1))
        cut = lambda i: packed[i * width : (i + 1) * width]
        return pd.DataFrame({"u": [cut(i) for i in us], "v": [cut(i) for i in vs]}, columns=["u", "v"])

    return compare


def _runs(tiles: DataFrame, target: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Blocks to runs of about ``target`` fingerprints, however many partitions they were dealt to, and each run's ranges of counts: a few numbers a run."""
    ends = (f(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(4))
    before, numbers, low, high = 0, [], [], []
    for r in tiles.groupBy("block").agg(F.sum("n").alias("n"), *ends).orderBy("block").collect():
        run = before // target
        run = min(run, len(low))
        numbers.append((r["block"], run))
        before += r["n"]
        least, most = ([r[f"{c}{k}"] for k in range(4)] for c in ("low", "high"))
        if run == len(low):
            low.append(least)
            high.append(most)
        low[run], high[run] = np.minimum(low[run], least), np.maximum(high[run], most)
    return F.broadcast(tiles.sparkSession.createDataFrame(numbers, "block int, run int")), np.array(low).reshape(-1, 4), np.array(high).reshape(-1, 4)


def fingerprint_links(fps: DataFrame, radius: int, tile: int = TILE, words: int = 1) -> DataFrame:
    """Distinct fingerprints ``fp`` of 64 * ``words`` bits (more bytes only name them) to links ``(u, v)`` that connect all within ``radius`` bits of each other, directly or by steps: a shortest spanning forest of what each task sees.

    Blocks whose population counts lie farther apart than the radius are not brought together.
    """
    n = fps.count()
    blocks = max(MIN_BLOCKS, -(-n // BLOCK))
    ordered = fps.select("fp", _tile_order(F.col("fp"), words).alias("at")).repartitionByRange(blocks, "at", "fp").sortWithinPartitions("at", "fp")
    tiles = checkpointed(ordered.select("fp").mapInPandas(_pack(tile, words), "block int, tile int, fps binary, n int, low array<int>, high array<int>"))
    runs, low, high = _runs(tiles, max(1, -(-n // blocks)))

    @F.pandas_udf("array<int>")
    def others(run: pd.Series) -> pd.Series:
        """The runs that may hold a link to each run, itself included."""
        near = {k: np.flatnonzero(np.maximum(0, np.maximum(low - high[k], low[k] - high)).sum(axis=1) <= radius) for k in run.unique()}
        return run.map(near)

    met = tiles.join(runs, "block").withColumn("other", F.explode(others("run")))
    met = met.select("run", "block", "tile", "fps", "n", F.least("run", "other").cast("int").alias("lo"), F.greatest("run", "other").cast("int").alias("hi"))
    compared = met.repartition(min(PAIR_TASKS, max(1, len(low) * (len(low) + 1) // 2)), "lo", "hi").groupBy("lo", "hi")
    return compared.applyInPandas(_compare(radius, tile, words), "u binary, v binary")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bond of each node, which a task sends once while it remembers the node."""
    sent: set[int] = set()
    for batch in batches:
        sent = sent if len(sent) < 1_000_000 else set()
        new = [not (i in sent or sent.add(i)) for i in batch.column("id").to_pylist()]
        batch = batch.filter(pa.array(new, pa.bool_()))
        lists = batch.column("bonds")
        ids = np.repeat(batch.column("id").to_numpy(), pc.list_value_length(lists).to_numpy())
        yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(ids, pa.int64())], ["bond", "id"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bond and node the first of each node in each bond of two nodes or more."""
    bond, id_ = np.empty(0, np.int64), np.empty(0, np.int64)
    sent = False  # whether the row kept from the batch before has been sent
    for batch in batches:
        if not len(batch):
            continue
        bond, id_ = (np.concatenate([kept, batch.column(c).to_numpy()]) for kept, c in ((bond, "bond"), (id_, "id")))
        first = np.append(True, (bond[1:] != bond[:-1]) | (id_[1:] != id_[:-1]))
        bond, id_ = bond[first], id_[first]
        again = bond[1:] == bond[:-1]
        met = np.append(again, False) | np.append(False, again)
        last = bool(met[-1]) if len(bond) > 1 else sent
        met[0] &= not sent
        yield pa.RecordBatch.from_arrays([pa.array(bond[met]), pa.array(id_[met])], ["bond", "id"])
        bond, id_, sent = bond[-1:], id_[-1:], last


def _in_bond(fps: np.ndarray, n: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect those texts of one large bond, sorted by their numbers of shingles ``n``, that are within the radius and as alike as ``n`` allows.

    Texts close to a few of them are one group at once; only the others meet all.
    """
    parent, met = np.arange(len(fps)), np.zeros(len(fps), bool)
    us, vs = [], []

    def join(u: np.ndarray, v: np.ndarray) -> None:
        keep = (parent[u] != parent[v]) & (np.minimum(n[u], n[v]) >= similarity * np.maximum(n[u], n[v]))
        u, v = _forest(parent, u[keep], v[keep], np.zeros(keep.sum()))
        us.append(u)
        vs.append(v)

    def rest() -> np.ndarray:
        """All but the largest group and those that have met all."""
        return np.flatnonzero((parent != np.bincount(parent).argmax()) & ~met)

    for _ in range(PIVOTS):
        if not len(left := rest()):
            break
        pivot = left[len(left) // 2]
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[pivot]).sum(axis=1, dtype=np.int64) <= radius)
        join(np.full(len(near), pivot), near)
        met[pivot] = True
    left = rest()
    xor, ones = np.empty((TILE, TILE), np.uint64), np.empty((TILE, TILE), np.uint8)
    for a in range(0, len(left), TILE):
        mine = left[a : a + TILE]
        first, end = np.searchsorted(n, [similarity * n[mine[0]], n[mine[-1]] / similarity + 1])
        others = first + np.flatnonzero(~met[first:end])
        for b in range(0, len(others), TILE):
            theirs = others[b : b + TILE]
            x, y, _ = _close(fps[mine], fps[theirs], radius, xor, ones)
            join(mine[x], theirs[y])
        met[mine] = True
    return np.concatenate([*us, np.empty(0, np.int64)]), np.concatenate([*vs, np.empty(0, np.int64)])


def _near_in_bonds(radius: int, words: int, similarity: float):
    def compared(table: pa.Table) -> pa.RecordBatch:
        """Every node that whole bonds' close pairs connect to a smaller one, with the smallest: mostly the same for the bonds of a group of near-copies, so that these give few different links."""
        bond, n = table.column("bond").to_numpy(), table.column("n").to_numpy()
        names, at = np.unique(np.array(table.column("fp").to_pylist(), object), return_inverse=True)
        fps = _as_words(names.tolist())[:, :words]
        starts = np.flatnonzero(np.append(True, bond[1:] != bond[:-1]))
        counts = np.diff(np.append(starts, len(bond)))
        us, vs = [], []
        for s, c in zip(starts[counts > PAIRED].tolist(), counts[counts > PAIRED].tolist()):
            u, v = _in_bond(fps[at[s : s + c]], n[s : s + c], radius, similarity)
            us.append(at[s + u])
            vs.append(at[s + v])
        few = np.repeat(counts <= PAIRED, counts)
        bond, n, at = bond[few], n[few], at[few]
        for apart in range(1, PAIRED):
            i = np.flatnonzero((bond[:-apart] == bond[apart:]) & (n[:-apart] >= similarity * n[apart:]))
            if not len(i):
                break
            close = np.bitwise_count(fps[at[i]] ^ fps[at[i + apart]]).sum(axis=1, dtype=np.int64) <= radius
            us.append(at[i[close]])
            vs.append(at[i[close] + apart])
        parent = np.arange(len(names))
        _contract(parent, *(np.concatenate([*x, np.empty(0, np.int64)]) for x in (us, vs)))
        v = np.flatnonzero(parent != np.arange(len(names)))
        u = parent[v]
        return pa.RecordBatch.from_arrays([pa.array(names[u], pa.binary()), pa.array(names[v], pa.binary())], ["u", "v"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by bond and number of shingles, some bonds at a time."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= HELD_ROWS:
                table = pa.Table.from_batches(held)
                bond = table.column("bond").to_numpy()
                whole = int(np.searchsorted(bond, bond[-1]))
                if whole:
                    yield compared(table.slice(0, whole))
                held, rows = table.slice(whole).to_batches(), len(table) - whole
        if rows:
            yield compared(pa.Table.from_batches(held))

    return near


def bond_links(bonds: DataFrame, nodes: DataFrame, radius: int, words: int, similarity: float) -> DataFrame:
    """``bonds(id, bonds)``, repeats allowed, and the distinct ``nodes(id, fp, n)`` to links ``(u, v)`` that connect, directly or by steps, nodes that share a bond, are within ``radius`` bits of each other and whose numbers of shingles ``n`` allow the similarity.

    Two numbers for each bond of a node are shuffled; only bonds of two nodes or more get the fingerprints.
    """
    dealt = bonds.mapInArrow(_dealt, "bond long, id long").repartition("bond").sortWithinPartitions("bond", "id")
    shared = checkpointed(dealt.mapInArrow(_shared, "bond long, id long"))
    crowded = checkpointed(shared.groupBy("bond").count().where(F.col("count") > CROWD).select("bond"))
    links = None
    if crowded.count():
        many = shared.join(crowded, "bond", "left_semi").select("id").distinct()
        links = fingerprint_links(checkpointed(nodes.join(many, "id", "left_semi").select("fp")), radius, words=words)
        shared = shared.join(crowded, "bond", "left_anti")
    placed = shared.join(nodes, "id").select("bond", "n", "fp").repartition("bond").sortWithinPartitions("bond", "n")
    found = placed.mapInArrow(_near_in_bonds(radius, words, similarity), "u binary, v binary")
    return found if links is None else found.union(links)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, words: int = 1, radius: int = 4) -> DataFrame:
    """One row per input row: the key, its ``fingerprint`` (binary) and ``component_id``, the smallest key reachable over links of ``radius`` differing bits or fewer.

    Every text counts whole. Null and empty texts, and texts of white space, have the
    fingerprint zero and are linked like any other. Rows with a null key get the
    component of their fingerprint, null if no row there has a key; repeated keys give
    repeated rows. Other columns are not read. An empty table gives no rows.
    """
    prints = stored(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), size, words).alias("fp")))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("key").alias("least")))
    named = _rooted(distinct, fingerprint_links(distinct.select("fp"), radius, words=words))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = checkpointed(named.join(roots, "root").select("fp", "component_id"))
    return skew_join(prints, classes, ["fp"]).select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def _rooted(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``distinct`` with ``root``, the fingerprint that names each one's group."""
    groups = connected_components(links)
    return distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def _shingles(text: Column, size: int) -> Column:
    """The distinct shingle hashes of a text."""

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t.as_py(), size).view(np.int64)) for t in texts], pa.list_(pa.int64()))

    return of(text.cast("string"))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` has in common with each of ``b``: products of their incidences, over shingles that both sides hold."""
    if len(a) * len(b) <= 4:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    flat = [np.concatenate(x) for x in (a, b)]
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    if a is b:
        values, counts = np.unique(flat[0], return_counts=True)
        shared = values[counts > 1]
    else:
        shared = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return out
    at = [np.minimum(np.searchsorted(shared, x), len(shared) - 1) for x in flat]
    held = [shared[i] == x for i, x in zip(at, flat)]
    (row_a, at_a), (row_b, at_b) = ((r[h], i[h]) for r, i, h in zip(row, at, held))
    for first in range(0, len(shared), COLUMNS):
        sides = []
        for r, i, n in ((row_a, at_a, len(a)), (row_b, at_b, len(b))):
            here = (i >= first) & (i < first + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(shared) - first)), np.float32)
            m[r[here], i[here] - first] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _verify(similarity: float):
    def links(a: dict, b: dict | None) -> tuple[list[bytes], list[bytes]]:
        """A spanning forest of the pairs of a tile, or between two, whose sets have the similarity."""
        sets = [np.split(np.frombuffer(t["hashes"], np.int64), np.cumsum(t["sizes"])[:-1]) for t in (a, b or a)]
        if b is None:
            sets[1] = sets[0]
        sizes = [np.array(t["sizes"], np.int64) for t in (a, b or a)]
        shared = _overlaps(*sets).astype(np.float64)
        i, j = np.nonzero(shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared))
        if b is None:
            i, j = i[i < j], j[i < j]
        else:
            j = j + len(sizes[0])
        names = a["fps"] + (b["fps"] if b else [])
        u, v = _forest(np.arange(len(names)), i, j, np.zeros(len(i)))
        return [names[k] for k in u], [names[k] for k in v]

    def run(pair: pa.Table) -> pa.Table:
        """Of a pair of tiles both or, where a hash left one empty, one; or the tile that is compared with itself."""
        t = pair.to_pylist()
        same = t[0]["lo"] == t[0]["hi"]
        u, v = links(t[0], None if same else t[1]) if same or len(t) == 2 else ([], [])
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    return run


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted sets to one row for each tile."""
    tile, rows = None, []

    def row() -> pa.RecordBatch:
        (group, part, parts), fps, sets = tile, [r[0] for r in rows], [r[1] for r in rows]
        columns = [[group], [part], [parts], [fps], [[len(s) for s in sets]], [np.concatenate(sets).tobytes()]]
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["group", "part", "parts", "fps", "sizes", "hashes"])

    for batch in batches:
        names, sets = (batch.select(["group", "part", "parts"]).to_pylist(), batch.column("s"))
        for name, fp, s in zip(names, batch.column("fp").to_pylist(), sets):
            if tile != (key := tuple(name.values())):
                if rows:
                    yield row()
                tile, rows = key, []
            rows.append((fp, s.values.to_numpy()))
    if rows:
        yield row()


def jaccard_links(sets: DataFrame, similarity: float) -> DataFrame:
    """``sets(group, fp, s)`` to verified links ``(u, v)`` that connect the sets of each group whose Jaccard similarity is ``similarity`` or more, directly or by steps.

    The sets of a group lie in tiles by a hash of ``fp``; each tile meets each of its group in
    a task that holds two of them, whatever the group's size.
    """
    sizes = sets.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("shingles")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / TILE_SETS), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int").alias("parts")
    dealt = sets.join(sizes.select("group", parts), "group").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    placed = dealt.select("group", "part", "parts", "fp", "s").repartition("group", "part").sortWithinPartitions("group", "part")
    tiles = stored(placed.mapInArrow(_tiled, "group binary, part int, parts int, fps array<binary>, sizes array<int>, hashes binary"))
    met = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("group", "part", "fps", "sizes", "hashes", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    return met.groupBy("group", "lo", "hi").applyInArrow(_verify(similarity), "u binary, v binary")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, words: int = 4, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, all columns: that of the smallest key (null last), of rows with that key the one with the smallest hash of its text.

    A group is what links of a Jaccard similarity of ``similarity`` or more between the
    distinct ``size``-word shingles of whole texts connect. Texts of fewer words are one
    shingle; null, empty and wordless texts are one group. Texts meet if steps of as many
    differing fingerprint bits as that similarity makes likely, or up to four standard deviations more,
    lead from one to the other; every link is verified on the shingles themselves. Equal rows are one group like any
    copies; an empty table gives no rows. Columns may have any names.
    """
    key_of, hash_of = F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`"))
    prints = stored(docs.select(key_of.alias("key"), hash_of.alias("hash"), _node(F.col(f"`{text}`"), size, words, smallest_for(similarity)).alias("node")))
    first = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "hash")).alias("row")
    distinct = checkpointed(prints.groupBy(F.col("node.fp").alias("fp")).agg(first, F.min("node.n").alias("n")))
    bonds = prints.select(F.xxhash64("node.fp").alias("id"), "node.bonds")
    links = bond_links(bonds, distinct.select(F.xxhash64("fp").alias("id"), "fp", "n"), radius_for(similarity, 64 * words, 4.0), words, similarity)
    near = checkpointed(connected_components(links))
    # The shingles of one row of each text that has a neighbour. Rows that are joined by key and hash lie together, so repeated ones go without another shuffle.
    at, wanted_at = F.struct(key_of.alias("key"), hash_of.alias("hash")).alias("at"), F.struct("row.key", "row.hash").alias("wanted")
    wanted = near.join(distinct, near["node"] == distinct["fp"]).select("fp", F.col("component").alias("group"), wanted_at)
    texts = docs.select(at, F.col(f"`{text}`").cast("string").alias("content"))
    met = texts.join(wanted, F.col("at") == F.col("wanted")).dropDuplicates(["wanted"])
    sets = stored(met.select("group", "fp", _shingles(F.col("content"), size).alias("s")))
    named = _rooted(distinct, jaccard_links(sets, similarity))
    chosen = checkpointed(named.groupBy("root").agg(F.min("row").alias("row")).select(wanted_at))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), at)
    return rows.join(chosen, F.col("at") == F.col("wanted")).dropDuplicates(["wanted"]).select("doc.*")
