"""Periodic runs of words: maximal repetitions found by an enhanced suffix array.

A branching tandem repeat is a square whose two halves are followed by different words;
every run ends in exactly one for each multiple of its period that fits it twice. Each
interval of the LCP array (the suffixes that share a prefix of some depth) is tested for
them: for the suffixes of all its children but the largest, is the suffix ``depth`` words
before or after in the interval too (by the inverse suffix array), and in another child?
Then the halves lie side by side. Such a square is rotated to the left as far as the words
agree, and squares that cover the same stretch are merged into one run of the smallest
period. There are no tree nodes: intervals are pairs of positions in the arrays.

A task takes whole documents, many at a time, as one sequence of word numbers in which
words of different documents differ, so all array work is vectorised over the batch. The
suffix array is built by prefix doubling over what is not yet told apart; the ranks of
all rounds, which tell in a logarithmic number of steps how far two places agree, also
give the LCP array and the rotations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has so many words and so many periods at least.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words handled at a time, at most, beyond one document.
CHUNK_WORDS = 400_000

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each stretch, one stretch after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class SuffixArray:
    """Suffix, inverse and LCP arrays of sequences laid end to end; suffixes of different ones share nothing."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        n = self.n = len(codes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.repeat(bounds[:-1], sizes)
        self.end = np.repeat(bounds[1:], sizes)
        key = np.repeat(np.arange(len(sizes)), sizes) * (int(codes.max(initial=0)) + 1) + codes
        sa = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[sa][1:] != key[sa][:-1]
        #: By round k: a number for the 2^k words from each place on (fewer at an end, which sets it apart).
        self.levels = [self._ranks(np.empty(n, np.int64), sa, np.arange(n), new)]
        #: By place in the suffix array: the first round that tells a suffix from the one before.
        self.told = np.zeros(n, np.int64)
        span, start = 1, np.flatnonzero(new)
        while True:
            last = np.concatenate([start[1:], [n]])
            many = last - start > 1
            if not many.any():
                break
            at = _spread(start[many], (last - start)[many])
            rank, places = self.levels[-1], sa[at]
            ahead = places + span
            key = rank[places] * (n + 1) + np.where(ahead < self.end[places], rank[np.minimum(ahead, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            sa[at], key = places[order], key[order]
            apart = np.ones(len(at), bool)
            apart[1:] = key[1:] != key[:-1]
            self.told[at[apart & ~new[at]]] = len(self.levels)
            self.levels.append(self._ranks(rank.copy(), sa, at, apart))
            new[at] |= apart
            start, span = np.flatnonzero(new), 2 * span
        self.sa = sa
        self.isa = np.empty(n, np.int64)
        self.isa[sa] = np.arange(n)
        #: Words that a suffix shares with the one before it in the array.
        self.lcp = np.zeros(n + 1, np.int64)
        shared = np.flatnonzero(self.told)
        self.lcp[shared] = self.agree(sa[shared - 1], sa[shared], self.told[shared])

    @staticmethod
    def _ranks(rank: np.ndarray, sa: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """``rank`` with the places ``sa[at]`` numbered by the first of their group in the array."""
        rank[sa[at]] = np.maximum.accumulate(np.where(new, at, 0))
        return rank

    def agree(self, a: np.ndarray, b: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """How many words agree from two places on, told apart by round ``rounds``."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            i = np.flatnonzero(rounds > k)
            i = i[(a[i] < self.end[np.minimum(a[i], self.n - 1)]) & (b[i] < self.n)]
            i = i[self.levels[k][a[i]] == self.levels[k][b[i]]]
            total[i] += 1 << k
            a[i] += 1 << k
            b[i] += 1 << k
        return total

    def agree_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree up to before two places of one sequence, ``a`` the earlier."""
        a, b, first = a.copy(), b.copy(), self.first[a]
        total = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                i = np.flatnonzero(a - (1 << k) >= first)
                i = i[self.levels[k][a[i] - (1 << k)] == self.levels[k][b[i] - (1 << k)]]
                total[i] += 1 << k
                a[i] -= 1 << k
                b[i] -= 1 << k
        return total

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(at, left, right)``: for each place ``at`` between two children the interval ``[left, right)`` of the array that it parts."""
        lcp = self.lcp
        at = np.flatnonzero(lcp)
        before, after = np.arange(self.n + 1) - 1, np.arange(self.n + 1) + 1
        for edge in (before, after):
            open_ = at
            while len(open_):
                open_ = open_[lcp[edge[open_]] >= lcp[open_]]
                edge[open_] = edge[edge[open_]]
        return at, before[at], after[at]


def _branching_squares(s: SuffixArray, min_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, period)`` of the last square of every run of ``min_periods`` periods or more, and of its period's multiples."""
    at, left, right = s.intervals()
    depth = s.lcp[at]
    # The places of a run, a period apart, all start with the words of that period: they are in its interval, which so has that many.
    fits = (right - left >= min_periods) & (min_periods * depth <= s.end[s.sa[at]] - s.first[s.sa[at]])
    at, left, right, depth = at[fits], left[fits], right[fits], depth[fits]
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((at, right, left))
    at, left, right, depth = at[order], left[order], right[order], depth[order]
    head = np.ones(len(at), bool)
    head[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    interval = np.cumsum(head) - 1
    # The children of an interval: from its left end to the first place between two, and from each such place to the next.
    heads = np.flatnonzero(head)
    starts, owner = np.insert(at, heads, left[heads]), np.insert(interval, heads, interval[heads])
    ends = np.append(starts[1:], 0)
    tails = np.append(np.flatnonzero(owner[1:] != owner[:-1]), len(owner) - 1)
    ends[tails] = right[heads]
    size = ends - starts
    firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    largest = np.flatnonzero(size == np.maximum.reduceat(size, firsts)[owner])
    small = np.ones(len(size), bool)
    small[largest[np.concatenate([[True], owner[largest][1:] != owner[largest][:-1]])]] = False
    starts, ends, owner, size = starts[small], ends[small], owner[small], size[small]
    place = s.sa[_spread(starts, size)]
    of = np.repeat(np.arange(len(size)), size)
    d, lo, hi, own_lo, own_hi = depth[heads][owner][of], left[heads][owner][of], right[heads][owner][of], starts[of], ends[of]

    def with_other(other: np.ndarray) -> np.ndarray:
        inside = np.flatnonzero((other >= s.first[place]) & (other < s.end[place]))
        r = s.isa[other[inside]]
        return inside[(r >= lo[inside]) & (r < hi[inside]) & ((r < own_lo[inside]) | (r >= own_hi[inside]))]

    later, earlier = with_other(place + d), with_other(place - d)
    found, period = np.concatenate([place[later], place[earlier] - d[earlier]]), np.concatenate([d[later], d[earlier]])
    return found, period


def find_runs(codes: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs of sequences laid end to end, by start, then period."""
    s = SuffixArray(codes, sizes)
    place, period = _branching_squares(s, min_periods)
    start, end = place - s.agree_before(place, place + period), place + 2 * period
    long = end - start >= np.maximum(min_words, min_periods * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _texts(held: list[list[bytes]], min_words: int, min_periods: int) -> tuple[pa.Array, pa.Array]:
    """The runs of each list of words, and its text without what they repeat."""
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    words = pa.array([w for words in held for w in words], pa.binary()).dictionary_encode()
    start, end, period = find_runs(words.indices.to_numpy().astype(np.int64), sizes, min_words, min_periods)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    offsets = np.searchsorted(start, bounds)
    shift = np.repeat(bounds[:-1], np.diff(offsets))
    rows = pa.StructArray.from_arrays([pa.array(start - shift), pa.array(end - start), pa.array(period)], fields=list(_RUN))
    depth = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    dropped = np.cumsum(depth) > 0
    collapsed = []
    for words, at, some in zip(held, bounds.tolist(), (np.diff(offsets) > 0).tolist()):
        collapsed.append(b" ".join([w for w, gone in zip(words, dropped[at : at + len(words)].tolist()) if not gone] if some else words).decode())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), pa.array(collapsed, pa.string())


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``(key, n_words, runs, collapsed)``: a row per document with its runs of words and its text without what they repeat.

    Words lie between spaces and the characters U+0009 to U+000D. A run ``(start, length,
    period)``, counted in words from 0, is a stretch with its smallest period, of at least
    ``min_words`` words and ``min_periods`` (2 or more) periods, that neither neighbouring word extends.
    ``collapsed`` joins with single spaces the words that no run contains after its first
    period. Runs are in order of start, then period.

    Every text counts whole, however long (a task holds a document's arrays, about 200 bytes a
    word); null, empty and wordless texts have no runs and an empty ``collapsed``. Repeated
    rows and null keys give rows of their own, an empty table none; no other column is read.
    There is no shuffle: a lost task is done again from its part of the input.
    """
    if min_periods < 2 or min_words < 1:
        raise ValueError("a run has two periods and one word at least")

    def flush(keys: list, held: list[list[bytes]]) -> pa.RecordBatch:
        runs, collapsed = _texts(held, min_words, min_periods)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(w) for w in held], pa.int64()), runs, collapsed], ["key", "n_words", "runs", "collapsed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k)
                held.append((t.as_py() or "").encode().split())
                size += len(held[-1])
                if size >= CHUNK_WORDS:
                    yield flush(keys, held)
                    keys, held, size = [], [], 0
        if held:
            yield flush(keys, held)

    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(run, f"key long, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("key", key)
