"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers cut the bytes of a space and the text. The token-byte incidence of each is
a sparse matrix A, B in compressed rows (:class:`Rows`), built by hand from token lengths.
Gustavson's row products A·Bᵀ give the overlap links, with the number of shared bytes.
Where tokens of both end at one byte, the text is cut into groups; the product of the
token-group incidences gives the links between tokens that share a group. Those grow with
the square of a group's size, so their number is taken from the symbolic phase alone.

Texts are encoded in chunks of whole documents. Both encoders see each different word of
a chunk once: neither vocabulary has a token in which a space follows another character, so
no merge passes there. Links per document are kept as counts of id pairs; how many documents of the
corpus hold a pair is a Spark aggregation, joined back to the documents' pairs.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe
from emberlog.llm.common import checkpointed, skew_join, stored

#: Characters aligned at a time, at most, beyond one text; nonzeros multiplied at a time, at most, beyond one row.
CHUNK_CHARS, BLOCK = 1_500_000, 1_000_000
#: Id pairs that are broadcast at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000

SCHEMA = "key long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups string, links array<struct<a:int,b:int,n:int>>"
_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
_ROW = pa.schema([*((c, pa.int64()) for c in ("key", "n_a", "n_b", "n_groups", "n_links", "n_group_links")), ("groups", pa.string()), ("links", pa.list_(_LINK))])


@dataclass
class Rows:
    """A sparse matrix of ones in compressed rows: row i has its ones in the columns ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, n_rows: int) -> Rows:
        """From the coordinates of its ones, in any order."""
        order = np.argsort(row, kind="stable")
        return cls(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))]), column[order])

    def transposed(self, n_columns: int) -> Rows:
        return Rows.of(self.columns, np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), n_columns)


def product_sizes(left: Rows, right: Rows) -> np.ndarray:
    """The symbolic phase of Gustavson's product: how many terms each row of ``left`` · ``right`` sums up."""
    terms = np.concatenate([[0], np.cumsum(np.diff(right.starts)[left.columns])])
    return terms[left.starts[1:]] - terms[left.starts[:-1]]


def row_products(left: Rows, right: Rows, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product ``left`` · ``right``: (row, column, value) of its nonzeros in order, for a block of rows at a time.

    A row of the product is the sum of the rows of ``right`` that the row of ``left`` names.
    """
    sizes = np.diff(right.starts)
    ends = np.cumsum(product_sizes(left, right))
    first, n = 0, len(left.starts) - 1
    while first < n:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + block, side="right")))
        inner = left.columns[left.starts[first] : left.starts[last]]
        row = np.repeat(np.arange(first, last), np.diff(left.starts[first : last + 1]))
        row, column = np.repeat(row, sizes[inner]), bpe._gather(right.columns, right.starts[inner], sizes[inner])
        order = np.lexsort((column, row)) if ((row[1:] == row[:-1]) & (column[1:] < column[:-1])).any() else slice(None)
        row, column = row[order], column[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
        at = np.flatnonzero(new)
        yield row[at], column[at], np.diff(np.append(at, len(row)))
        first = last


class ByteLevel(bpe.Vocabulary):
    """A byte-level BPE vocabulary to which special tokens' strings are plain text."""

    def __init__(self, spec: bytes):
        super().__init__(spec)
        self.special = {}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each text, end to end, and how many each has."""
        packed = list(self.encode_all(" " + t for t in texts))
        return np.frombuffer(b"".join(packed), "<u4").astype(np.int64), np.array([len(p) // 4 for p in packed], np.int64)


class Pieces:
    """A SentencePiece model with byte fallback, which itself puts a space before each text."""

    SPACE = "▁"
    _FRAGMENT = re.compile(" +[^ ]*")

    def __init__(self, spec: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        size = len(self.model)
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        raw = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(self.SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in raw])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        #: Words are encoded by themselves if no piece goes on over a space.
        self.by_word = not any(re.search(f"[^{self.SPACE}]{self.SPACE}", p) for p in pieces)
        self.space = self.model.encode("x ")[len(self.model.encode("x")) :]

    def _fragments(self, text: str) -> list[str]:
        """A text cut before spaces after other characters, without each part's first space."""
        if not self.by_word:
            return [text]
        if "  " in text or text[0] == " ":
            return [f[1:] for f in self._FRAGMENT.findall(" " + text)]
        return text.split(" ")

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text, end to end, and how many each has."""
        parts = [self._fragments(t) for t in texts]
        coded = pa.array(itertools.chain.from_iterable(parts), pa.large_string()).dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        found = [ids if w else self.space for w, ids in zip(words, self.model.encode(words, num_threads=1))]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[np.cumsum([0, *map(len, parts)])]
        return bpe._gather(flat, (np.cumsum(sizes) - sizes)[at], sizes[at]), np.diff(ends)


@functools.lru_cache(maxsize=2)
def _tokenizers(a: bytes, b: bytes) -> tuple[ByteLevel, Pieces, list[str]]:
    """Both, and every id with what may follow it in the text of groups: a comma, or the end of its half of a group."""
    one, other = ByteLevel(a), Pieces(b)
    shown = [f"{i}{end}" for i in range(len(one.lengths)) for end in ",|"] + [f"{i}{end}" for i in range(len(other.lengths)) for end in ",;"]
    return one, other, shown


def _lossless(v: ByteLevel | Pieces, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Whether the bytes of each text's tokens, joined, are those of a space and the text."""
    joined = bpe._gather(v.bytes, v.starts[ids], v.lengths[ids]).tobytes()
    bounds = np.concatenate([[0], np.cumsum(v.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return np.array([joined[a:b] == r for a, b, r in zip(bounds, bounds[1:], raw)], bool)


def align_texts(texts: list[str | None], one: ByteLevel, other: Pieces, shown: list[str]) -> list[pa.Array]:
    """All columns but the key of :func:`align`, for a chunk of texts."""
    n = len(texts)
    some = np.array([bool(t) for t in texts], bool)
    read = [t for t in texts if t]
    raw = [b" " + t.encode() for t in read]
    (a, n_a), (b, n_b) = one.ids(read), other.ids(read)
    whole = _lossless(one, a, n_a, raw) & _lossless(other, b, n_b, raw)
    a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
    texts_at = np.flatnonzero(some)[whole]
    n_a, n_b = n_a[whole], n_b[whole]
    text_a, text_b = np.repeat(texts_at, n_a), np.repeat(texts_at, n_b)

    end_a, end_b = np.cumsum(one.lengths[a]), np.cumsum(other.lengths[b])
    size = int(end_a[-1]) if len(end_a) else 0
    marks = np.zeros(size + 1, np.int8)
    marks[end_a] += 1
    marks[end_b] += 1
    cut_a, cut_b = marks[end_a] == 2, marks[end_b] == 2
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    n_groups = int(cut_a.sum())

    # Token-byte incidences: the bytes of a token are its columns. Their product: overlap links.
    bytes_a = Rows(np.concatenate([[0], end_a]), np.arange(size))
    bytes_b = Rows(np.concatenate([[0], end_b]), np.arange(size)).transposed(size)
    links = [(i, j) for i, j, _ in row_products(bytes_a, bytes_b)]
    i, j = (np.concatenate([x[k] for x in links] or [np.empty(0, np.int64)]) for k in (0, 1))
    # Token-group incidences.
    groups_a = Rows(np.arange(len(a) + 1), group_a)
    groups_b = Rows(np.arange(len(b) + 1), group_b).transposed(n_groups)
    in_groups = product_sizes(groups_a, groups_b)

    count = lambda at, weights=None: np.bincount(at, weights, n).astype(np.int64)
    key = (text_a[i] * len(one.lengths) + a[i]) * len(other.lengths) + b[j]
    pairs, times = np.unique(key, return_counts=True)
    of, pair = np.divmod(pairs, len(one.lengths) * len(other.lengths))
    left, right = np.divmod(pair, len(other.lengths))
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (left, right, times)], fields=list(_LINK))
    held = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), rows)

    # The tokens of both in the order of the groups' text, with what follows each.
    order = np.empty(len(a) + len(b), np.int64)
    before_b, upto_a = np.concatenate([[0], np.flatnonzero(cut_b) + 1]), np.flatnonzero(cut_a) + 1
    order[np.arange(len(a)) + before_b[group_a]] = 2 * a + cut_a
    order[np.arange(len(b)) + upto_a[group_b]] = 2 * (b + len(one.lengths)) + cut_b
    numbers, bounds, texts_of = order.tolist(), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist(), [""] * n
    for k, at in enumerate(texts_at.tolist()):
        texts_of[at] = "".join(map(shown.__getitem__, numbers[bounds[k] : bounds[k + 1]]))[:-1]
    return [pa.array(x) for x in (count(text_a), count(text_b), count(text_a[cut_a]), count(text_a[i]), count(text_a, in_groups))] + [pa.array(texts_of, pa.string()), held]


def load(spark: SparkSession, a: str, b: str):
    """A ``tokenizers`` JSON file of byte-level BPE and a SentencePiece model, broadcast (a fixed size, about 2 MB)."""
    specs = []
    for path in (a, b):
        with open(path, "rb") as f:
            specs.append(f.read())
    return spark.sparkContext.broadcast(tuple(specs))


def align(docs: DataFrame, tokenizers, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its key, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links`` overlapping pairs of token occurrences, ``n_group_links`` pairs that share a group, ``groups`` and ``links``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, the ids of each group in order; ``links(a, b, n)`` are
    the id pairs that overlap and how often. Special tokens' strings are plain text. Texts
    count whole, however long (a task holds a text's tokens and bytes, about 100 bytes a byte). Null and empty texts, and those
    whose tokens' bytes, joined, differ from a space and the text, have no tokens: zeros, empty
    groups, no links. Repeated rows and null keys give rows of their own, an empty table
    none; other columns are not read. There is no shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other, shown = _tokenizers(*tokenizers.value)
        keys, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *align_texts(held, one, other, shown)], schema=_ROW)

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k)
                held.append(t.as_py())
                size += len(held[-1] or "")
                if size >= CHUNK_CHARS:
                    yield flush()
                    keys, held, size = [], [], 0
        if held:
            yield flush()

    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(run, SCHEMA).withColumnRenamed("key", key)


def link_counts(links: DataFrame) -> DataFrame:
    """``(a, b, docs, best)`` from ``links(a, b)``, a row per document and id pair: how many documents hold the pair, and whether no other pair of ``a`` is held by more."""
    counts = links.groupBy("a", "b").agg(F.count("*").alias("docs"))
    return checkpointed(counts.join(counts.groupBy("a").agg(F.max("docs").alias("most")), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")))


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """``aligned`` (any columns, and ``links`` as :func:`align` gives them) with ``n_best``, the links whose pair is the commonest of its ``a`` in the corpus, and ``count_sum``, the corpus counts of all links added up; without ``links``.

    The aligned rows are kept as a table in the shared folder: texts are encoded once, and a
    lost executor costs no encoding. The pairs of a document are put together again in the
    task that takes them apart, so only sums are shuffled.
    """
    kept = stored(aligned.select(F.struct(*(c for c in aligned.columns if c != "links")).alias("out"), "links").withColumn("row", F.monotonically_increasing_id()), "zstd")
    links = kept.select("row", F.inline("links"))
    counts = link_counts(links)
    few = counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    met = links.join(F.broadcast(counts), ["a", "b"]) if few else skew_join(links, counts, ["a", "b"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    whole = kept.select("row", "out").join(sums, "row", "left")
    return whole.select("out.*", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))
