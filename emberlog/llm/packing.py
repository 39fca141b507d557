"""Token sequences of equal length: best-fit-decreasing packing and binary output.

Documents are cut losslessly into pieces of at most ``seq_len`` tokens and the pieces of
a shard are packed best-fit-decreasing: longest first, each into the fullest sequence
that still has room, found with a segment tree over the remaining capacities. Documents
are dealt to shards by a hash of their key and ids, and lie in a shard in order of that
hash, so that the result depends on the documents alone, not on how they were
partitioned. A task holds at most ``SHARD_TOKENS`` tokens at a time: a fuller shard is
packed in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import small_batches

SEQ_LEN = 2048
#: Documents in a shard, on average; tokens packed together, at most, beyond the last document (4 bytes each).
SHARD_DOCS, SHARD_TOKENS = 4_000, 2_000_000
#: Rows of a file of packed sequences, at most (about 1 GB of matrices at 2048 tokens).
FILE_ROWS = 65_536
#: Sequences sent on in one batch.
BATCH = 64

SCHEMA = (
    "shard string, sequence long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
    "doc_ids array<long>, doc_starts array<long>"
)
_ARROW = pa.schema([("shard", pa.string()), ("sequence", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])


class CapacityTree:
    """How many open sequences have each remaining capacity; finds the least capacity that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._change(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, sequence) with the smallest capacity of at least ``least``; None if there is none."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1


def pack(lengths: list[int], seq_len: int) -> list[list[int]]:
    """Best-fit-decreasing: the indices of the pieces in each sequence. Every length is from 1 to ``seq_len``; equal lengths keep their order."""
    tree, sequences = CapacityTree(seq_len), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found = (seq_len, len(sequences))
            sequences.append([])
        room, at = found
        sequences[at].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], at)
    return sequences


def pack_ids(docs: DataFrame, ids: Column, key: str = "doc_id", seq_len: int = SEQ_LEN, pad_id: int = 0, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Packed sequences of the token ids (packed little-endian, as ``bpe.encode`` gives them) of all documents.

    Each row is a sequence: ``input_ids`` and ``position_ids`` hold ``seq_len`` unsigned
    32-bit integers (one row of the shard's matrices; padding at the end), ``n_tokens`` how
    many of them are used, ``cu_seqlens`` the cumulative lengths of its segments from 0,
    ``doc_ids`` and ``doc_starts`` each segment's document and the token of that document it
    starts with. Positions start again at 0 in every segment. Concatenating a document's
    segments by start gives back its ids, of any length. Null or empty ids take no room and
    are in no sequence; a null key is carried on; repeated documents are packed as often as
    they occur. An empty table gives no rows; other columns are not read.
    """

    def flush(held: list[tuple[int | None, int, np.ndarray]], shard: str):
        sequences = pack([len(x) for *_, x in held], seq_len)
        for first in range(0, len(sequences), BATCH):
            yield rows(held, shard, first, sequences[first : first + BATCH])

    def rows(held: list[tuple[int | None, int, np.ndarray]], shard: str, first: int, sequences: list[list[int]]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in _ARROW]
        for number, members in enumerate(sequences, first):
            parts = [held[i] for i in members]
            bounds = np.concatenate([[0], np.cumsum([len(x) for *_, x in parts])])
            used = int(bounds[-1])
            row = np.full(seq_len, pad_id, "<u4")
            row[:used] = np.concatenate([x for *_, x in parts])
            position = np.zeros(seq_len, "<u4")
            position[:used] = np.arange(used) - np.repeat(bounds[:-1], np.diff(bounds))
            for column, value in zip(columns, (shard, number, used, row.tobytes(), position.tobytes(), bounds.tolist(), [k for k, *_ in parts], [s for _, s, _ in parts])):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    def run(batches):
        current, part, held, size = None, 0, [], 0
        for batch in batches:
            for shard, key_, packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if held and (shard != current or size >= shard_tokens):
                    yield from flush(held, f"{current:08d}-{part:04d}")
                    held, size, part = [], 0, part + 1
                if shard != current:
                    current, part = shard, 0
                tokens = np.frombuffer(packed.as_py() or b"", "<u4")
                for start in range(0, len(tokens), seq_len):
                    held.append((key_.as_py(), start, tokens[start : start + seq_len]))
                size += len(tokens)
        if held:
            yield from flush(held, f"{current:08d}-{part:04d}")

    shards = max(1, -(-docs.count() // shard_docs))
    at = F.xxhash64("key", "ids")
    kept = docs.select(F.col(key).cast("long").alias("key"), ids.alias("ids")).withColumn("at", at)
    dealt = kept.select(F.pmod("at", F.lit(shards)).alias("shard"), "key", "ids", "at").repartition("shard").sortWithinPartitions("shard", "at", "key")
    return dealt.drop("at").mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> DataFrame:
    """Writes the packed matrices as Parquet files of up to ``FILE_ROWS`` rows, whole shards in order in each, and returns them read again: every row is a row of its id and position matrices, as raw little-endian integers. Texts and ids reach Python in small batches."""
    with small_batches(packed.sparkSession):
        packed.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path, compression="zstd")
    return packed.sparkSession.read.schema(SCHEMA).parquet(path)
