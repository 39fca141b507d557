"""Cross-entropy difference: how much likelier a target model finds a document than a background model.

Both models are bigram models over the tokens of one vocabulary, of the same form and
smoothing: the target is counted over the documents marked as such, the background over
all documents. A document is scored by the counts of all others, its own held out of both
models, so that none is likely only for having been counted itself. Its score is the mean
over its tokens of the target's loss less the background's: low scores are like the
target.

Every distinct bigram is counted exactly, over all documents. Documents are dealt into
chunks of about ``CHUNK_TOKENS`` tokens; a chunk sends each of its distinct bigrams once, these
are added up over the corpus by bigram, and the sums go back to the chunks, which score
their documents with them. A frequent bigram thus costs one row a chunk. Only the counts
of single tokens and contexts, of the vocabulary's size, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import stored

#: Tokens of a chunk on average.
CHUNK_TOKENS = 2_000_000
#: Tokens counted or scored at a time, beyond one document.
SLICE_TOKENS = 500_000
#: At least so many chunks, for parallel work on small inputs.
MIN_CHUNKS = 256
#: Weight of the bigram estimate against the unigram one.
BIGRAM = 0.7
#: Added to each token's count.
SMOOTH = 0.5


def tokens_of(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", "<u4").astype(np.int64)


def bigrams_of(docs: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of some documents on end, the context of each, and the number of its bigram. A context is the token before it, or a document's start (token number ``vocabulary``)."""
    ids = np.concatenate([*docs, np.empty(0, np.int64)])
    before = np.concatenate([[vocabulary], ids[:-1]])[: len(ids)]
    before[np.cumsum([0, *(len(x) for x in docs if len(x))])[:-1]] = vocabulary
    if len(ids) and ids.max() >= vocabulary:
        raise ValueError(f"token id {ids.max()} is not below {vocabulary}")
    return ids, before, before * (vocabulary + 1) + ids


def count(docs: DataFrame, ids: Column, target: Column, vocabulary: int) -> DataFrame:
    """``(kind, token, target, background)``: counts of unigrams (0) and contexts (1) over all documents. A null ``target`` counts as false."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros((2, n), np.int64) for n in (vocabulary, vocabulary + 1)]

        def add(held: list[tuple[np.ndarray, bool]]) -> None:
            for good in (False, True):
                part = [x for x, marked in held if marked is good]
                for table, found in zip(tables, bigrams_of(part, vocabulary)) if part else ():
                    found = np.bincount(found, minlength=table.shape[1])
                    table[1] += found
                    if good:
                        table[0] += found

        held, size = [], 0
        for pdf in batches:
            for packed, good in zip(pdf["ids"], pdf["target"]):
                if packed:
                    held.append((tokens_of(packed), bool(good)))
                    size += len(held[-1][0])
                if size > SLICE_TOKENS:
                    add(held)
                    held, size = [], 0
        add(held)
        for kind, table in enumerate(tables):
            found = np.flatnonzero(table[1])
            yield pd.DataFrame({"kind": np.int8(kind), "token": found, "target": table[0, found], "background": table[1, found]})

    rows = docs.select(ids.alias("ids"), F.coalesce(target, F.lit(False)).alias("target"))
    return rows.mapInPandas(run, "kind byte, token long, target long, background long").groupBy("kind", "token").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def bigram_counts(chunks: DataFrame, vocabulary: int) -> DataFrame:
    """``(chunk, pair, target, background)``: every distinct bigram of a chunk with its exact counts over all chunks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = [tokens_of(b) for b in pdf["ids"]]
        pairs, background = np.unique(bigrams_of(docs, vocabulary)[2], return_counts=True)
        good = bigrams_of([x for x, marked in zip(docs, pdf["target"]) if marked], vocabulary)[2]
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "pair": pairs, "target": np.bincount(np.searchsorted(pairs, good), minlength=len(pairs)), "background": background})

    found = chunks.groupBy("chunk").applyInPandas(run, "chunk int, pair long, target long, background long")
    over = Window.partitionBy("pair")
    return found.select("chunk", "pair", F.sum("target").over(over).alias("target"), F.sum("background").over(over).alias("background"))


def score(docs: DataFrame, ids: Column, target: Column, vocabulary: int, key: str = "doc_id") -> DataFrame:
    """One row per document: the key, ``n_tokens``, ``target_loss`` and ``background_loss`` (mean nats per token) and ``score``, their difference.

    Documents without tokens (null or empty texts) score 0 with null losses. Without any
    target document, both models know the vocabulary only through smoothing. Repeated rows
    count, and are scored, as often as they occur: each is among the others of its copies.
    Whole texts count, however long. Ids must be below ``vocabulary``; a larger one is an
    error. Other columns are not read.
    """
    spark = docs.sparkSession
    # The ids are made once and kept: all passes read them, and no task holds an encoder beside its counts.
    kept = docs.select(F.col(key).cast("long").alias("key"), ids.alias("ids"), F.coalesce(target, F.lit(False)).alias("target"), F.monotonically_increasing_id().alias("row"))
    docs = stored(kept, compression="zstd")
    counted = count(docs, F.col("ids"), F.col("target"), vocabulary).toPandas()  # at most 2 * vocabulary + 1 rows, whatever the corpus
    dense = []
    for kind, size in ((0, vocabulary), (1, vocabulary + 1)):
        part, out = counted[counted["kind"] == kind], np.zeros((2, size), np.int64)
        out[0, part["token"]], out[1, part["token"]] = part["target"], part["background"]
        dense.append(out)
    shared = spark.sparkContext.broadcast(tuple(dense))
    n = max(MIN_CHUNKS, -(-int(dense[0][1].sum()) // CHUNK_TOKENS))
    chunks = docs.select(F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("chunk"), "key", "ids", "target")

    def run(pdf: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        unigrams, contexts = shared.value
        totals = [int(x.sum()) for x in unigrams]
        counts = counts.sort_values("pair")
        pairs, bigrams = counts["pair"].to_numpy(), (counts["target"].to_numpy(), counts["background"].to_numpy())
        lists, good = [tokens_of(b) for b in pdf["ids"]], pdf["target"].to_numpy(bool)
        sizes = np.array([len(x) for x in lists], np.int64)
        losses = [np.full(len(lists), np.nan) for _ in (0, 1)]
        for at, ids in enumerate(lists):
            if not len(ids):
                continue
            _, before, pair = bigrams_of([ids], vocabulary)
            # What the document itself adds to every count that is looked up.
            own_token, own_context, own_pair = (np.unique(x, return_inverse=True, return_counts=True)[1:] for x in (ids, before, pair))
            own_token, own_context, own_pair = (n[i] for i, n in (own_token, own_context, own_pair))
            for k in (0, 1):
                out = 1 if k or good[at] else 0
                uni = (unigrams[k][ids] - out * own_token + SMOOTH) / (totals[k] - out * len(ids) + SMOOTH * vocabulary)
                total = contexts[k][before] - out * own_context
                p = BIGRAM * (bigrams[k][np.searchsorted(pairs, pair)] - out * own_pair) / np.maximum(total, 1) + np.where(total > 0, 1 - BIGRAM, 1.0) * uni
                losses[k][at] = -np.log(p).mean()
        losses = [pd.Series(x).astype("Float64") for x in losses]
        return pd.DataFrame({"key": pdf["key"], "n_tokens": sizes, "target_loss": losses[0], "background_loss": losses[1], "score": (losses[0] - losses[1]).fillna(0.0)})

    # Both sides of the join read one exchange of the documents.
    scored = chunks.groupBy("chunk").cogroup(bigram_counts(chunks, vocabulary).groupBy("chunk"))
    return scored.applyInPandas(run, "key long, n_tokens long, target_loss double, background_loss double, score double").withColumnRenamed("key", key)
