"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters has an edit budget of k = m * ``RATE`` errors (at
least 1, and few enough that its pieces keep ``MIN_PIECE`` characters). Cut into k + 1
pieces, at least one piece of it stands unchanged in any text that holds the item with k
errors or fewer. All pieces are looked for at once with an Aho-Corasick automaton over
each whole document; around each hit the item is verified with Myers' bit-parallel
distance. Nothing is missed: the search is exact for the budget. Items of fewer than
``MIN_ITEM`` characters are looked for as they are, as whole words, in the same automaton.

A benchmark is a written collection, some megabytes by nature. Its items are cut into
blocks of at most ``BLOCK_CHARS`` characters, whatever their number; each block is one
broadcast automaton and one pass over the documents, and the driver holds one at a time.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Errors allowed per character of an item.
RATE = 0.08
#: Characters in a piece, at least; items too short for two such pieces must occur unchanged.
MIN_PIECE = 8
#: Items of fewer normalised characters must occur unchanged, between word boundaries.
MIN_ITEM = 24
#: Characters of items in one automaton, at most (about 60 bytes of memory each).
BLOCK_CHARS = 4_000_000

_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, and one space for every run of other characters than letters and digits."""
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def budget(length: int, rate: float = RATE) -> int:
    """Errors allowed in an item of so many normalised characters."""
    return 0 if length < MIN_ITEM else max(0, min(max(1, int(length * rate)), length // MIN_PIECE - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of an item, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def best_match(size: int, mask: dict[str, int], text: str) -> tuple[int, int]:
    """Myers' algorithm: the least edit distance of a pattern to any part of ``text``, and the end of the first such part."""
    full, top = (1 << size) - 1, 1 << size - 1
    plus, minus, score, best, end = full, 0, size, size, 0
    for at, c in enumerate(text):
        eq = mask.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(d | plus)) & full
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best, end = score, at + 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = (down | ~(x | up)) & full, up & x
    return best, end


class Matcher:
    """All items of a block, and where they occur in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, text, k := budget(len(text), rate), masks(text), masks(text[::-1])) for i, text in items]
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text, errors, *_rest) in enumerate(self.items):
            # Texts are normalised with a space at either end, so these mark the boundaries of a short item.
            for offset, piece in pieces(text, errors) if len(text) >= MIN_ITEM else [(-1, f" {text} ")]:
                self.pieces.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if self.pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item id, errors, start, end)`` in the normalised text, for each item its best occurrence, the first among equals."""
        if not self.pieces:
            return []
        whole = f" {normalise(text)} "
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in self.automaton.iter(whole):
            for at, offset in places:
                _, item, errors, *_rest = self.items[at]
                if at in near and len(item) < MIN_ITEM:
                    continue  # the first occurrence is the best there is
                start = end + 1 - length - offset
                span = (max(0, start - errors), min(len(whole), start + len(item) + errors))
                spans = near.setdefault(at, [])
                if spans and span[0] <= spans[-1][1] and spans[-1][0] <= span[0]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], span[1]))
                else:
                    spans.append(span)
        found = []
        for at, spans in near.items():
            item_id, item, errors, mask, mirrored = self.items[at]
            best = None
            for low, high in sorted(set(spans)):
                if high - low < len(item) - errors:
                    continue
                distance, end = best_match(len(item), mask, whole[low:high])
                if distance <= errors and (best is None or distance < best[0]):
                    best = (distance, low + end)
            if best:
                length = best_match(len(item), mirrored, whole[max(0, best[1] - len(item) - errors) : best[1]][::-1])[1]
                found.append((item_id, best[0], max(0, best[1] - length - 1), best[1] - 1))
        return sorted(found)


@functools.lru_cache(maxsize=2)
def _matcher(spec: bytes) -> Matcher:
    return Matcher(*pickle.loads(spec))


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The distinct normalised items in blocks of bounded size, read one partition at a time."""
    rows = items.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null and text is not null").dropDuplicates().orderBy("key", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        item = normalise(r["text"])
        if not item:
            continue
        if block and size + len(item) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["key"], item))
        size += len(item)
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """``(key, item_id, errors, start, end)``: for each document the items it holds within their budget of edits.

    Positions are in the document's normalised text; of an item's best occurrences the first
    counts. Whole texts are searched, however long. Nulls and texts without letters or digits
    hold nothing and are held by nothing; a repeated document gives repeated rows; items with
    the same key and text count once, with the same key and other texts each. Without items,
    or without documents, there are no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    schema = "key long, item_id long, errors int, start long, end long"
    found = spark.createDataFrame([], schema)
    for block in _blocks(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(pickle.dumps((block, rate)))  # at most BLOCK_CHARS characters and one item

        def search(batches, shared=shared):
            matcher = _matcher(shared.value)
            for pdf in batches:
                rows = [(k, *hit) for k, t in zip(pdf["key"], pdf["text"]) if t for hit in matcher.find(t)]
                yield pd.DataFrame(rows, columns=["key", "item_id", "errors", "start", "end"])

        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null and text is not null")
        found = found.unionByName(rows.mapInPandas(search, schema))
    return found.withColumnRenamed("key", key)
