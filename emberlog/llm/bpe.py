"""Byte-pair encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be joined: it marks a
certain cut. Texts are cut at those of these boundaries that the pre-token pattern cannot
see across either: before a single space or newline between other characters (no token
holds the pair of another byte and a space), and between letters. The fragments are
encoded independently, each different one of a batch once, and their ids are
concatenated; the result equals encoding the whole text. Only texts that hold the two
control characters used as marks, special tokens or letters newer than the tokenizer are
one fragment (special tokens cut them), encoded by the same merges.

Fragments are merged by a compiled BPE library from the vocabulary's own ranks. The file
(``tokenizers`` JSON, byte-level BPE) is read on the driver and broadcast: its size is
fixed by the tokenizer, not by the data. All work on texts is in Arrow batches on the
executors, without a shuffle.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: the published byte-level pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of text handled at a time, at most, beyond one text.
CHUNK_CHARS = 4_000_000
#: Characters that a text cut into words doesn't hold: one marks cuts, the other parts distinct words.
_MARK, _SEPARATOR = "\1", "\0|\0"
#: White space besides single spaces and newlines.
_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
#: What sends a text the slower way to its cuts: other white space than single spaces and newlines.
_ODD = ("  ", "\n\n", " \n", "\n ", *_SPACES)
#: Where a text with other white space is cut: before a single space or newline between other characters.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


#: Bytes that letters are made of, and others beyond ASCII.
_LETTER_BYTES = np.array([chr(b).isalpha() or b >= 0x80 for b in range(256)])


def _byte_symbols() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in shown}
    symbols.update({b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in symbols)})
    return [symbols[b] for b in range(256)]


def _ranges(chars: list[str]) -> Iterator[str]:
    start = last = None
    for c in [*chars, None]:
        if c is not None and last is not None and ord(c) == ord(last) + 1:
            last = c
            continue
        if start is not None:
            yield f"{start}-{last}"
        start = last = c


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Vocabulary:
    """A byte-level BPE vocabulary: texts to packed ids (little-endian unsigned 32 bit) and back."""

    def __init__(self, spec: bytes):
        config = json.loads(spec)
        pre, model = config["pre_tokenizer"] or {}, config["model"]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in config["added_tokens"])
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or config["normalizer"] or model.get("ignore_merges") or not plain:
            raise ValueError("a plain byte-level BPE tokenizer file is needed")
        byte_of = {s: b for b, s in enumerate(_byte_symbols())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        id_of = {raw(token): i for token, i in model["vocab"].items()}
        merged = [raw(m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)) for m in model["merges"]]
        by_rank = [*(bytes([b]) for b in range(256)), *merged]
        self.id_of_rank = np.array([id_of[t] for t in by_rank] + [0], "<u4")
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.separator = len(by_rank)
        self.fast = tiktoken.Encoding("fragments", pat_str=PRE_TOKEN, mergeable_ranks={t: r for r, t in enumerate(by_rank)}, special_tokens={_SEPARATOR: self.separator})
        #: By both bytes of a pair: whether no token holds it.
        self.forced = np.ones((256, 256), bool)
        for token in id_of:
            for pair in zip(token, token[1:]):
                self.forced[pair] = False
        # No token holds a space after the last byte of another character: those of wide spaces apart, that pair is forced.
        self.cuts_at_space = not any(re.search(r"\S[ \n]", token.decode("utf-8", "replace")) for token in id_of)
        tokens = {i: t for t, i in id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        size = max(tokens) + 1
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(size)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        # Letters and digits newer than the tokenizer's Unicode tables are no letters to it.
        letter = regex.compile(r"[\p{L}\p{N}]")
        newer = [c for c in map(chr, range(0x80, 0x40000)) if unicodedata.category(c) == "Cn" and letter.match(c)]
        self.newer = self.beyond = None
        if newer:
            known = "[" + "".join(_ranges(newer)) + "]"
            self.newer, self.beyond = re.compile(known), re.compile(f"[{newer[0]}-\U0010ffff]")
            older = PRE_TOKEN.replace(r" ?\p{L}+", rf" ?(?:(?!{known})\p{{L}})+").replace(r" ?\p{N}+", rf" ?(?:(?!{known})\p{{N}})+").replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|{known})+")
            self.older = tiktoken.Encoding("older", pat_str=older, mergeable_ranks={t: r for r, t in enumerate(by_rank)}, special_tokens={})

    def _holds_newer(self, text: str) -> bool:
        return self.newer is not None and not text.isascii() and bool(self.beyond.search(text)) and bool(self.newer.search(text))

    def fragments(self, word: str) -> list[str]:
        """A word, cut between letters at byte pairs that no token holds."""
        at = [i for i in range(1, len(word)) if word[i - 1].isalpha() and word[i].isalpha() and self.forced[word[i - 1].encode()[-1], word[i].encode()[0]]]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)])]

    def _may_be_cut(self, words: pa.Array) -> np.ndarray:
        """Which words hold a forced byte pair at the start of a character, between what may be letters."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        left, right = data[:-1], data[1:]
        at = np.flatnonzero(self.forced[left, right] & _LETTER_BYTES[left] & _LETTER_BYTES[right] & ((right < 0x80) | (right >= 0xC0))) + 1
        word = np.searchsorted(offsets, at, side="right") - 1
        out = np.zeros(len(words), bool)
        out[word[(at > offsets[0]) & (offsets[np.maximum(word, 0)] != at)]] = True
        return out

    def _single(self, text: str) -> np.ndarray:
        """Ids of a text that isn't cut into words."""
        merged = lambda t: self.id_of_rank[np.array((self.older if self._holds_newer(t) else self.fast).encode_ordinary(t), np.int64)]
        if not any(s in text for s in self.special):
            return merged(text)
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
        return np.concatenate([np.array([self.special[p]], "<u4") if p in self.special else merged(p) for p in parts])

    def _cuttable(self, text: str) -> bool:
        return self.cuts_at_space and "\0" not in text and _MARK not in text and not any(s in text for s in self.special) and not self._holds_newer(text)

    @staticmethod
    def _marked(text: str) -> str:
        """A text with its cuts at spaces and newlines marked."""
        if text[0] in " \n" or text[-1] in " \n" or any(s in text for s in _ODD):
            return _CUT.sub(_MARK, text)
        return text.replace(" ", _MARK + " ").replace("\n", _MARK + "\n")

    def _words(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that can be cut, by their distinct words."""
        marked = [self._marked(t) for t in texts]
        split = pc.split_pattern(pa.array(marked, pa.large_string()), _MARK)
        coded = split.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
        sizes = np.ones(len(words), np.int64)
        forced = self._may_be_cut(words)
        if forced.any():
            cut = [self.fragments(w) for w in words.filter(pa.array(forced)).to_pylist()]
            sizes[forced] = [len(c) for c in cut]
            words = pc.replace_with_mask(words, pa.array(forced), pa.array([_SEPARATOR.join(c) for c in cut], pa.string()))
        whole = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), _SEPARATOR)[0].as_py()
        ranks = self.fast.encode_to_numpy(whole, allowed_special={_SEPARATOR}, disallowed_special=()).astype(np.int64)
        cuts = np.flatnonzero(ranks == self.separator)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], cuts - np.arange(len(cuts)), [len(ranks) - len(cuts)]])[firsts]
        ids = self.id_of_rank[ranks[ranks != self.separator]]
        lengths = np.diff(bounds)[at]
        flat = _gather(ids, bounds[:-1][at], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[split.offsets.to_numpy()].tolist()
        return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Packed ids of each text; null counts as empty. A special token's string in a text becomes that token, as in the tokenizers library."""
        held: list[tuple[str, bool]] = []
        size = 0

        def flush() -> Iterator[bytes]:
            found = iter(self._words([t for t, cut in held if cut]) if any(c for _, c in held) else ())
            for t, cut in held:
                yield next(found) if cut else self._single(t).tobytes() if t else b""

        for text in texts:
            text = text or ""
            held.append((text, bool(text) and self._cuttable(text)))
            size += len(text)
            if size >= CHUNK_CHARS:
                yield from flush()
                held, size = [], 0
        yield from flush()

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, packed: bytes | None) -> str | None:
        """The text of packed ids, special tokens kept; bytes that are not UTF-8 become U+FFFD."""
        if packed is None:
            return None
        ids = np.frombuffer(packed, "<u4")
        return _gather(self.bytes, self.starts[ids], self.lengths[ids]).tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def _vocabulary(spec: bytes) -> Vocabulary:
    return Vocabulary(spec)


def load(spark: SparkSession, path: str):
    """The tokenizer file at ``path``, broadcast (a fixed size, about 2 MB for 50 thousand tokens)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(text: Column, vocabulary) -> Column:
    """Binary column: the ids of each whole text as little-endian unsigned 32-bit integers, however long it is.

    Null and empty texts give empty ids. A column, so repeated rows give repeated results, an
    empty table none, and no other column is read.
    """

    @F.arrow_udf("binary")
    def to_ids(texts: pa.Array) -> pa.Array:
        v = _vocabulary(vocabulary.value)
        return pa.array(v.encode_all(t.as_py() for t in texts), pa.binary())

    return to_ids(text.cast("string"))


def decode(ids: Column, vocabulary) -> Column:
    """String column: the text of packed ids; null stays null, an id outside the vocabulary is an error."""

    @F.arrow_udf("string")
    def to_text(packed: pa.Array) -> pa.Array:
        v = _vocabulary(vocabulary.value)
        return pa.array([v.decode(p.as_py()) for p in packed], pa.string())

    return to_text(ids)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
