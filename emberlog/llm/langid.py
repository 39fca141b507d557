"""Language identification as inference of a mixture of languages.

Each language has a model of byte n-grams (hashed into a fixed number of cells, add-k
smoothed). A document is taken as a mixture: every n-gram comes from one of a set of
languages with unknown proportions. Expectation-maximisation estimates the proportions;
the set grows one language at a time while the log likelihood rises by more than a
penalty of half the log of the number of n-grams for each further language.

Every language that is still outside the set is weighed for each document. The log
likelihood is concave in the proportions, so its slope toward a language bounds what that
language can add: those that can't add the penalty are passed over, and nothing is lost.

The models are fitted on a bounded sample of each language (``MAX_TEXTS``, a documented
parameter), for every language that is named; every whole text is then judged in Arrow
batches, without a shuffle. The models take ``CELLS`` floats (256 KB) a language, whatever
the size of the corpus, and are broadcast: languages are a closed list by nature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts of each language used for the fit, at most: those with the smallest hash of their id.
MAX_TEXTS = 3_000
#: Hash cells for n-grams.
CELLS = 1 << 16
#: Bytes in an n-gram.
GRAM = 4
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of the n-grams of a text; letters are folded to lower case, all else is one space."""
    folded = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    folded = folded[np.concatenate([[True], (folded[1:] != 32) | (folded[:-1] != 32)])]
    if len(folded) < GRAM:
        folded = np.concatenate([folded, np.full(GRAM - len(folded), 32, np.uint8)])
    n = len(folded) - GRAM + 1
    key = np.zeros(n, np.uint32)
    for k in range(GRAM):
        key = (key << np.uint32(8)) | folded[k : k + n]
    cells = (key * np.uint32(2654435761)) >> np.uint32(16)
    counts = np.bincount(cells, minlength=CELLS) if n > CELLS // 8 else None
    if counts is None:
        return np.unique(cells, return_counts=True)
    found = np.nonzero(counts)[0]
    return found, counts[found]


def mixture(likelihood: np.ndarray, counts: np.ndarray, steps: int = 25) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``likelihood`` (languages by n-grams) by expectation-maximisation, and their log likelihood."""
    share = np.full(len(likelihood), 1 / len(likelihood))
    if len(share) > 1:
        total = counts.sum()
        for _ in range(steps):
            joint = share[:, None] * likelihood
            new = (joint / joint.sum(axis=0)) @ counts / total
            settled = np.abs(new - share).max() < 1e-4
            share = new
            if settled:
                break
    return share, float(counts @ np.log(share @ likelihood))


@dataclass(frozen=True)
class Model:
    """``log_p``: languages by cells."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    def proportions(self, text: str | None, penalty: float = 0.5) -> dict[str, float]:
        """Language proportions of a text: those of the set with the best penalised likelihood. Empty without letters or languages."""
        if not text or not self.languages or not _LETTER.search(text):
            return {}
        cells, counts = grams(text)
        log_p = self.log_p[:, cells].astype(float)
        first = int(np.argmax(log_p @ counts))
        likelihood = np.exp(log_p - log_p.max(axis=0))
        chosen, share, best = [first], np.ones(1), float(counts @ np.log(likelihood[first]))
        total = counts.sum()
        cost = penalty * np.log(total + 1.0)
        while len(chosen) < len(likelihood):
            # No set of proportions gains more than the steepest slope from here, a language alone no more than its own (or what the chosen have left to settle).
            slope = likelihood @ (counts / (share @ likelihood[chosen])) - total
            hopeful = np.flatnonzero(np.maximum(slope, slope[chosen].max()) > cost)
            tried = [(mixture(likelihood[[*chosen, k]], counts, 6)[1], -int(k)) for k in hopeful if k not in chosen]
            if not tried:
                break
            k = -max(tried)[1]
            new, value = mixture(likelihood[[*chosen, k]], counts)
            if value - best <= cost:
                break
            chosen, share, best = [*chosen, k], new, value
        return {self.languages[k]: float(s) for k, s in sorted(zip(chosen, share), key=lambda x: (-x[1], x[0]))}

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.proportions(text)
        return next(iter(found.items()), (UNKNOWN, 0.0))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_texts: int = MAX_TEXTS, smooth: float = 0.02) -> Model:
    """Models of all languages that ``docs`` names.

    Whole texts are read, however long; repeated rows count as often as the sample
    holds them. Rows with a null language or text, or no letter, teach
    nothing; with none left the model knows no language. Other columns are not read.
    """
    named = docs.select(F.xxhash64(key, text).alias("at"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    languages = list(sizes)
    if not languages:
        return Model((), np.zeros((0, CELLS), np.float32))
    # Of each language a hash range that holds a few times as many rows as are wanted, then exactly those first in it: no language is sorted whole.
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, 2.0 * max_texts / n + 50 / n)) for k, n in sizes.items()], "lang string, share double")
    near = named.join(F.broadcast(shares), "lang").where((F.pmod("at", F.lit(1_000_003)) / 1_000_003.0) < F.col("share"))
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("at", F.lit(1_000_003)), "at"))).where(F.col("rank") <= max_texts)
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(number), CELLS), np.int64)
        for pdf in batches:
            for t, k in zip(pdf["text"], pdf["lang"]):
                if _LETTER.search(t):
                    cells, counts = grams(t)
                    total[number[k], cells] += counts
        at, cell = np.nonzero(total)
        yield pd.DataFrame({"number": at.astype(np.int32), "cell": cell.astype(np.int32), "n": total[at, cell]})

    counted = first.select("text", "lang").mapInPandas(count, "number int, cell int, n long").groupBy("number", "cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), CELLS))
    table[counted["number"], counted["cell"]] = counted["n"]
    known = table.sum(axis=1) > 0
    smoothed = table[known] + smooth
    log_p = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
    return Model(tuple(k for k, on in zip(languages, known) if on), log_p.astype(np.float32))


def identify(text: Column, model: Model, spark) -> Column:
    """Struct column ``(lang, score, languages)``: the language with the largest proportion, that proportion, and all languages of the chosen set.

    Whole texts count, however long; each row is judged by itself, so repeated rows give
    repeated results. Null and empty texts and texts without a letter (Unicode category L)
    give ``und``, 0 and no languages.
    """
    shared = spark.sparkContext.broadcast(model)  # CELLS floats a language

    @F.arrow_udf("lang string, score double, languages array<string>")
    def of(texts: pa.Array) -> pa.Array:
        found = [shared.value.proportions(t.as_py()) for t in texts]
        first = [next(iter(f.items()), (UNKNOWN, 0.0)) for f in found]
        return pa.StructArray.from_arrays(
            [pa.array([k for k, _ in first], pa.string()), pa.array([min(1.0, s) for _, s in first], pa.float64()), pa.array([list(f) for f in found], pa.list_(pa.string()))],
            names=["lang", "score", "languages"],
        )

    return of(text.cast("string"))
