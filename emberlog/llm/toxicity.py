"""Toxicity: a counterfactually regularised classifier over the words and word beginnings of whole texts.

Training works on a bounded sample of labelled rows (``MAX_LABELLED``, a documented
parameter). Spark counts in how many toxic and other sample texts each word occurs and
keeps the words that tell the classes apart, by an exact test whose threshold follows the
number of words tried (a false discovery rate), so that a few dozen labelled texts give
few features and many give more. A logistic regression over their presence is then fitted. Identity
terms are always features. Every labelled sentence that holds one is also written with
each other term of its group in the place, and with a neutral word, and the squared
change of the score's log odds is added to the loss: a group's mention alone cannot move
the score much, whichever group it is.

Scoring reads each whole text once in Arrow batches, without a shuffle; what it needs is
a weight for each of at most ``MAX_FEATURES`` words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from emberlog.llm.common import checkpointed, stored

#: Labelled rows used for the fit, at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Words with a weight, at most, besides the identity terms.
MAX_FEATURES = 2_000
#: Words in fewer sample texts are not tried: no share of theirs could be told from chance.
MIN_TEXTS = 3
#: Of the feature words, so many are expected to be there by chance.
FALSE_DISCOVERIES = 0.05
#: Characters of a longer word's beginning, which is a feature of its own.
STEM = 5

# Identity terms by group; within a group any term can stand for another.
IDENTITY_GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "heterosexual", "homosexual"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("girl", "boy"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "refugee", "migrant", "foreigner"),
    ("immigrants", "refugees", "migrants", "foreigners"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish"),
)

#: Stands in for any group; it has no weight.
NEUTRAL = "someone"

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def with_stems(words: set[str]) -> set[str]:
    """``words`` and, for the forms of a word that were not seen in training, the beginnings of longer ones, marked with ``*``."""
    return words | {f"{w[:STEM]}*" for w in words if len(w) > STEM and w != NEUTRAL}


def words_of(text: str | None) -> set[str]:
    return with_stems(set(_WORD.findall(text.lower()))) if text else set()


def swaps(text: str | None, groups=IDENTITY_GROUPS) -> list[tuple[set[str], set[str]]]:
    """For each sentence with an identity term: its words, and its words with the term swapped, once for each other term of the group and as often for ``NEUTRAL``."""
    others = {term: [x for t in group if t != term for x in (t, NEUTRAL)] for group in groups for term in group}
    found = []
    for sentence in _SENTENCE.split((text or "").lower()):
        words = set(_WORD.findall(sentence))
        for term in sorted(words & others.keys()):
            found += [(with_stems(words), with_stems(words - {term} | {other})) for other in others[term]]
    return found


@dataclass(frozen=True)
class Model:
    """Weight of each word's presence, and the bias; ``score`` is the logistic of their sum."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        total = self.bias + sum(self.weights[w] for w in words_of(text) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit_rows(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], size: int, l2: float = 0.000002, counterfactual: float = 3.0, steps: int = 900) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise class-balanced log loss + ``l2`` |w|^2 + ``counterfactual`` mean (w . (x' - x))^2, by gradient descent with step sizes adapted to each weight (Adam)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(at) else np.empty(0, np.int64)
    changed = [(k, j, s) for k, (x, y) in enumerate(pairs) for j, s in [*((j, -1.0) for j in set(x) - set(y)), *((j, 1.0) for j in set(y) - set(x))]]
    pk, pj, ps = (np.array(c) for c in zip(*changed)) if changed else (np.empty(0, int), np.empty(0, int), np.empty(0))
    y = labels.astype(float)
    toxic = max(y.sum(), 1.0)
    weight = np.where(y == 1, 0.5 / toxic, 0.5 / max(len(y) - y.sum(), 1.0))
    # The last entry is the bias.
    w, mean, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, w[col], len(rows)) + w[size]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.append(np.bincount(col, g[at], size) + 2 * l2 * w[:size], g.sum())
        if len(pk):
            moved = np.bincount(pk, ps * w[pj], len(pairs))
            gw[:size] += 2 * counterfactual * np.bincount(pj, ps * moved[pk], size) / len(pairs)
        mean, square = 0.9 * mean + 0.1 * gw, 0.99 * square + 0.01 * gw * gw
        w -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:size], float(w[size])


def _log_tails(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """For words in ``bad`` of ``n_bad`` toxic and ``good`` of ``n_good`` other texts: log of the two-sided exact (hypergeometric) probability of shares that far apart."""
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n_bad + n_good + 1)))])
    choose = lambda n, k: logs[n] - logs[k] - logs[n - k]
    out = np.empty(len(bad))
    for i, (b, g) in enumerate(zip(bad.tolist(), good.tolist())):
        n = b + g
        low, high = max(0, n - n_good), min(n, n_bad)
        k = np.arange(b, high + 1) if b * n_good >= g * n_bad else np.arange(low, b + 1)
        terms = choose(n_bad, k) + choose(n_good, n - k) - choose(n_bad + n_good, n)
        out[i] = min(0.0, np.log(2) + terms.max() + np.log(np.exp(terms - terms.max()).sum()))
    return out


def _telling(counts: pd.DataFrame, n_bad: int, n_good: int) -> pd.DataFrame:
    """Of ``counts(bad, good, words)`` those that tell the classes apart at the false discovery rate (the step-up rule of Benjamini and Hochberg), the surest first."""
    counts = counts.assign(p=_log_tails(counts["bad"].to_numpy(), counts["good"].to_numpy(), n_bad, n_good)).sort_values(["p", "bad", "good"], ignore_index=True)
    rank = counts["words"].cumsum()
    passed = np.flatnonzero(counts["p"] <= np.log(FALSE_DISCOVERIES) + np.log(rank) - np.log(max(1, counts["words"].sum())))
    return counts[: passed[-1] + 1 if len(passed) else 0]


def _distinct_sample(labelled: DataFrame) -> DataFrame:
    """The bounded sample ``(label, words)``, copies reduced to one: an equal least hash of eight-word runs, by either of two orders, means a shared text. Of copies with both labels a toxic one stays."""

    def read(batches):
        for pdf in batches:
            out = []
            for t, y in zip(pdf["text"], pdf["label"]):
                words = _WORD.findall(t.lower())
                runs = [xxh3_64_intdigest(" ".join(words[i : i + 8])) >> 1 for i in range(max(1, len(words) - 7))]
                out.append((int(y), sorted(with_stems(set(words))), min(runs), min(h ^ 0x5DEECE66D5DEECE6 for h in runs)))
            yield pd.DataFrame(out, columns=["label", "words", "sketch_a", "sketch_b"])

    rows = labelled.mapInPandas(read, "label int, words array<string>, sketch_a long, sketch_b long")
    for sketch in ("sketch_a", "sketch_b"):
        rows = rows.groupBy(sketch).agg(F.max(F.struct("label", *(c for c in ("sketch_b", "words") if c != sketch))).alias("r")).select(sketch, "r.*")
    return rows.select("label", "words")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", groups=IDENTITY_GROUPS, max_labelled: int = MAX_LABELLED, counterfactual: float = 3.0) -> Model:
    """The classifier learnt from ``docs`` whose key has a label of 0 or 1 in ``labels``.

    Of a key with several labels, and of copies of a text with both, the toxic one counts;
    copies and repeated rows count once. Whole texts are read, however long. Rows with null
    keys, texts or labels teach nothing, empty texts only that they are not toxic. Without a
    toxic or without another row, or where no word tells them apart, every score is the
    share of toxic rows (0 if there are none at all). Other columns are not read.
    """
    names = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label")).where("key is not null")
    chosen = names.orderBy(F.xxhash64("key"), "key").limit(max_labelled)
    labelled = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "key").select("text", "label")
    labelled = labelled.persist()
    try:
        rows = stored(_distinct_sample(labelled))
        sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        rate = bad / max(1, bad + good)
        alike = Model({}, float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
        if not bad or not good:
            return alike
        counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        counts = checkpointed(counts.where((F.col("bad") + F.col("good") >= MIN_TEXTS) & (F.col("word") != NEUTRAL)))
        pairs = counts.groupBy("bad", "good").agg(F.count("*").alias("words")).toPandas()  # fewer than max_labelled squared, in effect some thousands
        telling = _telling(pairs, bad, good)
        if not len(telling):
            return alike
        sure = F.broadcast(docs.sparkSession.createDataFrame(telling[["bad", "good", "p"]], "bad long, good long, p double"))
        features = [r["word"] for r in counts.join(sure, ["bad", "good"]).orderBy("p", "word").limit(MAX_FEATURES).collect()]
        terms = sorted({t for g in groups for t in g})
        index = {w: i for i, w in enumerate(dict.fromkeys([*features, *terms]))}

        def encoded(batches):
            for pdf in batches:
                yield pd.DataFrame({"label": pdf["label"], "found": pd.Series([[index[w] for w in words if w in index] for words in pdf["words"]], dtype=object)})

        def swapped(batches):
            for pdf in batches:
                both = [([index[w] for w in x if w in index], [index[w] for w in y if w in index]) for t in pdf["text"] for x, y in swaps(t, groups)]
                yield pd.DataFrame({"x": [sorted(x) for x, _ in both], "y": [sorted(y) for _, y in both]}, dtype=object)

        sample = rows.mapInPandas(encoded, "label int, found array<int>").toPandas()
        pairs = labelled.mapInPandas(swapped, "x array<int>, y array<int>").distinct().orderBy(F.xxhash64("x", "y")).limit(max_labelled).collect()
        order = sorted(range(len(sample)), key=lambda i: (int(sample["label"][i]), list(sample["found"][i])))
        w, b = fit_rows([list(sample["found"][i]) for i in order], sample["label"].to_numpy()[order], [(p["x"], p["y"]) for p in pairs], len(index), counterfactual=counterfactual)
        return Model({word: float(w[i]) for word, i in index.items() if abs(w[i]) > 1e-9}, b)
    finally:
        labelled.unpersist()


def score(text: Column, model: Model) -> Column:
    """Double column from 0 to 1: higher means likelier toxic. Whole texts count, however long; null and empty ones are scored as texts without words."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return of(text.cast("string"))
