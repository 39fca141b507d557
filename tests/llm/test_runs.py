"""Periodic runs against a version that compares every word with the word a period later."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import periodic
from emberlog.llm.queries import queries


def plain_runs(words, min_words=6, min_periods=4):
    """(start, length, period) of all runs, period by period."""
    n, out = len(words), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            smaller = any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q))
            if end - start >= max(min_words, min_periods * q) and not smaller:
                out.append((start, end - start, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_row(doc_id, text, planted=True):
    """What the query has to return for a document."""
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if planted and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, top[0] is not None and 1000 * top[1] // top[2] or None, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(kept)))


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (1, 3)])
def test_runs_of_many_sequences(least):
    rng = random.Random(str(least))
    for _ in range(250):
        docs = []
        for _ in range(rng.randint(1, 5)):
            letters, words = rng.choice(["a", "ab", "abc", "abcdef"]), []
            while rng.random() < 0.85:
                words += [rng.choice(letters) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 2, 4, 5, 7])
            docs.append(words)
        codes, sizes = np.array([ord(c) for d in docs for c in d], np.int64), np.array([len(d) for d in docs])
        start, end, period = periodic.find_runs(codes, sizes, *least)
        bounds, got = np.concatenate([[0], np.cumsum(sizes)]), [[] for _ in docs]
        for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
            d = int(np.searchsorted(bounds, s, side="right")) - 1
            got[d].append((s - int(bounds[d]), e - s, q))
        assert got == [plain_runs(d, *least) for d in docs]


def test_rows_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 40), (4, "x " * 40), (None, "a b " * 9), (5, "é\u2003é " * 7 + "ß"), (6, "one two three"), (7, "a a a a a"), (8, "k l m k l m k l m k l m" + " n" * 6)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, runs string").repartition(3)
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted([(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()], key=repr)
    want = []
    for doc_id, text in rows:
        runs, words = plain_runs(words_of(text)), words_of(text)
        want.append((doc_id, runs, " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))))
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_one_long_document(spark):
    rng = random.Random(5)
    words = [rng.choice("abcdefgh") for _ in range(30_000)]
    words[9_000:21_000] = (words[:1_500] * 8)[:12_000]
    (row,) = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert max((r.length, r.period) for r in row.runs)[1] == 1_500
    for r in row.runs:
        s, e, q = r.start, r.start + r.length, r.period
        assert words[s : e - q] == words[s + q : e] and r.length >= max(6, 4 * q)
        assert (s == 0 or words[s - 1] != words[s - 1 + q]) and (e == len(words) or words[e] != words[e - q])


def test_query_is_the_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.length("text") < 6_000)
    want = {r.doc_id: plain_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    got = queries()["op11_periodic"](spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    found = [r for r in got if r.doc_id in want]
    assert found and any(r.n_runs for r in found)
    for r in found:
        assert tuple(r[c] for c in columns) == want[r.doc_id]
