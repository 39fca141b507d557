"""BPE, packing, language-model scores, decontamination, language ID and toxicity against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.llm import bpe, decontam, langid, lmscore, packing, toxicity
from emberlog.llm.queries import tokenizer_path

TEXTS = "doc_id long, text string, lang string, key string"


def docs_of(spark, rows):
    """Documents with an extra column whose name operators use inside."""
    return spark.createDataFrame([(*r, "x") if len(r) == 3 else (*r, "en", "x") for r in rows], TEXTS).repartition(3)


@pytest.fixture(scope="module")
def vocabulary():
    with open(tokenizer_path(), "rb") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("alphabet", ["ab é漢'st.0 \n", "ab  \n\té漢\U0001f600'st0՘\x1c\xa0\x01\0", "abéßé-_"])
def test_bpe_is_the_librarys(vocabulary, library, alphabet):
    rng = random.Random(3)
    extra = ["<|endoftext|>", " the", "'ll", "\n"] if " " in alphabet else []
    texts = ["".join(rng.choice([*alphabet, *extra]) for _ in range(rng.randint(0, 150))) for _ in range(600)]
    for text, packed in zip(texts, vocabulary.encode_all([*texts])):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert vocabulary.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_bpe_long_words_and_cuts(vocabulary, library):
    for text in ("aab" * 20_000, "éa" * 500 + " x", "a" * 41 + "é" * 41):
        assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    word = "éàüß" * 20
    assert "".join(vocabulary.fragments(word)) == word
    for left, right in zip(parts := vocabulary.fragments(word), parts[1:]):
        assert vocabulary.forced[left.encode()[-1], right.encode()[0]]


def test_bpe_invalid_bytes(vocabulary, library):
    ids = [i for i in range(50_000) if vocabulary.lengths[i] and vocabulary.bytes[vocabulary.starts[i]] >= 128][:400:3]
    assert vocabulary.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_bpe_columns(spark):
    shared = bpe.load(spark, tokenizer_path())
    docs = docs_of(spark, [(1, "Hello there"), (1, "Hello there"), (2, None), (3, ""), (None, "x")])
    rows = docs.select("doc_id", bpe.encode(F.col("text"), shared).alias("ids")).select("doc_id", "ids", bpe.n_tokens(F.col("ids")).alias("n"), bpe.decode(F.col("ids"), shared).alias("t")).collect()
    assert sorted((r.doc_id or -1, r.n, r.t) for r in rows) == [(-1, 1, "x"), (1, 2, "Hello there"), (1, 2, "Hello there"), (2, 0, ""), (3, 0, "")]
    assert docs.limit(0).select(bpe.encode(F.col("text"), shared)).count() == 0


def best_fit(lengths, seq_len):
    rooms, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [room for room in rooms if room >= lengths[i]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[i]
        else:
            rooms.append(seq_len - lengths[i])
    return sorted(rooms)


def test_packing_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        seq_len = rng.choice([8, 33, 64])
        lengths = [rng.randint(1, seq_len) for _ in range(rng.randint(0, 120))]
        packed = packing.pack(lengths, seq_len)
        assert sorted(i for s in packed for i in s) == list(range(len(lengths)))
        assert sorted(seq_len - sum(lengths[i] for i in s) for s in packed) == best_fit(lengths, seq_len)


def test_packing_is_lossless(spark, tmp_path):
    rng = random.Random(2)
    ids = {k: [rng.randrange(50_000) for _ in range(rng.choice([0, 1, 7, 16, 17, 100]))] for k in range(40)}
    packed = lambda v: bytearray(np.array(v, "<u4").tobytes())
    rows = [(k, packed(v), "x") for k, v in ids.items()] + [(99, None, "x"), (None, packed([5, 6]), "x"), (7, packed([1] * 300), "x"), (7, packed([1] * 300), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, ids binary, shard string").repartition(3)
    out = packing.write_packed(packing.pack_ids(docs, F.col("ids"), seq_len=16, shard_docs=7, shard_tokens=200), f"{tmp_path}/packed").collect()
    parts = {}
    for r in out:
        tokens, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(tokens) == len(positions) == 16 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for k, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(k, []).append((start, tokens[a:b].tolist()))
        assert not tokens[r.n_tokens :].any()
    pieces = lambda v: [(s, v[s : s + 16]) for s in range(0, len(v), 16)]
    expected = {k: pieces(v) for k, v in ids.items() if v} | {None: [(0, [5, 6])]}
    expected[7] = sorted(expected.get(7, []) + 2 * pieces([1] * 300))
    assert {k: sorted(p) for k, p in parts.items()} == expected
    # The same shards and sequences, however the documents are partitioned.
    other = packing.pack_ids(docs.repartition(5, "ids"), F.col("ids"), seq_len=16, shard_docs=7, shard_tokens=200).collect()
    assert sorted(map(str, out)) == sorted(map(str, other))
    assert packing.pack_ids(docs.limit(0), F.col("ids")).count() == 0


def test_packing_takes_small_batches(spark, tmp_path):
    """Ids of 16 MB in all, computed in Python from one partition: no batch is over 10 MB, and the session's setting is as before."""

    @F.arrow_udf("binary")
    def ids(keys: pa.Array) -> pa.Array:
        if keys.nbytes > 10_000_000:
            raise ValueError(f"a batch of {keys.nbytes} bytes")
        return pa.array([b"\1\0\0\0" for _ in keys], pa.binary())

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    docs = spark.range(1000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789abcdef"), 1000).alias("text"))
    out = packing.write_packed(packing.pack_ids(docs, ids(F.col("text"))), f"{tmp_path}/packed").collect()
    assert sorted(k for r in out for k in r.doc_ids) == list(range(1000)) and spark.conf.get(setting) == before


def held_out_losses(ids, chosen, size):
    """The mean loss of each document under a bigram model of the ``chosen`` others, counted one by one."""
    out = {}
    for k, v in ids.items():
        uni, ctx, big = {}, {}, {}
        for other in chosen:
            before = size
            for t in ids[other].tolist() if other != k else ():
                uni[t], ctx[before], big[before, t] = uni.get(t, 0) + 1, ctx.get(before, 0) + 1, big.get((before, t), 0) + 1
                before = t
        before, total = size, 0.0
        for t in v.tolist():
            p1 = (uni.get(t, 0) + lmscore.SMOOTH) / (sum(uni.values()) + lmscore.SMOOTH * size)
            w = lmscore.BIGRAM if ctx.get(before) else 0.0
            total -= np.log(w * big.get((before, t), 0) / max(1, ctx.get(before, 0)) + (1 - w) * p1)
            before = t
        out[k] = total / len(v) if len(v) else None
    return out


def test_lm_scores(spark):
    rng = np.random.default_rng(5)
    ids = {k: rng.integers(0, 9, rng.integers(0, 40)) for k in range(60)}
    rows = [(k, bytearray(v.astype("<u4").tobytes()), k % 3 == 0 if k % 7 else None, "x") for k, v in ids.items()]
    docs = spark.createDataFrame(rows, "doc_id long, ids binary, good boolean, chunk string").repartition(4)
    got = {r.doc_id: r for r in lmscore.score(docs, F.col("ids"), F.col("good"), 9).collect()}
    target, background = held_out_losses(ids, [k for k in ids if k % 3 == 0 and k % 7], 9), held_out_losses(ids, list(ids), 9)
    for k, v in ids.items():
        assert got[k].n_tokens == len(v)
        assert got[k].score == pytest.approx(target[k] - background[k] if len(v) else 0.0)
        assert (got[k].target_loss is None) == (len(v) == 0)
    assert lmscore.score(docs.limit(0), F.col("ids"), F.col("good"), 9).count() == 0


def test_lm_repeated_rows_nulls_and_keys(spark):
    packed = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    rows = [(1, packed(1, 2, 3), True), (1, packed(1, 2, 3), True), (None, packed(4, 4), None), (2, None, True), (3, packed(*[5] * 50_000), False)]
    docs = spark.createDataFrame(rows, "doc_id long, ids binary, good boolean").repartition(2)
    got = lmscore.score(docs, F.col("ids"), F.col("good"), 9).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 3), (1, 3), (2, 0), (3, 50_000)]
    assert {r.score < 0 for r in got if r.doc_id == 1} == {True} and {r.score for r in got if r.doc_id == 2} == {0.0}
    with pytest.raises(Exception, match="not below"):
        lmscore.score(docs, F.col("ids"), F.col("good"), 4).count()


def test_lm_bigrams_are_exact(spark):
    """More distinct bigrams (250 000) than could lie in a table of fixed size without some sharing a cell; no loss is below the entropy."""
    rng = np.random.default_rng(6)
    ids = [rng.integers(0, 3000, 5000) for _ in range(50)]
    docs = spark.createDataFrame([(k, bytearray(v.astype("<u4").tobytes()), k % 2 == 0) for k, v in enumerate(ids)], "doc_id long, ids binary, good boolean").repartition(4)
    got = {r.doc_id: r for r in lmscore.score(docs, F.col("ids"), F.col("good"), 3000).collect()}
    pairs = [np.concatenate([[3000], v[:-1]]) * 3001 + v for v in ids]
    for name, chosen in (("target_loss", range(0, 50, 2)), ("background_loss", range(50))):
        for k, v in enumerate(ids[:8]):
            others = [c for c in chosen if c != k]
            flat, keys = np.concatenate([ids[c] for c in others]), np.concatenate([pairs[c] for c in others])
            uni, big, ctx = np.bincount(flat, minlength=3000), np.bincount(keys, minlength=3001**2), np.bincount(keys // 3001, minlength=3001)
            total = ctx[pairs[k] // 3001]
            w = np.where(total > 0, lmscore.BIGRAM, 0.0)
            p = w * big[pairs[k]] / np.maximum(total, 1) + (1 - w) * (uni[v] + lmscore.SMOOTH) / (len(flat) + lmscore.SMOOTH * 3000)
            assert got[k][name] == pytest.approx(-np.log(p).mean(), rel=1e-9)
    assert np.mean([r.background_loss for r in got.values()]) >= np.log(3000)


def distance_within(item, text):
    """The least edit distance of an item to any part of a text, by dynamic programming."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, d in enumerate(item, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (d != c)))
        row, best = new, min(best, new[-1])
    return best


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", rng.choice("abcde "), text[i] + rng.choice("abcde")]) + text[i + 1 :]
    return text


def test_myers_distance():
    rng = random.Random(4)
    for _ in range(150):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) + edited(rng, item, rng.randint(0, 9)) + "cab"
        assert decontam.best_match(len(item), decontam.masks(item), text)[0] == distance_within(item, text)


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 30)))) for i in range(11)] + [(11, " ".join(word() for _ in range(25)))] + [(50, None), (51, ""), (52, "short")]
    docs = []
    for k in range(80):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        if k % 2:
            text += " " + edited(rng, items[k % 12][1], k % 7 * 2).upper() + "\n\n" + " ".join(word() for _ in range(20))
        docs.append((k, text))
    docs += [(80, None), (81, ""), (1, docs[1][1]), (82, "A SHORT; word"), (83, "shorts, ashort")]
    table = spark.createDataFrame(items, "item_id long, text string").unionByName(spark.createDataFrame(items[:2], "item_id long, text string"))
    found = [(r.doc_id, r.item_id, r.errors) for r in decontam.contamination(docs_of(spark, docs), table).collect()]
    expected = []
    for k, text in docs:
        for i, item in items:
            item = decontam.normalise(item)
            whole = f" {decontam.normalise(text)} "
            if len(item) >= decontam.MIN_ITEM:
                d = distance_within(item, whole)
                if d <= decontam.budget(len(item)):
                    expected.append((k, i, d))
            elif item and f" {item} " in whole:
                expected.append((k, i, 0))
    assert sorted(found) == sorted(expected) and len(expected) > 20 and (82, 52, 0) in expected
    long = docs_of(spark, [(7, f"{'filler ' * 60_000}{edited(rng, items[11][1], 1)} {'filler ' * 60_000}short")])
    assert {(r.item_id, r.errors <= 1) for r in decontam.contamination(long, table.where("item_id in (10, 11, 52)")).collect()} == {(11, True), (52, True)}
    assert decontam.contamination(docs_of(spark, docs).limit(0), table).count() == 0
    assert decontam.contamination(docs_of(spark, docs), table.limit(0)).count() == 0


def language_rows(rng, n):
    syllables = {"en": ["the", "ing", "wh", "sh", "th"], "de": ["sch", "ung", "ein", "ü", "ch"], "fr": ["eau", "que", "é", "ou", "ai"]}
    text = lambda k: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(30))
    return [(i, text(k), k) for i, k in ((i, rng.choice(list(syllables))) for i in range(n))], text


def test_language_mixtures(spark):
    rows, text = language_rows(random.Random(8), 150)
    model = langid.fit(docs_of(spark, [*rows, (900, None, "en"), (901, "the", None), (902, "123", "xx")]))
    assert sorted(model.languages) == ["de", "en", "fr"]
    mixed = text("de") + ". " + text("de") + ". " + text("fr")
    cases = [(0, text("en"), ""), (1, mixed, ""), (2, None, ""), (3, "", ""), (4, "12 345 !", ""), (5, (text("fr") + " ") * 300, "")]
    got = {r.doc_id: r.f for r in docs_of(spark, cases).select("doc_id", langid.identify(F.col("text"), model, spark).alias("f")).collect()}
    assert got[0].lang == "en" and got[0].languages == ["en"] and got[5].lang == "fr"
    assert got[1].languages == ["de", "fr"] and got[1].score == pytest.approx(2 / 3, abs=0.1)
    assert all(got[k] == (langid.UNKNOWN, 0.0, []) for k in (2, 3, 4))
    assert langid.fit(docs_of(spark, rows).limit(0)).predict("the") == (langid.UNKNOWN, 0.0)


def test_mixture_proportions_are_likeliest():
    rng = np.random.default_rng(1)
    likelihood, counts = rng.random((2, 50)), rng.integers(1, 9, 50)
    share, value = langid.mixture(likelihood, counts, 500)
    grid = [counts @ np.log(a * likelihood[0] + (1 - a) * likelihood[1]) for a in np.linspace(0.001, 0.999, 999)]
    assert value == pytest.approx(max(grid), abs=0.05) and share.sum() == pytest.approx(1)


def toxic_rows(rng, n):
    words = ["tree", "house", "river", "music", "paper", "stone", "cloud", "garden"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        text = [rng.choice(words) for _ in range(20)] + [str(rng.randrange(10**6)) for _ in range(6)]
        if toxic:
            text[5], text[9] = rng.choice(["awful", "nasty"]), "muslim" if rng.random() < 0.5 else "woman"
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows(random.Random(9), 300)
    table = spark.createDataFrame([*labels, (0, 1, 1), (None, 1, 1), (5000, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    fair = toxicity.fit(docs_of(spark, [*rows, (400, None)]), table)
    plain = toxicity.fit(docs_of(spark, rows), table, counterfactual=0.0)
    docs = docs_of(spark, [*rows, (400, None), (401, ""), (402, "the muslim house and the woman in the garden")])
    scores = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(F.col("text"), fair).alias("s")).collect()}
    assert all((scores[i] >= 0.5) == bool(t) for i, _, t in labels)
    assert scores[402] < 0.5 and 0 <= scores[400] == scores[401] <= 1
    gap = lambda m: abs(m.score("a muslim house") - m.score("a hindu house"))
    assert gap(fair) < gap(plain) / 2
    assert toxicity.fit(docs_of(spark, rows).limit(0), table).score("x") < 0.01


def test_swaps():
    found = toxicity.swaps("A woman sings. Nothing here")
    assert found == [({"a", "woman", "sings"}, {"a", "man", "sings"}), ({"a", "woman", "sings"}, {"a", toxicity.NEUTRAL, "sings"})]


def test_toxicity_on_few_labels(spark):
    """A dozen toxic texts are enough for words that all of them share, and none is made up where nothing tells the classes apart."""
    rng = random.Random(10)
    words = [f"w{rng.randrange(60)}" for _ in range(400)]
    text = lambda toxic: " ".join([*rng.sample(words, 15), *(["vile"] if toxic else [])])
    rows = [(i, text(i % 4 == 0)) for i in range(48)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(48)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, rows), labels)
    assert set(model.weights) == {"vile"} and all((model.score(t) >= 0.5) == (i % 4 == 0) for i, t in rows)
    noise = toxicity.fit(docs_of(spark, [(i, text(False)) for i in range(48)]), labels)
    assert noise.weights == {} and noise.score("anything") == pytest.approx(0.25, abs=1e-4)


def test_toxicity_copies_repeats_and_long_texts(spark):
    """Copies with both labels are toxic, whichever partition they are in; repeated rows change nothing; a text's end counts."""
    rows, labels = toxic_rows(random.Random(11), 200)
    twins = [(1000 + i, f"copied words of text number {i} and more of them awful") for i in range(6)]
    table = spark.createDataFrame([*((i, y) for i, _, y in labels), *((1000 + i, 1) for i in range(6)), *((2000 + i, 0) for i in range(6))], "doc_id long, toxic int")
    docs = [*rows, *twins, *((k + 1000, t) for k, t in twins)]
    models = [toxicity.fit(docs_of(spark, d).repartition(n), table) for d, n in ((docs, 2), (docs[::-1] + rows[:50], 5))]
    assert models[0].weights.keys() == models[1].weights.keys() and all(m.score(twins[0][1]) >= 0.5 for m in models)
    assert models[0].score("tree " * 200_000) < 0.5 <= models[0].score("tree " * 200_000 + "awful nasty")


def test_exact_probabilities():
    """The hypergeometric tails against a count of all samples."""
    from itertools import combinations

    n_bad, n_good = 4, 5
    for n in range(1, 9):
        draws = [sum(i < n_bad for i in c) for c in combinations(range(n_bad + n_good), n)]
        for b in range(max(0, n - n_good), min(n, n_bad) + 1):
            more = b * n_good >= (n - b) * n_bad
            tail = sum(d >= b if more else d <= b for d in draws) / len(draws)
            got = toxicity._log_tails(np.array([b]), np.array([n - b]), n_bad, n_good)[0]
            assert np.exp(got) == pytest.approx(min(1.0, 2 * tail))


def test_every_language_is_weighed():
    """Twelve languages, of which a document's second one is among the worst alone: it is found all the same."""
    rng = np.random.default_rng(2)
    base = rng.random((12, langid.CELLS)) ** 4 + 1e-4
    base[1:11] += 0.8 * base[0]  # close relatives of the first language
    model = langid.Model(tuple(f"l{k:02}" for k in range(12)), np.log(base / base.sum(axis=1, keepdims=True)).astype(np.float32))
    cells = np.concatenate([rng.choice(langid.CELLS, 900, p=base[k] / base[k].sum()) for k in (0, 0, 11)])
    found, counts = np.unique(cells, return_counts=True)
    real, langid.grams = langid.grams, lambda text: (found, counts)
    try:
        got = model.proportions("text")
    finally:
        langid.grams = real
    alone = np.argsort(-(model.log_p[:, found] @ counts))
    assert list(alone).index(11) >= 6 and list(got)[:2] == ["l00", "l11"] and got["l11"] == pytest.approx(1 / 3, abs=0.08)


@pytest.mark.parametrize("text", ["\u00b2", "\u00bd 12", "\u2460", "\u2167", "1 2 3", "!", "\u0660"])
def test_no_letters_no_language(text):
    model = langid.Model(("en",), np.zeros((1, langid.CELLS), np.float32))
    assert model.predict(text) == (langid.UNKNOWN, 0.0) and model.predict(f"{text} a")[0] == "en"
