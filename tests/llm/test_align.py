"""Cross-tokenizer alignment against the libraries' own tokens and all pairs of byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import align
from emberlog.llm.queries import queries, tokenizer_path


@pytest.fixture(scope="module")
def specs():
    return tuple(open(tokenizer_path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """What a text has to give: (n_a, n_b, n_groups, n_links, n_group_links, groups, links); None without tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path())
    one.encode_special_tokens = True
    shown = {ord(c): b for b, c in enumerate(align.bpe._byte_symbols())}
    other = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))

    def of(text):
        if not text:
            return None
        raw = (" " + text).encode()
        a, b = one.encode(" " + text, add_special_tokens=False), other.encode(text)
        bytes_a = [bytes(shown[ord(c)] for c in t) for t in a.tokens]
        pieces = [other.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:-1], 16)]) if other.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        span = lambda parts: list(zip(np.cumsum([0, *map(len, parts)]).tolist(), np.cumsum([len(p) for p in parts]).tolist()))
        spans_a, spans_b = span(bytes_a), span(bytes_b)
        ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups, pairs = [], 0
        for low, high in zip([0, *ends], ends):
            x, y = ([i for i, (_, e) in zip(ids, spans) if low < e <= high] for ids, spans in ((a.ids, spans_a), (b, spans_b)))
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            pairs += len(x) * len(y)
        links = Counter((i, j) for i, (s, e) in zip(a.ids, spans_a) for j, (t, f) in zip(b, spans_b) if max(s, t) < min(e, f))
        return len(a.ids), len(b), len(ends), sum(links.values()), pairs, ";".join(groups), links

    return of


def test_products_of_sparse_rows():
    rng = np.random.default_rng(1)
    for block in (1, 7, 10_000):
        for _ in range(30):
            x, y = rng.random((rng.integers(1, 9), 8)) < 0.3, rng.random((8, rng.integers(1, 9))) < 0.3
            left, right = (align.Rows.of(*np.nonzero(m), m.shape[0]) for m in (x, y))
            dense = np.zeros((x.shape[0], y.shape[1]), int)
            for row, column, value in align.row_products(left, right, block):
                dense[row, column] += value
            assert (dense == x.astype(int) @ y.astype(int)).all()
            assert (align.product_sizes(left, right) == dense.sum(axis=1)).all()
            back = left.transposed(8).transposed(x.shape[0])
            assert (back.starts == left.starts).all() and (back.columns == left.columns).all()


def test_texts_are_aligned_as_the_libraries_do(specs, plain):
    rng = random.Random(2)
    letters = ["a", "b", " ", "  ", "é", "漢", " the", "ing", "\n", "\t", "<|endoftext|>", "<s>", "0", "st", "\x00", "\U0001f600", "\xa0"]
    texts = [None, "", " ", "▁", "a▁b", "  a  b ", "<unk>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    rows = zip(*(c.to_pylist() for c in align.align_texts(texts, *align._tokenizers(*specs))))
    without = 0
    for text, row in zip(texts, rows):
        want = plain(text)
        if want is None:
            without += 1
            assert row == (0, 0, 0, 0, 0, "", [])
        else:
            assert row[:6] == want[:6] and {(x["a"], x["b"]): x["n"] for x in row[6]} == want[6]
    assert without < 100


def corpus_rows(texts, plain):
    """n_best and count_sum of every text."""
    found = [plain(t) for t in texts]
    docs = Counter(pair for f in found if f for pair in f[6])
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    return [(sum(n for p, n in f[6].items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in f[6].items())) if f else (0, 0) for f in found]


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_counts_over_the_corpus(spark, specs, plain, monkeypatch, broadcast):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", broadcast)
    texts = ["The tokenization of words", "The tokenization of words", None, "", "tokens unify", "unify▁", "untokenized wording " * 30]
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    out = align.with_link_counts(align.align(docs, align.load(spark, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))))
    got = {r.doc_id or 0: (r.n_best, r.count_sum) for r in out.collect()}
    assert got == dict(enumerate(corpus_rows(texts, plain)))
    empty = align.with_link_counts(align.align(docs.limit(0), align.load(spark, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))))
    assert empty.count() == 0 and "links" not in empty.columns


def test_query_is_the_plain_version(spark, small, plain, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 1500 or text is null")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in queries()["op13_align"](spark, str(tmp_path)).collect()}
    assert rows.keys() == texts.keys() and len(rows) > 20
    for (doc_id, text), (n_best, count_sum) in zip(texts.items(), corpus_rows(texts.values(), plain)):
        r, want = rows[doc_id], plain(text) or (0, 0, 0, 0, 0, "")
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_group_links, r.n_best, r.count_sum) == (*want[:5], n_best, count_sum)
        assert r.groups_sha256 == (hashlib.sha256(want[5].encode()).hexdigest() if want[0] else "")
