"""SimHash, components, nearest neighbours, chat forests, URL filters and the pipeline against plain versions."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberlog.llm import ann, bpe, chat, components, simhash, urls
from emberlog.llm.queries import URL_RULES, queries, tokenizer_path


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5)]
    edges = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == plain_components({n for link in real for n in link}, real)
    assert components.connected_components(edges.limit(0)).count() == 0


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(rng):
    rows = []
    for k in range(60):
        words = [f"W{rng.randrange(4000)}" for _ in range(rng.choice([0, 1, 3, 4, 5, 80, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((len(rows), rng.choice([" ", "\t", "\n\n"]).join(words)))
            if words:
                words[rng.randrange(len(words))] = f"w{rng.randrange(4000)}"
    return [*rows, (len(rows), None), (len(rows) + 1, " \n "), (3, rows[3][1]), (None, rows[5][1])]


def test_simhash(spark):
    rows = near_texts(random.Random(2))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, fp int").repartition(3)
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = plain_components(range(len(rows)), links)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root[i]] = min(k, least.get(root[i], k))
    expected = sorted((k if k is not None else -1, f"{prints[i]:016x}", least[root[i]]) for i, (k, _) in enumerate(rows))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.fingerprint).hex(), r.component_id) for r in got) == expected
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_tiles_skip_nothing(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    values = np.unique(np.concatenate([base, near, near ^ np.uint64(7)]))
    fps = spark.createDataFrame([(bytearray(int(v).to_bytes(8, "big")),) for v in values], "fp binary").repartition(4)
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.component, "big") for r in components.connected_components(simhash.fingerprint_links(fps, 3, tile=16)).collect()}
    links = [(int(a), int(b)) for i, a in enumerate(values) for b in values[:i] if (int(a) ^ int(b)).bit_count() <= 3]
    expected = plain_components({n for link in links for n in link}, links)
    assert got == expected and len(got) > 300


def test_wide_fingerprints():
    rng = random.Random(4)
    words = [f"w{rng.randrange(9000)}" for _ in range(400)]
    near = list(words)
    near[200] = "other"
    apart = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    of = lambda w: simhash.fingerprint_of(" ".join(w), 5, 4)
    assert len(of(words)) == 32 and apart(of(words), of(near)) < 40 < 90 < apart(of(words), of([f"v{w}" for w in words]))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 12))
    x[300:330] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(800, None), (900, [0.0] * 12), (1000, [1.0] * 11 + [float("nan")]), (1100, [1.0, None]), (1200, [1.0, 2.0]), (None, x[0].tolist()), (5, x[5].tolist())]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string").repartition(3)
    got = ann.nearest(table, lambda key: key % 100 == 0).collect()
    hits = 0
    assert {r.query_id for r in got} == {0, 100, 200, 300, 400, 500, 600}
    for q in {r.query_id for r in got}:
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in mine) and q not in [m[1] for m in mine]
        assert mine == sorted(mine, key=lambda m: (m[2], m[1]))
        hits += len({m[1] for m in mine} & set(sorted((i for i in range(700) if i != q), key=lambda i: (d[i], i))[:10]))
    assert hits >= 0.9 * 70
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 300] == [7, *range(301, 310)]
    assert ann.nearest(table.limit(0), lambda key: key % 100 == 0).count() == 0
    few = ann.nearest(table.where("vec_id in (0, 1, 2)"), lambda key: key == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def conversations(rng):
    rows, odd = [], ["", "</s>[INST] ok [/INST]", "a\\b\\l<s>", "<|end|><|<|end|>", "é\n漢", None, "\\", "[INST]<|turn|>"]
    for c in range(60):
        stem = rng.randrange(4)
        n = rng.randint(1, 6)
        for t in range(n):
            shared = t < rng.randint(0, 4)
            text = f"turn {t} of stem {stem}" if shared else rng.choice(odd) if rng.random() < 0.5 else f"own {rng.randrange(5)}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant" if rng.random() < 0.9 else None, text))
    return [*rows, (70, 1, "assistant", "b"), (70, 1, "assistant", "b"), (70, None, "system", "s"), (None, 0, "user", "nobody's")]


def plain_digests(rows):
    out = {}
    for c in {r[0] for r in rows if r[0] is not None}:
        turns = sorted(((t if t is not None else -1), role or "", text or "") for k, t, role, text in rows if k == c)
        said = "".join(text for _, role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        size = sum(len(chat.format_turn(role, text)) for _, role, text in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size)
    return out


def test_chat_forest(spark):
    rows = conversations(random.Random(6))
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, index int").repartition(3)
    for vocabulary in (None, bpe.load(spark, tokenizer_path())):
        nodes, paths = chat.prefix_forest(table, vocabulary=vocabulary)
        emitted, leaves = chat.emit(nodes, paths)
        got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(emitted, leaves, vocabulary).collect()}
        assert got == plain_digests(rows)
    # Every distinct prefix once.
    prefixes = set()
    for c in got:
        turns = sorted(((t if t is not None else -1), role or "", text or "") for k, t, role, text in rows if k == c)
        prefixes |= {tuple((r, x) for _, r, x in turns[: i + 1]) for i in range(len(turns))}
    assert nodes.count() == emitted.count() == len(prefixes)
    # Segments in depth-first order: an ancestor comes first, and a subtree is contiguous.
    segments = sorted(chat.segments(nodes, paths).collect(), key=lambda s: (s.root, s.path_key))
    place = {s.owner: i for i, s in enumerate(segments)}
    sizes = {s.owner: (s.position, s.size) for s in segments}
    for s in segments:
        reach = 0
        for a in s.attends:
            assert place[a.owner] < place[s.owner] and a["from"] == reach and a.to <= sum(sizes[a.owner])
            reach = a.to
        assert reach == s.position
    for root in {s.root for s in segments}:
        span = [place[s.owner] for s in segments if s.root == root]
        assert span == list(range(min(span), max(span) + 1))
    # In that order the tokens of every segment lie in one piece, their position ids counting on.
    out = emitted.collect()
    for owner in place:
        mine = sorted((r["index"], r.position, len(r.ids) // 4) for r in out if r.owner == owner)
        assert all(a + n == b for (_, a, n), (_, b, _) in zip(mine, mine[1:]))
    assert chat.read_back(*chat.emit(*chat.prefix_forest(table.limit(0)))).count() == 0


def test_chat_common_first_turn(spark):
    """All conversations share their first turn, and a third of them everything: joins are salted, results the same."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 else f"turn {t} of {0 if c % 3 == 0 else c}") for c in range(400) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(*chat.emit(*chat.prefix_forest(table))).collect()}
    assert got == plain_digests(rows)


def test_chat_escapes():
    for text in ("", "\\", "\\l", "<s></s>", "<<s>s>", "[/INST][INST]", "<|end|>\\<|body|>", "<</SYS>>", "a<b>[c]"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in (chat.TURN, chat.BODY, chat.END, *chat.FOREIGN))
        assert chat.parse_turn(chat.format_turn("us<|body|>er", text)) == ("us<|body|>er", text)


def plain_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_url_filters(spark):
    urls_ = ["http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/en/21", "x://b.com/fr/1", "x://com/de/", "x://b.com/de", "x://xcom/de/1", "no scheme", None, "", "a://", "a://h", "a://h?q", "a://h#f/x", "a://h/p://q/r", "a://É.COM:80/fr/é\n/x", "a://h//x//"]
    pages = [(i, u) for i, u in enumerate(urls_)] + [(100 + i, f"https://site.net/{'spam' if i % 2 else 'news'}/{i}/a.html") for i in range(200)] + [(3, urls_[3])]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, host string").repartition(3)
    labels = spark.createDataFrame([(100 + i, 0 if i % 2 else 1) for i in range(0, 120)] + [(100, 1), (None, 1), (101, None)], "doc_id long, quality int")
    templates = urls.learn_templates(table.select("page_id", "url"), labels)
    got = urls.judge(table, templates, URL_RULES).collect()
    assert len(got) == len(pages)
    by_id = dict(pages)
    for r in got:
        host, path, (rule, verdict) = plain_url(by_id[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), by_id[r.page_id]
        spam = (by_id[r.page_id] or "").startswith("https://site.net/spam")
        assert r.verdict == (verdict or ("block" if spam else "allow"))
    assert {r.template for r in got if r.host == "site.net"} == {"/spam/*/a.html", "/news/*/a.html"}
    assert urls.judge(table.limit(0), urls.learn_templates(table.limit(0), labels.limit(0)), URL_RULES).count() == 0


def test_url_branches_merge(spark):
    pages = [(i, f"https://h.net/{['en', 'de', 'fr'][i % 3]}/{i}") for i in range(300)]
    table = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(300)], "doc_id long, quality int")
    rows = urls.learn_templates(table, labels).collect()
    assert {r.template for r in rows} == {"/*/*"} and not any(r.rejected for r in rows)


def test_url_branches_stay_beside_rare_ones_and_deep_down(spark):
    wide = [f"https://w.net/spam/{i}" for i in range(100)] + [f"https://w.net/news/{i}" for i in range(300)] + [f"https://w.net/rare{'abcdefghijklmnopqrstuvwxyz'[i // 26]}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}/1" for i in range(60)]
    deep = [f"https://d.net/a/b/c/d/e/{'spam' if i % 3 == 0 else 'news'}/{i}" for i in range(300)] + ["https://d.net/" + "x/" * 90]
    pages = list(enumerate(wide + deep))
    table = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, int("spam" not in u)) for i, u in pages], "doc_id long, quality int")
    by_id = dict(pages)
    for r in urls.judge(table, urls.learn_templates(table, labels)).collect():
        assert r.verdict == ("block" if "spam" in by_id[r.page_id] else "allow"), r


def test_url_branches_merge_at_every_level(spark):
    """Bad branches of two labelled pages each are blocked together, beside good ones."""
    pages = [(i, f"https://h.net/articles/{'bad' if i % 4 == 0 else 'fine'}-{'abcdefghij'[i % 40 // 4]}/{i}") for i in range(800)]
    table = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(80)], "doc_id long, quality int")
    by_id = dict(pages)
    for r in urls.judge(table, urls.learn_templates(table, labels)).collect():
        assert r.verdict == ("block" if "bad" in by_id[r.page_id] else "allow"), r


def test_near_dedup_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(None, a), (5, b), (5, c), (5, c), (2, b), (7, a), (None, "alone " + c[::-1])], "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(7, a), (2, b), (5, c), (0, "alone " + c[::-1])])


def plain_shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_near_dedup_is_by_jaccard_similarity(spark):
    """Groups of texts at similarities on both sides of 0.8, chains among them, against all pairs."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for k in range(70):
        words = [f"w{rng.randrange(50_000)}" for _ in range(rng.choice([30, 90, 200, 600]))]
        for _ in range(rng.choice([1, 2, 3, 9])):
            rows.append((len(rows), " ".join(words), "x"))
            for _ in range(max(1, int(len(words) * rng.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.06])))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(50_000)}"
    rows += [(len(rows) + i, " ".join(["same line of words"] * n + [f"end {i}"]), "x") for i, n in enumerate((1, 2, 40, 90))] + [(900, None, "y"), (901, "", "y"), (902, " ", "y")]
    rng.shuffle(rows)
    sets = [plain_shingles(t) for _, t, _ in rows]
    alike = lambda a, b: a == b or (bool(a and b) and len(a & b) >= 0.8 * len(a | b))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    root = plain_components(range(len(rows)), links)
    least = {}
    for i, (k, *_) in enumerate(rows):
        least[root[i]] = min(k, least.get(root[i], k))
    near = [(i, j) for i, j in links if sets[i] != sets[j]]
    assert len(near) > 100 and sum(0.7 < len(a & b) / len(a | b) < 0.8 for i, a in enumerate(sets) for b in sets[:i] if a and b) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(least.values())


def test_skew_join(spark):
    from emberlog.llm.common import skew_join

    left = spark.createDataFrame([(i, 7 if i % 2 else i % 50 if i % 5 else None) for i in range(4000)], "i long, k long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(40)], "k long, r string")
    for how in ("inner", "left"):
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(skew_join(left, right, ["k"], how).select("i", "k", "r").collect(), key=key) == sorted(left.join(right, ["k"], how).select("i", "k", "r").collect(), key=key)


def test_pipeline(spark, small):
    import corpus_pipeline
    from emberlog.llm import decontam, langid, queries as q, toxicity

    docs = spark.read.parquet(f"{small}/documents.parquet")
    tox = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = [r for r in docs.collect() if tox.score(r.text) < corpus_pipeline.TOXIC]
    assert 0 < len(rows) <= docs.count()
    rows = [r for r in rows if r.text and langid._LETTER.search(r.text)]
    sets = [plain_shingles(r.text) for r in rows]
    links = [(rows[i].doc_id, rows[j].doc_id) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = plain_components([r.doc_id for r in rows], links)
    rows = [r for r in rows if root[r.doc_id] == r.doc_id]
    items = [(r.item_id, decontam.normalise(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in f" {decontam.normalise(r.text)} " for _, i in items)]
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, small).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(q.tokenizer_path())
    expected = {r.doc_id: np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes() for r in rows}
    assert got.keys() <= expected.keys() and len(expected) - len(got) <= 3  # edited items are found as well
    assert all(expected[k] == v for k, v in got.items())
    last = [name for name, _ in corpus_pipeline.STAGES]
    assert len(last) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_registry():
    assert sorted(queries()) == sorted(["pipeline", *(f"op{n}_{x}" for n, x in enumerate("bpe ann packing toxicity chat urls lmscore decontam langid simhash periodic secrets align".split(), 1))])


def test_pipeline_stages_keep_columns(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, small)
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, odd.limit(0), small).count() == 0, name


def exact_neighbours(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
    return [ids[i] for i in sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (d[i], ids[i]))[:k]]


def test_neighbour_graph_recall(spark):
    """Six thousand clustered vectors far from the origin, in many blocks and chunks, besides some of another length: recall against brute force."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 24)) * 2
    x = centres[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 24)) + 1e5
    other = rng.standard_normal((30, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + 50 * i, v.tolist()) for i, v in enumerate(other)] + [(30_000, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in sorted(ann.nearest(table, lambda key: key % 100 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    wanted = {q: exact_neighbours(list(range(6000)), x, q) for q in range(0, 6000, 100)}
    hits = sum(len(set(found[q]) & set(w)) for q, w in wanted.items())
    assert hits >= 0.95 * 10 * len(wanted)
    short = [10_000 + 50 * i for i in range(30)]
    assert all(found[q] == exact_neighbours(short, other, q) for q in short if q % 100 == 0)
    assert found.keys() == wanted.keys() | {q for q in short if q % 100 == 0}


def test_chunks_do_not_follow_partitions(spark, monkeypatch):
    """With many more partitions than chunks, the graph still starts from whole chunks, and blocks are as few as asked for."""
    x = np.random.default_rng(9).standard_normal((1200, 6)).astype("<f4")
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, v binary").repartition(4)
    asked = type(nodes).repartitionByRange
    monkeypatch.setattr(type(nodes), "repartitionByRange", lambda self, n, *cols: asked(self, max(n, 150), *cols))
    assert ann.in_blocks(nodes, 600).select("block").distinct().count() == 2
    graph = {r.id: [e.id for e in r.near] for r in ann.start_graph(nodes, degree=5, orders=1, chunk=601).collect()}
    for i in range(0, 1200, 50):
        d = ((x - x[i]) ** 2).sum(axis=1)
        assert graph[i] == sorted((j for j in range(1200) if j != i), key=lambda j: d[j])[:5]


def plain_segments(path):
    import re

    out = []
    for part in (p for p in path.split("/") if p):
        stem, ending = re.fullmatch(r"(?s)(.*?)(\.[A-Za-z0-9]{1,5})?", part).groups()
        varies = re.fullmatch(r"[0-9]+([-_.][0-9]+)*|[0-9a-fA-F-]{16,}", stem) or re.search("[0-9]{5,}", stem)
        out.append(f"*{ending or ''}" if varies else part)
    return out


def plain_templates(pages, good):
    """The template, purity and rejection of every page, from nested dictionaries: the tree grown from the top, branches merged from the bottom."""
    rows = {i: plain_url(u)[:2] for i, u in pages}
    paths = {i: (h, plain_segments(p)) for i, (h, p) in rows.items()}
    kept = {i: [] for i in paths}
    for level in range(max((len(s) for _, s in paths.values()), default=0)):
        support = {}
        for i, (h, s) in paths.items():
            if len(s) > level:
                support[h, tuple(kept[i]), s[level]] = support.get((h, tuple(kept[i]), s[level]), 0) + 1
        for i, (h, s) in paths.items():
            if len(s) > level:
                kept[i] = [*kept[i], s[level] if support[h, tuple(kept[i]), s[level]] >= urls.MIN_SUPPORT else "*"]
    prior = (sum(good.values()) + 1) / (len(good) + 1)

    def tally(members):
        marks = [good[i] for i in members if i in good]
        return len(marks), sum(marks)

    def share(n, g):
        return (g + 1) / (n + 2)

    def apart(a, b):
        if not a[0] or not b[0]:
            return 0.0
        p = share(a[0] + b[0], a[1] + b[1])
        return abs(share(*a) - share(*b)) / np.sqrt(p * (1 - p) * (1 / (a[0] + 1) + 1 / (b[0] + 1)))

    for level in reversed(range(max(map(len, kept.values()), default=0))):
        parents = {}
        for i, t in kept.items():
            if len(t) > level:
                parents.setdefault((paths[i][0], tuple(t[:level]), tuple(t[level + 1 :])), {}).setdefault(t[level], []).append(i)
        for children in parents.values():
            same = {}
            for name, members in children.items():
                same.setdefault(tally(members), []).append(name)
            order = sorted(sorted(same), key=lambda c: -(c[1] + 2 * prior) / (c[0] + 2))
            groups = [((n * len(same[n, g]), g * len(same[n, g])), same[n, g]) for n, g in order]
            while len(groups) > 1:
                gaps = [apart(a[0], b[0]) for a, b in zip(groups, groups[1:])]
                if min(gaps) > urls.ALIKE_Z:
                    break
                k = gaps.index(min(gaps))
                (a, x), (b, y) = groups[k : k + 2]
                groups[k : k + 2] = [((a[0] + b[0], a[1] + b[1]), x + y)]
            for number, (_, names) in enumerate(groups):
                for name in names:
                    if len(names) > 1 or name == "*":
                        for i in children[name]:
                            kept[i] = [*kept[i][:level], "*" if not number else f"*{number + 1}", *kept[i][level + 1 :]]
    total = {}
    for i, t in kept.items():
        n, g = total.get((paths[i][0], tuple(t)), (0, 0))
        total[paths[i][0], tuple(t)] = n + (i in good), g + good.get(i, 0)
    out = {}
    for i, t in kept.items():
        n, g = total[paths[i][0], tuple(t)]
        purity = (g + urls.PRIOR_WEIGHT * prior) / (n + urls.PRIOR_WEIGHT)
        out[i] = ("/" + "/".join(t), round(purity, 9), purity < urls.MIN_PURITY * prior)
    return out


@pytest.mark.parametrize("paths", [1, 30, 256])
def test_url_templates_are_the_plain_ones(spark, monkeypatch, paths):
    """Whether hosts are grown by one task each or split into branches of at most so many paths."""
    monkeypatch.setattr(urls, "LEAST_BRANCH", paths)
    rng = random.Random(13)
    names = ["news", "shop", "a.html", "x", "spam", "tag"]
    pages = [(i, f"http://{rng.choice(['a.net', 'b.net', 'c.net'])}/" + "/".join(rng.choice([*names, str(rng.randrange(10**6)), f"n{rng.randrange(40)}"]) for _ in range(rng.randint(0, 4)))) for i in range(700)]
    good = {i: int(rng.random() < (0.15 if "spam" in u or "/x" in u else 0.9)) for i, u in pages if rng.random() < 0.5}
    table = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    expected = plain_templates(pages, good)
    got = {r.page_id: (r.template, round(r.purity, 9), r.verdict == "block") for r in urls.judge(table, urls.learn_templates(table, labels)).collect()}
    assert got == expected and 0 < sum(b for *_, b in got.values()) < 600


def test_url_traps(spark):
    """Urls of 60 segments beside short ones, from one host."""
    import time

    pages = [(i, "http://trap.net/" + "/".join(f"s{(i * k) % 3}" for k in range(60))) for i in range(120)] + [(1000 + i, f"http://trap.net/{'ok' if i % 2 else 'bad'}/{i}") for i in range(50)]
    table = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    good = {i: int(i < 1000 or i % 2) for i, _ in pages}
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    began = time.time()
    got = {r.page_id: (r.template, round(r.purity, 9), r.verdict == "block") for r in urls.judge(table, urls.learn_templates(table, labels)).collect()}
    assert time.time() - began < 60
    assert got == plain_templates(pages, good)


def test_registered_digests(spark, small):
    """What the queries of op1, op4, op9 and op10 return for every document, against one text at a time."""
    import zlib

    from tokenizers import Tokenizer

    found, library = queries(), Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {k: np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for k, t in texts.items()}
    got = {r.doc_id: r for r in found["op1_bpe"](spark, small).collect()}
    assert {k: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for k, r in got.items()} == {k: (len(ids[k]), hashlib.sha256(ids[k].tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in found["op10_simhash"](spark, small).collect()} == {k: f"{plain_fingerprint(t):016x}" for k, t in texts.items()}
    for name, mod, out in (("op4_toxicity", 5, 0), ("op9_langid", 4, 2)):
        assert {r.doc_id: r.held_out for r in found[name](spark, small).collect()} == {k: zlib.crc32(str(k).encode()) % mod == out for k in texts}


def test_near_dedup_of_a_large_group_just_below(spark):
    """2 000 texts nearly all 0.74 to 0.8 alike in pairs, some of them linked, whatever the columns are called."""
    import corpus_pipeline

    rng = random.Random(8)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for k in range(2_000):
        words = list(base)
        for i in rng.sample(range(80), 6):
            words[5 * i + 2] = f"n{k}.{i}"
        rows.append((k, " ".join(words), 1, 2, 3))
    sets = [plain_shingles(t) for _, t, *_ in rows]
    some = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in ((rng.randrange(2_000), rng.randrange(2_000)) for _ in range(2_000)) if i != j]
    assert 0.7 < sum(some) / len(some) < 0.8
    rows += [(10_000 + k, rows[k][1] + " once more", 1, 2, 3) for k in range(0, 2_000, 100)]
    sets += [plain_shingles(t) for _, t, *_ in rows[2_000:]]
    held = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    code = {x: n for n, x in enumerate(k for k, v in held.items() if len(v) > 1)}
    m = np.zeros((len(sets), len(code)), np.float32)
    for i, s in enumerate(sets):
        m[i, [code[x] for x in s if x in code]] = 1
    shared, sizes = m @ m.T, np.array([len(s) for s in sets])
    i, j = np.nonzero(shared >= 0.8 * (sizes[:, None] + sizes - shared))
    root = plain_components(range(len(rows)), [(int(a), int(b)) for a, b in zip(i, j) if a < b])
    least = {}
    for k, r in enumerate(rows):
        least[root[k]] = min(r[0], least.get(root[k], r[0]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hash long, __key long, __root long").repartition(6)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(least.values()) and 200 < len(least) < 2_000


def bond_rows(texts):
    """(bond, name of the node, n, fingerprint with its name) of every bond."""
    rows = []
    for t in texts:
        fp, n, bonds = simhash.node_of(t, 5, 4, simhash.smallest_for(0.8))
        rows += [(b, int.from_bytes(fp[-8:], "little", signed=True), n, fp) for b in bonds.tolist()]
    return rows


def batches_of(rows, names, kinds, size):
    import pyarrow as pa

    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[at : at + size]), kinds)], names)


def test_near_dedup_compares_no_unrelated_texts(spark, monkeypatch):
    """Texts of common words meet in no bond, and near-dedup does without the comparison of all with all."""
    import corpus_pipeline

    def refused(*_, **__):
        raise AssertionError("all texts are compared with all")

    rng = random.Random(31)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 200]))) for _ in range(600)]
    assert len({r[0] for r in bond_rows(texts)}) == len(bond_rows(texts))
    monkeypatch.setattr(simhash, "fingerprint_links", refused)
    rows = list(enumerate(texts + [f"{t} once more" for t in texts if len(t.split()) > 100]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == list(range(600))


def test_near_texts_share_a_bond():
    """Every pair at 0.8 or more, of sets of 4 shingles and more."""
    rng = np.random.default_rng(32)
    smallest = simhash.smallest_for(0.8)
    for n in [*range(5, 80), 200, 1000, 5000]:
        for _ in range(20):
            union = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            role = rng.permutation(n)
            cut = rng.integers(0, n // 5 + 1)
            a, b = union[role >= cut], union[(role < cut) | (role >= n // 5)]
            assert len(np.intersect1d(a, b)) >= 0.8 * n
            assert len(np.intersect1d(simhash._bonds(a, smallest), simhash._bonds(b, smallest)))


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_shared_bonds_are_found_across_batches(size):
    rng = random.Random(33)
    rows = sorted((rng.randrange(150), rng.randrange(6)) for _ in range(300))
    held = {}
    for bond, i in rows:
        held.setdefault(bond, set()).add(i)
    expected = sorted((b, i) for b, ids in held.items() if len(ids) > 1 for i in ids)
    got = [(b, i) for out in simhash._shared(batches_of(rows, ["bond", "id"], ["int64", "int64"], size)) for b, i in zip(out["bond"].to_pylist(), out["id"].to_pylist())]
    assert got == expected and len({b for b, _ in expected}) < len(held)


@pytest.mark.parametrize("paired, held, tile", [(64, 100_000, 512), (3, 40, 4)])
def test_close_pairs_of_bonds_are_linked(monkeypatch, paired, held, tile):
    """Small and large bonds, some of near copies, some of texts that only have a line in common, against all pairs of each."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    monkeypatch.setattr(simhash, "HELD_ROWS", held)
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "PIVOTS", 3)
    rng = random.Random(34)
    line = " ".join(f"l{i}" for i in range(40))
    texts = [f"{line} " + " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.choice([5, 30, 90]))) for _ in range(150)]
    words = [f"w{i}" for i in range(300)]
    for _ in range(100):
        words[rng.randrange(300)] = f"v{rng.randrange(9000)}"
        texts.append(" ".join(words))
    rows = sorted({(b, n, fp) for b, _, n, fp in bond_rows(texts)})
    met = {}
    for b, n, fp in rows:
        met.setdefault(b, []).append((fp, n))
    assert max(map(len, met.values())) > 64
    far = lambda a, b: (int.from_bytes(a[:32], "big") ^ int.from_bytes(b[:32], "big")).bit_count()
    links = {(x, y) for of in met.values() for x, n in of for y, m in of if x < y and min(n, m) >= 0.8 * max(n, m) and far(x, y) <= 60}
    out = list(simhash._near_in_bonds(60, 4, 0.8)(batches_of(rows, ["bond", "n", "fp"], ["int64", "int32", "binary"], 25)))
    got = [(u, v) for o in out for u, v in zip(o["u"].to_pylist(), o["v"].to_pylist())]
    nodes = {fp for _, _, fp in rows}
    assert plain_components(nodes, got) == plain_components(nodes, list(links)) and 20 < len(set(plain_components(nodes, got).values())) < len(nodes) - 20


def test_crowded_bonds_are_compared_as_well(spark, monkeypatch):
    """Bonds of more texts than a task should compare give the same rows."""
    import corpus_pipeline

    rng = random.Random(35)
    rows, words = [], [f"w{i}" for i in range(200)]
    for k in range(120):
        words[rng.randrange(200)] = f"v{k}"
        rows.append((k, " ".join(words)))
        rows.append((1000 + k, " ".join(f"u{rng.randrange(5000)}" for _ in range(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    compared = []
    monkeypatch.setattr(simhash, "CROWD", 5)
    monkeypatch.setattr(simhash, "fingerprint_links", lambda fps, *a, f=simhash.fingerprint_links, **k: compared.append(fps.count()) or f(fps, *a, **k))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == expected == [0, *range(1000, 1120)]
    assert 5 < compared[0] <= 120
