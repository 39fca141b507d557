"""Secret scans against plain searches of every row, and what the ledger spares."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.llm import secrets
from emberlog.llm.queries import queries

ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def plain(text):
    """(n_assign, n_access, n_hex, base digest) as the patterns read, without hints or a ledger."""
    text = text or ""
    kinds = [
        [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12],
        [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 18],
        [m.span() for m in HEX.finditer(text) if len(m[0]) >= 16],
    ]
    spans = sorted((a, k, b) for k, found in enumerate(kinds) for a, b in found)
    shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return (*map(len, kinds), hashlib.sha256(shown.encode()).hexdigest())


def row(found):
    return [(f.rule, f.start, f.end) for f in found]


def test_base_rules_on_random_texts():
    rng = random.Random(4)
    parts = ["password", "PassWD", "api_key", "APIKEY", "to\u212aen", "token", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCD1234EF", "0123456789abcdef", "abc", "é", "\U0001f600", "/", ".", "-", "\n", "Zz9+"]
    rules = [(r, re.compile(r.pattern)) for r in secrets.RULES if r.base]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        found = secrets.scan_text(text, rules)
        order = ["assign", "access", "hex"]
        shown = ",".join(f"{r}:{a}:{b}" for r, _, a, b in sorted(found, key=lambda f: (f[2], order.index(f[0]))))
        assert (*(sum(f[0] == k for f in found) for k in order), hashlib.sha256(shown.encode()).hexdigest()) == plain(text)


@pytest.mark.parametrize(
    "text, rule",
    [
        ("-----BEGIN RSA PRIVATE KEY-----", "private_key"),
        ("x eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK y", "jwt"),
        ("ghp_" + "a1B2" * 9, "forge_token"),
        ("postgres://app:hunter22@db/x", "url_password"),
    ],
)
def test_further_rules(text, rule):
    found = secrets.scan_text(text, [(r, re.compile(r.pattern)) for r in secrets.RULES])
    assert rule in {f[0] for f in found}
    assert not [f for f in secrets.scan_text("no secrets in a plain sentence: see https://example.org/a", [(r, re.compile(r.pattern)) for r in secrets.RULES])]


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "token=abcdefghijkl"), (3, "é password: 'abcdefghijklmnop'"), (4, "x " * 40_000 + "deadbeefdeadbeef00"), (4, "x " * 40_000 + "deadbeefdeadbeef00")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, seen string").repartition(3)
    out = secrets.scan_versions(docs)
    assert out.columns == ["doc_id", "seen", "blob", "found"]
    got = sorted(((r.doc_id, row(r.found)) for r in out.collect()), key=repr)
    assert got == sorted([(1, []), (1, []), (2, []), (None, [("assign", 0, 18)]), (3, [("assign", 2, 29)]), (4, [("hex", 80_000, 80_018)]), (4, [("hex", 80_000, 80_018)])], key=repr)
    assert secrets.scan_versions(docs.limit(0)).count() == 0


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first, second = secrets.Rule("one", "a+", 3), secrets.Rule("two", "b+", 3)
    day1 = spark.createDataFrame([("p", 1, "xaaax bbb"), ("q", 1, "none"), ("r", 1, "xaaax bbb")], "path string, rev int, text string")
    day2 = day1.unionByName(spark.createDataFrame([("q", 2, "aaaa"), ("p", 2, "none"), ("s", 1, "xaaax bbb")], day1.schema))
    pairs = lambda: sorted((bytes(r.blob).hex()[:6], tuple(r.scanned)) for r in spark.read.parquet(ledger).collect())
    due = lambda docs, rules: secrets.unscanned(docs, "text", secrets.read_ledger(spark, ledger), rules).count()
    assert due(day1, [first]) == 2  # three rows, two blobs
    secrets.scan(day1, "text", ledger, [first])
    assert due(day1, [first]) == 0 and due(day2, [first]) == 1 and due(day2, [first, second]) == 3
    out = secrets.scan_versions(day2, "text", ledger, [first])
    assert len(pairs()) == 3
    assert {(r.path, r.rev): row(r.found) for r in out.collect()} == {("p", 1): [("one", 1, 4)], ("r", 1): [("one", 1, 4)], ("s", 1): [("one", 1, 4)], ("q", 1): [], ("p", 2): [], ("q", 2): [("one", 0, 4)]}
    # A new rule is all that is looked for; its findings come in the order of the rules.
    out = secrets.scan_versions(day2, "text", ledger, [second, first])
    assert [p[1] for p in pairs()].count(("two@1",)) == 3 and [p[1] for p in pairs()].count(("one@1",)) == 3
    assert {row(r.found)[0][0] for r in out.where("path = 's'").collect()} == {"one"}
    # A new version takes the place of the old one's findings.
    newer = secrets.Rule("one", "x+", 1, version=2)
    out = secrets.scan_versions(day2, "text", ledger, [newer])
    assert row(out.where("path = 's'").head().found) == [("one", 0, 1), ("one", 4, 5)]
    # The old version's findings are still there for who asks for it.
    assert row(secrets.scan_versions(day2, "text", ledger, [first]).where("path = 's'").head().found) == [("one", 1, 4)]
    with pytest.raises(ValueError):
        secrets.scan(day1, "text", ledger, [first, first])


def test_hot_blob(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "token=abcdefghijkl").otherwise(F.concat(F.lit("n"), "id")).alias("text"))
    out = secrets.scan_versions(docs)
    assert out.where(F.size("found") > 0).count() == 1_500 and out.count() == 3_000


def test_query_is_the_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *plain(d.text)) for d in docs)
    rows = queries()["op12_secrets"](spark, small).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want
    assert any(r.n_assign or r.n_hex or r.n_access for r in rows)
