"""The training-data queries: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import align, ann, bpe, chat, decontam, langid, lmscore, packing, periodic, secrets, simhash, toxicity, urls
from emberlog.llm.common import fold, in_fold, new_folder, small, table

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of the URL filter: verdict, host, path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(spark, tokenizer_path())
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), vocabulary).alias("ids"))
    return ids.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids"), vocabulary).cast("binary"), 256).alias("decoded_sha256"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per packed sequence, as written: its documents, and digests of its row of the id and position matrices."""
    vocabulary = bpe.load(spark, tokenizer_path())
    packed = packing.pack_ids(table(spark, sf_dir, "documents"), bpe.encode(F.col("text"), vocabulary))
    packed = packing.write_packed(packed, new_folder(spark, "tables"))
    return packed.select("shard", "sequence", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", F.sha2("input_ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = docs.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from the depth-first output in tokens."""
    vocabulary = bpe.load(spark, tokenizer_path())
    forest = chat.prefix_forest(chat.with_probe(table(spark, sf_dir, "conversations")), vocabulary=vocabulary)
    return chat.read_back(*chat.emit(*forest), vocabulary)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.learn_templates(pages, table(spark, sf_dir, "labels")), URL_RULES)


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality; background: all documents."""
    vocabulary = bpe.load(spark, tokenizer_path())
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.min("quality") == 1).alias("target")).where("target and doc_id is not null")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(small(good), "doc_id", "left")
    return lmscore.score(docs, bpe.encode(F.col("text"), vocabulary), F.col("target"), 50_257)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(F.coalesce(fold("doc_id", 4) != 2, F.lit(False))))
    found = docs.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), langid.identify(F.col("text"), model, spark).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.array_join("found.languages", " ").alias("languages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def planted_text(key: Column, text: Column) -> Column:
    """The text, in a tenth of the documents made periodic from a word on: h = crc32 of the id, g = h // 10; if h % 10 = 0, word i >= a is word a + (i - a) % p, a = g % n, p = 1 + (n - a) // (3 + g % 8). Those are words with single spaces between."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    copies = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), copies)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), repeated), " ")).otherwise(text)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words, of which a tenth of the documents are given some."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs)
    # Runs are in order, so of equal exponents the first stays.
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    top = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), longer)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.name for r in secrets.RULES if r.base]
    number = lambda name: F.size(F.filter("found", lambda f: f["rule"] == name)).cast("long").alias(f"n_{name}")
    shown = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["rule"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    of_base = shown(F.filter("found", lambda f: f["rule"].isin(base)))
    return found.select("doc_id", *map(number, base), F.sha2(of_base.cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = align.load(spark, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    found = align.align(table(spark, sf_dir, "documents"), tokenizers)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return align.with_link_counts(found.withColumn("groups_sha256", digest).drop("groups"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (op1_bpe, op2_ann, op3_packing, op4_toxicity, op5_chat, op6_urls, op7_lmscore, op8_decontam, op9_langid, op10_simhash, op11_periodic, op12_secrets, op13_align, pipeline)
    return {f.__name__: f for f in found}


def _chat_sql() -> str:
    """Digests straight from the turns: escaping adds a character for every backslash and control string."""
    escaped = "|".join(re.escape(c) for c in ("\\", chat.TURN, chat.BODY, chat.END, *chat.FOREIGN))
    size = lambda c: f"length(regexp_replace({c}, '({escaped})', '\\1+', 'g'))"
    frame = len(chat.TURN + chat.BODY + chat.END)
    probe = "</s>[INST] ok [/INST]"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
UNION ALL VALUES (-7, 0, 'user', '{probe}'), (-7, 1, 'assistant', '{probe}')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' {order}) AS turns,
coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS loss, cast(sum({frame} + {size('role')} + {size('text')}) AS bigint) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": _chat_sql()}
