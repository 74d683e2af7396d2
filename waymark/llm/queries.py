"""One query per operator over its whole table, with production parameters, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import alignment, bpe, chat, decontaminate, embed_dedup, pii, quality, sharding, simhash, spelling, suffix_dedup, toxicity, url_filter

VOCABULARY = "byte_bpe_50k.tiktoken"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Fixed value: every 31st word of a document loses a letter before spelling variants are grouped.
TYPO_EVERY = 31
#: Fixed values of the query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block")]
#: A conversation whose texts hold control strings of a common chat template.
EXTRA_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@lru_cache(1)
def tokenizers() -> alignment.Tokenizers:
    import public_tokenizers

    return alignment.Tokenizers.read(*map(public_tokenizers.path, ALIGNED))


@lru_cache(1)
def ranks() -> dict[bytes, int]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(VOCABULARY))


def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"), 40)


def trusted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where("quality = 1")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return quality.classify(docs, trusted(spark, folder)).select("doc_id", "lang", "perplexity", "threshold", "keep")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    done = bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), ranks())
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    apart = toxicity.held_out("doc_id")
    model = toxicity.train(docs, table(spark, folder, "labels").where(~apart))
    return toxicity.score(docs, model).select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                                              "spans")


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id bigint, turn bigint, role string, text string")
    made = chat.read_back(chat.format_conversations(turns.unionByName(extra)))
    lost = F.filter("turns", lambda t: t["loss"])
    trained = F.array_join(F.transform(lost, lambda t: t["text"]), "")
    return made.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.length(trained).cast("bigint").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid")


def _of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.extract(table(spark, folder, "documents"))
    numbers = [_of_kind("base", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.documents.select("doc_id", *numbers, F.sha2(pii.described(F.col("base")), 256).alias("base_sha256"),
                                  pii.described(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), tokenizers(), keep_groups=False).documents.drop("groups")


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"), typo_every=TYPO_EVERY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_chat": op10_chat,
    "op11_pii": op11_pii,
    "op12_alignment": op12_alignment,
    "op13_spelling": op13_spelling,
}

ORACLE: dict[str, str] = {
    "op8_url_filter": """
WITH parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0)
                                    ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END,
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM parts),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
         FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM named n LEFT JOIN fits f ON n.page_id = f.page_id""",
}
