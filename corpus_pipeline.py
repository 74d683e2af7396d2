"""A corpus pipeline over `documents`: quality, near-duplicates, repeated passages, benchmark passages, tokens.

What all stages share: columns other than those of documents are dropped; an empty table gives an empty one; rows are known by id
and text, so rows of one id, or without an id, stand for themselves. A null text counts as an empty one: it has no words, no
passages and no tokens. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, decontaminate, quality, simhash, suffix_dedup
from waymark.llm.common import drop_unused, shared_folder, small_batches
from waymark.llm.queries import ranks, table, trusted
from waymark.session import checkpointed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BROADCAST_KEYS = 2_000_000  # dropped keys up to which they are broadcast


def identified(docs: DataFrame) -> DataFrame:
    """docs with `_row`, which rows share if they have one doc_id and one text. A null id is greater than any other."""
    return docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("digest"),
                                          F.xxhash64(F.lit(1), "text").alias("more")).alias("_row"))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The identified rows whose `_row` is not among the dropped ones."""
    keys = dropped.select(F.col("_row").alias("_dropped")).distinct()
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, F.col("_row") == F.col("_dropped"), "left_anti").select(*rows.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold. Of a null or empty
    text only its end is scored; a null language is one of its own; a language with few trusted documents takes the threshold of all.
    Rows are judged one by one."""
    small_batches(spark)
    return quality.classify(docs, trusted(spark, sf_dir)).where("keep").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of copies and near copies. Of rows with one id and text one stays. Null and empty texts
    are copies of each other; a null id counts as the greatest.

    Fingerprints of 64 bits that differ in two at most are linked, found at the anchors of the covering code. Their groups go on into
    the comparison of shingle sets, which adds edited copies whose fingerprints are further apart.
    """
    small_batches(spark)
    rows = identified(docs)
    near = checkpointed(simhash.near_duplicates(rows, "_row"))
    drop_unused(spark)
    groups = checkpointed(simhash.similar_documents(rows, "_row", known=near))
    left = without(rows, groups.where("_row <> component_id"))
    twice = groups.groupBy("_row").agg(F.count("*").alias("n")).where("n > 1")
    return (left if twice.isEmpty() else left.dropDuplicates(["_row"])).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 200 that occur more than once; one of which nothing is left goes. Texts without such
    strings, null and empty ones among them, stay as they are; n_chars is counted anew where something goes."""
    small_batches(spark)
    done = suffix_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True)
    left = done.where("n_removed = 0 or length(kept) > 0")
    changed = F.col("n_removed") > 0
    return left.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
                       F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs. Null and empty texts and items have no words and hit
    nothing."""
    small_batches(spark)
    rows = identified(docs)
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), "_row")
    return without(rows, found.where("n_hit > 0")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, and its text as they decode. A null or empty text has no ids and an empty text."""
    small_batches(spark)
    done = bpe.round_trip(docs.select(*COLUMNS), ranks())
    return done.select("doc_id", F.decode("decoded", "UTF-8").alias("text"), "lang", "source", "n_chars",
                       F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: SQL can't express the stages; tests/llm compares them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written as Parquet and read again."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
