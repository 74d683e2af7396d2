"""Shards of near-equal size by sampled splitters. DataFrame functions only."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import checkpointed

OVERHEAD = 16
SAMPLES_A_RANGE = 64
STEP = 13


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, group): the UTF-8 bytes of the text plus 16, its checksum, and the order of the ranges.

    Equal texts have the same group, so they lie side by side; null counts as empty.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), (F.octet_length(content).cast("bigint") + OVERHEAD).alias("size"),
                       F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"), F.xxhash64(content).alias("_group"))


def splitters(rows: DataFrame, order: list[str], ranges: int) -> list[tuple]:
    """At most `ranges` - 1 boundaries of ranges of about equal bytes, from a sample in which a row's chance is its size.

    The sample has about ranges x SAMPLES_A_RANGE rows whatever the table's size; it only steers the work, results don't
    depend on it. A row's draw follows from its key, so a recomputed task draws the same rows.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    wanted = ranges * SAMPLES_A_RANGE
    draw = F.shiftrightunsigned(F.xxhash64(*order, F.lit(11)), 11) / F.lit(float(1 << 53))
    drawn = rows.where(draw < F.col("size") * F.lit(wanted / total)).select(
        *order, F.greatest(F.col("size") * F.lit(wanted / total), F.lit(1.0)).alias("_weight"))
    found = sorted(drawn.collect(), key=lambda r: [(v is not None, v) for v in r[:-1]])
    out, seen = [], 0.0
    mass = sum(r[-1] for r in found)
    for r in found:
        seen += r[-1]
        if len(out) < ranges - 1 and seen >= mass * (len(out) + 1) / ranges:
            out.append(tuple(r[:-1]))
    return sorted(set(out), key=lambda r: [(v is not None, v) for v in r])


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): every row's shard under the law `bytes`.

    Rows are ordered by (text group, key), cut into ranges at the sampled splitters, and numbered in bytes inside each range;
    with the ranges' totals every row knows how many bytes lie before its middle, and so its shard: sizes differ from the
    mean by less than one row at each end. A range that is overfull for a shard is thus subdivided, also inside a group of
    copies. slot counts a shard's rows from 0. grown_shard is null (only the law `key` has it). An empty table gives no rows;
    repeated keys keep a row each; null keys count as the smallest key; other columns are not read.
    """
    order = ["_group", key]
    rows = checkpointed(keyed(docs, key, text))  # the texts are read once
    types = [dict(rows.dtypes)[c] for c in order]
    cuts = splitters(rows, order, ranges or 4 * shards)
    rows = rows.withColumn("_range", _position(order, cuts, types))
    total = F.lit(rows.agg(F.sum("size")).first()[0] or 1)
    inside = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy("_range").agg(F.sum("size").alias("_all"), F.count("*").alias("_n"))
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range: ranges are bounded
    totals = sizes.select("_range", F.coalesce(F.sum("_all").over(whole), F.lit(0)).alias("_before"),
                          F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_rows_before"))
    numbered = rows.withColumn("_bytes", F.sum("size").over(inside)).withColumn("_rank", F.count(F.lit(1)).over(inside))
    placed = numbered.join(F.broadcast(totals), "_range").withColumn(
        "shard", F.least(F.lit(shards - 1), F.floor((F.col("_before") + F.col("_bytes") - F.col("size") / 2) * shards / total)).cast("int"))
    placed = placed.withColumn("_at", F.col("_rows_before") + F.col("_rank"))
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def _position(order: list[str], cuts: list[tuple], types: list[str]) -> Column:
    """How many cuts lie below the row: first among every STEP-th cut, then among the STEP after that. Nulls come first."""
    if not cuts:
        return F.lit(0)
    fine = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(cut, types, order, strict=True)]) for cut in cuts])
    coarse = F.filter(fine, lambda c, i: F.pmod(i, F.lit(STEP)) == STEP - 1)
    own = F.struct(*order)
    before = F.size(F.filter(coarse, lambda c: c < own)) * STEP
    return before + F.size(F.filter(F.slice(fine, before + 1, F.lit(STEP)), lambda c: c < own))


def write_shards(docs: DataFrame, placed: DataFrame, folder: str, key: str = "doc_id") -> None:
    """Write docs into one folder per shard, rows in slot order. `placed` comes from shard() over unique keys."""
    where = placed.select(F.col(key).alias("_key"), "shard", "slot")
    joined = docs.join(where, docs[key].eqNullSafe(where["_key"])).drop("_key")
    (joined.repartition("shard", (F.col("slot") / F.lit(100_000)).cast("int")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(folder))


def balance(placed: DataFrame) -> DataFrame:
    """(shard, n_rows, n_bytes) of every shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
