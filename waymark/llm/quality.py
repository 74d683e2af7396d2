"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, and per-language perplexity thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import ragged, released, slices, text_buffer, with_arrow_columns
from waymark.session import checkpointed

ORDER = 5  # bytes; a gram of up to 7 bytes fits a long without hashing
END = 3
SHARD_ROWS = 4_000_000  # rows of the score table a task holds at a time (64 MB)
QUANTILE, MARGIN, LEAST_TEXTS = 0.99, 1.15, 30
BIN = 1e-3
NAMES_BROADCAST = 2_000_000  # keys of trusted documents up to which they are broadcast rather than joined by a shuffle


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every byte and of the end of every text, bounds per text). The bytes before a text are zeros."""
    lengths = np.diff(offsets)
    starts = offsets[:-1] + order * np.arange(len(lengths)) + order - 1
    padded = np.zeros(len(data) + order * len(lengths), np.uint8)
    padded[ragged(starts, lengths)] = data
    padded[starts + lengths] = END
    every = np.zeros(len(padded) - order + 1, np.int64) if len(padded) >= order else np.empty(0, np.int64)
    for k in range(order):
        every = every << 8 | padded[k:len(padded) - order + 1 + k]
    return every[ragged(starts - order + 1, lengths + 1)], np.append(0, np.cumsum(lengths + 1))


def _gram_rows(docs: DataFrame, text: str, order: int) -> DataFrame:
    """(gram, n): counts of each slice of texts, summed up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for low, high in slices(offsets):
                g, _ = grams(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], order)
                g, n = np.unique(g, return_counts=True)
                both, inverse = np.unique(np.concatenate([known, g]), return_inverse=True)
                total = np.bincount(inverse, np.concatenate([total, n]), len(both)).astype(np.int64)
                known = both
                if len(known) > SHARD_ROWS:
                    yield pa.RecordBatch.from_pydict({"gram": pa.array(known), "n": pa.array(total)})
                    known, total = known[:0], total[:0]
        if len(known):
            yield pa.RecordBatch.from_pydict({"gram": pa.array(known), "n": pa.array(total)})

    return docs.select(text).mapInArrow(released(run), "gram bigint, n bigint")


def count_tables(docs: DataFrame, text: str = "text", order: int = ORDER) -> list[DataFrame]:
    """Tables (gram, n) of orders 1 to `order`: counts of the highest order, numbers of different bytes before for the others."""
    tables = [checkpointed(_gram_rows(docs, text, order).groupBy("gram").agg(F.sum("n").alias("n")))]
    for k in range(order - 1, 0, -1):
        below = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        tables.append(checkpointed(tables[-1].select(below).groupBy("gram").agg(F.count("*").alias("n"))))
    return tables[::-1]


def discounts(table: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the numbers of grams counted once to four times, kept within 0 and the count."""
    counted = {r["n"]: r["grams"] for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("grams")).collect()}
    n1, n2, n3, n4 = (counted.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0)
    return [min(max(d, 0.05), float(k)) for k, d in enumerate(raw, 1)]


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n >= 3, d[2]).when(n == 2, d[1]).when(n == 1, d[0]).otherwise(0.0)


def probabilities(wanted: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(gram, log_p) for the distinct `gram`s wanted. Counts are looked up by joins on the grams and on their contexts, order by
    order, so tables of any size stay spread over the executors."""
    if not tables:
        return wanted.select("gram", F.lit(-np.log(256.0)).alias("log_p"))
    rows = wanted.select("gram").withColumn("p", F.lit(1 / 256))
    for k, table in enumerate(tables, 1):
        d = discounts(table)
        context = (table.groupBy(F.shiftright("gram", 8).alias("_context"))
                   .agg(F.sum("n").alias("_total"), F.sum(_discount(F.col("n"), d)).alias("_kept_back")))
        own = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        rows = rows.withColumn("_own", own).withColumn("_context", F.shiftright("_own", 8))
        rows = rows.join(table.select(F.col("gram").alias("_own"), F.col("n").alias("_n")), "_own", "left").join(context, "_context", "left")
        n = F.coalesce("_n", F.lit(0))
        mixed = (F.greatest(n - _discount(n, d), F.lit(0.0)) + F.col("_kept_back") * F.col("p")) / F.col("_total")
        rows = rows.select("gram", F.coalesce(mixed, "p").alias("p"))
    return rows.select("gram", F.log("p").alias("log_p"))


class Lookup:
    """Values by key in an open-addressed table that numpy probes for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            self.keys[at[todo[free]]] = keys[todo[free]]
            done = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[done]]] = values[todo[done]]
            todo = todo[~done]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Zero for a key the table does not have."""
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], 0.0)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


def _sums(docs: DataFrame, scores: DataFrame, text: str, order: int) -> DataFrame:
    """docs with `_log_p`, the sum over the grams that `scores` (bounded) has, and `_n`, the number of all grams."""
    table = scores.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), table.column(1).to_numpy()))

    held: list[Lookup] = []

    def fill(batch: pa.RecordBatch) -> list[pa.Array]:
        if not held:
            held.append(Lookup(*sent.value))
        data, offsets = text_buffer(batch.column(text))
        sums, numbers = [np.empty(0)], [np.empty(0, np.int64)]
        for low, high in slices(offsets, 1 << 20):
            g, bounds = grams(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], order)
            sums.append(np.add.reduceat(held[0](g), bounds[:-1]))
            numbers.append(np.diff(bounds))
        return [pa.array(np.concatenate(sums)), pa.array(np.concatenate(numbers))]

    return with_arrow_columns(docs, "_log_p double, _n bigint", fill)


def score_table(docs: DataFrame, tables: list[DataFrame], text: str = "text") -> DataFrame:
    """(gram, log_p) of all grams of all texts."""
    return checkpointed(probabilities(_gram_rows(docs, text, max(1, len(tables))).select("gram").distinct(), tables))


def perplexities(docs: DataFrame, scores: DataFrame, order: int, key: str = "doc_id", text: str = "text",
                 shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs with `perplexity` per byte (the end of the text counts as one).

    The scores come back to the texts as a broadcast of bounded size: if there are more than `shard_rows`, they are dealt into
    shards, each is met by one pass over the texts, and the sums are added per document.
    """
    shards = -(-scores.count() // shard_rows)
    if shards <= 1:
        summed = _sums(docs, scores, text, order)
        return summed.withColumn("perplexity", F.exp(-F.col("_log_p") / F.col("_n"))).drop("_log_p", "_n")
    slim = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    parts = None
    for s in range(shards):
        part = _sums(slim, scores.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == s), "_text", order)
        part = part.select("_key", F.sha2("_text", 256).alias("_digest"), "_log_p", (F.col("_n") / shards).alias("_n"))
        parts = part if parts is None else parts.unionByName(part)
    # equal rows add the same share to both sums, so a repeated document has the perplexity of one
    found = parts.groupBy("_key", "_digest").agg(F.exp(-F.sum("_log_p") / F.sum("_n")).alias("perplexity"))
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return (docs.withColumn("_digest2", digest).join(found, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_digest2") == F.col("_digest")))
            .drop("_key", "_digest", "_digest2"))


def thresholds(scored: DataFrame, lang: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(_lang, threshold): the quantile of the perplexity, times the margin, per language; null is the one of all languages.

    Perplexities are counted in bins of a thousandth of their logarithm; the bin where the quantile falls decides, so the
    result depends on no order. A language with fewer than LEAST_TEXTS texts gets none of its own.
    """
    bins = scored.select(F.coalesce(lang, F.lit("")).alias("_lang"), F.floor(F.log("perplexity") / BIN).alias("_bin"))
    counts = bins.groupBy("_lang", "_bin").agg(F.count("*").alias("n"))
    both = counts.unionByName(counts.groupBy("_bin").agg(F.sum("n").alias("n")).withColumn("_lang", F.lit(None).cast("string")))
    listed = both.groupBy("_lang").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("_bin", "n"))).alias("bins"))
    listed = listed.where((F.col("total") >= LEAST_TEXTS) | F.col("_lang").isNull())
    place = F.expr(f"""aggregate(bins, named_struct('seen', 0L, 'at', cast(null as bigint)),
        (s, b) -> named_struct('seen', s.seen + b.n, 'at', if(s.at is null and s.seen + b.n >= {quantile} * total, b._bin, s.at)), s -> s.at)""")
    return listed.select("_lang", (F.exp((place + 1) * BIN) * margin).alias("threshold"))


def classify(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER,
             quantile: float = QUANTILE, margin: float = MARGIN, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs with perplexity, threshold and keep (perplexity at most the threshold of the document's language).

    The keys in `trusted` (column `key`) name the trusted documents. Four fifths of them, by a hash of the key, train the
    model, all their text counts; the rest set the thresholds, so a small corpus does not judge new text by the perplexity of
    text it has learnt. Null text counts as empty (only its end is scored); a null language is one of its own; a language
    without enough trusted texts takes the threshold of all; without any trusted texts everything is kept and the threshold is
    null. Repeated rows keep a row each; empty tables give empty results; columns named like the results are replaced.
    """
    docs = docs.drop("perplexity", "threshold", "keep")
    names = trusted.where(F.col(key).isNotNull()).select(F.col(key).alias("_trusted")).distinct()
    if names.count() <= NAMES_BROADCAST:
        names = F.broadcast(names)
    own = docs.join(names, F.col(key) == F.col("_trusted"), "left_semi")
    tuning = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("tuning")), F.lit(5)) == 0
    tables = count_tables(own.where(~tuning), text, order)
    scores = score_table(docs, tables, text)
    tuned = perplexities(own.where(tuning), scores, order, key, text, shard_rows)
    limits = thresholds(tuned, lang, quantile, margin).collect()  # a row per language
    scored = perplexities(docs, scores, order, key, text, shard_rows)
    general = next((r["threshold"] for r in limits if r["_lang"] is None), None)
    limit = F.lit(general).cast("double")
    for r in limits:
        if r["_lang"] is not None:
            limit = F.when(F.coalesce(lang, F.lit("")) == r["_lang"], r["threshold"]).otherwise(limit)
    return scored.withColumn("threshold", limit).withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
