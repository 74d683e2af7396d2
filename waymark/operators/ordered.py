"""Ordered calculations within a key that stay parallel when one key holds a large part of all rows.

Normally a key is small and a plain window over it is the best plan: one shuffle, one sort. `split_hot` looks for
keys above a row limit first. If there are any, it cuts their time line into chunks of about that size (equal depth,
from approximate quantiles) and adds a `chunk` column. All helpers here see that column: they then run the window
within (key, chunk) and add what earlier chunks of the key carry over, which is one row per chunk. That small carry
table is checkpointed, so stacked calls do not run each other again and again, and it is broadcast when its row count
allows. Results do not depend on where the cuts are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULTS
from waymark.functions.columns import micros
from waymark.session import checkpointed

CHUNK = "chunk"
ORDER = ("timestamp", "seq")
BROADCAST_ROWS = 200_000  # rows or cuts of a few numbers each: some MB


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def split_hot(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", limit: int = DEFAULTS.hot_rows,
              max_chunks: int = DEFAULTS.max_chunks, source: DataFrame | None = None) -> DataFrame:
    """Add `chunk` when some key has more than `limit` rows; otherwise return the frame unchanged.

    The probe is one aggregation over the key columns; only the number of hot keys (at most rows / limit) comes back. `source` is
    a cheaper frame with at least the rows of df, on which the probe then runs.
    """
    if df.isStreaming or CHUNK in df.columns:
        return df
    sizes = (df if source is None else source).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    n_hot, largest = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
    if n_hot == 0:
        return df
    # a grid fine enough for the largest key, so that chunks keep their size however long it is
    max_chunks = max(max_chunks, -(-largest // limit))
    grid = [i / max_chunks for i in range(1, max_chunks)]
    # keep every k-th quantile so that a key gets about n / limit chunks
    step = F.greatest(F.lit(1), F.floor(max_chunks / F.ceil(F.col("_n") / limit)).cast("int"))
    cuts = (
        df.join(_small(sizes, n_hot), list(keys))
        .groupBy(*keys)
        .agg(F.percentile_approx(micros(ts), grid, 10_000).alias("_grid"), F.max("_n").alias("_n"))
        .select(*keys, F.array_distinct(F.filter("_grid", lambda _, i: (i + 1) % step == 0)).alias("_cuts"))
    )
    before = F.size(F.filter("_cuts", lambda cut: cut < micros(ts)))
    return (
        df.join(_small(cuts, n_hot * max_chunks), list(keys), "left")
        .withColumn(CHUNK, F.when(F.col("_cuts").isNull(), F.lit(-1)).otherwise(before))
        .drop("_cuts")
    )


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER, *,
            prior: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None,
            peak: Mapping[str, Column] | None = None) -> DataFrame:
    """Add running columns within `keys` in `order`.

    prior: last non-null value strictly before the row. total / peak: sum / maximum up to and including the row.
    """
    prior, total, peak = prior or {}, total or {}, peak or {}
    chunked = CHUNK in df.columns
    part = [*keys, CHUNK] if chunked and CHUNK not in keys else list(keys)
    w = Window.partitionBy(*part).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    inside = df.select(
        "*",
        *[F.last(v, ignorenulls=True).over(before).alias(n) for n, v in prior.items()],
        *[F.sum(v).over(upto).alias(n) for n, v in total.items()],
        *[F.max(v).over(upto).alias(n) for n, v in peak.items()],
    )
    if not chunked:
        return inside

    at = F.struct(*order)
    ends = df.filter(F.col(CHUNK) >= 0).groupBy(*part).agg(
        *[F.max_by(v, F.when(v.isNotNull(), at)).alias(n) for n, v in prior.items()],
        *[F.sum(v).alias(n) for n, v in total.items()],
        *[F.max(v).alias(n) for n, v in peak.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *part,
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in prior],
        *[F.sum(n).over(earlier).alias(f"_c_{n}") for n in total],
        *[F.max(n).over(earlier).alias(f"_c_{n}") for n in peak],
    )
    merged = {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in prior}
    merged |= {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in total}
    merged |= {n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in peak}
    carry = checkpointed(carry)
    carry = _small(carry, carry.count())
    names = inside.columns
    return inside.join(carry, part, "left").select(*[merged[n].alias(n) if n in merged else F.col(n) for n in names])


def group_max(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Add the maximum of a column over the whole key."""
    if CHUNK not in df.columns:
        return df.withColumn(name, F.max(column).over(Window.partitionBy(*keys)))
    return df.join(df.groupBy(*keys).agg(F.max(column).alias(name)), list(keys))


def spread(df: DataFrame, value: str, n: int = 256) -> DataFrame:
    """Chunk by a number, about as many rows in every chunk, for global rankings over many distinct values.

    The cuts are approximate quantiles of all rows, so values that lie close together are divided too.
    """
    cuts = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    return df.withColumn(CHUNK, _below(sorted(set(cuts)), F.col(value)))


def _below(cuts: Sequence[float], value: Column, first: int = 0) -> Column:
    """How many of the ascending cuts lie below the value, as a tree of comparisons."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(value > cuts[middle], _below(cuts[middle + 1:], value, first + middle + 1)).otherwise(_below(cuts[:middle], value, first))
