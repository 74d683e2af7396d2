"""Sums over a time range around each probe, without pairing probes and facts.

A range sum is the difference of two running sums. Facts and range borders are sorted together once per key, so the
cost grows with their number and not with the number of (probe, fact) pairs; keys with very many rows are chunked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.config import DEFAULTS, Settings
from waymark.operators.ordered import ordered, split_hot


def range_sums(probes: DataFrame, facts: DataFrame, key: str, values: Sequence[str],
               s: Settings = DEFAULTS) -> DataFrame:
    """probes: probe_id, <key>, lo, hi (both inclusive); facts: <key>, at, <values>. Result: probe_id, <values>."""
    per_time = facts.filter(F.col(key).isNotNull()).groupBy(key, "at").agg(*[F.sum(v).alias(v) for v in values])
    known = probes.filter(F.col(key).isNotNull() & F.col("lo").isNotNull())
    zero = [F.lit(0).cast(facts.schema[v].dataType).alias(v) for v in values]
    none = F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id")
    # at equal times: lower border, then facts, then upper border, so that both borders are inside
    both = (
        per_time.select(key, "at", F.lit(1).alias("rank"), none, *values)
        .unionByName(known.select(key, F.col("lo").alias("at"), F.lit(0).alias("rank"), "probe_id", *zero))
        .unionByName(known.select(key, F.col("hi").alias("at"), F.lit(2).alias("rank"), "probe_id", *zero))
    )
    both = split_hot(both, [key], "at", s.hot_rows, s.max_chunks)
    run = ordered(both, [key], ["at", "rank"], total={f"r_{v}": F.col(v) for v in values}).filter("rank <> 1")
    side = F.when(F.col("rank") == 2, 1).otherwise(-1)
    return run.groupBy("probe_id").agg(*[F.sum(side * F.col(f"r_{v}")).alias(v) for v in values])
