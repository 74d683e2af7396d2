"""Fits see all rows, whatever the number of tasks that hold them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import boosting, metrics, models

MANY = 60_000


def _base(nodes, model):
    return nodes.filter((F.col("model") == model) & (F.col("tree") == boosting.ROOT)).first()["value"]


def _odds(frame, label):
    mean = frame.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return np.log(mean / (1 - mean))


def _numbered(spark, n):
    """Few positives that follow no pattern of the key, so a part of the rows has another share of them."""
    return spark.range(n).select(F.concat(F.lit("s_"), "id").alias("session_id"), (F.col("id") % 7).alias("a"), F.rand(4).alias("b"),
                                 (F.hash("id") % 37 == 0).cast("int").alias("label"), (F.hash("id") % 23 == 0).cast("int").alias("other"))


def test_the_risk_model_sees_every_row(spark):
    frame = _numbered(spark, MANY * 3 // 2)
    seen = frame.filter(~metrics.is_test(F.col("session_id"))).filter(~metrics.is_calibration(F.col("session_id")))
    assert seen.count() > 50_000
    model = models.RiskModel.fit(frame, features=["a", "b"], rounds=1, leaves=2)
    assert _base(model.nodes, "risk") == pytest.approx(_odds(seen, "label"), abs=1e-12)


def test_the_models_of_scored_sessions_see_every_row(spark):
    frame = _numbered(spark, MANY * 6 // 5)
    labels = frame.select("session_id", F.col("label").alias("x"), F.col("other").alias("y"))
    model = models.FrictionModel.fit(frame, labels, features=["a", "b"], rounds=1, leaves=2, frictions=["x", "y"])
    seen = frame.filter(~metrics.is_test(F.col("session_id"))).cache()
    assert seen.count() > 50_000
    assert [_base(model.nodes, f) for f in ("x", "y")] == pytest.approx([_odds(seen, "label"), _odds(seen, "other")], abs=1e-12)


def test_every_tree_counts_all_rows_that_it_draws(spark):
    # the first leaf has 40 of 60,000 rows: a part of them would not be allowed to have a leaf of their own
    frame = spark.range(MANY).select(F.concat(F.lit("s_"), "id").alias("k"), (F.col("id") < 40).cast("int").alias("a"), ((F.col("id") < 40) | (F.col("id") % 50 == 3)).cast("int").alias("y"))
    nodes = boosting.fit(frame, "k", ["a"], ["y"], boosting.Growth(1, 2, least_rows=40, row_share=1.1)).collect()
    assert len(nodes) == 4 and sorted(n["feature"] for n in nodes if n["left"] >= 0) == [0]


def _mixed(spark, n):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=(n, 3)), rng.integers(0, 6, (n, 4)) * rng.integers(0, 2, (n, 4)), np.full(n, 3.0)])
    x[:40, 0], x[40:60, 1] = -0.0, np.inf
    y = ((x[:, 0] > 0) ^ (x[:, 4] > 1)).astype(float)
    z = (x[:, 1] + rng.normal(size=n) > 0.5).astype(float)
    keys = [None if i % 50 == 0 else f"s{i // 3}" for i in range(n)]  # keys are missing or come several times
    rows = [(k, *(None if j == 2 and i % 5 == 0 else float(v) for j, v in enumerate(r)), float(a), float(b)) for i, (k, r, a, b) in enumerate(zip(keys, x, y, z))]
    names = [f"c{j}" for j in range(x.shape[1])]
    frame = spark.createDataFrame(rows + rows[:25], "k string, " + ", ".join(f"{c} double" for c in names) + ", y double, z double")
    return frame, names


def test_one_task_and_many_tasks_give_the_same_trees(spark):
    frame, names = _mixed(spark, 1500)
    how = boosting.Growth(4, 12)
    one = boosting.fit(frame, "k", names, ["y", "z"], how)
    many = boosting.fit(frame.repartition(5), "k", names, ["y", "z"], how, task_rows=300)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert {n["model"] for n in one.collect()} == {"y", "z"} and one.count() > 100


def test_borders_are_exact_quantiles(spark):
    frame, names = _mixed(spark, 1500)
    whole = frame.select(F.array(*[F.coalesce(c, F.lit(0.0)) for c in names]).alias("x"))
    x = np.array([r["x"] for r in whole.collect()])
    found, n = boosting.exact_borders(whole.repartition(7), len(names))
    expected = boosting.borders_of(x)
    assert n == len(x) and [len(b) for b in expected][-1] == 1 and max(len(b) for b in expected) == boosting.BINS
    assert all(np.array_equal(a, b) for a, b in zip(found, expected, strict=True))
    # a row's place among the borders survives the packing of several columns into one number
    packing = boosting.Packing.of(expected, 10**6)
    packed = packing.packed(x)
    assert len(packing.groups) < len(packing.columns) == len(names) - 1
    for k in packing.columns:
        for cut in range(len(expected[k])):
            line, lower = packing.lower(k, cut)
            assert np.array_equal(lower[packed[line]], x[:, k] <= expected[k][cut])


def test_an_empty_frame_gives_no_trees(spark):
    frame = spark.range(0).select(F.col("id").cast("string").alias("k"), F.lit(1.0).alias("a"), F.lit(1).alias("y"))
    assert boosting.fit(frame, "k", ["a"], ["y"], boosting.Growth(2)).count() == 0
