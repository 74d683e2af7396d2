"""Evaluation metrics as aggregations. Rankings are made over distinct scores in score ranges, not in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.functions.columns import bucket, ratio
from waymark.operators.ordered import CHUNK, ordered, spread


def is_test(key: Column, s: Settings = DEFAULTS) -> Column:
    """Stable one-in-n test split."""
    return bucket(key, s.test_share_mod) == 0


def is_calibration(key: Column) -> Column:
    """Stable one-in-five split inside the training part."""
    return bucket(F.concat(key, F.lit(":calibration")), 5) == 0


def friction_labels(truth: DataFrame) -> DataFrame:
    """Multi-hot labels from 'a|b' texts."""
    named = F.split(F.coalesce("friction_types", F.lit("")), r"\|")
    return truth.select("session_id", *[F.array_contains(named, f).cast("int").alias(f) for f in vocab.FRICTIONS])


def _ranked(scored: DataFrame, score: str, label: str, groups: Sequence[str]) -> DataFrame:
    """Distinct scores per group with positives / negatives and the running counts from the top."""
    counts = scored.groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    # squeeze any score into (0, 1), falling, so that equal ranges of it are chunks of the ranking
    falling = F.lit(0.5) - F.col("score") / (2 * (1 + F.abs("score")))
    counts = counts.withColumns({"_fall": falling, "_down": -F.col("score"), "_all": F.lit(0)})
    run = ordered(spread(counts, "_fall"), [*groups, "_all"], ["_down"], total={"tp": F.col("pos"), "fp": F.col("neg")})
    return run.drop(CHUNK)


def ranking_metrics(scored: DataFrame, score: str = "score", label: str = "label",
                    groups: Sequence[str] = ()) -> DataFrame:
    """Average precision (step definition, ties together), ROC-AUC (ties count half), Brier score and base rate."""
    ranked = _ranked(scored, score, label, groups)
    before, pos = F.col("fp") - F.col("neg"), F.col("pos").cast("double")
    # negatives ranked below a positive, ties half: total minus those above
    parts = ranked.groupBy(*groups).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(pos * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("_ap"),
        F.sum(pos * before * 2 + pos * F.col("neg")).alias("_above2"),
        F.sum(F.col("pos") * F.pow(F.col("score") - 1, 2) + F.col("neg") * F.pow("score", F.lit(2))).alias("_sq"))
    return parts.select(
        *groups, (F.col("P") + F.col("N")).alias("n"), ratio(F.col("P"), F.col("P") + F.col("N")).alias("positive_rate"),
        ratio(F.col("_ap"), F.col("P")).alias("average_precision"),
        (1 - ratio(F.col("_above2"), F.col("P").cast("double") * F.col("N") * 2)).alias("roc_auc"),
        ratio(F.col("_sq"), F.col("P") + F.col("N")).alias("brier"))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision = F.coalesce(ratio(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(ratio(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return [F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
            (tp + fn).alias("support")]


def prf_per_class(long: DataFrame) -> DataFrame:
    """long: class, truth (bool), predicted (bool) -> precision, recall, f1, support; 0 where undefined."""
    t, p = F.col("truth"), F.col("predicted")
    counts = long.groupBy("class").agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return counts.select("class", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.round(F.avg("f1"), 4).alias("macro_f1"))


def long_form(labels: DataFrame, predicted: DataFrame, classes: Sequence[str] = vocab.FRICTIONS) -> DataFrame:
    """One-hot columns of two frames (session_id + one column per class) as class, truth, predicted rows."""
    stack = ", ".join(f"'{c}', `t_{c}`, `p_{c}`" for c in classes)
    t = labels.select("session_id", *[F.col(c).cast("boolean").alias(f"t_{c}") for c in classes])
    p = predicted.select("session_id", *[F.col(c).cast("boolean").alias(f"p_{c}") for c in classes])
    joined = p.join(t, "session_id", "left").na.fill(False)
    return joined.selectExpr("session_id", f"stack({len(classes)}, {stack}) as (class, truth, predicted)")


def rule_quality(flagged: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per friction P/R/F1, share of clean sessions with any rule). flagged: session_id, frictions (array)."""
    fired = flagged.select("session_id", "frictions", *[
        F.array_contains("frictions", f).alias(f) for f in vocab.FRICTIONS])
    per = prf_per_class(long_form(friction_labels(truth), fired))
    clean = truth.filter("is_clean").select("session_id").join(flagged, "session_id")
    share = clean.agg(F.round(ratio(F.count_if(F.size("frictions") > 0), F.count(F.lit(1))), 4)
                      .alias("clean_sessions_with_any_rule"))
    return per, share


def decision_quality(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: coverage, cause accuracy, false alerts. decisions: session_id, friction_type, gate (sessions only)."""
    both = truth.join(decisions.select("session_id", "friction_type", "gate"), "session_id", "left")
    covered = ~F.col("is_clean") & F.col("friction_type").isNotNull()
    alerted = F.coalesce(F.col("gate").isin("high", "medium"), F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    planted = F.array_contains(F.split("friction_types", r"\|"), F.col("friction_type"))
    part = lambda a, b: F.round(F.coalesce(ratio(n(a), n(b)), F.lit(0.0)), 4)
    return both.agg(
        n(~F.col("is_clean")).alias("friction_sessions"),
        part(covered, ~F.col("is_clean")).alias("detection_coverage"),
        part(covered & (F.col("friction_type") == F.col("primary_friction")), covered).alias("cause_accuracy_primary"),
        part(covered & planted, covered).alias("cause_accuracy_any_planted"),
        part(F.col("is_clean") & alerted, F.col("is_clean")).alias("clean_sessions_alerted"),
        part(F.col("gate") == "high", alerted).alias("alerts_high_confidence_share"))


def gate_counts(decisions: DataFrame) -> DataFrame:
    """Decisions per gate, sessions and anomalies apart."""
    return decisions.groupBy("packet_type", "gate").agg(F.count(F.lit(1)).alias("packets"))


def aggregate_decisions(decisions: DataFrame) -> DataFrame:
    """What was decided about every anomaly."""
    return decisions.filter("packet_type = 'aggregate'").select("packet_id", "friction_type", "gate", "confidence", "priority")


def accuracy_by_friction(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    covered = truth.filter("NOT is_clean").join(decisions.select("session_id", "friction_type"), "session_id")
    return covered.groupBy("primary_friction").agg(F.round(ratio(F.count_if(
        F.col("friction_type") == F.col("primary_friction")), F.count(F.lit(1))), 4).alias("accuracy"))


def text_quality(scored: DataFrame, s: Settings = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    """scored: label, predicted, prob -> accuracy, coverage at the gate, accuracy when confident and with fallback."""
    right = F.col("label") == F.col("predicted")
    sure = F.col("prob") >= s.theme_min_prob
    gated = F.when(sure, F.col("predicted")).otherwise("other")
    n = F.count(F.lit(1))
    return scored.groupBy(*by).agg(
        n.alias("texts"), F.round(ratio(F.count_if(right), n), 4).alias("accuracy"),
        F.round(ratio(F.count_if(sure), n), 4).alias("coverage_at_min_prob"),
        F.round(ratio(F.count_if(sure & right), F.count_if(sure)), 4).alias("accuracy_when_confident"),
        F.round(ratio(F.count_if(gated == F.col("label")), n), 4).alias("accuracy_with_fallback"))


def multiclass_prf(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Per-class metrics of a single-label classifier from its confusion counts."""
    cells = scored.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(
        F.struct(F.col("l").alias("class"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(F.col("l") != F.col("p"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(F.col("l") != F.col("p"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn"))))
    sums = cells.select(sides.alias("x")).groupBy("x.class").agg(
        F.sum("x.tp").alias("tp"), F.sum("x.fp").alias("fp"), F.sum("x.fn").alias("fn"))
    return sums.select("class", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def incident_quality(packets: DataFrame, incidents: DataFrame, matches: DataFrame) -> DataFrame:
    """incident_id, packets, detected."""
    hits = matches.groupBy("incident_id").agg(F.count(F.lit(1)).alias("packets"))
    return incidents.select("incident_id").join(hits, "incident_id", "left").select(
        "incident_id", F.coalesce("packets", F.lit(0)).alias("packets"), F.col("packets").isNotNull().alias("detected"))


def unmatched_anomalies(packets: DataFrame, matches: DataFrame) -> DataFrame:
    return packets.join(matches.select("packet_id").distinct(), "packet_id", "left_anti").select("packet_id")


def planted_products_flagged(packets: DataFrame, incidents: DataFrame, matches: DataFrame) -> DataFrame:
    """Products of missing-size incidents: how many were planted and how many a matched packet names."""
    from waymark.operators.anomaly import incident_segments
    planted = incident_segments(incidents.filter("kind = 'missing_size_info'")).select("segment_value").distinct()
    named = packets.filter("segment_type = 'product'").join(matches.select("packet_id").distinct(), "packet_id", "left_semi") \
                   .select("segment_value").distinct().withColumn("hit", F.lit(True))
    return planted.join(named, "segment_value", "left").agg(
        F.count(F.lit(1)).alias("planted"), F.count_if("hit").alias("flagged"))


def label_prevalence(truth: DataFrame) -> DataFrame:
    """Shares of clean sessions, of sessions with two frictions, and of each friction, as (label, share)."""
    n_types = F.size(F.filter(F.split(F.coalesce("friction_types", F.lit("")), r"\|"), lambda x: x != ""))
    named = F.split(F.coalesce("friction_types", F.lit("")), r"\|")
    marks = F.array_compact(F.array(
        F.when(F.col("is_clean"), "clean"), F.when(n_types >= 2, "double"),
        *[F.when(F.array_contains(named, f), f) for f in vocab.FRICTIONS]))
    total = truth.agg(F.count(F.lit(1)).alias("n")).scalar()
    return truth.select(F.explode(marks).alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("sessions")).withColumn("share", F.round(ratio(F.col("sessions"), total), 4))


def affected_per_incident(truth: DataFrame) -> DataFrame:
    return truth.filter("incident_id IS NOT NULL").groupBy("incident_id").agg(F.count(F.lit(1)).alias("affected_sessions"))


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """Several metric tables as one long table: section, metric, key, value."""
    parts = []
    for name, df in sections.items():
        numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "long", "integer", "boolean")]
        keys = [c for c in df.columns if c not in numeric]
        key = F.concat_ws("|", *keys) if keys else F.lit("")
        rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in numeric]))
        parts.append(df.select(F.lit(name).alias("section"), key.alias("key"), rows.alias("m")).select(
            "section", "m.metric", "key", "m.value"))
    return reduce(DataFrame.unionByName, parts)
