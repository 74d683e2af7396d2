"""The whole batch job. Stage tables are written and read back, so no stage runs twice and lost executors cost little."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.config import DEFAULTS, Settings
from waymark.functions.rules import evaluate_rules
from waymark.operators import (actions, anomaly, clean, decide, features, fusion, investigate, joins, metrics, models,
                               sessions)
from waymark.sources import tables


@dataclass
class Paths:
    raw: str
    processed: str
    models: str


def ingest(spark: SparkSession, paths: Paths, s: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """Raw tables to clean events, sessions, features, prefixes, baselines and texts."""
    raw = tables.load(spark, paths.raw)
    out = paths.processed
    events = sessions.sessionize(clean.clean_events(raw["events"], s), settings=s, source=raw["events"])
    events = tables.save(events, out, "events_clean", day="timestamp")
    table = tables.save(sessions.with_returning(sessions.session_table(events)), out, "sessions")
    full, prefixes, baselines = features.feature_tables(events, s)
    joined = joins.join_session_data(table, raw["payments"], raw["orders"], raw["tickets"], raw["reviews"])
    return {
        "events": events, "sessions": table, "baselines": tables.save(baselines, out, "dwell_baselines"),
        "features": tables.save(full.join(joined, "session_id", "left"), out, "features"),
        "prefixes": tables.save(prefixes, out, "prefix_features"),
        "texts": tables.save(joins.session_texts(raw["tickets"], raw["chats"], raw["reviews"]), out, "texts"),
        **{n: raw[n] for n in ("payments", "orders", "products", "reviews")},
    }


def train(spark: SparkSession, data: dict[str, DataFrame], truth: DataFrame, paths: Paths,
          s: Settings = DEFAULTS) -> None:
    """Fit and save the risk and friction models."""
    risk = models.RiskModel.fit(joins.risk_frame(data["prefixes"], data["sessions"]), s)
    risk.save(f"{paths.models}/risk")
    models.FrictionModel.fit(data["features"], metrics.friction_labels(truth), s).save(f"{paths.models}/friction")


def label_texts(data: dict[str, DataFrame], paths: Paths, s: Settings = DEFAULTS) -> DataFrame:
    """Fit the theme model on the training texts and label every text."""
    texts = data["texts"]
    model = models.ThemeModel.fit(texts.filter(~metrics.is_test(F.col("text_id"), s)))
    return tables.save(models.classify_distinct(model, texts.drop("theme_label"), s), paths.processed, "text_themes")


def score(spark: SparkSession, data: dict[str, DataFrame], paths: Paths) -> DataFrame:
    """Rules, risk, friction probabilities and what drove them, one row per session."""
    risk, friction = models.RiskModel.load(spark, f"{paths.models}/risk"), models.FrictionModel.load(spark, f"{paths.models}/friction")
    scores = models.score_sessions(data["features"], data["prefixes"], data["sessions"], risk, friction)
    scores = models.with_signals(scores, data["features"], data["prefixes"], risk, friction)
    flags = evaluate_rules(data["features"]).select("session_id", "rule_flags")
    return tables.save(scores.join(flags, "session_id"), paths.processed, "session_scores")


def decide_all(data: dict[str, DataFrame], scores: DataFrame, themes: DataFrame, paths: Paths,
               s: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """Packets, decisions with investigation, alerts, recovery plan and audit log."""
    out, table = paths.processed, data["sessions"]
    found, members = anomaly.detect_anomalies(anomaly.Sources(table, data["events"], data["payments"], data["orders"], data["reviews"]), s)
    found, members = tables.save(found, out, "anomalies"), tables.save(members, out, "anomaly_sessions")
    by_session = tables.save(fusion.session_themes(themes, table), out, "session_themes")
    aggregates = fusion.enrich_aggregates(found, members, scores, by_session, s)
    of_sessions = fusion.session_packets(scores, table, by_session, fusion.session_context(found, members), data["orders"], s)
    packets = tables.save(of_sessions.unionByName(aggregates, allowMissingColumns=True), out, "packets")
    first = decide.decide(packets, s).filter("gate = 'medium'")
    chosen = first.join(F.broadcast(decide.to_investigate(first, s=s)), "packet_id", "left_semi")
    facts = investigate.findings(chosen, data["payments"], data["orders"], themes, data["products"], table, members, s)
    decisions = tables.save(decide.decide_with_findings(packets, facts, s), out, "decisions")
    alerts = tables.save(actions.alerts(decisions, members), out, "alerts")
    recoveries = tables.save(actions.recovery_plan(decisions, s, data["products"]), out, "recovery_actions")
    log = tables.save(actions.audit_log(decisions, alerts, recoveries), out, "audit_log")
    return {"packets": packets, "decisions": decisions, "alerts": alerts, "recoveries": recoveries, "audit": log}


def evaluate(spark: SparkSession, paths: Paths, sections: dict[str, tuple[list[str], object]]) -> DataFrame:
    """Metric sections as one long table. A section whose tables are missing is reported as skipped.

    sections: name -> (tables it needs, function of those tables to a metrics frame).
    """
    done: dict[str, DataFrame] = {}
    for name, (needed, make) in sections.items():
        have = {n: tables.read(spark, paths.processed, n) for n in needed}
        missing = [n for n, df in have.items() if df is None]
        if missing:
            done[name] = spark.createDataFrame([(f"missing table: {missing[0]}", 0.0)], "skipped string, value double")
        else:
            done[name] = make(**have)
    return metrics.report(done)


__all__ = ["Paths", "decide_all", "evaluate", "ingest", "label_texts", "score", "train"]
