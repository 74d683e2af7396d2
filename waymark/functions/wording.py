"""Titles, explanations and messages filled from packet fields only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import vocab
from waymark.functions.columns import lookup, percent
from waymark.functions.decision import is_aggregate


def spaced(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def friction_label() -> Column:
    return lookup(vocab.FRICTION_LABELS, F.col("friction_type"))


def metric_label() -> Column:
    return F.coalesce(lookup(vocab.METRIC_LABELS, F.col("metric")), F.col("metric"))


def alert_title() -> Column:
    """Needs the packet columns of aggregates (segment, rates) and of sessions (device, city)."""
    anomaly = F.concat(
        friction_label(), F.lit(": "), spaced(F.col("segment_type")), F.lit(" "), F.col("segment_value"),
        F.lit(" - "), metric_label(), F.lit(" "), percent(F.col("observed")), F.lit(" vs "),
        percent(F.col("baseline")), F.lit(" ("), F.col("multiplier").cast("string"), F.lit("x)"))
    where = F.concat_ws(", ", F.nullif(F.col("device"), F.lit("")), F.nullif(F.col("city"), F.lit("")))
    session = F.concat(friction_label(), F.lit(" - session "), F.col("session_id"),
                       F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise(""))
    return F.substring(F.when(is_aggregate(), anomaly).otherwise(session), 1, 300)


def behaviour() -> Column:
    """Up to three rule meanings; the anomaly in front, or the strongest signals when nothing else is known."""
    meanings = F.slice(F.array_compact(F.transform(
        "rule_flags", lambda f: lookup({r[0]: r[3] for r in vocab.RULES}, f))), 1, 3)
    anomaly = F.concat(
        F.col("segment_type"), F.lit(" "), F.col("segment_value"), F.lit(": "), metric_label(), F.lit(" at "),
        percent(F.col("observed")), F.lit(" vs "), percent(F.col("baseline")), F.lit(" baseline ("),
        F.col("multiplier").cast("string"), F.lit("x) across "), F.col("affected_sessions").cast("string"),
        F.lit(" sessions"))
    signals = F.concat(F.lit("strongest signals: "), F.array_join(
        F.transform(F.slice("top_signals", 1, 3), lambda s: spaced(s["feature"])), ", "))
    themes = F.concat(F.lit("customer feedback themes: "), F.array_join(
        F.transform(F.slice("text_themes", 1, 3), spaced), ", "))
    parts = F.concat(
        F.when(is_aggregate(), F.array(anomaly)).otherwise(F.array().cast("array<string>")), meanings,
        F.when(~is_aggregate() & (F.size(meanings) == 0) & (F.size("top_signals") > 0), F.array(signals))
         .otherwise(F.array().cast("array<string>")),
        F.when(F.size("text_themes") > 0, F.array(themes)).otherwise(F.array().cast("array<string>")))
    text = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("detector signals")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000), F.lit("."))


def evidence_used() -> Column:
    """Names of the packet fields the explanation draws on."""
    flags = F.size("rule_flags") > 0
    names = F.array_compact(F.array(
        F.when(flags, "rule_flags"),
        *[F.when(is_aggregate(), c) for c in ("segment_value", "observed", "baseline", "multiplier",
                                              "affected_sessions")],
        F.when(~is_aggregate() & ~flags & (F.size("top_signals") > 0), "top_signals"),
        F.when(F.size("text_themes") > 0, "text_themes"),
        F.when(~is_aggregate() & F.col("aggregate_context.segment_type").isNotNull(), "aggregate_context")))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("friction_probs")))


def explanation() -> Column:
    ctx = "aggregate_context"
    linked = F.concat(
        F.lit(" Linked anomaly: "), F.col(f"{ctx}.segment_type"), F.lit(" "), F.col(f"{ctx}.segment"), F.lit(" at "),
        F.col(f"{ctx}.multiplier").cast("string"), F.lit("x baseline."))
    summary = F.concat(
        friction_label(), F.lit(" (confidence "), F.format_string("%.2f", F.col("confidence")), F.lit(") routed to "),
        spaced(F.col("owner_team")), F.lit("."))
    return F.struct(
        summary.alias("summary"), behaviour().alias("behavior_observed"),
        F.concat(lookup(vocab.LIKELY_CAUSES, F.col("friction_type")),
                 F.when(~is_aggregate(), F.coalesce(linked, F.lit(""))).otherwise("")).alias("likely_business_cause"),
        evidence_used().alias("evidence_used"))


def message(action: Column, product: Column | None = None, method: Column | None = None) -> Column:
    """The action's template with its slots filled, at most 300 characters."""
    text = lookup(vocab.TEMPLATES, action["template_id"])
    slots = {"{product}": F.coalesce(product, F.lit("item")) if product is not None else F.lit("item"),
             "{method}": F.coalesce(method, F.lit("this method")) if method is not None else F.lit("this method"),
             "{action}": action["description"]}
    for slot, value in slots.items():
        text = F.replace(text, F.lit(slot), value)
    return F.substring(text, 1, 300)
