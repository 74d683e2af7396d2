"""Evidence packets: what all detectors say about one session or one anomaly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.functions.decision import theme_frictions
from waymark.functions.rules import rule_frictions
from waymark.operators.decide import SIGNALS
from waymark.operators.joins import sparse_left_join
from waymark.operators.ordered import _small

# fixed values: the context fields of a packet
CONTEXT = ["device", "app_version", "city", "city_tier", "source", "gateway", "payment_method", "courier",
           "primary_product_id", "order_id", "exit_step", "furthest_step", "converted", "abandoned"]


def session_themes(texts: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, themes: of texts linked to the session itself, then of texts about its order, first seen first.

    Texts are reduced to one row per (key, theme) before the joins, so a key with very many texts stays small.
    """
    at = F.struct("ts", "text_id")
    direct = texts.filter("session_id IS NOT NULL").groupBy("session_id", "theme").agg(F.min(at).alias("at"))
    ordered = texts.filter("order_id IS NOT NULL").groupBy("order_id", "theme").agg(F.min(at).alias("at"))
    known = sessions.select("session_id", "order_id")
    # the themes of few orders go to the sessions; the other way round, all sessions of an order meet in one task
    via_order = known.filter("order_id IS NOT NULL").join(_small(ordered, ordered.count()), "order_id")
    rows = (
        direct.join(known, "session_id", "left_semi").select("session_id", "theme", F.lit(0).alias("via"), "at")
        .unionByName(via_order.select("session_id", "theme", F.lit(1).alias("via"), "at"))
        .groupBy("session_id", "theme").agg(F.min(F.struct("via", "at")).alias("first"))
    )
    listed = F.array_sort(F.collect_list(F.struct("first", "theme")))  # at most one entry per theme
    return rows.groupBy("session_id").agg(F.transform(listed, lambda x: x["theme"]).alias("themes"))


def session_context(packets: DataFrame, members: DataFrame) -> DataFrame:
    """session_id, aggregate_context of the strongest anomaly the session belongs to."""
    context = F.struct(
        "packet_id", "segment_type", F.col("segment_value").alias("segment"), "metric", "friction_hint", "multiplier",
        F.col("observed").alias("observed_rate"), F.col("baseline").alias("baseline_rate"), "affected_sessions",
        "window_start", "window_end")
    joined = members.join(packets.select("packet_id", "z_score", context.alias("context")), "packet_id")
    return joined.groupBy("session_id").agg(
        F.max_by("context", F.struct("z_score", "packet_id")).alias("aggregate_context"))


def at_risk(s: Settings = DEFAULTS):
    """Any rule, any theme that means friction, or a high risk without a purchase."""
    return (
        (F.size("rule_flags") > 0)
        | (F.size(theme_frictions(F.col("text_themes"))) > 0)
        | ((F.col("risk_score") >= s.at_risk_threshold) & ~F.col("converted"))
    )


def session_packets(scores: DataFrame, sessions: DataFrame, themes: DataFrame, contexts: DataFrame | None,
                    orders: DataFrame | None, s: Settings = DEFAULTS) -> DataFrame:
    """One packet per session at risk.

    scores: session_id, risk_score, rule_flags, top_signals, friction_probs, friction_signals.
    """
    have = [c for c in CONTEXT if c in sessions.columns]
    info = sessions.select("session_id", "user_id", "session_kind", "cart_value", "start", *have)
    out = scores.join(info, "session_id").join(themes, "session_id", "left").withColumn(
        "text_themes", F.coalesce("themes", F.array().cast("array<string>"))).drop("themes").filter(at_risk(s))
    if contexts is not None:
        out = out.join(contexts, "session_id", "left").withColumns({
            "friction_hint": F.col("aggregate_context.friction_hint"),
            "multiplier": F.col("aggregate_context.multiplier")})
    if orders is not None:
        values = orders.select("order_id", F.col("order_value").cast("double").alias("order_value"))
        out = sparse_left_join(out, values, "order_id", "session_id")
    return out.withColumns({"packet_id": F.concat(F.lit("pk_"), "session_id"), "packet_type": F.lit("session")})


def enrich_aggregates(packets: DataFrame, members: DataFrame, scores: DataFrame, themes: DataFrame,
                      s: Settings = DEFAULTS) -> DataFrame:
    """Summarise the affected sessions' detector outputs onto each anomaly.

    Each summary is a count per (packet, value) over a fixed vocabulary; no list of sessions is ever built.
    """
    hinted = members.join(packets.select("packet_id", "friction_hint"), "packet_id")
    rows = hinted.join(scores, "session_id")
    hint_signals = F.coalesce(F.try_element_at("friction_signals", F.col("friction_hint")), F.array().cast(SIGNALS))
    support = F.coalesce(F.array_contains(rule_frictions(F.col("rule_flags")), F.col("friction_hint")), F.lit(False))
    likely = F.coalesce(F.try_element_at("friction_probs", F.col("friction_hint")), F.lit(0.0))
    exact = lambda c: F.sum(c.cast("decimal(30,10)")).cast("double")
    totals = rows.groupBy("packet_id").agg(
        F.count(F.lit(1)).alias("sessions_scored"),
        F.count_if(support).alias("_rule"), F.count_if(likely >= s.friction_prob_threshold).alias("_model"),
        *[exact(F.coalesce(F.try_element_at("friction_probs", F.lit(f)), F.lit(0.0))).alias(f"_p_{f}")
          for f in vocab.FRICTIONS])
    # flags and signals in one pass: (kind, name, weight) per session, summed per packet
    entries = F.concat(
        F.transform("rule_flags", lambda x: F.struct(F.lit("flag").alias("kind"), x.alias("name"), F.lit(1.0).alias("w"))),
        F.transform("top_signals", lambda x: F.struct(F.lit("top").alias("kind"), x["feature"].alias("name"), x["value"].alias("w"))),
        F.transform(hint_signals, lambda x: F.struct(F.lit("hint").alias("kind"), x["feature"].alias("name"), x["value"].alias("w"))))
    weighed = rows.select("packet_id", F.explode(entries).alias("e")).groupBy("packet_id", "e.kind", "e.name").agg(
        exact(F.col("e.w")).alias("w"))
    ranked = weighed.withColumn("r", F.row_number().over(
        Window.partitionBy("packet_id", "kind").orderBy(F.desc("w"), "name")))
    item = F.struct("r", "name", "w")
    pick = lambda kind, cond=F.lit(True): F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & cond, item)))
    lists = ranked.groupBy("packet_id").agg(
        pick("flag").alias("_flags"), pick("top", F.col("r") <= 5).alias("_top"), pick("hint", F.col("r") <= 5).alias("_hint"))
    told = (
        members.join(themes, "session_id").select("packet_id", F.explode("themes").alias("theme"))
        .filter("theme <> 'other'").groupBy("packet_id", "theme").agg(F.count(F.lit(1)).alias("n"))
    )
    told = told.withColumn("r", F.row_number().over(Window.partitionBy("packet_id").orderBy(F.desc("n"), "theme")))
    top_themes = told.filter("r <= 3").groupBy("packet_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "theme"))), lambda x: x["theme"]).alias("_themes"))

    n = F.col("sessions_scored")
    signals = lambda c: F.transform(c, lambda x: F.struct(
        x["name"].alias("feature"), F.round(x["w"] / n, 4).alias("value")))
    common = F.filter("_flags", lambda x: x["w"] / n >= s.rule_support_share)
    hint_top = F.when(F.size("_hint") > 0, signals("_hint")).otherwise(signals("_top"))
    out = packets.join(totals, "packet_id", "left").join(lists, "packet_id", "left").join(top_themes, "packet_id", "left")
    scored = n.isNotNull()
    none = F.array().cast("array<string>")
    return out.withColumns({
        "rule_flags": F.coalesce(F.transform(common, lambda x: x["name"]), none),
        "friction_probs": F.when(scored, F.create_map(*[
            x for f in vocab.FRICTIONS for x in (F.lit(f), F.round(F.col(f"_p_{f}") / n, 4))])),
        "top_signals": F.coalesce(signals("_top"), F.array().cast(SIGNALS)),
        "friction_signals": F.when(scored & F.col("friction_hint").isNotNull() & F.col("_top").isNotNull(),
                                   F.create_map("friction_hint", hint_top)),
        "text_themes": F.when(scored, F.coalesce("_themes", none)).otherwise(none),
        "rule_support_share": F.round(F.col("_rule") / n, 3),
        "model_support_share": F.round(F.col("_model") / n, 3),
    }).drop("_rule", "_model", "_flags", "_top", "_hint", "_themes", *[f"_p_{f}" for f in vocab.FRICTIONS])
