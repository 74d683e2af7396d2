"""Decisions: one row per packet in, one decision row out, no shuffle on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.functions import decision as d
from waymark.functions.columns import strings
from waymark.functions.rules import rule_frictions

SIGNALS = "array<struct<feature:string,value:double>>"
FINDINGS = ("array<struct<tool:string,summary:string,supports:string,evidence_kind:string,args:array<struct<name:string,value:string>>,"
            "numbers:array<struct<name:string,value:double>>>>")
_FINDING = {"tool": "string", "summary": "string", "supports": "string", "evidence_kind": "string", "args": "array<struct<name:string,value:string>>",
            "numbers": "array<struct<name:string,value:double>>"}
# columns of a packet frame with the value a packet has when it does not say anything
PACKET = {
    "packet_id": "string", "packet_type": "string", "session_id": "string", "user_id": "string",
    "session_kind": "string", "risk_score": "double", "rule_flags": "array<string>",
    "friction_probs": "map<string,double>", "top_signals": SIGNALS, "friction_signals": f"map<string,{SIGNALS}>",
    "text_themes": "array<string>", "friction_hint": "string", "multiplier": "double", "converted": "boolean",
    "cart_value": "double", "order_value": "double", "revenue_at_risk": "double", "affected_sessions": "bigint",
    "rule_support_share": "double", "model_support_share": "double", "findings": FINDINGS,
}
_EMPTY = {"rule_flags": F.array, "text_themes": F.array, "top_signals": F.array, "findings": F.array,
          "friction_probs": F.create_map, "friction_signals": F.create_map}


def packet_frame(packets: DataFrame) -> DataFrame:
    """Complete a frame of packets with the columns decisions need. Other columns stay."""
    def column(name: str, kind: str) -> Column:
        have = F.col(name) if name in packets.columns else F.lit(None)
        return F.coalesce(have.cast(kind), _EMPTY[name]().cast(kind)) if name in _EMPTY else have.cast(kind)

    return packets.withColumns({n: column(n, k) for n, k in PACKET.items()})


def classified(packets: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Add friction_type, secondary_friction, classification_source.

    Order of belief: the anomaly's own friction, rules, model, themes, and the least unlikely friction at the end.
    """
    p = packets.withColumns({
        "_rules": d.by_stage(rule_frictions(F.col("rule_flags"))),
        "_model": d.model_frictions(s),
        "_themes": d.theme_frictions(F.col("text_themes")),
    })
    hinted = d.is_aggregate() & F.col("friction_hint").isNotNull()
    has = lambda c: F.size(c) > 0
    p = p.withColumns({
        "classification_source": F.when(hinted, "aggregate_metric").when(has("_rules"), "rules")
            .when(has("_model"), "classifier").when(has("_themes"), "themes").otherwise("weak_classifier"),
        "_ordered": F.when(hinted, F.array("friction_hint")).when(has("_rules"), F.col("_rules"))
            .when(has("_model"), F.col("_model")).when(has("_themes"), d.by_prob(F.col("_themes")))
            .otherwise(d.by_prob(strings(vocab.FRICTIONS))),
    })
    p = p.withColumn("friction_type", F.get("_ordered", F.lit(0)))
    pool = F.concat(F.slice("_ordered", F.lit(2), F.size("_ordered")), "_rules", "_model", "_themes")
    other = F.get(F.filter(pool, lambda f: f != F.col("friction_type")), F.lit(0))
    return p.withColumn("secondary_friction", other).drop("_rules", "_model", "_themes", "_ordered")


def with_confidence(packets: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Weighted agreement of the detectors on the chosen friction, and the gate it opens."""
    f = F.col("friction_type")
    own = F.coalesce(F.try_element_at(F.col("friction_signals"), f), F.array().cast(SIGNALS))
    features = F.transform(F.concat("top_signals", own), lambda x: x["feature"])
    on_hint = F.coalesce(F.col("friction_hint") == f, F.lit(False))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    signal = d.signal_supports(features, f)
    out = packets.withColumns({
        "rule_supports": F.when(d.is_aggregate(), on_hint & (share("rule_support_share") >= s.rule_support_share))
            .otherwise(F.array_contains(rule_frictions(F.col("rule_flags")), f)),
        "model_supports": signal & F.when(
            d.is_aggregate(), on_hint & (share("model_support_share") >= s.model_support_share)
        ).otherwise(d.prob(f) >= s.friction_prob_threshold),
        "text_supports": F.array_contains(d.theme_frictions(F.col("text_themes")), f) | d.finding_supports(f, "text"),
        "aggregate_supports": on_hint | d.finding_supports(f, "aggregate", "catalog"),
    })
    weights = {"rule_supports": s.weight_rule, "model_supports": s.weight_model, "text_supports": s.weight_text,
               "aggregate_supports": s.weight_aggregate}
    score = sum((F.when(F.col(c), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    out = out.withColumn("confidence", F.round(score, 4))  # rounded before it is compared
    return out.withColumn("gate", d.gate(F.col("confidence"), s))


def with_priority(packets: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Exposure and priority: money at risk, customers affected, trend."""
    late = F.col("session_kind") == "post_purchase"
    revenue = (
        F.when(d.is_aggregate(), F.col("revenue_at_risk"))
        .when(late, F.coalesce("order_value", F.lit(0.0)))
        .when(F.coalesce("converted", F.lit(False)), F.lit(0.0)).otherwise(F.col("cart_value"))
    )
    out = packets.withColumns({
        "_revenue": F.coalesce(revenue, F.lit(0.0)),
        "customers_affected": F.when(d.is_aggregate(), F.col("affected_sessions")).otherwise(F.lit(1)).cast("bigint"),
        "trend_factor": d.trend_factor(F.col("multiplier")),
    })
    out = out.withColumn("impact", d.impact(F.col("_revenue"), F.col("customers_affected"), F.col("trend_factor")))
    return out.withColumns({"priority": d.priority(F.col("impact"), s),
                            "revenue_at_risk": F.round("_revenue", 2)}).drop("_revenue")


def with_actions(packets: DataFrame, moment: str | None = None) -> DataFrame:
    when = F.lit(moment) if moment else d.default_moment()
    f = F.col("friction_type")
    return packets.withColumns({
        "moment": when,
        "customer_action": d.first_action(f, "customer", when),
        "team_action": d.first_action(f, "team"),
    })


def decide(packets: DataFrame, s: Settings = DEFAULTS, moment: str | None = None) -> DataFrame:
    """Packet columns plus the decision columns."""
    out = with_confidence(classified(packet_frame(packets), s), s)
    out = with_actions(with_priority(out, s), moment)
    return out.withColumns({"owner_team": d.owner_team(F.col("friction_type")),
                            "needs_review": F.col("gate") == "medium"})


def to_investigate(decisions: DataFrame, limit: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Ids of the medium packets worth a look: aggregates first, then by risk. The limit is the daily budget."""
    order = [d.is_aggregate().desc(), F.coalesce("risk_score", F.lit(1.0)).desc(), F.col("packet_id")]
    return decisions.filter("gate = 'medium'").orderBy(*order).limit(
        s.investigate_limit if limit is None else limit).select("packet_id")


def _as_findings(findings: DataFrame, column: str) -> Column:
    """Findings with all fields, by name; those that somebody's findings do not have are null."""
    have = findings.schema["findings"].dataType.elementType.fieldNames()
    return F.transform(column, lambda x: F.struct(*[(x[n] if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in _FINDING.items()]))


def decide_with_findings(packets: DataFrame, findings: DataFrame, s: Settings = DEFAULTS,
                         limit: int | None = None, moment: str | None = None) -> DataFrame:
    """Two passes: medium packets within the budget get their findings and the same decision again.

    `findings`: packet_id, findings. A packet without findings is looked at too, and stays as it is.
    """
    first = decide(packets, s, moment).select("packet_id", "packet_type", "risk_score", "gate")
    chosen = F.broadcast(to_investigate(first, limit, s)).withColumn("investigated", F.lit(True))
    enriched = (
        packet_frame(packets).join(chosen, "packet_id", "left")
        .join(findings.select("packet_id", F.col("findings").alias("_found")), "packet_id", "left")
        .withColumn("investigated", F.coalesce("investigated", F.lit(False)))
        .withColumn("findings", F.when(F.col("investigated") & F.col("_found").isNotNull(),
                                       F.concat("findings", _as_findings(findings, "_found"))).otherwise(F.col("findings")))
        .drop("_found")
    )
    return decide(enriched, s, moment)


DECISION_COLUMNS = [
    "packet_id", "packet_type", "session_id", "friction_type", "secondary_friction", "classification_source",
    "confidence", "gate", "owner_team", "priority", "impact", "revenue_at_risk", "customers_affected",
    "trend_factor", "rule_supports", "model_supports", "text_supports", "aggregate_supports", "customer_action",
    "team_action", "needs_review",
]


def decision_rows(decisions: DataFrame) -> DataFrame:
    extra = ["investigated"] if "investigated" in decisions.columns else []
    return decisions.select(*DECISION_COLUMNS, *extra)


def summary(decisions: DataFrame) -> DataFrame:
    """Counts by gate, priority, team and investigation, as (section, value, packets)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("value"))
                      for c in ("gate", "priority", "owner_team", "investigated") if c in decisions.columns])
    return decisions.select(F.explode(pairs).alias("x")).groupBy("x.section", "x.value").agg(
        F.count(F.lit(1)).alias("packets"))
