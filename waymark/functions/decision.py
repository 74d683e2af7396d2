"""The decision layer as column expressions: cause, confidence, gate, priority, action.

They work on a *packet frame*: one row per packet, session and aggregate packets side by side (see
`operators.decide.packet_frame` for the columns).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.functions.columns import hash32, lookup, strings


def is_aggregate() -> Column:
    return F.col("packet_type") == "aggregate"


def _array_lookup(table: dict[str, list[str]], key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), strings(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def theme_frictions(themes: Column) -> Column:
    """Frictions the themes point at, in order, without repeats."""
    nested = F.transform(themes, lambda t: F.coalesce(_array_lookup(vocab.THEME_FRICTIONS, t), strings([])))
    return F.array_distinct(F.flatten(nested))


def prob(friction: Column, probs: str = "friction_probs") -> Column:
    return F.coalesce(F.try_element_at(F.col(probs), friction), F.lit(0.0))


def _place(friction: Column) -> Column:
    return lookup({f: i for i, f in enumerate(vocab.FRICTIONS)}, friction)


def by_prob(frictions: Column) -> Column:
    """Most probable first, taxonomy order on ties."""
    keyed = F.transform(frictions, lambda f: F.struct((-prob(f)).alias("p"), _place(f).alias("i"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda s: s["f"])


def by_stage(frictions: Column) -> Column:
    """Latest funnel stage first, then probability, then taxonomy order."""
    keyed = F.transform(frictions, lambda f: F.struct(
        (-lookup(vocab.FRICTION_STAGE, f)).alias("s"), (-prob(f)).alias("p"), _place(f).alias("i"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda s: s["f"])


def model_frictions(s: Settings = DEFAULTS) -> Column:
    likely = F.filter(strings(vocab.FRICTIONS), lambda f: prob(f) >= s.friction_prob_threshold)
    return by_prob(likely)


def signal_supports(features: Column, friction: Column) -> Column:
    """Does any signal belong to the features that are evidence for the friction?"""
    return F.coalesce(F.arrays_overlap(features, _array_lookup(vocab.EVIDENCE_FEATURES, friction)), F.lit(False))


def finding_supports(friction: Column, *kinds: str) -> Column:
    return F.coalesce(F.exists(
        "findings", lambda f: (f["supports"] == friction) & f["evidence_kind"].isin(*kinds)), F.lit(False))


def gate(score: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(score >= s.gate_high, "high").when(score >= s.gate_medium, "medium").otherwise("low")


def trend_factor(multiplier: Column) -> Column:
    clamped = F.round(F.least(F.greatest(multiplier, F.lit(1.0)), F.lit(5.0)), 2)
    return F.when(multiplier.isNull() | F.isnan(multiplier), 1.0).otherwise(clamped)


def impact(revenue: Column, customers: Column, trend: Column) -> Column:
    return F.round(F.greatest(revenue, F.lit(0.0)) * F.log1p(F.greatest(customers, F.lit(0))) * trend, 2)


def priority(score: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(score >= s.impact_critical, "critical").when(score >= s.impact_high, "high").otherwise("normal")


def owner_team(friction: Column) -> Column:
    return lookup(vocab.OWNER_TEAM, friction)


# --- playbook -------------------------------------------------------------------------------------

def _action(row: tuple) -> Column:
    _, _, name, moment, channel, auto, template, when_key, when_values, terms, description = row
    return F.struct(
        F.lit(name).alias("id"), F.lit(description).alias("description"), F.lit(channel).alias("channel"),
        F.lit(auto).alias("auto_allowed"), F.lit(template).alias("template_id"),
        F.lit(moment).cast("string").alias("moment"), strings(terms).alias("allows_terms"),
        F.lit(when_key).cast("string").alias("when_key"), strings(when_values).alias("when_values"))


def playbook_actions(friction: Column, kind: str) -> Column:
    """All actions of one kind for a friction, in playbook order."""
    pairs = []
    for f in vocab.FRICTIONS:
        pairs += [F.lit(f), F.array(*[_action(r) for r in vocab.PLAYBOOK if r[0] == f and r[1] == kind])]
    return F.try_element_at(F.create_map(*pairs), friction)


def first_action(friction: Column, kind: str, moment: Column | None = None) -> Column:
    """First action in playbook order whose condition (and moment) holds; null when there is none."""
    def holds(a: Column) -> Column:
        values = a["when_values"]
        ok = (
            F.when(a["when_key"] == "packet_type", F.array_contains(values, F.col("packet_type")))
            .when(a["when_key"] == "rule_any", F.arrays_overlap(values, F.col("rule_flags")))
            .when(a["when_key"] == "theme_any", F.arrays_overlap(values, F.col("text_themes")))
            .otherwise(F.lit(True))
        )
        ok = F.coalesce(ok, F.lit(False))
        return ok if moment is None else ok & (a["moment"] == moment)

    return F.get(F.filter(playbook_actions(friction, kind), holds), 0)


def default_moment() -> Column:
    late = ~is_aggregate() & (F.col("session_kind") == "post_purchase")
    return F.when(late, "post_purchase").otherwise("post_session")


# --- stable assignments ----------------------------------------------------------------------------

def in_holdout(session_id: Column, s: Settings = DEFAULTS) -> Column:
    return hash32(F.concat(F.lit("holdout:"), session_id)) / F.lit(0xFFFFFFFF) < s.holdout_share


def has_consent(user_id: Column, s: Settings = DEFAULTS) -> Column:
    return hash32(F.concat(F.lit("consent:"), user_id)) / F.lit(0xFFFFFFFF) < s.consent_share
