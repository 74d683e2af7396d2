"""Tables behind the dashboard: funnel, health, overview, team views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import vocab
from waymark.functions.columns import lookup, position, ratio
from waymark.operators.ordered import ORDER

FUNNEL = vocab.SHOPPING_STEPS
OPEN = ["open", "needs_review"]
ACTIVE = ["open", "needs_review", "approved", "assigned"]


def _money(column: str = "revenue_at_risk", where: Column | None = None) -> Column:
    value = F.col(column).cast("decimal(28,2)")
    return F.round(F.coalesce(F.sum(value if where is None else F.when(where, value)).cast("double"), F.lit(0.0)), 2)


def packet_table(decisions: DataFrame, source: str = "batch") -> DataFrame:
    """Packets with their decisions, flattened for the dashboard."""
    have = set(decisions.columns)
    pick = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    start = F.col("start") if "start" in have else F.lit(None).cast("timestamp")
    end = F.col("window_end") if "window_end" in have else F.lit(None).cast("timestamp")
    return decisions.select(
        "packet_id", "packet_type", "session_id", F.lit(source).alias("source"), "friction_type", "gate", "confidence",
        "risk_score", "revenue_at_risk", "priority", "owner_team", "impact", pick("device").alias("device"),
        pick("city").alias("city"), pick("primary_product_id").alias("product"), pick("gateway").alias("gateway"),
        pick("courier").alias("courier"), "rule_flags", F.col("text_themes").alias("themes"),
        F.transform("top_signals", lambda s: s["feature"]).alias("signals"),
        F.when(F.col("packet_type") == "aggregate", end).otherwise(start).alias("created_at"),
        F.col("customer_action.id").alias("customer_action"))


def risky_sessions(packets: DataFrame) -> DataFrame:
    return packets.filter("gate <> 'low' AND packet_type = 'session'")


# --- funnel -------------------------------------------------------------------------------------------------

def _steps_reached(sessions: DataFrame, *more: str) -> DataFrame:
    """Counts per (furthest step, exit step, converted): a few dozen rows to derive every funnel view from."""
    shopping = sessions.filter("session_kind = 'shopping'")
    small = shopping.groupBy("furthest_step", "exit_step", "converted", *more).agg(F.count(F.lit(1)).alias("n"))
    reach = F.sequence(F.lit(0), F.least(position(FUNNEL, F.col("furthest_step")), F.lit(len(FUNNEL) - 2)))
    return small.select("*", F.explode(reach).alias("i")).withColumn(
        "step", F.get(F.array(*[F.lit(s) for s in FUNNEL]), F.col("i")))


def funnel(sessions: DataFrame) -> DataFrame:
    """step, sessions, dropped, drop_rate; the order row counts conversions."""
    gone = (F.col("exit_step") == F.col("step")) & ~F.col("converted")
    steps = _steps_reached(sessions).groupBy("step").agg(
        F.sum("n").alias("sessions"), F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("dropped"))
    steps = steps.select("step", "sessions", "dropped", F.round(ratio(F.col("dropped"), F.col("sessions")), 4).alias("drop_rate"))
    ordered = sessions.filter("session_kind = 'shopping'").agg(
        F.lit("order").alias("step"), F.count_if("converted").alias("sessions"),
        F.lit(0).cast("bigint").alias("dropped"), F.lit(0.0).alias("drop_rate"))
    return steps.unionByName(ordered)


def heatmap(sessions: DataFrame, segment: str = "device") -> DataFrame:
    """step x segment: sessions that reached the step and the share that left there."""
    gone = (F.col("exit_step") == F.col("step")) & ~F.col("converted")
    cells = _steps_reached(sessions, segment).filter(F.col(segment).isNotNull()).groupBy(
        "step", F.col(segment).alias("segment")).agg(
        F.sum("n").alias("sessions"), F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("dropped"))
    return cells.select("step", "segment", F.round(ratio(F.col("dropped"), F.col("sessions")), 4).alias("drop_rate"), "sessions")


# --- frictions ---------------------------------------------------------------------------------------------

def _taxonomy(df: DataFrame) -> DataFrame:
    rows = [(f, i, vocab.FRICTION_LABELS[f], vocab.OWNER_TEAM[f]) for i, f in enumerate(vocab.FRICTIONS)]
    return df.sparkSession.createDataFrame(rows, "friction_type string, place int, label string, owner_team string")


def daily_counts(packets: DataFrame) -> DataFrame:
    """Risky sessions per friction and day: the table health and daily views are made from."""
    return risky_sessions(packets).groupBy("friction_type", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


def health(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per friction: last 3 days against the days before; critical when an important alert is open."""
    days = daily_counts(packets)
    last = days.agg(F.max("day").alias("d")).scalar()
    counts = days.withColumn("last_day", last).groupBy("friction_type").agg(
        F.sum(F.when(F.col("day") > F.date_sub("last_day", 3), F.col("n")).otherwise(0)).alias("recent_n"),
        F.sum(F.when(F.col("day") <= F.date_sub("last_day", 3), F.col("n")).otherwise(0)).alias("before_n"),
        F.max("last_day").alias("last_day"), F.min("day").alias("first_day"))
    pressing = alerts.filter(F.col("priority").isin("critical", "high") & F.col("status").isin(*OPEN)) \
                     .groupBy("friction_type").agg(F.lit(True).alias("pressing"))
    per_day = F.col("recent_n") / 3
    base = F.col("before_n") / F.greatest(F.date_diff("last_day", "first_day") - 2, F.lit(1))
    rate = F.when(F.col("before_n") > 0, ratio(per_day, base)).otherwise(1.0)
    joined = _taxonomy(packets).join(counts, "friction_type", "left").join(pressing, "friction_type", "left")
    seen = F.col("recent_n").isNotNull()
    status = (F.when(seen & F.col("pressing"), "critical").when(seen & (rate >= 1.3), "rising").otherwise("normal"))
    return joined.select(
        "friction_type", status.alias("status"), F.round(F.coalesce(per_day, F.lit(0.0)), 1).alias("recent_per_day"),
        F.round(F.coalesce(base, F.lit(0.0)), 1).alias("baseline_per_day"),
        F.when(seen, F.round(rate, 2)).alias("ratio"))


def top_frictions(packets: DataFrame) -> DataFrame:
    """Every friction with its risky sessions and money, most money first; frictions without any stay."""
    risky = risky_sessions(packets).groupBy("friction_type").agg(
        F.count(F.lit(1)).alias("sessions"), _money().alias("revenue_at_risk"),
        F.count_if(F.col("gate") == "high").alias("high"), F.count_if(F.col("gate") == "medium").alias("needs_review"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return _taxonomy(packets).join(risky, "friction_type", "left").select(
        "friction_type", "label", "owner_team", "place", zero("sessions", 0), zero("revenue_at_risk", 0.0),
        zero("high", 0), zero("needs_review", 0)).orderBy(F.desc("revenue_at_risk"), "place").drop("place")


def daily_pivot(packets: DataFrame) -> DataFrame:
    """day x friction counts of risky sessions, one column per friction."""
    days = daily_counts(packets)
    wide = days.groupBy(F.date_format("day", "MM-dd").alias("day")).pivot("friction_type", vocab.FRICTIONS).agg(F.sum("n"))
    return wide.na.fill(0, vocab.FRICTIONS).orderBy("day")


def overview(sessions: DataFrame, packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of key figures, from three independent aggregations."""
    shopping = F.col("session_kind") == "shopping"
    a = sessions.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(shopping).alias("shopping_sessions"),
        F.round(ratio(F.count_if(shopping & F.col("converted")), F.count_if(shopping)), 4).alias("conversion_rate"),
        F.round(ratio(F.count_if(shopping & F.col("abandoned")),
                      F.greatest(F.count_if(shopping & F.col("reached_cart")), F.lit(1))), 4).alias("cart_abandonment_rate"))
    risky = (F.col("gate") != "low") & (F.col("packet_type") == "session")
    b = packets.agg(F.count_if(risky).alias("at_risk_sessions"), _money(where=risky).alias("revenue_at_risk"),
                    F.count_if(F.col("source") == "live").alias("live_sessions"))
    c = alerts.agg(F.count_if(F.col("status") == "open").alias("open_alerts"),
                   F.count_if(F.col("status") == "needs_review").alias("needs_review"))
    one = lambda df: df.withColumn("_k", F.lit(1))  # noqa: E731  (each side is exactly one row)
    return one(a).join(one(b), "_k").join(one(c), "_k").drop("_k")


# --- team views -----------------------------------------------------------------------------------------------

DIMENSIONS = {"device": 3, "city": 3, "product": 3, "gateway": 3, "courier": 3}
LISTS = {"flag": ("rule_flags", 4), "theme": ("themes", 3), "signal": ("signals", 4)}


def _tagged(kind: str, column: str) -> Column:
    return F.transform(column, lambda v: F.struct(F.lit(kind).alias("dimension"), v.alias("value")))


def top_values(packets: DataFrame) -> DataFrame:
    """friction_type, dimension, value, sessions: most frequent values of every dimension, flag, theme and signal.

    Counting is one pass over (friction, dimension, value); the ranking sees counts only.
    """
    pairs = [F.array(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value"))) for c in DIMENSIONS]
    pairs += [_tagged(kind, col) for kind, (col, _) in LISTS.items()]
    counted = (
        risky_sessions(packets).select("friction_type", F.explode(F.concat(*pairs)).alias("x"))
        .filter("x.value IS NOT NULL AND NOT (x.dimension = 'theme' AND x.value = 'other')")
        .groupBy("friction_type", "x.dimension", "x.value").agg(F.count(F.lit(1)).alias("sessions"))
    )
    w = Window.partitionBy("friction_type", "dimension").orderBy(F.desc("sessions"), "value")
    limits = {**DIMENSIONS, **{k: n for k, (_, n) in LISTS.items()}}
    keep = F.row_number().over(w)
    return counted.withColumn("rank", keep).filter(F.col("rank") <= lookup(limits, F.col("dimension")))


def best_alerts(alerts: DataFrame, n: int = 6) -> DataFrame:
    """The most important active alerts of each friction."""
    w = Window.partitionBy("friction_type").orderBy("alert_type", F.desc("impact"), "packet_id")
    return alerts.filter(F.col("status").isin(*ACTIVE)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def recommended_actions(friction: Column) -> Column:
    """The playbook's actions for a friction: team (the general one), incident (for anomalies), and all those for customers."""
    def action(row: tuple) -> Column:
        return F.struct(F.lit(row[2]).alias("id"), F.lit(row[10]).alias("description"))

    none = F.lit(None).cast("struct<id:string,description:string>")
    out = F.lit(None)
    for f in vocab.FRICTIONS:
        team = [r for r in vocab.PLAYBOOK if r[0] == f and r[1] == "team"]
        incident = next((r for r in team if r[7] == "packet_type" and "aggregate" in r[8]), None)
        customer = [action(r) for r in vocab.PLAYBOOK if r[0] == f and r[1] == "customer"]
        out = F.when(friction == f, F.struct(action(team[-1]).alias("team"), (action(incident) if incident else none).alias("incident"),
                                             F.array(*customer).alias("customer"))).otherwise(out)
    return out


def team_insights(team: str, packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per friction a team owns: numbers, health, likely cause, top values and best alerts."""
    if team not in vocab.TEAM_VIEWS:
        raise ValueError(f"unknown team {team}, use one of {sorted(vocab.TEAM_VIEWS)}")
    mine = F.col("owner_team").isin(*vocab.TEAM_VIEWS[team])
    dim = _taxonomy(packets).filter(mine)
    risky = packets.filter("gate <> 'low'")
    session = F.col("packet_type") == "session"
    numbers = risky.groupBy("friction_type").agg(
        F.count_if(session).alias("sessions"), _money(where=session).alias("revenue_at_risk"),
        F.count_if(session & (F.col("gate") == "high")).alias("high_confidence"),
        F.count_if(session & (F.col("gate") == "medium")).alias("needs_review"),
        F.count_if(~session).alias("aggregate_anomalies"))
    described = F.when(F.col("dimension") == "flag", lookup({r[0]: r[3] for r in vocab.RULES}, F.col("value")))
    values = top_values(packets).groupBy("friction_type").agg(F.array_sort(F.collect_list(F.struct(
        "dimension", "rank", "value", "sessions", described.alias("description")))).alias("top_values"))
    shown = best_alerts(alerts).groupBy("friction_type").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "alert_id", "title", "gate", "priority", "status", "confidence", "alert_type", "revenue_at_risk"))).alias("alerts"))
    out = dim.join(numbers, "friction_type", "left").join(health(packets, alerts), "friction_type", "left") \
             .join(values, "friction_type", "left").join(shown, "friction_type", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("sessions", "high_confidence", "needs_review", "aggregate_anomalies")}
    zero["revenue_at_risk"] = F.coalesce("revenue_at_risk", F.lit(0.0))
    out = out.withColumns(zero).withColumn("likely_cause", lookup(vocab.LIKELY_CAUSES, F.col("friction_type"))).withColumn(
        "recommended", recommended_actions(F.col("friction_type")))
    return out.orderBy(F.desc("revenue_at_risk"), "place").drop("place")


# --- sessions and quality ------------------------------------------------------------------------------------

SHOWN_FEATURES = [*vocab.BEHAVIOUR_COLUMNS, *(c for c in vocab.CONTEXT_COLUMNS if c not in vocab.CODED_CONTEXT), "max_dwell_z"]


def nonzero_features(features: DataFrame) -> DataFrame:
    """Key features of each session that are not zero, as a map."""
    pairs = [x for c in SHOWN_FEATURES if c in features.columns for x in (F.lit(c), F.col(c))]
    kept = F.map_filter(F.create_map(*pairs), lambda _, v: v != 0)
    return features.select("session_id", kept.alias("features"))


def session_detail(session_id: str, timeline: DataFrame, features: DataFrame, decisions: DataFrame,
                   alerts: DataFrame, recoveries: DataFrame) -> dict[str, DataFrame]:
    """Everything about one session, each part as a table."""
    one = F.col("session_id") == session_id
    return {
        "journey": timeline.filter(one).orderBy(*ORDER), "features": nonzero_features(features.filter(one)),
        "packet": decisions.filter(one), "alert": alerts.filter(one), "recoveries": recoveries.filter(one),
    }


def alert_quality(alerts: DataFrame) -> DataFrame:
    """Alerts by gate and the share of each gate."""
    by_gate = alerts.groupBy("gate").agg(F.count(F.lit(1)).alias("alerts"))
    total = by_gate.agg(F.sum("alerts").alias("n")).scalar()
    return by_gate.select("gate", "alerts", F.round(ratio(F.col("alerts"), total), 4).alias("share"))


def draft_pass_rate(log: DataFrame) -> DataFrame:
    """Share of drafted texts that passed all checks, from the audit log."""
    kinds = ["alert_created", "recovery_message_drafted", "explanation_drafted"]
    fields = F.from_json("payload", "struct<explanation_source:string,source:string,guardrail_failures:array<string>>")
    rows = log.filter(F.col("event_type").isin(*kinds)).withColumn("p", fields)
    source = F.coalesce("p.explanation_source", "p.source")
    failed = F.coalesce(F.size("p.guardrail_failures") > 0, F.lit(False))
    drafted = F.coalesce(source == "llm", F.lit(False)) | failed
    passed = F.coalesce(source == "llm", F.lit(False)) & ~failed
    return rows.agg(F.count_if(drafted).alias("drafted"), F.count_if(passed).alias("passed"),
                    F.round(ratio(F.count_if(passed), F.count_if(drafted)), 4).alias("pass_rate"))


def top_products(products: DataFrame, limit: int = 24) -> DataFrame:
    """Best products per category: in stock first, then by rating."""
    w = Window.partitionBy("category").orderBy(F.desc("in_stock"), F.desc("rating"), "product_id")
    return products.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(limit // 5, 3)) \
                   .orderBy("category", "rank").limit(limit)
