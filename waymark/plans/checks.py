"""Queries over the benchmark tables, one or more per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import vocab
from waymark.config import Settings
from waymark.functions import decision as d
from waymark.functions.columns import meta, micros
from waymark.functions.rules import evaluate_rules, rule_frictions
from waymark.operators import (actions, anomaly, boosting, clean, decide, drafts, features, fusion, investigate, joins, metrics, models,
                               readmodels, sessions)
from waymark.session import checkpointed, configure
from waymark.sources import adapters
from waymark.streaming import ingest, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SESSION_GAP, SEQUENCE_GAP = 720, 2880
# the benchmark tables are random, so the anomaly checks use lower thresholds to have something to find
SENSITIVE = Settings(anomaly_min_count=3, anomaly_z=1.5, anomaly_ratio=2.0)
DAILY = Settings(anomaly_min_count=5)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    QUERIES[fn.__name__] = run
    return run


# --- shared inputs ------------------------------------------------------------------------------------------

_SHARED: dict[tuple, object] = {}


def shared(fn):
    """Build a frame once per session, folder and arguments, given or by default. Frames stay lazy unless the builder itself stores them."""
    defaults = fn.__defaults__ or ()

    def get(spark: SparkSession, folder: str, *args):
        key = (fn.__name__, spark.sparkContext.applicationId, id(spark), folder, *args, *defaults[len(args):])
        if key not in _SHARED:
            _SHARED[key] = fn(spark, folder, *args)
        return _SHARED[key]

    return get


def forget() -> None:
    """Drop shared frames, so that the next query builds everything itself."""
    _SHARED.clear()


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_events(adapters.clickstream(spark, folder))


@shared
def segmented(spark: SparkSession, folder: str, gap: int = SESSION_GAP) -> DataFrame:
    return sessions.sessionize(cleaned(spark, folder), gap, source=adapters.clickstream(spark, folder))


@shared
def stored_events(spark: SparkSession, folder: str, gap: int = SESSION_GAP) -> DataFrame:
    """Sessionized events, stored once for the queries that need them more than once."""
    return checkpointed(segmented(spark, folder, gap))


@shared
def session_rows(spark: SparkSession, folder: str, gap: int = SESSION_GAP) -> DataFrame:
    # the clickstream has no city; the last digit of the user stands in where one is needed
    return checkpointed(sessions.session_table(stored_events(spark, folder, gap)).withColumn(
        "city", F.concat(F.lit("city_"), F.substring("user_id", -1, 1))))


@shared
def fixed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Detector outputs with made-up probabilities that an oracle can compute too; the rules are real."""
    f = evaluate_rules(features.session_features(stored_events(spark, folder)))
    i = lambda c: F.col(c).cast("bigint")
    probs = [x for n, name in enumerate(vocab.FRICTIONS) for x in (
        F.lit(name), ((i("n_events") * 7 + i("product_views") * 11 + n * 13) % 100) / 100.0)]
    names = ["payment_failures", "searches", "product_views", "js_errors"]
    signals = F.filter(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in names]),
                       lambda s: s["value"] > 0)
    return f.select(
        "session_id", ((i("n_events") * 17 + i("searches") * 5) % 100 / 100.0).alias("risk_score"), "rule_flags",
        signals.alias("top_signals"), F.create_map(*probs).alias("friction_probs"),
        F.create_map().cast(f"map<string,{decide.SIGNALS}>").alias("friction_signals"))


@shared
def themed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as texts about orders, with a theme given by the document number."""
    themes = F.array(*[F.lit(t) for t in vocab.THEME_FRICTIONS])
    return adapters.table(spark, folder, "documents").select(
        F.col("doc_id").alias("text_id"), F.lit(None).cast("string").alias("session_id"),
        F.concat(F.lit("u_"), F.col("doc_id") % 50).alias("user_id"),
        F.concat(F.lit("o_"), F.col("doc_id") % 300).alias("order_id"),
        F.concat(F.lit("p_"), F.col("doc_id") % 40).alias("product_id"),
        F.timestamp_seconds(F.col("doc_id")).alias("ts"), "text", F.col("lang").alias("language"), "source",
        F.get(themes, (F.col("doc_id") % len(vocab.THEME_FRICTIONS)).cast("int")).alias("theme"))


def stream_payments(events: DataFrame) -> DataFrame:
    """Payment records as far as the clickstream shows them."""
    return events.filter(F.col("event").isin("payment_attempt", "payment_failed")).select(
        "session_id", "timestamp", meta("gateway").alias("gateway"),
        F.when(F.col("event") == "payment_failed", "failed").otherwise("success").alias("status"))


def overlaid_payments(spark: SparkSession, folder: str) -> DataFrame:
    """Payments of one gateway fail for two weeks; the table itself has a flat failure rate."""
    broken = (F.col("gateway") == "G1") & F.col("timestamp").between("1998-06-01 00:00:00", "1998-06-14 23:59:59")
    return adapters.payments(spark, folder).withColumn("status", F.when(broken, "failed").otherwise(F.col("status")))


def payment_units(spark: SparkSession, folder: str) -> DataFrame:
    """One unit per payment record."""
    return overlaid_payments(spark, folder).select(
        F.col("timestamp").alias("ts"), F.col("gateway").alias("segment"), (F.col("status") == "failed").alias("bad"),
        "session_id", F.lit(False).alias("converted"), F.col("amount").alias("value"))


@shared
def stream_packets(spark: SparkSession, folder: str):
    """(packets, members, sessions) of anomalies found in the clickstream itself, stored like the batch job does."""
    ev, table = stored_events(spark, folder), session_rows(spark, folder)
    units = anomaly.gateway_units(stream_payments(ev), table)
    packets, members = anomaly.temporal_anomalies(units, anomaly.GATEWAY, [1440], 10 * 1440, SENSITIVE)
    return checkpointed(packets), checkpointed(members), table


@shared
def packets_of_sessions(spark: SparkSession, folder: str) -> DataFrame:
    packets, members, table = stream_packets(spark, folder)
    return checkpointed(fusion.session_packets(
        fixed_scores(spark, folder), table, fusion.session_themes(themed_texts(spark, folder), table),
        fusion.session_context(packets, members), adapters.orders(spark, folder)))


@shared
def decisions_of_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return decide.decide(packets_of_sessions(spark, folder))


def joined(array: str | Column, by: str = "|") -> Column:
    return F.array_join(array, by)


# --- cleaning -------------------------------------------------------------------------------------------------

@query
def dedup_events(spark, folder):
    once = adapters.clickstream(spark, folder)
    twice = once.unionByName(once.withColumn("seq", F.col("seq") + 1_000_000_000))
    out = clean.dedup(twice)
    return out.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query
def clean_vocab(spark, folder):
    out = clean.clean_events(adapters.clickstream(spark, folder))
    return out.groupBy("event", "page", "step").agg(F.count(F.lit(1)).alias("n"), F.count("product_id").alias("products"))


@query
def metadata_redact(spark, folder):
    raw = adapters.table(spark, folder, "events").select(
        "event_id", F.expr("concat(substring(props, 1, length(props) - 1), ', \"OTP\": \"1\", \"Pin\": 2, \"ok\": true}')")
        .alias("metadata"))
    out = clean.parse_metadata(raw).withColumn("metadata", clean.safe_metadata(F.col("metadata")))
    return out.groupBy(meta("k").cast("bigint").alias("k"), meta("ok").alias("ok"),
                       F.size("metadata").cast("bigint").alias("n_keys")).agg(F.count(F.lit(1)).alias("n"))


@query
def hash_users(spark, folder):
    ev = adapters.table(spark, folder, "events").select(F.col("user_id").cast("string").alias("user_id"))
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", clean.hashed_user(F.col("user_id")).alias("hashed"), "n")


@query
def live_validation(spark, folder):
    out = clean.validated(adapters.clickstream(spark, folder))
    return out.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


# --- sessions -------------------------------------------------------------------------------------------------

@query
def sessionize(spark, folder):
    return segmented(spark, folder).groupBy("user_id", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(micros()).alias("first_us"), F.max(micros()).alias("last_us"))


@query
def session_table(spark, folder):
    t = _bare_sessions(spark, folder)
    text = ["device", "gateway", "payment_method", "courier", "order_id"]
    return t.select(
        "session_id", "user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n_events",
        *[F.coalesce(c, F.lit("-")).alias(c) for c in text], "session_kind", "furthest_step", "exit_step", "exit_page",
        "reached_cart", "converted", "abandoned", "has_exit_event", F.round("cart_value", 2).alias("cart_value"))


@query
def returning_flag(spark, folder):
    return sessions.with_returning(_bare_sessions(spark, folder)).select("session_id", "is_returning")


@query
def primary_product(spark, folder):
    return sessions.primary_products(segmented(spark, folder, SEQUENCE_GAP)).select("session_id", "primary_product_id")


@query
def ordered_events(spark, folder):
    return sessions.timeline(segmented(spark, folder)).select("session_id", "idx", "event", "seq")


@query
def collapsed_journeys(spark, folder):
    return sessions.journeys(segmented(spark, folder, SEQUENCE_GAP)).select("session_id", joined("journey").alias("journey"))


@query
def rage_clicks(spark, folder):
    clicks = adapters.table(spark, folder, "events").select(
        F.concat(F.lit("u_"), "user_id").alias("session_id"), F.col("event_type").alias("element"),
        F.col("ts").cast("timestamp").alias("timestamp"))
    # clicks are sparse in this table, so "two seconds" is eight hours here
    return sessions.rage_clicks(clicks, window_ms=8 * 3_600_000).select(
        "session_id", "element", F.unix_millis("timestamp").alias("at_ms"), F.col("clicks").cast("bigint").alias("clicks"), "window_ms")


# --- features -------------------------------------------------------------------------------------------------

@shared
def _features(spark, folder):
    return features.session_features(segmented(spark, folder, SEQUENCE_GAP))


def _us(c: str) -> Column:
    return F.round(F.col(c) * 1e6).cast("bigint").alias(c.removesuffix("_s") + "_us")


@query
def event_counts(spark, folder):
    return _features(spark, folder).select("session_id", *[F.col(c).cast("bigint").alias(c) for c in vocab.COUNTERS])


@query
def dwell_by_step(spark, folder):
    return _features(spark, folder).select(
        "session_id", F.col("n_events").cast("bigint").alias("n_events"), _us("duration_s"), _us("max_gap_s"),
        _us("exit_dwell_s"), *[_us(c) for c in vocab.DWELL_COLUMNS])


@query
def loops(spark, folder):
    return _features(spark, folder).select("session_id", *[F.col(c).cast("bigint").alias(c) for c in (
        "unique_products", "pdp_loops", "checkout_cart_loops", "method_switches")])


@query
def metadata_features(spark, folder):
    return _features(spark, folder).select("session_id", *[F.round(c, 4).alias(c) for c in (
        "max_eta_days", "cart_value", "max_extra_fees", "max_review_page", "payment_timeouts", "size_chart_unavailable")])


@query
def exit_after(spark, folder):
    return _features(spark, folder).select("session_id", *[F.col(c).cast("bigint").alias(c) for c in (
        "furthest_step_idx", "current_step_idx", *vocab.EXIT_GROUPS)])


@query
def context_features(spark, folder):
    return _features(spark, folder).select("session_id", *[F.col(c).cast("bigint").alias(c) for c in vocab.CONTEXT_COLUMNS])


@query
def dwell_baseline(spark, folder):
    return features.dwell_baselines(_features(spark, folder)).select(
        "step", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def dwell_z(spark, folder):
    f = _features(spark, folder)
    z = features.add_dwell_z(f, features.baseline_values(features.dwell_baselines(f)))
    return z.select("session_id", *[F.round(c, 4).alias(c) for c in vocab.Z_COLUMNS])


@query
def prefix_cuts(spark, folder):
    return features.prefix_cuts(segmented(spark, folder, SEQUENCE_GAP)).select(
        "session_id", F.col("prefix_len").cast("bigint").alias("prefix_len"), micros("prefix_end").alias("end_us"), "is_final")


@query
def prefix_features(spark, folder):
    p = features.prefix_features(segmented(spark, folder, SEQUENCE_GAP))
    whole = ["n_events", "furthest_step_idx", "current_step_idx", "product_views", "size_chart_opens", "searches",
             "unique_products", "pdp_loops", "checkout_cart_loops", "method_switches", "payment_failures", "js_errors"]
    return p.select("session_id", F.col("prefix_len").cast("bigint").alias("prefix_len"), _us("duration_s"), _us("max_gap_s"),
                    *[_us(c) for c in vocab.DWELL_COLUMNS], *[F.col(c).cast("bigint").alias(c) for c in whole],
                    F.round("cart_value", 4).alias("cart_value"), F.round("max_eta_days", 4).alias("max_eta_days"))


# --- every event name, every metadata field -----------------------------------------------------------------------

@shared
def behaviour_events(spark, folder):
    raw = adapters.behaviour(spark, folder)
    return checkpointed(sessions.sessionize(clean.clean_events(raw), SEQUENCE_GAP, source=raw))


@shared
def behaviour_table(spark, folder):
    """Features of every session with its payments: a record for each attempt and failure the stream shows."""
    ev = behaviour_events(spark, folder)
    pay = stream_payments(ev.withColumn("_debited", meta("debited") == "true")).select("session_id", "gateway", "status")
    debited = ev.filter("event = 'payment_failed'").select("session_id", meta("gateway").alias("gateway"), F.lit("failed").alias("status"),
                                                           F.coalesce(meta("debited") == "true", F.lit(False)).alias("amount_debited"))
    attempts = pay.filter("status <> 'failed'").withColumn("amount_debited", F.lit(True))
    totals = joins.payment_totals(debited.unionByName(attempts)).select("session_id", "failed_debited_payments")
    full = features.session_features(ev).join(totals, "session_id", "left")
    return checkpointed(full.withColumn("failed_debited_payments", F.coalesce("failed_debited_payments", F.lit(0)).cast("double")))


SHOWN = [*vocab.BEHAVIOUR_COLUMNS, *vocab.CONTEXT_COLUMNS]


@query
def behaviour_features(spark, folder):
    """All features of every session."""
    return behaviour_table(spark, folder).select("session_id", *[F.round(c, 4).alias(c) for c in SHOWN])


@query
def feature_coverage(spark, folder):
    """In how many sessions each feature is above zero."""
    wide = behaviour_table(spark, folder).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in SHOWN])
    return wide.unpivot([], SHOWN, "feature", "sessions")


@query
def rule_hits(spark, folder):
    """In how many sessions each rule fires."""
    flags = evaluate_rules(behaviour_table(spark, folder)).select(F.explode("rule_flags").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(r[0],) for r in vocab.RULES], "rule string")
    n = F.coalesce("n", F.lit(0))
    return names.join(F.broadcast(flags), "rule", "left").select("rule", n.alias("sessions"), (n > 0).alias("fires"))


@query
def typed_fees(spark, folder):
    """Metadata as JSON: numbers and true count as fees, numeric texts, nulls and nested values do not."""
    v = F.pmod(F.col("seq") * 13, F.lit(60))
    fields = F.struct(v.alias("wrapping"), v.cast("string").alias("label"), (v % 2 == 0).alias("rush"), F.when(v % 3 == 0, v / 4).alias("tip"),
                      F.struct(v.alias("x")).alias("nested"), F.lit(99).alias("subtotal"), v.alias("Pin"))
    raw = adapters.behaviour(spark, folder).withColumn("metadata", F.to_json(fields, {"ignoreNullFields": "false"}))
    ev = sessions.sessionize(clean.clean_events(raw), SEQUENCE_GAP, source=raw)
    return features.session_features(ev).select("session_id", F.round("max_extra_fees", 4).alias("max_extra_fees"))


@query
def session_context(spark, folder):
    """All context keys of every session, and who has been there before or is logged in."""
    table = sessions.with_returning(sessions.session_table(behaviour_events(spark, folder)))
    return table.select("session_id", *[F.coalesce(c, F.lit("-")).alias(c) for c in vocab.CONTEXT_KEYS], "is_returning")


@query
def custom_rules(spark, folder):
    """A user's own rule table over the features."""
    bought = behaviour_events(spark, folder).groupBy("session_id").agg(F.bool_or(F.col("event") == "order_placed").alias("bought"))
    rules = [("asked_for_help", "technical_glitch", "chat_opens + help_views >= 2", "asked for help twice"),
             ("cod_buyer", "price_shock", "cod_selected = 1 AND bought", "bought with cash on delivery")]
    full = behaviour_table(spark, folder).join(bought, "session_id")
    return evaluate_rules(full, rules).select("session_id", joined("rule_flags").alias("flags"))


# --- joins ------------------------------------------------------------------------------------------------------

def _order_sessions(spark, folder):
    return adapters.table(spark, folder, "orders").select(
        F.concat(F.lit("s_"), "o_orderkey").alias("session_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("o_"), "o_orderkey")).alias("order_id"))


@query
def session_joins(spark, folder):
    tickets = adapters.table(spark, folder, "documents").select(F.concat(F.lit("s_"), F.col("doc_id") % 200).alias("session_id"))
    reviews = adapters.table(spark, folder, "labels").select(
        F.concat(F.lit("s_"), F.col("doc_id") % 150).alias("session_id"), (F.col("quality") * 3 + F.col("toxic") + 1).alias("rating"))
    orders = adapters.orders(spark, folder).withColumn("refund_status", F.when(F.col("delay_days") == 3, "pending"))
    out = joins.join_session_data(_order_sessions(spark, folder), adapters.payments(spark, folder), orders, tickets, reviews)
    return out.select("session_id", *[F.col(c).cast("bigint").alias(c) for c in vocab.JOIN_COLUMNS])


@query
def text_union(spark, folder):
    docs = adapters.texts(spark, folder)
    at = F.timestamp_seconds("text_id")
    tickets = docs.select(F.col("text_id").cast("string").alias("ticket_id"), at.alias("created_at"), "text", "language", "theme_label")
    talks = adapters.chats(spark, folder).select(
        F.col("conv_id").cast("string").alias("chat_id"), F.timestamp_seconds("conv_id").alias("started_at"), "customer_text")
    rated = adapters.table(spark, folder, "labels").withColumnRenamed("doc_id", "text_id").join(docs, "text_id").select(
        F.col("text_id").cast("string").alias("review_id"), at.alias("created_at"), "text", "language", "theme_label")
    out = joins.session_texts(tickets, talks, rated)
    return out.groupBy("source", F.coalesce("language", F.lit("-")).alias("language")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count("session_id").alias("with_session"))


@query
def risk_frame(spark, folder):
    ev = segmented(spark, folder, SEQUENCE_GAP)
    cuts = features.prefix_cuts(ev).withColumn("current_step_idx", F.lit(0))
    out = joins.risk_frame(cuts, sessions.session_table(ev))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("prefixes"), F.sum("prefix_len").cast("bigint").alias("events"))


@query
def first_visit_lookup(spark, folder):
    ev, orders = segmented(spark, folder), adapters.orders(spark, folder)
    units = anomaly.courier_delay_units(orders, ev)
    return units.groupBy("segment", "bad").agg(
        F.count(F.lit(1)).alias("n"), F.min("session_id").alias("first_session"), F.max("session_id").alias("last_session"))


@query
def added_or_not(spark, folder):
    return joins.size_chart_outcomes(segmented(spark, folder, SEQUENCE_GAP)).select(
        "session_id", "product_id", micros("ts").alias("ts_us"), "added")


# --- rules ------------------------------------------------------------------------------------------------------

def _flags(spark, folder):
    return evaluate_rules(_features(spark, folder)).select("session_id", "rule_flags")


def _stored_flags(spark, folder):
    """The same flags for queries that need the events a second time."""
    full = features.session_features(stored_events(spark, folder, SEQUENCE_GAP))
    return evaluate_rules(full).select("session_id", "rule_flags")


@query
def rules_flags(spark, folder):
    return _flags(spark, folder).select("session_id", joined("rule_flags").alias("flags"))


@query
def rule_friction_counts(spark, folder):
    out = _flags(spark, folder).select(F.explode(rule_frictions(F.col("rule_flags"))).alias("friction"))
    return out.groupBy("friction").agg(F.count(F.lit(1)).alias("sessions"))


# --- anomalies --------------------------------------------------------------------------------------------------

@query
def gateway_units(spark, folder):
    units = anomaly.gateway_units(adapters.payments(spark, folder))
    return units.select("session_id", "segment", micros("ts").alias("ts_us"), "bad")


@query
def courier_eta_units(spark, folder):
    units = anomaly.courier_eta_units(stored_events(spark, folder), session_rows(spark, folder))
    return units.select("session_id", "segment", micros("ts").alias("ts_us"), "bad", "converted", F.round("value", 2).alias("value"))


@query
def rate_bins(spark, folder):
    bins = anomaly._bins(payment_units(spark, folder), 1440)
    return bins.select("segment", (F.col("at") / 1440).cast("bigint").alias("day"), "n", "bad", F.col("lost").cast("double").alias("lost"))


def _windows(spark, folder, s=DAILY):
    return anomaly.flagged_windows(anomaly._bins(payment_units(spark, folder), 1440), [1440], 60 * 1440, s)


@query
def temporal_flags(spark, folder):
    return _windows(spark, folder).select("segment", (F.col("start") / 1440).cast("bigint").alias("day"), "n", "bad", "n_before", "bad_before")


@query
def merged_intervals(spark, folder):
    day = lambda c: (F.col(c) / 1440).cast("bigint").alias(c)
    wide = Settings(anomaly_min_count=3)
    return anomaly.merged_intervals(_windows(spark, folder, wide)).select("segment", day("start"), day("stop"))


@query
def gateway_anomalies(spark, folder):
    packets, _ = anomaly.temporal_anomalies(payment_units(spark, folder), anomaly.GATEWAY, [1440], 60 * 1440, DAILY)
    return packets.select("packet_id", "segment_value", "observed", "baseline", "z_score", "multiplier",
                          "affected_sessions", "revenue_at_risk", "trend", "bad_units")


@query
def anomaly_members(spark, folder):
    _, members = anomaly.temporal_anomalies(payment_units(spark, folder), anomaly.GATEWAY, [1440], 60 * 1440, DAILY)
    return members


@query
def intraday_anomalies(spark, folder):
    """Windows of three widths over clickstream payments, merged and measured."""
    ev = segmented(spark, folder)
    units = anomaly.gateway_units(stream_payments(ev), sessions.session_table(ev))
    packets, _ = anomaly.temporal_anomalies(units, anomaly.GATEWAY, [360, 720, 1440], 10 * 1440, SENSITIVE)
    return packets.select("packet_id", "observed", "baseline", "z_score", "affected_sessions", "revenue_at_risk", "trend")


@query
def cross_sectional(spark, folder):
    ev, table = stored_events(spark, folder), session_rows(spark, folder)
    parts = [("device", anomaly.device_error_units(ev, table.withColumn("app_version", F.lit(None).cast("string")))),
             ("product", anomaly.product_size_units(ev, table))]
    return reduce(DataFrame.unionByName, [
        anomaly.leave_one_out(u).select(F.lit(k).alias("kind"), "segment", "n", "bad", F.round("p", 6).alias("p"), F.round("p0", 6).alias("p0"),
                                        F.round(anomaly.binomial_z(F.col("p"), F.col("p0"), F.col("n")), 4).alias("z"))
        for k, u in parts])


@shared
def all_detector_sources(spark, folder):
    """What the six detectors read: the stream of all events, orders placed in its time, and the label table as reviews."""
    ev = behaviour_events(spark, folder)
    table = checkpointed(sessions.session_table(ev).withColumn("city", F.concat(F.lit("city_"), F.substring("user_id", -1, 1))))
    key = adapters.table(spark, folder, "orders").select(F.concat(F.lit("o_"), "o_orderkey").alias("order_id"), F.col("o_orderkey").alias("k"))
    late = (F.pmod("k", F.lit(720)) >= 600) & (F.col("k") % 2 == 0) & (F.col("courier") == "1-URGENT") | (F.col("k") % 23 == 0)
    orders = adapters.orders(spark, folder).join(key, "order_id").withColumns({
        "placed_at": F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("k", F.lit(720)) * 3600), "delay_days": F.when(late, 2).otherwise(0)})
    doc = F.col("doc_id")
    rating = F.when((F.col("quality") == 0) | (doc % 3 == 1) & (doc % 2 == 0), 1).otherwise(4)
    reviews = adapters.table(spark, folder, "labels").select(
        F.lit(None).cast("string").alias("session_id"), F.timestamp_seconds(F.lit(1_704_067_200) + doc).alias("created_at"),
        F.concat(F.lit("p_"), doc % 3).alias("product_id"), rating.alias("rating"))
    return anomaly.Sources(table, ev, stream_payments(ev), orders, reviews)


LOW = Settings(anomaly_min_count=3, anomaly_z=1.0, anomaly_ratio=1.2)


@query
def detect_anomalies(spark, folder):
    """Packets of all six detectors, with the original's windows; the random tables need lower thresholds."""
    packets, _ = anomaly.detect_anomalies(all_detector_sources(spark, folder), LOW)
    return packets.select("packet_id", "observed", "baseline", "z_score", "multiplier", "affected_sessions", "revenue_at_risk", "trend", "bad_units")


@query
def anomalies_by_detector(spark, folder):
    """Units of all detectors."""
    units = anomaly.detector_units(all_detector_sources(spark, folder))
    return units.groupBy("detector").agg(F.count(F.lit(1)).alias("units"), F.count_if("bad").alias("bad"), F.count_distinct("segment").alias("segments"))


@query
def product_feedback(spark, folder):
    """Reviews of products against all others; ratings come from the label table."""
    reviews = adapters.table(spark, folder, "labels").select(
        F.lit(None).cast("string").alias("session_id"), F.timestamp_seconds("doc_id").alias("created_at"),
        F.concat(F.lit("p_"), F.col("doc_id") % 10).alias("product_id"), (F.col("quality") * 3 + 1).alias("rating"))
    units = anomaly.product_feedback_units(stored_events(spark, folder), reviews, session_rows(spark, folder))
    return anomaly.leave_one_out(units).select("segment", "n", "bad", "n_other", "bad_other")


@query
def incident_overlap(spark, folder):
    packets, _ = anomaly.temporal_anomalies(payment_units(spark, folder), anomaly.GATEWAY, [1440], 60 * 1440, DAILY)
    suppliers = adapters.table(spark, folder, "supplier")
    incidents = suppliers.select(
        F.concat(F.lit("i_"), "s_suppkey").alias("incident_id"), F.lit("gateway_outage").alias("kind"),
        F.concat(F.lit('{"gateway": "G'), F.col("s_suppkey") % 5, F.lit('"}')).alias("scope"),
        F.expr("timestamp '1995-01-01' + make_dt_interval(cast(s_suppkey * 20 as int))").alias("start"),
        F.expr("timestamp '1995-03-01' + make_dt_interval(cast(s_suppkey * 20 as int))").alias("end"))
    matched = anomaly.match_incidents(packets, incidents)
    return metrics.incident_quality(packets, incidents, matched)


def _all_incidents(spark, folder):
    """Known incidents of all three kinds, by supplier number."""
    n = F.col("s_suppkey")
    kind = F.when(n % 3 == 0, "gateway_outage").when(n % 3 == 1, "courier_delay").otherwise("missing_size_info")
    scope = F.when(n % 3 == 0, F.concat(F.lit('{"gateway": "'), F.substring(F.lit("ABC"), (n % 3 + 1).cast("int"), F.lit(1)), F.lit('"}'))).when(
        n % 3 == 1, F.concat(F.lit('{"courier": "courier_'), n % 2, F.lit('", "cities": ["city_'), n % 10, F.lit('", "city_'), (n + 5) % 10, F.lit('"]}'))).otherwise(
        F.concat(F.lit('{"product_ids": ["p_'), n % 4, F.lit('"]}')))
    begin = F.timestamp_seconds(F.lit(1_704_067_200) + (n % 28) * 86400)
    return adapters.table(spark, folder, "supplier").select(
        F.concat(F.lit("i_"), n).alias("incident_id"), kind.alias("kind"), scope.alias("scope"), begin.alias("start"), (begin + F.expr("INTERVAL 3 DAYS")).alias("end"))


@shared
def _all_packets(spark, folder):
    packets, _ = anomaly.detect_anomalies(all_detector_sources(spark, folder), LOW)
    return checkpointed(packets)


@query
def incident_matches(spark, folder):
    """Incidents of all kinds: the packets that name them and overlap them in time (products at any time)."""
    return anomaly.match_incidents(_all_packets(spark, folder), _all_incidents(spark, folder))


@query
def unmatched_anomalies(spark, folder):
    packets = _all_packets(spark, folder)
    return metrics.unmatched_anomalies(packets, anomaly.match_incidents(packets, _all_incidents(spark, folder)))


@query
def planted_products_flagged(spark, folder):
    packets, incidents = _all_packets(spark, folder), _all_incidents(spark, folder)
    return metrics.planted_products_flagged(packets, incidents, anomaly.match_incidents(packets, incidents))


@query
def affected_per_incident(spark, folder):
    truth = _truth(spark, folder).withColumn("incident_id", F.when(~F.col("is_clean"), F.concat(F.lit("i_"), F.right("session_id", F.lit(1)))))
    return metrics.affected_per_incident(truth)


# --- packets and decisions --------------------------------------------------------------------------------------

@query
def session_packets(spark, folder):
    return packets_of_sessions(spark, folder).select(
        "packet_id", "session_kind", "risk_score", joined("rule_flags").alias("flags"), joined("text_themes").alias("themes"),
        F.coalesce("friction_hint", F.lit("-")).alias("hint"), F.coalesce("order_value", F.lit(-1.0)).alias("order_value"))


@query
def aggregate_enrich(spark, folder):
    packets, members, table = stream_packets(spark, folder)
    out = fusion.enrich_aggregates(packets, members, fixed_scores(spark, folder), fusion.session_themes(themed_texts(spark, folder), table))
    return out.select(
        "packet_id", "sessions_scored", "rule_support_share", "model_support_share", joined("rule_flags").alias("flags"),
        joined("text_themes").alias("themes"), F.try_element_at("friction_probs", F.lit("payment_failure")).alias("p_payment"),
        joined(F.transform("top_signals", lambda s: s["feature"])).alias("signals"))


@query
def aggregate_decisions(spark, folder):
    packets, members, table = stream_packets(spark, folder)
    out = fusion.enrich_aggregates(packets, members, fixed_scores(spark, folder), fusion.session_themes(themed_texts(spark, folder), table))
    return decide.decide(out).select("packet_id", "friction_type", "classification_source", "confidence", "gate", "impact",
                                     "priority", "trend_factor", F.col("team_action.id").alias("team_action"))


@query
def classify(spark, folder):
    return decide.classified(decide.packet_frame(packets_of_sessions(spark, folder))).select(
        "packet_id", "friction_type", "secondary_friction", "classification_source")


@query
def confidence_gate(spark, folder):
    return decisions_of_sessions(spark, folder).select(
        "packet_id", "rule_supports", "model_supports", "text_supports", "aggregate_supports", "confidence", "gate")


@query
def priority(spark, folder):
    return decisions_of_sessions(spark, folder).select(
        "packet_id", "revenue_at_risk", "trend_factor", F.round("impact", 1).alias("impact"), "priority", "owner_team")


@query
def playbook_pick(spark, folder):
    rows = decide.with_actions(decide.classified(decide.packet_frame(packets_of_sessions(spark, folder))))
    late = decide.with_actions(decide.classified(decide.packet_frame(packets_of_sessions(spark, folder))), "in_session")
    return rows.select("packet_id", "moment", F.coalesce("customer_action.id", F.lit("-")).alias("customer_action"),
                       F.col("team_action.id").alias("team_action")).unionByName(
        late.select("packet_id", "moment", F.coalesce("customer_action.id", F.lit("-")).alias("customer_action"),
                    F.col("team_action.id").alias("team_action")))


@query
def decision_summary(spark, folder):
    return decide.summary(decisions_of_sessions(spark, folder))


@query
def second_pass(spark, folder):
    """Medium packets of the budget get findings and the same decision again."""
    packets = packets_of_sessions(spark, folder)
    # what is found depends on the packet: support for payments, for delivery, or nothing
    last = F.pmod(F.ascii(F.right("packet_id", F.lit(1))), F.lit(3))
    supports = F.when(last == 0, "payment_failure").when(last == 1, "delivery_uncertainty")
    found = packets.select("packet_id", F.array(F.struct(
        F.lit("gateway_health").alias("tool"), F.lit("").alias("summary"), supports.alias("supports"),
        F.when(supports.isNotNull(), "aggregate").otherwise("none").alias("evidence_kind"))).alias("findings"))
    out = decide.decide_with_findings(packets, found)
    return out.groupBy("investigated", "gate", "friction_type").agg(F.count(F.lit(1)).alias("n"))


# --- investigation ----------------------------------------------------------------------------------------------

@query
def drop_off_by_segment(spark, folder):
    table = session_rows(spark, folder)
    return reduce(DataFrame.unionByName, [
        investigate.drop_off_by_segment(table, step).withColumn("step", F.lit(step)) for step in ("browse", "product", "checkout", "payment")])


@query
def converters_vs_abandoners(spark, folder):
    ev = segmented(spark, folder, SEQUENCE_GAP)
    return investigate.converters_vs_abandoners(features.session_features(ev), sessions.session_table(ev)).select(
        "feature", "n_converters", "n_abandoners", "converters", "abandoners", F.coalesce("ratio", F.lit(-1.0)).alias("ratio"))


@query
def sample_feedback(spark, folder):
    texts = themed_texts(spark, folder)
    return investigate.theme_counts(investigate.matching_feedback(texts, user_id="u_7", product_id="p_3"))


@query
def newest_feedback(spark, folder):
    return investigate.sample_feedback(themed_texts(spark, folder), theme="app_bug", limit=20).select("text_id", "theme", "language")


@query
def order_status(spark, folder):
    orders = adapters.orders(spark, folder).withColumn("refund_status", F.when(F.col("delay_days") == 3, "pending"))
    asked = adapters.orders(spark, folder).select(F.concat(F.lit("pk_"), "user_id").alias("packet_id"), "order_id")
    return investigate.order_status(asked, orders)


@query
def gateway_health(spark, folder):
    pay = overlaid_payments(spark, folder)
    probes = adapters.orders(spark, folder).select(
        F.col("order_id").alias("probe_id"), F.concat(F.lit("G"), F.substring("order_id", -1, 1).cast("int") % 5).alias("gateway"),
        F.col("placed_at").alias("around"))
    return investigate.gateway_health(probes, pay, window_minutes=10 * 1440).select(
        "probe_id", "sessions_in_window", "failed_sessions", "failure_rate", "baseline_failure_rate", "multiplier")


@query
def gateway_health_live(spark, folder):
    """Stored payments of the first half of the month give the baseline; those of the second half are live."""
    ev = behaviour_events(spark, folder)
    middle = F.lit("2024-01-16").cast("timestamp")
    probes = ev.filter("event = 'payment_failed'").select(F.col("seq").cast("string").alias("probe_id"), meta("gateway").alias("gateway"), F.col("timestamp").alias("around"))
    out = investigate.gateway_health(probes, stream_payments(ev.filter(F.col("timestamp") < middle)), 600, live.payment_units(ev.filter(F.col("timestamp") >= middle)))
    return out.select("probe_id", "sessions_in_window", "failed_sessions", "failure_rate", "baseline_failure_rate", "multiplier")


@query
def courier_health(spark, folder):
    orders = adapters.orders(spark, folder)
    by_one = lambda c: F.substring("order_id", -1, 1).cast("int") % 2 == c
    probes = orders.select(F.col("order_id").alias("probe_id"), "courier", F.when(by_one(0), F.col("city")).alias("city"),
                           F.col("placed_at").alias("around"))
    return investigate.courier_health(probes, orders, days=30).select(
        "probe_id", "orders_in_window", "delayed_share", "baseline_delayed_share", "multiplier", "mean_delay_days")


@query
def delivery_eta(spark, folder):
    quotes = investigate.eta_quotes(stored_events(spark, folder), session_rows(spark, folder))
    out = investigate.delivery_eta(quotes)
    return out.select(F.coalesce("city", F.lit("-")).alias("city"), "courier", "quotes",
                      F.round("median_eta_days", 4).alias("median_eta_days"), F.round("p90_eta_days", 4).alias("p90_eta_days"))


@query
def stock_check(spark, folder):
    parts = adapters.table(spark, folder, "part").select(
        F.concat(F.lit("p_"), "p_partkey").alias("product_id"), (F.col("p_size") > 5).alias("in_stock"),
        F.create_map(F.lit("S"), F.col("p_size") % 3, F.lit("M"), F.col("p_size") % 4, F.lit("L"), F.col("p_size") % 5).alias("stock"))
    return investigate.stock_check(parts).select("product_id", "in_stock", F.array_join(F.array_sort("sizes_out_of_stock"), "|").alias("out"), "share_sizes_out")


@query
def catalog_changes(spark, folder):
    parts = adapters.table(spark, folder, "part").select(
        F.concat(F.lit("p_"), "p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        F.timestamp_seconds(F.col("p_partkey") * 3600).alias("catalog_updated_at"))
    return investigate.recent_catalog_changes(parts, 3).select("product_id", micros("catalog_updated_at").alias("at_us"))


@query
def top_frictions_tool(spark, folder):
    return investigate.top_frictions(decisions_of_sessions(spark, folder))


@query
def investigation_findings(spark, folder):
    """Findings of every packet from all queries that fit it, in bulk."""
    table = session_rows(spark, folder)
    packets, members, _ = stream_packets(spark, folder)
    decided = decide.decide(packets_of_sessions(spark, folder)).unionByName(decide.decide(packets), allowMissingColumns=True)
    products = adapters.table(spark, folder, "part").select(
        F.concat(F.lit("p_"), "p_partkey").alias("product_id"), F.array(F.lit("S")).alias("sizes"), (F.col("p_size") % 2 == 0).alias("has_size_chart"),
        F.array().cast("array<string>").alias("missing_attributes"), (F.col("p_size") > 5).alias("in_stock"),
        F.create_map(F.lit("S"), F.col("p_size") % 3).alias("stock"))
    orders = adapters.orders(spark, folder).withColumn("refund_status", F.when(F.col("delay_days") == 3, "pending"))
    out = investigate.findings(decided, stream_payments(stored_events(spark, folder)), orders, themed_texts(spark, folder), products, table, members)
    return out.select(F.explode("findings").alias("f")).groupBy("f.tool", "f.evidence_kind").agg(F.count(F.lit(1)).alias("n"))


@query
def customer_context(spark, folder):
    ev = segmented(spark, folder)
    orders = adapters.orders(spark, folder).withColumn("refund_status", F.when(F.col("delay_days") == 3, "pending"))
    pay = stream_payments(ev).withColumn("amount_debited", F.col("gateway") == "A")
    out = investigate.customer_context(sessions.session_table(ev), sessions.journeys(ev), pay, orders)
    return out.select("session_id", "attempts", "failed", "debited_without_order", F.coalesce("order_status", F.lit("-")).alias("order_status"),
                      F.coalesce("delay_days", F.lit(-1)).cast("bigint").alias("delay_days"), F.size("journey").cast("bigint").alias("steps"))


# --- actions ----------------------------------------------------------------------------------------------------

@query
def alert_rows(spark, folder):
    return actions.alerts(decisions_of_sessions(spark, folder)).select("alert_id", "title", "gate", "status", "priority", "explanation.summary")


@query
def alert_list(spark, folder):
    page = actions.alert_list(actions.alerts(decisions_of_sessions(spark, folder)), team="operations", status="open,needs_review", limit=100)
    return page.select("packet_id", "owner_team", "status", F.round("impact", 1).alias("impact"), "total")


@query
def at_risk_list(spark, folder):
    return actions.at_risk_list(decisions_of_sessions(spark, folder), limit=100).select("packet_id", "gate", micros("start").alias("start_us"))


@query
def anomaly_samples(spark, folder):
    _, members = anomaly.temporal_anomalies(payment_units(spark, folder), anomaly.GATEWAY, [1440], 60 * 1440, DAILY)
    return actions.sample_sessions(members).select("packet_id", joined("sample_sessions").alias("sample_sessions"))


@query
def message_cap(spark, folder):
    """The daily cap over all sessions of all users, as if each had led to a message."""
    rows = _bare_sessions(spark, folder).select(F.col("session_id").alias("packet_id"), "user_id", F.col("start").alias("created_at"))
    return actions.message_cap(checkpointed(rows)).select("packet_id", "accepted")


@query
def recent_messages(spark, folder):
    rows = _bare_sessions(spark, folder).select(F.col("session_id").alias("packet_id"), "user_id", F.col("start").alias("created_at"))
    return actions.recent_messages(rows)


@query
def recovery_plan(spark, folder):
    return actions.recovery_plan(decisions_of_sessions(spark, folder)).select(
        "packet_id", "action_id", "channel", "status", "auto", "holdout", F.round("value", 2).alias("value"))


@query
def recovery_messages(spark, folder):
    return actions.recovery_plan(decisions_of_sessions(spark, folder)).groupBy("action_id", F.coalesce("message", F.lit("-")).alias("message")).agg(F.count(F.lit(1)).alias("n"))


def _observed(spark, folder):
    """Orders as recoveries with an observed outcome."""
    s = F.concat(F.lit("s_"), "o_orderkey")
    return adapters.table(spark, folder, "orders").select(
        F.when(d.in_holdout(s), "holdout").when(F.col("o_orderkey") % 7 == 0, "suppressed_cap").otherwise("sent").alias("status"),
        d.in_holdout(s).alias("holdout"), F.when(F.col("o_orderstatus") == "F", "recovered").when(F.col("o_orderstatus") == "O", "not_recovered").alias("outcome"),
        F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("friction_type"))


@query
def recovery_stats(spark, folder):
    return actions.recovery_stats(_observed(spark, folder))


@query
def recovery_by_friction(spark, folder):
    return actions.recovery_by_friction(_observed(spark, folder))


def _requests(spark, folder):
    """All events as workflow requests on one alert per user; one action is unknown."""
    names = F.array(*[F.lit(a) for a in vocab.TRANSITIONS], F.lit("escalate"))
    return adapters.table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("al_"), "user_id").alias("alert_id"),
        F.get(names, (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 6)).alias("action"), F.lit("agent").alias("actor"),
        F.lit(None).cast("string").alias("assignee"), F.lit(None).cast("string").alias("note"), F.col("ts").cast("timestamp").alias("requested_at"))


def _alerts_per_user(spark, folder):
    users = adapters.table(spark, folder, "events").select("user_id").distinct()
    return users.select(F.concat(F.lit("al_"), "user_id").alias("alert_id"), F.concat(F.lit("pk_"), "user_id").alias("packet_id"),
                        F.lit("product").alias("owner_team"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("assigned_to"),
                        F.lit(None).cast("timestamp").alias("updated_at"))


@query
def workflow_fold(spark, folder):
    done = actions.workflow(_alerts_per_user(spark, folder), _requests(spark, folder))
    return done.select("request_id", "alert_id", "action", "from_status", "to_status", F.coalesce("rejected", F.lit("-")).alias("rejected"),
                       F.coalesce("ticket_ref", F.lit("-")).alias("ticket_ref"))


@query
def workflow_state(spark, folder):
    alerts = _alerts_per_user(spark, folder)
    out = actions.apply_workflow(alerts, actions.workflow(alerts, _requests(spark, folder)))
    return out.select("alert_id", "status", F.coalesce("assigned_to", F.lit("-")).alias("assigned_to"))


@query
def recovery_by_status(spark, folder):
    return actions.recovery_by_status(_observed(spark, folder))


def _pending(spark, folder):
    """One message per alert, waiting, sent or held out by the user's number."""
    number = F.regexp_extract("packet_id", "([0-9]+)", 1).cast("int") % 3
    return _alerts_per_user(spark, folder).select("packet_id", F.when(number == 0, "sent").when(number == 1, "holdout").otherwise("pending_approval").alias("status"))


@query
def release_pending(spark, folder):
    """Approved alerts release the messages that wait for them."""
    alerts = _alerts_per_user(spark, folder)
    out = actions.release_pending(_pending(spark, folder), actions.workflow(alerts, _requests(spark, folder)))
    return out.select("packet_id", "status", F.coalesce("approved_by", F.lit("-")).alias("approved_by"))


@query
def approve_drafts(spark, folder):
    """Reply drafts approved once, by the first of several requests."""
    turns = adapters.table(spark, folder, "conversations").filter("role = 'assistant'")
    draft = F.concat_ws("-", "conv_id", "turn")
    replies = turns.select(draft.alias("draft_id"), F.when(F.col("conv_id") % 4 == 0, "sent").otherwise("pending_approval").alias("status"))
    asked = turns.filter("(conv_id + turn) % 3 = 0").select(draft.alias("draft_id"), "conv_id").select(
        "draft_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("n"), "conv_id").select(
        "draft_id", F.concat(F.lit("agent_"), F.col("n") % 2).alias("actor"), F.timestamp_seconds(F.col("conv_id") + F.col("n")).alias("requested_at"), F.col("n").alias("request_id"))
    return actions.approve_drafts(replies, asked).select("draft_id", "status", F.coalesce("approved_by", F.lit("-")).alias("approved_by"))


def _full_log(spark, folder):
    decisions = decisions_of_sessions(spark, folder)
    plan = actions.recovery_plan(decisions).withColumn("approved_by", F.when((F.col("status") == "pending_approval") & F.endswith("session_id", F.lit("1")), "ann"))
    number = F.regexp_extract("draft_id", "([0-9]+)", 1).cast("int")
    replies = adapters.table(spark, folder, "conversations").filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("draft_id")).withColumns({
        "session_id": F.lit("s"), "status": F.lit("pending_approval"), "source": F.when(number % 2 == 0, "llm").otherwise("fallback"),
        "guardrail_failures": F.when(number % 3 == 0, F.array(F.lit("schema"))).otherwise(F.array().cast("array<string>")),
        "created_at": F.timestamp_seconds(number), "approved_by": F.when(number % 5 == 0, "kim")})
    return actions.audit_log(decisions, actions.alerts(decisions), plan, None, replies)


@query
def audit_events(spark, folder):
    """Everything that can be in the log, with what the payload says."""
    log = _full_log(spark, folder)
    seen = F.from_json("payload", "struct<investigated:boolean,breakdown:struct<rule_supports:boolean>,status:string>")
    return log.withColumn("p", seen).groupBy("event_type", "entity_type", "actor").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p.breakdown.rule_supports")).alias("by_rule"), F.count_if(F.col("p.investigated")).alias("investigated"))


@query
def audit_trail(spark, folder):
    """What happened to one reply draft and to one session, newest first."""
    log = _full_log(spark, folder)
    ids = [r[0] for r in log.filter("entity_type = 'cs_draft'").select("entity_id").distinct().orderBy("entity_id").limit(3).collect()]
    return actions.trail(log, ids, 5).select("event_type", "entity_id", "actor", micros("ts").alias("at_us"))


@query
def draft_pass_rate(spark, folder):
    replies = _full_log(spark, folder).filter("event_type = 'cs_reply_drafted'").withColumn("event_type", F.lit("explanation_drafted"))
    return readmodels.draft_pass_rate(replies)


@query
def anomalies_ordered(spark, folder):
    """Strongest anomalies first; the place of each in the list."""
    packets, _ = anomaly.temporal_anomalies(payment_units(spark, folder), anomaly.GATEWAY, [1440], 60 * 1440, DAILY)
    first = anomaly.strongest_first(packets).limit(25)
    return first.select("packet_id", "z_score")


@query
def audit_counts(spark, folder):
    decisions = decisions_of_sessions(spark, folder)
    log = actions.audit_log(decisions, actions.alerts(decisions), actions.recovery_plan(decisions))
    return log.groupBy("event_type", "entity_type").agg(F.count(F.lit(1)).alias("n"))


# --- read models ------------------------------------------------------------------------------------------------

def _bare_sessions(spark, folder):
    return sessions.session_table(segmented(spark, folder))


@query
def funnel(spark, folder):
    return readmodels.funnel(_bare_sessions(spark, folder))


@query
def heatmap(spark, folder):
    return readmodels.heatmap(_bare_sessions(spark, folder))


@shared
def _dashboard(spark, folder):
    decisions = decisions_of_sessions(spark, folder)
    return readmodels.packet_table(decisions), actions.alerts(decisions)


@query
def health(spark, folder):
    return readmodels.health(*_dashboard(spark, folder)).withColumn("ratio", F.coalesce("ratio", F.lit(-1.0)))


@query
def overview_kpis(spark, folder):
    return readmodels.overview(session_rows(spark, folder), *_dashboard(spark, folder))


@query
def top_frictions(spark, folder):
    return readmodels.top_frictions(_dashboard(spark, folder)[0])


@query
def daily_pivot(spark, folder):
    return readmodels.daily_pivot(_dashboard(spark, folder)[0])


@query
def team_top_values(spark, folder):
    return readmodels.top_values(_dashboard(spark, folder)[0]).withColumn("rank", F.col("rank").cast("bigint"))


@query
def best_alerts(spark, folder):
    return readmodels.best_alerts(_dashboard(spark, folder)[1]).select("friction_type", "packet_id", F.col("rank").cast("bigint").alias("rank"))


@query
def team_insights(spark, folder):
    packets, alerts = _dashboard(spark, folder)
    return reduce(DataFrame.unionByName, [readmodels.team_insights(t, packets, alerts).select(
        F.lit(t).alias("team"), "friction_type", "sessions", "revenue_at_risk", "high_confidence", "needs_review", "aggregate_anomalies")
        for t in vocab.TEAM_VIEWS])


@query
def alert_quality(spark, folder):
    return readmodels.alert_quality(actions.alerts(decisions_of_sessions(spark, folder)))


@query
def nonzero_features(spark, folder):
    out = readmodels.nonzero_features(behaviour_table(spark, folder)).select("session_id", F.explode("features").alias("feature", "v"))
    return out.groupBy("feature").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.sum("v"), 2).alias("total"))


@query
def top_n_per_category(spark, folder):
    parts = adapters.table(spark, folder, "part").select(
        F.concat(F.lit("p_"), "p_partkey").alias("product_id"), F.col("p_type").alias("category"), (F.col("p_size") > 5).alias("in_stock"), F.col("p_retailprice").alias("rating"))
    return readmodels.top_products(parts, 1000).select("category", "product_id", F.col("rank").cast("bigint").alias("rank"))


# --- metrics ----------------------------------------------------------------------------------------------------

def _scored_labels(spark, folder):
    docs = adapters.table(spark, folder, "documents").select("doc_id", "n_chars", "lang")
    return adapters.table(spark, folder, "labels").join(docs, "doc_id").withColumn("score", (F.col("n_chars") % 97) / 97.0)


@query
def split_buckets(spark, folder):
    docs = adapters.table(spark, folder, "documents").select(F.concat(F.lit("s_"), "doc_id").alias("k"))
    return docs.groupBy(metrics.is_test(F.col("k")).alias("test"), metrics.is_calibration(F.col("k")).alias("calibration")).agg(F.count(F.lit(1)).alias("n"))


@query
def ranking_metrics(spark, folder):
    out = metrics.ranking_metrics(_scored_labels(spark, folder), "score", "quality", ["lang"])
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("positive_rate", "average_precision", "roc_auc", "brier")])


@query
def prf_per_class(spark, folder):
    s = _scored_labels(spark, folder)
    long = reduce(DataFrame.unionByName, [s.select(
        F.lit(c).alias("class"), (F.col(c) == 1).alias("truth"), (F.col("score") >= t).alias("predicted")) for c, t in (("quality", .3), ("toxic", .8))])
    return metrics.prf_per_class(long)


@query
def multiclass_prf(spark, folder):
    e = adapters.table(spark, folder, "embeddings").select("label", F.pmod(F.col("vec_id") * 7, F.lit(10)).alias("predicted"))
    return metrics.multiclass_prf(e.select(F.col("label").cast("string").alias("label"), F.col("predicted").cast("string").alias("predicted")))


@query
def text_quality(spark, folder):
    docs = adapters.table(spark, folder, "documents").select(
        F.col("lang").alias("label"), F.col("source").alias("language"),
        F.get(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("doc_id") % 4).cast("int")).alias("predicted"),
        ((F.col("n_chars") % 100) / 100.0).alias("prob"))
    return metrics.text_quality(docs, by=["language"]).na.fill(0.0)


@query
def rule_quality(spark, folder):
    """Rules against planted labels; the labels are a fixed function of the session."""
    flagged = _stored_flags(spark, folder).withColumn("frictions", rule_frictions(F.col("rule_flags")))
    per, _ = metrics.rule_quality(flagged, _truth(spark, folder))
    return per


@shared
def _truth(spark, folder):
    # only what the labels need of the session table is made and stored
    t = sessions.session_table(stored_events(spark, folder, SEQUENCE_GAP))
    names = F.array(*[F.lit(f) for f in vocab.FRICTIONS])
    one = F.get(names, (F.col("n_events") % 10).cast("int"))
    two = F.get(names, ((F.col("n_events") * 3 + 1) % 10).cast("int"))
    clean_ = F.col("n_events") % 3 == 0
    return checkpointed(t.select(
        "session_id", clean_.alias("is_clean"), F.when(clean_, "").otherwise(F.concat_ws("|", one, two)).alias("friction_types"),
        F.when(~clean_, one).alias("primary_friction")))


@query
def label_prevalence(spark, folder):
    return metrics.label_prevalence(_truth(spark, folder))


@query
def decision_quality(spark, folder):
    table = session_rows(spark, folder)
    names = F.array(*[F.lit(f) for f in vocab.FRICTIONS])
    truth = table.select("session_id", (F.col("n_events") % 3 == 0).alias("is_clean"), F.get(names, (F.col("n_events") % 10).cast("int")).alias("primary_friction")) \
                 .withColumn("friction_types", F.concat_ws("|", "primary_friction", F.lit("payment_failure")))
    return metrics.decision_quality(decisions_of_sessions(spark, folder), truth)


@query
def gate_counts(spark, folder):
    return metrics.gate_counts(decisions_of_sessions(spark, folder))


@query
def clean_sessions_with_rules(spark, folder):
    """Share of clean sessions in which any rule fires."""
    flagged = _stored_flags(spark, folder).select("session_id", rule_frictions(F.col("rule_flags")).alias("frictions"))
    return metrics.rule_quality(flagged, _truth(spark, folder))[1]


@query
def metrics_report(spark, folder):
    """Several metric tables as one long table."""
    decisions = decisions_of_sessions(spark, folder)
    return metrics.report({"gates": metrics.gate_counts(decisions), "risk": decisions.agg(F.count(F.lit(1)).alias("packets"), F.max("risk_score").alias("highest"))})


@query
def recommended_actions(spark, folder):
    """What the playbook recommends for each friction that sessions have."""
    seen = decisions_of_sessions(spark, folder).select("friction_type").distinct().withColumn("r", readmodels.recommended_actions(F.col("friction_type")))
    return seen.select("friction_type", F.col("r.team.id").alias("team"), F.coalesce("r.incident.id", F.lit("-")).alias("incident"),
                       joined(F.transform("r.customer", lambda c: c["id"])).alias("customer"))


# --- drafts -----------------------------------------------------------------------------------------------------

def _documents_as_texts(spark, folder):
    return adapters.table(spark, folder, "documents").select("doc_id", "text")


@query
def draft_policy(spark, folder):
    found = drafts.policy_failures(F.col("text"), F.array(F.lit("refund")))
    return _documents_as_texts(spark, folder).select("doc_id", F.size(found).cast("bigint").alias("failures"), joined(found).alias("what"))


@query
def draft_grounding(spark, folder):
    tokens = drafts.number_tokens(F.col("text"))
    numbers = F.array(*[F.lit(x) for x in (0.82, 0.2, 4.1, 41500.0, 2024.0)])
    loose = F.filter(tokens, lambda t: ~F.coalesce(drafts.grounded(t, numbers), F.lit(False)))
    return _documents_as_texts(spark, folder).select("doc_id", F.size(tokens).cast("bigint").alias("numbers"), F.size(loose).cast("bigint").alias("ungrounded"))


@query
def draft_validation(spark, folder):
    """Conversation replies as drafts, checked in full against a small evidence record."""
    turns = adapters.table(spark, folder, "conversations").filter("role = 'assistant'")
    rows = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("draft_id"), F.lit("reply").alias("kind"), F.to_json(F.struct(F.col("text").alias("reply"))).alias("draft"),
        F.lit('{"observed": 0.82, "baseline": 0.2}').alias("evidence"), F.lit("payment_failure").alias("friction_type"),
        F.array(F.lit("retry_payment_link")).alias("action_ids"), F.array(F.lit("refund")).alias("allowed_terms"),
        F.array().cast("array<string>").alias("allowed_frictions"), F.lit("fallback").alias("fallback"))
    out = drafts.validate(rows)
    return out.select("draft_id", "ok", F.size("failures").cast("bigint").alias("failures"), "source")


@query
def evidence_keys(spark, folder):
    """Keys a draft cites that its evidence does not have; the raw event properties are the evidence."""
    cited = F.array(F.lit("k"), F.lit("absent"), F.concat(F.lit("k"), F.col("event_id") % 2))
    found = drafts.grounding_failures(F.array().cast("array<string>"), F.col("props"), cited)
    return adapters.table(spark, folder, "events").select("event_id", joined(found).alias("what"))


# --- models (no SQL counterpart: learned values) -------------------------------------------------------------

def _risk_training(spark, folder):
    ev = stored_events(spark, folder, SEQUENCE_GAP)
    full = checkpointed(features.session_features(ev))
    base = features.baseline_values(features.dwell_baselines(full))
    prefixes = features.add_dwell_z(features.prefix_features(ev), base)
    return joins.risk_frame(prefixes, sessions.session_table(ev)), features.add_dwell_z(full, base)


@shared
def _risk(spark, folder):
    """(training frame, full features, model with all its rounds)."""
    frame, full = _risk_training(spark, folder)
    frame = checkpointed(frame)
    return frame, full, models.RiskModel.fit(frame)


@query
def risk_model(spark, folder):
    """Ranking quality of the risk model on its test split."""
    frame, _, model = _risk(spark, folder)
    test = model.score(frame.filter(metrics.is_test(F.col("session_id"))))
    early = F.when(F.col("current_step_idx").between(2, 3), "cart_checkout").otherwise("other")
    return metrics.ranking_metrics(test.withColumn("stage", early), "risk", "label", ["stage"])


@shared
def joined_behaviour(spark, folder):
    """Features of the stream of all events with payments, orders, tickets and reviews joined on; rules give the frictions."""
    ev = behaviour_events(spark, folder)
    full = features.session_features(ev)
    full = features.add_dwell_z(full, features.baseline_values(features.dwell_baselines(full)))
    pay = ev.filter("event IN ('payment_attempt', 'payment_failed')").select(
        "session_id", meta("gateway").alias("gateway"), F.when(F.col("event") == "payment_failed", "failed").otherwise("success").alias("status"),
        F.coalesce(meta("debited") == "true", F.col("event") == "payment_attempt").alias("amount_debited"))
    first = F.lit("_2024-01-0")
    tickets = adapters.table(spark, folder, "documents").select(F.concat(F.lit("b_"), F.col("doc_id") % 200, first).alias("session_id"))
    reviews = adapters.table(spark, folder, "labels").select(F.concat(F.lit("b_"), F.col("doc_id") % 150, first).alias("session_id"),
                                                             (F.col("quality") * 3 + F.col("toxic") + 1).alias("rating"))
    orders = adapters.orders(spark, folder).withColumn("refund_status", F.when(F.col("delay_days") == 3, "pending"))
    more = joins.join_session_data(sessions.session_table(ev), pay, orders, tickets, reviews)
    return checkpointed(evaluate_rules(full.join(more, "session_id")).withColumn("frictions", rule_frictions(F.col("rule_flags"))))


@query
def features_with_joins(spark, folder):
    """The frame the friction models see: features and joined numbers of every session."""
    return joined_behaviour(spark, folder).select("session_id", *[F.col(c).cast("bigint").alias(c) for c in vocab.JOIN_COLUMNS], F.round("cart_value", 4).alias("cart_value"),
                                                  F.col("n_events").cast("bigint").alias("n_events"))


@shared
def _friction(spark, folder):
    frame = joined_behaviour(spark, folder)
    labels = frame.select("session_id", *[F.array_contains("frictions", f).cast("int").alias(f) for f in vocab.FRICTIONS])
    return frame, labels, models.FrictionModel.fit(frame, labels)


@query
def friction_ovr(spark, folder):
    """Independent probabilities of all ten frictions; rule flags serve as labels on this data."""
    frame, labels, model = _friction(spark, folder)
    scored = model.score(frame).filter(metrics.is_test(F.col("session_id")))
    pred = scored.select("session_id", *[(F.col("friction_probs")[f] >= 0.6).alias(f) for f in vocab.FRICTIONS])
    return metrics.prf_per_class(metrics.long_form(labels, pred, vocab.FRICTIONS))


@query
def scored_sessions(spark, folder):
    """Risk, friction probabilities and what drove them, for every session of the stream of all events."""
    frame, _, friction = _friction(spark, folder)
    ev = behaviour_events(spark, folder)
    table = checkpointed(sessions.session_table(ev))
    base = features.baseline_values(features.dwell_baselines(frame))
    prefixes = checkpointed(features.add_dwell_z(features.prefix_features(ev), base))
    risk = models.RiskModel.fit(joins.risk_frame(prefixes, table))
    scores = checkpointed(models.score_sessions(frame, prefixes, table, risk, friction))
    return models.with_signals(scores, frame, prefixes, risk, friction)


@query
def theme_classifier(spark, folder):
    """Language of documents as the theme, from hashed text."""
    docs = adapters.texts(spark, folder)
    train = docs.filter(~metrics.is_test(F.col("text_id").cast("string")))
    model = models.ThemeModel.fit(train)
    scored = model.classify(docs.filter(metrics.is_test(F.col("text_id").cast("string"))))
    return metrics.text_quality(scored.select(F.col("theme_label").alias("label"), "predicted", F.col("theme_prob").alias("prob"), "language"), by=["language"])


@query
def theme_embeddings(spark, folder):
    e = adapters.table(spark, folder, "embeddings").withColumn("theme_label", F.col("label").cast("string"))
    model = models.ThemeModel.fit(e.filter("vec_id % 5 <> 0"), embedding="embedding")
    scored = model.classify(e.filter("vec_id % 5 = 0"), embedding="embedding")
    return metrics.text_quality(scored.select(F.col("theme_label").alias("label"), "predicted", F.col("theme_prob").alias("prob")))


@query
def distinct_themes(spark, folder):
    """Every text labelled once per distinct text; the unsure ones fall back."""
    docs = adapters.texts(spark, folder)
    labelled = models.classify_distinct(models.ThemeModel.fit(docs.filter(~metrics.is_test(F.col("text_id").cast("string")))), docs.select("text_id", "text"))
    return labelled.select("text_id", "theme", "theme_prob", "theme_method")


@query
def attribution(spark, folder):
    """Features that drove the risk of every session, counted."""
    _, full, model = _risk(spark, folder)
    signals = models.attributed(full, model.nodes, model.features)
    return signals.select(F.explode(F.col("signals")["risk"]).alias("s")).groupBy("s.feature").agg(F.count(F.lit(1)).alias("sessions"))


#: A small ensemble written out: model, tree, node, left, right, feature, threshold, value.
WALKED = ["payment_failures", "searches", "product_views", "n_events"]
SMALL_TREES = [
    ("m", -1, 0, -1, -1, -1, 0.0, -0.5),
    ("m", 0, 0, 1, 2, 0, 0.5, 0.0), ("m", 0, 1, 3, 4, 3, 9.5, -0.25), ("m", 0, 2, -1, -1, -1, 0.0, 0.75), ("m", 0, 3, -1, -1, -1, 0.0, -0.5), ("m", 0, 4, -1, -1, -1, 0.0, 0.125),
    ("m", 1, 0, 1, 2, 2, 1.0, 0.0625), ("m", 1, 1, -1, -1, -1, 0.0, -0.125), ("m", 1, 2, 3, 4, 1, 0.0, 0.25), ("m", 1, 3, -1, -1, -1, 0.0, 0.5), ("m", 1, 4, -1, -1, -1, 0.0, 0.0),
    ("m", 2, 0, 1, 2, 3, 20.0, 0.0), ("m", 2, 1, 3, 4, 1, 1.0, -0.0625), ("m", 2, 2, -1, -1, -1, 0.0, 0.375), ("m", 2, 3, -1, -1, -1, 0.0, 0.0), ("m", 2, 4, -1, -1, -1, 0.0, 0.25),
]


@query
def attribution_walk(spark, folder):
    """Attributions of a fixed ensemble over every session."""
    nodes = spark.createDataFrame(SMALL_TREES, boosting.NODES)
    signals = models.attributed(behaviour_table(spark, folder), nodes, WALKED)
    return signals.select("session_id", F.explode(F.col("signals")["m"]).alias("s")).select("session_id", "s.feature", "s.value")


@query
def top_two_frictions(spark, folder):
    """The two most probable frictions of made-up probabilities."""
    return fixed_scores(spark, folder).select("session_id", joined(models.top_frictions(F.col("friction_probs"))).alias("top"))


# --- streams -----------------------------------------------------------------------------------------------------

@query
def stream_rates(spark, folder):
    """The streaming failure rate on the stored clickstream; a batch frame runs through the same function."""
    rates = ingest.failure_rates(cleaned(spark, folder), "1 day")
    return rates.select(micros("window.start").alias("start_us"), "gateway", "attempts", "failed")


@query
def stream_sessions(spark, folder):
    """Idle sessions of the clickstream with a one-day pause."""
    idle = ingest.idle_sessions(cleaned(spark, folder), 1440)
    return idle.select("session_id", micros("w.start").alias("start_us"), "events", "converted")


@query
def live_packets(spark, folder):
    """Live scoring of every session as if all had just been touched."""
    zero = {s: (0.0, 1.0) for s in vocab.STEPS}
    packets = live.live_packets(segmented(spark, folder), zero)
    return packets.select("packet_id", joined("rule_flags").alias("flags"), F.round("cart_value", 2).alias("cart_value"), "exit_step",
                          "furthest_step", "device", "source", "session_kind", "courier", "gateway", "payment_method", "converted")


@query
def live_risk_view(spark, folder):
    """What a live risk model sees of every session: the events before the first outcome or exit, or the first event."""
    seen = live.risk_events(segmented(spark, folder))
    return seen.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))
