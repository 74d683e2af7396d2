"""Investigation queries, each for one question and in bulk for many packets at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.functions.columns import meta, number, percent, position, ratio
from waymark.functions.decision import theme_frictions
from waymark.operators.anomaly import gateway_units
from waymark.operators.joins import sparse_left_join
from waymark.operators.ranges import range_sums
from waymark.session import checkpointed



# --- funnel ---------------------------------------------------------------------------------------------

def drop_off_by_segment(sessions: DataFrame, step: str = "payment", segment: str = "device",
                        limit: int = 8) -> DataFrame:
    """segment, reached, left, exit_rate, overall_exit_rate: worst segments first."""
    if step not in vocab.SHOPPING_STEPS or segment not in sessions.columns:
        raise ValueError(f"unknown step or segment: {step}, {segment}")
    rows = drop_offs(sessions, segment).filter(F.col("step") == step).drop("step")
    return rows.orderBy(F.desc("exit_rate"), "segment").limit(limit)


def drop_offs(sessions: DataFrame, segment: str) -> DataFrame:
    """The same for all steps at once, from counts per (furthest step, exit step, outcome, segment)."""
    names = F.array(*[F.lit(s) for s in vocab.SHOPPING_STEPS])
    small = sessions.filter("session_kind = 'shopping'").groupBy(
        "furthest_step", "exit_step", "converted", F.col(segment).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    reach = F.sequence(F.lit(0), position(vocab.SHOPPING_STEPS, F.col("furthest_step")))
    rows = small.select("*", F.explode(F.transform(reach, lambda i: F.get(names, i))).alias("step"))
    here = (F.col("exit_step") == F.col("step")) & ~F.col("converted")
    rates = rows.groupBy("step", "segment").agg(
        F.sum("n").alias("reached"), F.sum(F.when(here, F.col("n")).otherwise(0)).alias("left"))
    overall = rates.groupBy("step").agg(
        F.round(ratio(F.sum("left"), F.sum("reached")), 4).alias("overall_exit_rate"))  # at most six rows
    return rates.filter("segment IS NOT NULL").join(F.broadcast(overall), "step").select(
        "step", "segment", "reached", "left", F.round(ratio(F.col("left"), F.col("reached")), 4).alias("exit_rate"),
        "overall_exit_rate")


def converters_vs_abandoners(features: DataFrame, sessions: DataFrame,
                             columns: Sequence[str] = vocab.COMPARED_FEATURES) -> DataFrame:
    """feature, n_converters, n_abandoners, converters, abandoners, ratio among sessions that reached the cart, largest ratio first."""
    outcome = sessions.select("user_id", "session_id", "converted", "reached_cart").filter("reached_cart")
    joined = features.select("user_id", "session_id", *columns).join(outcome, ["user_id", "session_id"])
    exact = lambda c: F.col(c).cast("decimal(30,6)")
    sums = joined.agg(*[x for c in columns for x in (
        ratio(F.sum(F.when(F.col("converted"), exact(c))), F.count_if("converted")).alias(f"c_{c}"),
        ratio(F.sum(F.when(~F.col("converted"), exact(c))), F.count_if(~F.col("converted"))).alias(f"a_{c}"))],
        F.count_if("converted").alias("n_converters"), F.count_if(~F.col("converted")).alias("n_abandoners"))
    stacked = ", ".join(f"'{c}', c_{c}, a_{c}" for c in columns)
    long = sums.selectExpr("n_converters", "n_abandoners", f"stack({len(columns)}, {stacked}) as (feature, c, a)")
    return long.select("feature", "n_converters", "n_abandoners", F.round("c", 3).alias("converters"), F.round("a", 3).alias("abandoners"),
                       F.round(ratio(F.col("a"), F.col("c")), 2).alias("ratio")) \
               .orderBy(F.coalesce(F.when(F.col("ratio") != 0, F.col("ratio")), F.lit(99.0)).desc(), "feature")


# --- feedback, orders, catalog ------------------------------------------------------------------------------

def sample_feedback(texts: DataFrame, session_ids: Sequence[str] = (), user_id: str | None = None,
                    product_id: str | None = None, theme: str | None = None, limit: int = 5) -> DataFrame:
    """Newest texts of a session, user or product (any of them), optionally of one theme."""
    return matching_feedback(texts, session_ids, user_id, product_id, theme).orderBy(
        F.desc("ts"), "text_id").limit(limit)


def matching_feedback(texts: DataFrame, session_ids: Sequence[str] = (), user_id: str | None = None,
                      product_id: str | None = None, theme: str | None = None) -> DataFrame:
    any_of = []
    if session_ids:
        any_of.append(F.col("session_id").isin(*session_ids))
    if user_id:
        any_of.append(F.col("user_id") == user_id)
    if product_id:
        any_of.append(F.col("product_id") == product_id)
    out = texts.filter(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in any_of])) if any_of else texts
    return out.filter(F.col("theme") == theme) if theme else out


def theme_counts(texts: DataFrame) -> DataFrame:
    return texts.groupBy("theme").agg(F.count(F.lit(1)).alias("texts")).orderBy(F.desc("texts"), "theme")


def order_status(packet_orders: DataFrame, orders: DataFrame) -> DataFrame:
    """packet_id, orders, delayed, mean_delay_days, refunds_pending. packet_orders: packet_id, order_id."""
    joined = packet_orders.filter("order_id IS NOT NULL").distinct().join(orders, "order_id")
    return joined.groupBy("packet_id").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("delay_days") > 0).alias("delayed"),
        F.round(ratio(F.sum("delay_days"), F.count("delay_days")), 2).alias("mean_delay_days"),
        F.count_if(F.col("refund_status") == "pending").alias("refunds_pending"))


def order_status_counts(packet_orders: DataFrame, orders: DataFrame) -> DataFrame:
    joined = packet_orders.filter("order_id IS NOT NULL").distinct().join(orders, "order_id")
    return joined.groupBy("packet_id", "status").agg(F.count(F.lit(1)).alias("orders"))


def recent_catalog_changes(products: DataFrame, days: int = 3, before: str | None = None) -> DataFrame:
    end = F.lit(before).cast("timestamp") if before else products.agg(F.max("catalog_updated_at")).scalar()
    span = F.make_dt_interval(F.lit(days))
    return products.filter((F.col("catalog_updated_at") <= end) & (F.col("catalog_updated_at") >= end - span)) \
                   .select("product_id", "name", "catalog_updated_at")



def product_details(products: DataFrame, product_id: str) -> DataFrame:
    return products.filter(F.col("product_id") == product_id).select(*vocab.PRODUCT_DETAILS)


def stock_check(products: DataFrame) -> DataFrame:
    """Sizes that are out of stock, per product."""
    out = F.map_keys(F.map_filter("stock", lambda _, n: n == 0))
    return products.select(
        "product_id", "in_stock", "stock", out.alias("sizes_out_of_stock"),
        F.round(ratio(F.size(out), F.greatest(F.size("stock"), F.lit(1))), 2).alias("share_sizes_out"))


# --- operations -------------------------------------------------------------------------------------------

def gateway_health(probes: DataFrame, payments: DataFrame, window_minutes: int = 60, live: DataFrame | None = None,
                   s: Settings = DEFAULTS) -> DataFrame:
    """Failure rate of a gateway around a time against its rate over all time.

    probes: probe_id, gateway, around. live: session_id, gateway, ts, failed (sessions seen on the stream).
    """
    units = gateway_units(payments)
    facts = units.select(F.col("segment").alias("gateway"), F.col("ts").alias("at"), F.lit(1).cast("bigint").alias("n"),
                         F.col("bad").cast("bigint").alias("failed"))
    base = facts.groupBy("gateway").agg(ratio(F.sum("failed"), F.sum("n")).alias("baseline"))
    if live is not None:
        facts = facts.unionByName(live.select("gateway", F.col("ts").alias("at"), F.lit(1).cast("bigint").alias("n"),
                                              F.col("failed").cast("bigint").alias("failed")))
    span = F.make_dt_interval(mins=F.lit(window_minutes))
    sums = range_sums(probes.withColumns({"lo": F.col("around") - span, "hi": F.col("around") + span}), facts,
                      "gateway", ["n", "failed"], s)
    rate = F.coalesce(ratio(F.col("failed"), F.col("n")), F.lit(0.0))
    return probes.join(sums, "probe_id", "left").join(base, "gateway", "left").select(
        "probe_id", "gateway", F.coalesce("n", F.lit(0)).alias("sessions_in_window"),
        F.coalesce("failed", F.lit(0)).alias("failed_sessions"), F.round(rate, 4).alias("failure_rate"),
        F.round(F.coalesce("baseline", F.lit(0.0)), 4).alias("baseline_failure_rate"),
        F.round(ratio(rate, F.col("baseline")), 2).alias("multiplier"))


def courier_health(probes: DataFrame, orders: DataFrame, days: int = 2, s: Settings = DEFAULTS) -> DataFrame:
    """Delayed share of a courier (in a city, or everywhere when the city is null) around a time.

    probes: probe_id, courier, city, around.
    """
    name = lambda city: F.concat("courier", F.lit("|"), F.coalesce(city, F.lit("*")))
    scopes = F.explode(F.array(name(F.col("city")), name(F.lit(None).cast("string"))))
    late = F.col("delay_days") >= 2
    facts = orders.select(scopes.alias("scope"), F.col("placed_at").alias("at"), F.lit(1).cast("bigint").alias("n"),
                          F.coalesce(late, F.lit(False)).cast("bigint").alias("delayed"),
                          F.coalesce("delay_days", F.lit(0)).cast("bigint").alias("days"),
                          F.col("delay_days").isNotNull().cast("bigint").alias("known"))
    base = facts.groupBy("scope").agg(ratio(F.sum("delayed"), F.sum("n")).alias("baseline"))
    span = F.make_dt_interval(F.lit(days))
    asked = probes.withColumns({"scope": name(F.col("city")), "lo": F.col("around") - span,
                                "hi": F.col("around") + span})
    sums = range_sums(asked, facts, "scope", ["n", "delayed", "days", "known"], s)
    rate = F.coalesce(ratio(F.col("delayed"), F.col("n")), F.lit(0.0))
    return asked.join(sums, "probe_id", "left").join(base, "scope", "left").select(
        "probe_id", "courier", "city", F.coalesce("n", F.lit(0)).alias("orders_in_window"),
        F.round(rate, 4).alias("delayed_share"),
        F.round(F.coalesce("baseline", F.lit(0.0)), 4).alias("baseline_delayed_share"),
        F.round(ratio(rate, F.col("baseline")), 2).alias("multiplier"),
        F.round(F.coalesce(ratio(F.col("days"), F.col("known")), F.lit(0.0)), 2).alias("mean_delay_days"))


def delivery_eta(quotes: DataFrame, by: Sequence[str] = ("city", "courier")) -> DataFrame:
    """Quotes, median and 90th percentile of the quoted days. quotes: city, courier, eta_days."""
    return quotes.groupBy(*by).agg(
        F.count("eta_days").alias("quotes"), F.percentile("eta_days", 0.5).alias("median_eta_days"),
        F.percentile("eta_days", 0.9).alias("p90_eta_days"))


def eta_quotes(events: DataFrame, sessions: DataFrame) -> DataFrame:
    shown = events.filter("event = 'delivery_info_view'").select(
        "user_id", "session_id", meta("courier").alias("courier"), number(meta("eta_days")).alias("eta_days"))
    return shown.join(sessions.select("user_id", "session_id", "city"), ["user_id", "session_id"])


def top_frictions(decisions: DataFrame, limit: int = 5) -> DataFrame:
    money = F.sum(F.col("revenue_at_risk").cast("decimal(28,2)")).cast("double")
    return (
        decisions.filter("packet_type = 'session'").groupBy("friction_type")
        .agg(F.count(F.lit(1)).alias("sessions"), F.round(money, 2).alias("revenue_at_risk"))
        .orderBy(F.desc("revenue_at_risk"), "friction_type").limit(limit)
    )


# --- findings for the second pass ---------------------------------------------------------------------------

#: What an answer must show to count as evidence.
MULTIPLIER, FAILED_SESSIONS, ORDERS, MISSING_ATTRIBUTES, SEGMENT_FACTOR = 2, 2, 3, 2, 1.5


def _finding(tool: str, supported: Column, kind: str, summary: Column, args: dict[str, Column], numbers: dict[str, Column]) -> Column:
    """What was asked (args), what came back in numbers and words, and which friction it supports."""
    def listed(values: dict[str, Column], kind: str) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), v.cast(kind).alias("value")) for n, v in values.items()])

    supported = F.coalesce(supported, F.lit(False))
    return F.struct(
        F.lit(tool).alias("tool"), summary.alias("summary"),
        F.when(supported, F.col("friction_type")).cast("string").alias("supports"),
        F.when(supported, kind).otherwise("none").alias("evidence_kind"),
        F.filter(listed(args, "string"), lambda x: x["value"].isNotNull()).alias("args"), listed(numbers, "double").alias("numbers")).alias("finding")


def _themes_by(texts: DataFrame, key: str) -> DataFrame:
    """key -> themes of its texts and their number; themes come from a short fixed list."""
    return texts.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.collect_set("theme").alias("themes"), F.count(F.lit(1)).alias("matched"))


def findings(packets: DataFrame, payments: DataFrame, orders: DataFrame, texts: DataFrame, products: DataFrame,
             sessions: DataFrame, members: DataFrame, s: Settings = DEFAULTS, live: DataFrame | None = None) -> DataFrame:
    """packet_id, findings. `live`: payment sessions seen on the stream (see gateway_health). Each packet is routed to the queries that fit its friction or its segment.

    packets: decided packets with friction_type and, for sessions, session_id, user_id, gateway, courier, city,
    primary_product_id, order_id, exit_step, start; for aggregates segment_type, segment_value, window_start.
    """
    agg = F.col("packet_type") == "aggregate"
    kind = F.col("segment_type")
    f = F.col("friction_type")
    parts = F.split("segment_value", r"\|", 2)
    p = packets.withColumns({
        "_gateway": F.when(agg & (kind == "gateway"), F.col("segment_value"))
                     .when(~agg & (f == "payment_failure"), F.col("gateway")),
        "_courier": F.when(agg & (kind == "courier_city"), F.get(parts, F.lit(0)))
                     .when(~agg & f.isin("delivery_uncertainty", "post_purchase_concern"), F.col("courier")),
        "_city": F.when(agg, F.get(parts, F.lit(1))).otherwise(F.col("city")),
        "_around": F.when(agg, F.col("window_start")).otherwise(F.col("start")),
        "_product": F.when(agg & (kind == "product"), F.col("segment_value"))
                     .when(~agg & f.isin("unclear_product_info", "out_of_stock"), F.col("primary_product_id")),
    }).select("packet_id", "packet_type", "friction_type", "session_id", "user_id", "order_id", "segment_type",
              F.coalesce("exit_step", F.lit("payment")).alias("_step"), "_gateway", "_courier", "_city", "_around",
              "_product")
    p = checkpointed(p)  # read by every query below, so it is stored once
    known = p.select("packet_id", "friction_type", "_around", "_city", "session_id")
    found: list[DataFrame] = []

    def add(df: DataFrame, finding: Column) -> None:
        found.append(df.select("packet_id", finding))

    asked = p.filter("_gateway IS NOT NULL").select(
        F.col("packet_id").alias("probe_id"), F.col("_gateway").alias("gateway"), F.col("_around").alias("around"))
    health = gateway_health(asked, payments, live=live, s=s).withColumnRenamed("probe_id", "packet_id").join(known, "packet_id")
    add(health, _finding("gateway_health", (F.col("multiplier") >= MULTIPLIER) & (F.col("failed_sessions") >= FAILED_SESSIONS)
                         & (f == "payment_failure"), "aggregate",
        F.concat(F.lit("Gateway "), "gateway", F.lit(" failure rate "), percent(F.col("failure_rate")), F.lit(" vs "),
                 percent(F.col("baseline_failure_rate")), F.lit(" baseline ("), F.col("failed_sessions").cast("string"),
                 F.lit(" failed sessions)")),
        {"gateway": F.col("gateway"), "around": F.col("_around")},
        {c: F.col(c) for c in ("failure_rate", "baseline_failure_rate", "failed_sessions")}))

    asked = p.filter("_courier IS NOT NULL").select(
        F.col("packet_id").alias("probe_id"), F.col("_courier").alias("courier"), F.col("_city").alias("city"),
        F.col("_around").alias("around"))
    health = courier_health(asked, orders, s=s).withColumnRenamed("probe_id", "packet_id").join(known, "packet_id")
    add(health, _finding("courier_health", (F.col("multiplier") >= MULTIPLIER) & (F.col("orders_in_window") >= ORDERS)
                         & f.isin("delivery_uncertainty", "post_purchase_concern"), "aggregate",
        F.concat("courier", F.lit(" delayed-order share "), percent(F.col("delayed_share")), F.lit(" vs "),
                 percent(F.col("baseline_delayed_share")), F.lit(" baseline ("),
                 F.col("orders_in_window").cast("string"), F.lit(" orders)")),
        {"courier": F.col("courier"), "city": F.col("_city"), "around": F.col("_around")},
        {c: F.col(c) for c in ("delayed_share", "baseline_delayed_share", "orders_in_window")}))

    # orders of the session itself, or of all sessions of a courier anomaly
    own = p.filter((F.col("packet_type") == "session") & (f == "post_purchase_concern")).select("packet_id", "order_id")
    touched = p.filter("packet_type = 'aggregate' AND segment_type = 'courier_city'").select("packet_id")
    of_members = touched.join(members, "packet_id").join(sessions.select("session_id", "order_id"), "session_id") \
                        .select("packet_id", "order_id")
    status = own.select("packet_id").unionByName(touched).join(
        order_status(own.unionByName(of_members), orders), "packet_id", "left").join(known, "packet_id")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    add(status, _finding("order_status_for_sessions", (f == "post_purchase_concern")
                         & ((n("delayed") > 0) | (n("refunds_pending") > 0)), "aggregate",
        F.concat(n("orders").cast("string"), F.lit(" orders: "), n("delayed").cast("string"), F.lit(" delayed, "),
                 n("refunds_pending").cast("string"), F.lit(" refunds pending")),
        {"session_id": F.col("session_id"), "packet_id": F.when(F.col("session_id").isNull(), F.col("packet_id"))},
        {c: n(c) for c in ("orders", "delayed", "refunds_pending")}))

    catalog = products.select(
        F.col("product_id").alias("_product"), "sizes", "has_size_chart", "missing_attributes", "in_stock", "stock")
    about = p.filter("_product IS NOT NULL").join(catalog, "_product", "left")
    no_chart = (F.size("sizes") > 0) & ~F.coalesce("has_size_chart", F.lit(False))
    missing = F.greatest(F.coalesce(F.size("missing_attributes"), F.lit(0)), F.lit(0))
    add(about.filter((F.col("packet_type") == "aggregate") | (f == "unclear_product_info")),
        _finding("product_details", (f == "unclear_product_info") & (F.coalesce(no_chart, F.lit(False)) | (missing >= MISSING_ATTRIBUTES)),
                 "catalog", F.concat(F.lit("Product "), "_product", F.lit(": size chart "),
                                     F.when(no_chart, "missing").otherwise("present"), F.lit(", "),
                                     missing.cast("string"), F.lit(" missing attributes")),
                 {"product_id": F.col("_product")}, {"missing_attributes": missing}))
    sold_out = F.coalesce(F.size(F.map_filter("stock", lambda _, q: q == 0)), F.lit(0))
    add(about.filter((F.col("packet_type") == "session") & (f == "out_of_stock")),
        _finding("stock_check", (f == "out_of_stock") & F.col("in_stock").isNotNull()
                 & ((sold_out > 0) | ~F.col("in_stock")), "catalog",
                 F.concat(F.lit("Product "), "_product", F.lit(": "), sold_out.cast("string"),
                          F.lit(" sizes out of stock")),
                 {"product_id": F.col("_product")}, {"sizes_out_of_stock": sold_out}))

    glitch = p.filter((F.col("packet_type") == "session") & (f == "technical_glitch"))
    top = F.min(F.struct((-F.col("exit_rate")).alias("minus"), "segment"))
    worst = drop_offs(sessions, "device").groupBy("step").agg(top.alias("_top"), F.max("overall_exit_rate").alias("overall_exit_rate")).select(
        F.col("step").alias("_step"), (-F.col("_top.minus")).alias("exit_rate"), F.col("_top.segment").alias("_segment"), "overall_exit_rate")
    rates = glitch.join(F.broadcast(worst), "_step", "left")  # one row per funnel step
    add(rates, _finding("drop_off_by_segment", F.col("exit_rate") >= SEGMENT_FACTOR * F.greatest(
        F.col("overall_exit_rate"), F.lit(1e-3)), "aggregate",
        F.concat(F.lit("Exit rate at "), "_step", F.lit(": "), F.coalesce(percent(F.col("overall_exit_rate")), F.lit("0%")), F.lit(" overall"),
                 F.coalesce(F.concat(F.lit(", highest "), "_segment", F.lit(" "), percent(F.col("exit_rate"))), F.lit(""))),
        {"step": F.col("_step"), "segment": F.lit("device")}, {"overall_exit_rate": F.coalesce("overall_exit_rate", F.lit(0.0))}))

    found.append(_feedback(p, texts, members))
    listed = reduce(DataFrame.unionByName, found)
    return listed.groupBy("packet_id").agg(F.array_sort(F.collect_list("finding")).alias("findings"))


def _feedback(p: DataFrame, texts: DataFrame, members: DataFrame) -> DataFrame:
    """What customers wrote: about the product, or in the session and by its user, or in an anomaly's sessions."""
    f = F.col("friction_type")
    by_product = (F.col("packet_type") == "aggregate") | (f == "unclear_product_info")
    product = p.filter(F.col("_product").isNotNull() & by_product)
    other = p.join(product.select("packet_id"), "packet_id", "left_anti")
    told = [product.join(_themes_by(texts, "product_id").withColumnRenamed("product_id", "_product"), "_product")
            .select("packet_id", "themes", "matched")]
    own = other.filter("packet_type = 'session'")
    told.append(own.join(_themes_by(texts, "user_id"), "user_id").select("packet_id", "themes", "matched"))
    # texts of the session by somebody else; those by the same user are counted above
    direct = texts.filter("session_id IS NOT NULL").groupBy("session_id", F.col("user_id").alias("_by")).agg(
        F.collect_set("theme").alias("themes"), F.count(F.lit(1)).alias("matched"))
    told.append(own.join(direct, "session_id").filter(~F.col("user_id").eqNullSafe(F.col("_by")))
                .select("packet_id", "themes", "matched"))
    told.append(other.filter("packet_type = 'aggregate'").select("packet_id").join(members, "packet_id")
                .join(_themes_by(texts, "session_id"), "session_id").select("packet_id", "themes", "matched"))
    merged = reduce(DataFrame.unionByName, told).select("packet_id", "matched", F.explode("themes").alias("theme"))
    counts = reduce(DataFrame.unionByName, told).groupBy("packet_id").agg(F.sum("matched").alias("matched"))
    themes = merged.groupBy("packet_id").agg(F.array_sort(F.collect_set("theme")).alias("themes"))
    rows = p.join(counts, "packet_id", "left").join(themes, "packet_id", "left")
    none = F.array().cast("array<string>")
    supported = F.array_contains(theme_frictions(F.coalesce("themes", none)), f)
    text = F.concat(F.coalesce("matched", F.lit(0)).cast("string"), F.lit(" customer texts; themes: "),
                    F.when(F.size("themes") > 0, F.array_join("themes", ", ")).otherwise("none"))
    of_product = F.col("_product").isNotNull() & by_product
    args = {"product_id": F.when(of_product, F.col("_product")), "session_id": F.when(~of_product, F.col("session_id")), "user_id": F.when(~of_product, F.col("user_id")),
            "packet_id": F.when(~of_product & F.col("session_id").isNull(), F.col("packet_id"))}
    return rows.select("packet_id", _finding("sample_feedback", supported, "text", text, args, {"matched_texts": F.coalesce("matched", F.lit(0))}))


# --- one customer --------------------------------------------------------------------------------------------

def customer_context(sessions: DataFrame, journeys: DataFrame, payments: DataFrame, orders: DataFrame,
                     texts: DataFrame | None = None, messages: int = 3, products: DataFrame | None = None) -> DataFrame:
    """What an agent needs to know per session: journey, product, payments, order, last messages and the themes of all messages."""
    failed = F.col("status") == "failed"
    paid = payments.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(failed).alias("failed"),
        F.count_if(failed & F.col("amount_debited")).alias("debited_without_order"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = sessions.select("user_id", "session_id", "order_id", "primary_product_id") \
                  .join(journeys, ["user_id", "session_id"], "left").join(paid, "session_id", "left")
    have = [c for c in ("courier", "delay_days", "refund_status") if c in orders.columns]
    placed = orders.select("order_id", F.col("status").alias("order_status"), *have)
    out = sparse_left_join(out, placed, "order_id", "session_id")
    out = out.withColumns({c: zero(c) for c in ("attempts", "failed", "debited_without_order")})
    if products is not None:
        named = products.select(F.col("product_id").alias("primary_product_id"), F.col("subcategory").alias("product"))
        out = sparse_left_join(out, named, "primary_product_id", "session_id")
    if texts is None:
        return out
    # a text counts once for a session even when both the session and the user match
    wanted = out.select("user_id", "session_id")
    mine = texts.select("text_id", "ts", "text", "theme", F.col("session_id").alias("_s"), F.col("user_id").alias("_u"))
    by_user = _newest(mine.filter("_u IS NOT NULL"), "_u", messages)
    by_session = _newest(mine.filter("_s IS NOT NULL"), "_s", messages)
    both = wanted.join(by_user, F.col("user_id") == F.col("_u")).select("session_id", "m").unionByName(
        wanted.join(by_session, F.col("session_id") == F.col("_s")).select("session_id", "m")).distinct()
    last = F.slice(F.sort_array(F.collect_list("m"), asc=False), 1, messages)
    told = both.groupBy("session_id").agg(F.transform(last, lambda m: m["text"]).alias("customer_messages"))
    # the themes of everything written in the session or by its user
    of_user = mine.filter("_u IS NOT NULL").select("_u", "theme").distinct()
    of_session = mine.filter("_s IS NOT NULL").select("_s", "theme").distinct()
    every = wanted.join(of_user, F.col("user_id") == F.col("_u")).select("session_id", "theme").unionByName(
        wanted.join(of_session, F.col("session_id") == F.col("_s")).select("session_id", "theme"))
    themes = every.groupBy("session_id").agg(F.array_sort(F.collect_set("theme")).alias("themes"))
    return out.join(told, "session_id", "left").join(themes, "session_id", "left")


def _newest(texts: DataFrame, key: str, n: int) -> DataFrame:
    """Last n texts of each key: first per salted part of the key, then per key."""
    m = F.struct("ts", "text_id", "text", "theme")
    salted = texts.select(key, m.alias("m"), F.pmod(F.xxhash64("text_id"), F.lit(64)).alias("_salt"))
    part = Window.partitionBy(key, "_salt").orderBy(F.desc("m"))
    whole = Window.partitionBy(key).orderBy(F.desc("m"))
    some = salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= n).select(key, "m")

