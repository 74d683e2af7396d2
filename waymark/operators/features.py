"""Behaviour features of sessions and of session prefixes.

Every event first gets its *increments*: what it adds to each feature, given the events before it. All features are
then sums and maxima of increments. A session is one aggregation; a prefix is the running sum over the few blocks a
session consists of, so prefixes do not multiply the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.functions.columns import any_of, flag, lookup, meta, micros, number, number_or_zero, position, truthy
from waymark.operators.clean import NUMBERS
from waymark.operators.ordered import CHUNK, group_max, ordered
from waymark.operators.sessions import SESSION

_GROUPS = list(vocab.EXIT_GROUPS)
_GROUP_OF_EVENT = {event: _GROUPS.index(g) + 1 for g, events in vocab.EXIT_GROUPS.items() for event in events}
# event counters share one column, the others have their own
_SUMS = ["new_product", "pdp_loop", "cart_loop", "method_switch", "chart_unavailable", "oos_view", "timeout",
         "rage_checkout", "fatal", "oos_removal", "refund_pending", "delayed_status", "info_return", "quality_return"]
_MAXES = ["review_page", "eta_days", "delivery_fee", "fee_first", "load_ms", "cart", "delta_pct", "extra_fees", "cod",
          "update_hours"]
_FIRSTS = ["first_page_view", "device_code", "android", "tier", "source_code", "logged_in", "first_step",
           "first_cart"]


def _extra_fees(events: DataFrame) -> Column:
    """Sum of the numeric values of a total whose key is not a standard one. Metadata that came as JSON tells numbers from texts;
    in a map of texts a numeric text counts as a number."""
    extra = lambda c: F.map_filter(c, lambda k, v: ~k.isin(*vocab.STANDARD_TOTAL_KEYS))
    if NUMBERS in events.columns:
        return F.aggregate(F.map_values(extra(NUMBERS)), F.lit(0.0), lambda acc, v: acc + v)

    def value(v: Column) -> Column:
        return F.when(v == "true", 1.0).otherwise(number_or_zero(v))

    return F.aggregate(F.map_values(extra("metadata")), F.lit(0.0), lambda acc, v: acc + value(v))


def event_facts(events: DataFrame) -> DataFrame:
    """What each event says by itself. Metadata is read once here and not carried any further."""
    name, page = F.col("event"), F.col("page")

    def on(event: str, condition: Column) -> Column:
        return (name == event) & F.coalesce(condition, F.lit(False))

    def amount(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    quote = name.isin("pincode_check", "delivery_info_view")
    page_view = name == "page_view"
    reason = meta("reason")
    columns = {
        "body": name != "exit",
        "step_idx": position(vocab.STEPS, F.col("step")),
        "group": F.coalesce(lookup(_GROUP_OF_EVENT, name), F.lit(0)),
        "viewed": F.when(name == "product_view", F.col("product_id")),
        "method": F.when(name == "payment_attempt", F.coalesce(meta("method"), F.lit("None"))),
        "chart_unavailable": flag(on("size_chart_open", meta("available") == "false")),
        "oos_view": flag(on("product_view", meta("in_stock") == "false")),
        "timeout": flag(on("payment_failed", F.contains(meta("error"), F.lit("timeout")))),
        "rage_checkout": flag(on("rage_click", page.isin(*vocab.CHECKOUT_PAGES))),
        "fatal": flag(on("js_error", truthy(meta("fatal")))),
        "oos_removal": flag(on("remove_from_cart", reason == "out_of_stock")),
        "refund_pending": flag(on("tracking_view", meta("refund_status") == "pending")),
        "delayed_status": flag(on("tracking_view", meta("status") == "delayed")),
        "info_return": flag(on("return_initiated", reason.isin(*vocab.INFO_RETURN_REASONS))),
        "quality_return": flag(on("return_initiated", reason.isin(*vocab.QUALITY_RETURN_REASONS))),
        "review_page": amount(name == "review_open", F.coalesce(number(meta("review_page")), F.lit(1.0))),
        "eta_days": amount(quote, number_or_zero(meta("eta_days"))),
        "delivery_fee": amount(quote, number_or_zero(meta("delivery_fee"))),
        "fee_first": amount(quote, flag(truthy(meta("fee_first_shown"))).cast("double")),
        "load_ms": amount(name == "slow_load", number_or_zero(meta("load_ms"))),
        "delta_pct": amount(name == "total_shown", number_or_zero(meta("delta_pct"))),
        "extra_fees": amount(name == "total_shown", _extra_fees(events)),
        "cod": amount(on("total_shown", meta("payment_method") == "COD"), F.lit(1.0)),
        "update_hours": amount(name == "tracking_view", number_or_zero(meta("last_update_hours"))),
        "cart_value": number(meta("cart_value")),
        # context, used only where the event opens the session
        "c_device": amount(page_view, lookup(vocab.DEVICE_CODES, meta("device"), -1)),
        "c_tier": amount(page_view, lookup(vocab.CITY_TIERS, meta("city_tier"), 0)),
        "c_source": amount(page_view, lookup(vocab.SOURCE_CODES, meta("source"), -1)),
        "c_logged_in": amount(page_view, flag(truthy(meta("is_logged_in")))),
    }
    keep = [*SESSION, "timestamp", "seq", "event", "page", *([CHUNK] if CHUNK in events.columns else [])]
    return events.select(*keep, *[c.alias(n) for n, c in columns.items()])


def increments(facts: DataFrame) -> DataFrame:
    """Add what depends on the events before: gaps, loops, switches, first views."""
    body = F.col("body")
    ev = ordered(
        facts, SESSION,
        prior={
            "p_ts": micros(), "p_step": F.col("step_idx"), "p_page": F.when(body, F.col("page")),
            "p_method": F.col("method"), "p_viewed": F.col("viewed"),
        },
        total={"idx": F.lit(1)},
    )
    ev = ordered(ev, SESSION, prior={"p2_viewed": F.when(F.col("viewed").isNotNull(), F.col("p_viewed"))})
    ev = ordered(ev, [*SESSION, "viewed"], total={"nth_view": flag(F.col("viewed").isNotNull())})
    opens = F.col("idx") == 1
    viewed = F.col("viewed")
    return ev.withColumns({
        "gap": micros() - F.col("p_ts"),
        "new_product": flag(F.col("nth_view") == 1),
        "pdp_loop": flag((viewed == F.col("p2_viewed")) & (viewed != F.col("p_viewed"))),
        "cart_loop": flag(body & (F.col("page") == "cart") & any_of(F.col("p_page"), vocab.CHECKOUT_PAGES)),
        "method_switch": flag(F.col("method") != F.col("p_method")),
        "cart": F.when(body, F.col("cart_value")),
        # where the session stands after this event: place, step and exit group packed into one number
        "mark": F.when(body, F.col("idx") * 128 + F.col("step_idx") * 16 + F.col("group")),
        "end_mark": F.col("idx") * 2 + flag(~body),
        "body_ts": F.when(body, micros()),
        "first_page_view": F.when(opens, flag(F.col("event") == "page_view")),
        "device_code": F.when(opens, F.col("c_device")),
        "android": F.when(opens, flag(F.col("c_device") == vocab.DEVICE_CODES["android_app"])),
        "tier": F.when(opens, F.col("c_tier")),
        "source_code": F.when(opens, F.col("c_source")),
        "logged_in": F.when(opens, F.col("c_logged_in")),
        "first_step": F.when(opens, F.col("step_idx")),
        "first_cart": F.when(opens, F.col("cart_value")),
    })


def _accumulators() -> tuple[dict[str, Column], dict[str, Column]]:
    """(sums, maxima) over increments; both kinds can be merged by applying them again."""
    name, body = F.col("event"), F.col("body")
    sums = {"n_body": flag(body)}
    sums |= {c: flag(name == e) for c, e in vocab.COUNTERS.items()}
    sums |= {f"dwell_{s}": F.when(F.col("p_step") == i, F.col("gap")).otherwise(0) for i, s in enumerate(vocab.STEPS)}
    sums |= {c: F.col(c) for c in _SUMS}
    maxes = {c: F.col(c) for c in (*_MAXES, *_FIRSTS)}
    maxes |= {
        "max_gap": F.col("gap"), "last_ts": micros(), "body_ts": F.col("body_ts"), "mark": F.col("mark"),
        "end_mark": F.col("end_mark"), "furthest": F.when(body, F.col("step_idx")),
        "pp_page": flag(body & F.col("page").isin(*vocab.POST_PURCHASE_PAGES)),
        "first_pp_page": F.when(F.col("idx") == 1, flag(F.col("page").isin(*vocab.POST_PURCHASE_PAGES))),
        "neg_first_ts": -micros(),
    }
    return sums, maxes


def accumulate(ev: DataFrame, keys: list[str]) -> DataFrame:
    sums, maxes = _accumulators()
    return ev.groupBy(*keys).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxes.items()])


def finish(acc: DataFrame, keys: list[str]) -> DataFrame:
    """Accumulators to named feature columns, all doubles."""
    empty = F.col("n_body") == 0  # only exit beacons: the first one stands for the session
    first_ts = -F.col("neg_first_ts")
    start = F.timestamp_micros(first_ts)
    seconds = lambda c: c / 1e6
    n_total = F.floor(F.col("end_mark") / 2)
    ends_with_exit = (F.col("end_mark") % 2 == 1) & (n_total > 1)
    step_now = F.floor((F.col("mark") % 128) / 16)
    group_now = F.col("mark") % 16
    floor0 = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    context = lambda c, missing: F.coalesce(F.col(c), F.lit(missing))
    pp_page = F.when(empty, F.col("first_pp_page")).otherwise(F.col("pp_page")) == 1
    out = {
        "n_events": F.greatest(F.col("n_body"), F.lit(1)),
        "duration_s": seconds(F.col("last_ts") - first_ts),
        "max_gap_s": F.coalesce(seconds(F.col("max_gap")), F.lit(0.0)),
        "exit_dwell_s": F.when(ends_with_exit, seconds(F.col("last_ts") - F.coalesce("body_ts", first_ts)))
                         .otherwise(0.0),
        **{f"dwell_{s}_s": seconds(F.col(f"dwell_{s}")) for s in vocab.STEPS},
        "furthest_step_idx": F.coalesce("furthest", "first_step"),
        "current_step_idx": F.coalesce(step_now, F.col("first_step")),
        **{c: F.col(c) for c in vocab.COUNTERS},
        "unique_products": F.col("new_product"), "pdp_loops": F.col("pdp_loop"),
        "checkout_cart_loops": F.col("cart_loop"), "size_chart_unavailable": F.col("chart_unavailable"),
        "max_review_page": floor0("review_page"), "max_eta_days": floor0("eta_days"),
        "max_delivery_fee": floor0("delivery_fee"), "fee_first_shown": floor0("fee_first"),
        "oos_product_views": F.col("oos_view"), "method_switches": F.col("method_switch"),
        "payment_timeouts": F.col("timeout"), "rage_clicks_checkout": F.col("rage_checkout"),
        "max_load_ms": floor0("load_ms"), "fatal_errors": F.col("fatal"), "oos_removals": F.col("oos_removal"),
        "cart_value": F.when(empty, floor0("first_cart")).otherwise(floor0("cart")),
        "max_total_delta_pct": floor0("delta_pct"), "max_extra_fees": floor0("extra_fees"),
        "cod_selected": floor0("cod"), "refund_pending_views": F.col("refund_pending"),
        "delayed_status_views": F.col("delayed_status"), "max_last_update_hours": floor0("update_hours"),
        "info_mismatch_returns": F.col("info_return"), "quality_returns": F.col("quality_return"),
        **{g: flag(group_now == i + 1) for i, g in enumerate(_GROUPS)},
        "device_code": context("device_code", -1), "is_android_app": context("android", 0),
        "city_tier_num": context("tier", 0), "source_code": context("source_code", -1),
        "logged_in_at_start": context("logged_in", 0),
        "hour": F.hour(start), "is_weekend": flag(F.weekday(start) >= 5),
        "is_post_purchase": flag(pp_page & (F.col("add_to_carts") == 0) & (F.col("checkout_starts") == 0)),
    }
    names = [*vocab.BEHAVIOUR_COLUMNS, *vocab.CONTEXT_COLUMNS]
    extra = [c for c in ("prefix_len", "prefix_end", "is_final") if c in acc.columns]
    return acc.select(*keys, *extra, *[out[c].cast("double").alias(c) for c in names])


def session_features(events: DataFrame) -> DataFrame:
    """Full-session features without dwell scores. Input: sessionized, clean events."""
    return finish(accumulate(increments(event_facts(events)), list(SESSION)), list(SESSION))


# --- prefixes ---------------------------------------------------------------------------------------

def live_view(facts: DataFrame) -> DataFrame:
    """Events a live scorer can know: no exit beacon, nothing from the first outcome on."""
    seen = ordered(facts.filter("body"), SESSION, total={"_outcomes": flag(F.col("event").isin(*vocab.OUTCOME_EVENTS))})
    return seen.filter("_outcomes = 0").drop("_outcomes")


def _blocks(events: DataFrame) -> DataFrame:
    """Live view with increments and a block number: a block is a run of events on the same funnel step."""
    ev = increments(live_view(event_facts(events)))
    change = flag(F.col("p_step") != F.col("step_idx"))
    return ordered(ev, SESSION, total={"block": change})


def _last_blocks(blocks: DataFrame, max_prefixes: int) -> DataFrame:
    """A prefix ends where a block ends; only the last few of a session are kept."""
    out = group_max(blocks, SESSION, "block", "_last_block")
    return (
        out.filter(F.col("block") > F.col("_last_block") - max_prefixes)
        .withColumn("is_final", F.col("block") == F.col("_last_block"))
        .drop("_last_block")
    )


def prefix_cuts(events: DataFrame, max_prefixes: int = DEFAULTS.max_prefixes) -> DataFrame:
    """user_id, session_id, prefix_len, prefix_end, is_final: prefix lengths where the funnel step changes."""
    facts = live_view(event_facts(events))
    ev = ordered(facts, SESSION, prior={"p_step": F.col("step_idx")}, total={"idx": F.lit(1)})
    ev = ordered(ev, SESSION, total={"block": flag(F.col("p_step") != F.col("step_idx"))})
    blocks = ev.groupBy(*SESSION, "block").agg(
        F.max("idx").alias("prefix_len"), F.max("timestamp").alias("prefix_end"),
        *([F.min(CHUNK).alias(CHUNK)] if CHUNK in ev.columns else []))
    return _last_blocks(blocks, max_prefixes).drop("block", CHUNK)


def prefix_features(events: DataFrame, max_prefixes: int = DEFAULTS.max_prefixes) -> DataFrame:
    """One feature row per prefix: running sums and maxima over the blocks of a session."""
    ev = _blocks(events)
    sums, maxes = _accumulators()
    per_block = ev.groupBy(*SESSION, "block").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxes.items()],
        F.max("idx").alias("prefix_len"),
        *([F.min(CHUNK).alias(CHUNK)] if CHUNK in ev.columns else []))
    names = [*sums, *maxes]
    run = ordered(
        per_block, SESSION, ["block"],
        total={f"r_{n}": F.col(n) for n in sums}, peak={f"r_{n}": F.col(n) for n in maxes})
    run = run.select(*SESSION, "block", "prefix_len", *([CHUNK] if CHUNK in run.columns else []),
                     *[F.col(f"r_{n}").alias(n) for n in names])
    run = _last_blocks(run, max_prefixes).withColumn("prefix_end", F.timestamp_micros("last_ts"))
    return finish(run, list(SESSION))


# --- dwell scores -----------------------------------------------------------------------------------

def dwell_baselines(features: DataFrame) -> DataFrame:
    """One row per step: mean and sample deviation of log(1 + dwell) over sessions that spent time there."""
    def stats(step: str) -> list[Column]:
        x = F.when(F.col(f"dwell_{step}_s") > 0, F.log1p(f"dwell_{step}_s"))
        return [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{step}_mean"),
                F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(1.0).alias(f"{step}_std")]

    wide = features.agg(*[c for s in vocab.STEPS for c in stats(s)])
    rows = ", ".join(f"'{s}', `{s}_mean`, `{s}_std`" for s in vocab.STEPS)
    return wide.selectExpr(f"stack({len(vocab.STEPS)}, {rows}) as (step, mean, std)")


def baseline_values(baselines: DataFrame) -> dict[str, tuple[float, float]]:
    """The seven baseline rows as numbers, like the parameters of a fitted model."""
    return {r["step"]: (r["mean"], r["std"]) for r in baselines.collect()}


def add_dwell_z(features: DataFrame, baselines: dict[str, tuple[float, float]]) -> DataFrame:
    def z(step: str) -> Column:
        mean, std = baselines[step]
        dwell = F.col(f"dwell_{step}_s")
        return F.when(dwell > 0, (F.log1p(dwell) - mean) / max(std, 1e-6)).otherwise(0.0)

    scored = features.withColumns({f"dwell_z_{s}": z(s) for s in vocab.STEPS})
    return scored.withColumn("max_dwell_z", F.greatest(*[F.col(f"dwell_z_{s}") for s in vocab.STEPS]))


def feature_tables(events: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(session features with dwell scores, prefix features with dwell scores, baselines)."""
    full = session_features(events)
    baselines = dwell_baselines(full)
    values = baseline_values(baselines)
    prefixes = prefix_features(events, settings.max_prefixes)
    return add_dwell_z(full, values), add_dwell_z(prefixes, values), baselines
