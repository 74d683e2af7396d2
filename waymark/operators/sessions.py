"""Sessions: splitting event streams, and one summary row per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.functions.columns import meta, micros, number, position, truthy
from waymark.operators.ordered import CHUNK, ORDER, ordered, split_hot

SESSION = ("user_id", "session_id")


def sessionize(events: DataFrame, gap_minutes: int | None = None, settings: Settings = DEFAULTS, source: DataFrame | None = None) -> DataFrame:
    """Split every user's events where they pause for more than the gap or the tracker's session id changes.

    The k-th segment (k > 1) of a tracker id is named `<id>_k`, also when several users share the tracker id. `source` may be the
    raw events that `events` were cleaned from: the probes for hot users and shared trackers then read its key columns instead of
    running the cleaning again.
    """
    gap = (settings.session_gap_minutes if gap_minutes is None else gap_minutes) * 60_000_000
    ev = split_hot(events, ["user_id"], limit=settings.hot_rows, max_chunks=settings.max_chunks, source=source)
    ev = ordered(ev, ["user_id"], prior={"_before": micros(), "_tracker": F.col("session_id")})
    starts = (
        F.col("_before").isNull()
        | (micros() - F.col("_before") > gap)
        | (F.col("session_id") != F.col("_tracker"))
    )
    ev = ev.withColumn("_new", starts.cast("int"))
    # a segment never changes its tracker id, so the k of a row is the number of starts of its tracker id so far
    ev = ordered(ev, SESSION, total={"_k": F.col("_new")})
    ev = _continue_shared_trackers(ev, events if source is None else source)
    k = F.col("_k")
    name = F.when(k > 1, F.concat_ws("_", "session_id", k.cast("string"))).otherwise(F.col("session_id"))
    return ev.withColumn("session_id", name).drop("_before", "_tracker", "_new", "_k")


def _continue_shared_trackers(ev: DataFrame, events: DataFrame) -> DataFrame:
    """A tracker id seen for several users goes on counting from user to user, in user id order."""
    owners = events.groupBy("session_id").agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))
    shared = owners.filter("lo < hi").select("session_id")
    if shared.isEmpty():
        return ev
    per_user = (
        ev.filter("_new = 1").join(shared, "session_id", "left_semi")
        .groupBy("session_id", "user_id").agg(F.sum("_new").alias("_n"))
        # user ids with the same beginning are neighbours, so the beginning is a chunk of the order
        .withColumn("_head", F.substring("user_id", 1, 6))
    )
    inside = Window.partitionBy("session_id", "_head").orderBy("user_id").rowsBetween(Window.unboundedPreceding, -1)
    heads = per_user.groupBy("session_id", "_head").agg(F.sum("_n").alias("_n"))
    across = Window.partitionBy("session_id").orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_user.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(heads.select("session_id", "_head", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_out")),
              ["session_id", "_head"])
        .select("session_id", "user_id", (F.col("_in") + F.col("_out")).alias("_offset"))
        .filter("_offset > 0")
    )
    joined = ev.join(offsets, ["session_id", "user_id"], "left")
    return joined.withColumn("_k", F.col("_k") + F.coalesce(F.col("_offset"), F.lit(0))).drop("_offset")


def _last(value: Column, where: Column) -> Column:
    return F.max_by(value, F.when(where, F.struct(*ORDER)))


def _first(value: Column, where: Column) -> Column:
    return F.min_by(value, F.when(where, F.struct(*ORDER)))


def primary_products(events: DataFrame) -> DataFrame:
    """Most frequent product per session, the first seen on ties."""
    at = F.struct(*ORDER)
    return (
        events.filter(F.col("product_id").isNotNull())
        .groupBy(*SESSION, "product_id").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at"))
        .groupBy(*SESSION)
        .agg(F.min_by("product_id", F.struct(-F.col("n"), F.col("at"))).alias("primary_product_id"))
    )


def session_table(events: DataFrame) -> DataFrame:
    """One row per session: context, funnel position, outcome and join keys."""
    name, page = F.col("event"), F.col("page")
    at = F.struct(*ORDER)
    body = name != "exit"
    step = position(vocab.STEPS, F.col("step"))
    always = F.lit(True)
    # all values of the first event, read once
    first = F.min_by(F.struct(
        F.col("timestamp"), F.col("page"), step.alias("step"), *[meta(k).alias(k) for k in vocab.CONTEXT_KEYS]), at)
    rows = events.groupBy(*SESSION).agg(
        first.alias("_first"),
        F.max("timestamp").alias("end"),
        F.count(F.lit(1)).alias("n_events"),
        F.bool_or(page.isin(*vocab.POST_PURCHASE_PAGES)).alias("_pp_page"),
        F.bool_or(name == "add_to_cart").alias("reached_cart"),
        F.bool_or(name == "checkout_start").alias("_checkout"),
        F.bool_or(name == "order_placed").alias("converted"),
        F.max(F.when(body & (step < len(vocab.SHOPPING_STEPS)), step)).alias("_furthest"),
        _last(F.struct(step.alias("step"), page.alias("page")), body).alias("_exit"),
        _last(name, always).alias("_last_event"),
        _last(F.struct(meta("gateway").alias("gateway"), meta("method").alias("method")),
              name == "payment_attempt").alias("_pay"),
        _last(meta("courier"), (name == "delivery_info_view") & meta("courier").isNotNull()).alias("courier"),
        _first(F.col("order_id"), F.col("order_id").isNotNull()).alias("order_id"),
        F.max(number(meta("cart_value"))).alias("_cart"),
    )
    post_purchase = F.col("_pp_page") & ~F.col("reached_cart") & ~F.col("_checkout")
    steps = F.array(*[F.lit(s) for s in vocab.STEPS])
    first_shopping = F.when(F.col("_first.step") < len(vocab.SHOPPING_STEPS), F.col("_first.step"))
    furthest = F.coalesce("_furthest", F.when(F.col("_exit").isNull(), first_shopping), F.lit(0))
    out = rows.select(
        "session_id", "user_id", F.col("_first.timestamp").alias("start"), "end",
        ((micros("end") - micros("_first.timestamp")) / 1e6).alias("duration_s"), "n_events",
        *[F.col(f"_first.{k}").alias(k) for k in vocab.CONTEXT_KEYS],
        F.when(post_purchase, "post_purchase").otherwise("shopping").alias("session_kind"),
        F.when(post_purchase, "post_purchase").otherwise(F.get(steps, furthest)).alias("furthest_step"),
        F.get(steps, F.coalesce("_exit.step", "_first.step")).alias("exit_step"),
        F.coalesce("_exit.page", "_first.page").alias("exit_page"),
        "reached_cart", "converted", (F.col("_last_event") == "exit").alias("has_exit_event"),
        F.col("_pay.gateway").alias("gateway"), F.col("_pay.method").alias("payment_method"), "courier", "order_id",
        F.coalesce("_cart", F.lit(0.0)).alias("cart_value"),
        (F.col("reached_cart") & ~F.col("converted")).alias("abandoned"),
    )
    return out.join(primary_products(events), list(SESSION), "left")


def with_returning(sessions: DataFrame) -> DataFrame:
    """is_returning: not the user's first session, or logged in at the start.

    The first session per user is an aggregate, so a user with very many sessions needs no long window.
    """
    first = sessions.groupBy("user_id").agg(F.min(F.struct("start", "session_id")).alias("_first"))
    later = F.struct("start", "session_id") > F.col("_first")
    return (
        sessions.join(first, "user_id", "left")
        .withColumn("is_returning", F.coalesce(later, F.lit(False)) | truthy(F.col("is_logged_in")))
        .drop("_first")
    )


def timeline(events: DataFrame) -> DataFrame:
    """Events of each session with their place in it. Rows instead of one list per session: sessions are unbounded."""
    return ordered(events, SESSION, total={"idx": F.lit(1)}).drop(CHUNK)


def journeys(events: DataFrame, steps: int = 25) -> DataFrame:
    """First steps of each session after collapsing repeats, as readable labels."""
    ev = ordered(events, SESSION, prior={"_before": F.col("event")})
    ev = ev.filter(F.col("_before").isNull() | (F.col("_before") != F.col("event")))
    ev = ordered(ev, SESSION, total={"_i": F.lit(1)}).filter(F.col("_i") <= steps)
    label = F.replace("event", F.lit("_"), F.lit(" "))
    listed = F.array_sort(F.collect_list(F.struct("_i", label.alias("label"))))
    return ev.groupBy(*SESSION).agg(F.transform(listed, lambda s: s["label"]).alias("journey"))


def rage_clicks(clicks: DataFrame, window_ms: int = 2000, needed: int = 4) -> DataFrame:
    """One row per burst: the moment a session clicked one element for the `needed`-th time within the window.

    `clicks`: session_id, element, timestamp. Counts per millisecond come first, so copies shrink before the window.
    """
    at = F.unix_millis("timestamp")
    key = ["session_id", "element"]
    per_ms = clicks.groupBy(*key, at.alias("ms")).agg(F.count(F.lit(1)).alias("n"))
    # the window is short, so a time slice plus the rows just before it is all a slice needs
    width = max(600_000, 4 * window_ms)
    own, next_ = F.floor(F.col("ms") / width), F.floor((F.col("ms") + window_ms) / width)
    slices = per_ms.select("*", F.explode(F.array_distinct(F.array(own, next_))).alias("slice"))
    w = Window.partitionBy(*key, "slice").orderBy("ms")
    trailing = F.sum("n").over(w.rangeBetween(-(window_ms - 1), 0))
    first = F.min("ms").over(w.rangeBetween(-(window_ms - 1), 0))
    hits = slices.withColumn("clicks", trailing).withColumn("first_ms", first)
    hits = hits.filter(F.col("slice") == own)
    # the count passes `needed` at this millisecond
    return (
        hits.filter((F.col("clicks") >= needed) & (F.col("clicks") - F.col("n") < needed))
        .select(*key, F.timestamp_millis("ms").alias("timestamp"), F.lit(needed).alias("clicks"),
                (F.col("ms") - F.col("first_ms")).alias("window_ms"))
    )


__all__ = ["SESSION", "journeys", "primary_products", "rage_clicks", "session_table", "sessionize",
           "timeline", "with_returning"]
