"""Joins of payments, orders and feedback onto sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import vocab


def sparse_left_join(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join on a column that is often null.

    Null keys match nothing but would all be shuffled to one task, so each gets a key of its own instead.
    """
    own = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col(spread_by)))
    return left.withColumn("_key", own).join(right.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def payment_totals(payments: DataFrame) -> DataFrame:
    failed_debited = (F.col("status") == "failed") & F.col("amount_debited")
    return payments.filter("session_id IS NOT NULL").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_payment_records"),
        F.count_if(failed_debited).alias("failed_debited_payments"),
        F.count_distinct("gateway").alias("n_gateways"),
    )


def join_session_data(sessions: DataFrame, payments: DataFrame, orders: DataFrame, tickets: DataFrame,
                      reviews: DataFrame) -> DataFrame:
    """One row per session with payment, order and feedback numbers, 0 where nothing joins."""
    counts = tickets.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_tickets"))
    rated = reviews.filter("session_id IS NOT NULL").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.min("rating").alias("min_review_rating"))
    joined = (
        sessions.select("session_id", "order_id")
        .join(payment_totals(payments), "session_id", "left")
        .join(counts, "session_id", "left")
        .join(rated, "session_id", "left")
    )
    looked_up = orders.select("order_id", "delay_days", "status", "refund_status")
    joined = sparse_left_join(joined, looked_up, "order_id", "session_id")
    delayed = (F.col("status") == "delayed") | (F.coalesce("delay_days", F.lit(0)) > 0)
    values = {
        "order_delay_days": F.col("delay_days"), "order_is_delayed": delayed.cast("int"),
        "order_refund_pending": (F.col("refund_status") == "pending").cast("int"),
        "order_return_requested": F.col("status").isin("return_requested", "returned").cast("int"),
    }

    def value(name: str) -> Column:
        return F.coalesce(values.get(name, F.col(name)).cast("double"), F.lit(0.0)).alias(name)

    return joined.select("session_id", *[value(c) for c in vocab.JOIN_COLUMNS])


TEXT_COLUMNS = ["source", "text_id", "session_id", "user_id", "order_id", "product_id", "ts", "text", "language",
                "theme_label"]


def session_texts(tickets: DataFrame, chats: DataFrame, reviews: DataFrame) -> DataFrame:
    """All customer texts in one shape."""
    def shape(df: DataFrame, source: str, **renames: str) -> DataFrame:
        out = df.withColumnsRenamed(renames).withColumn("source", F.lit(source))
        none = {c: F.lit(None).cast("string") for c in TEXT_COLUMNS if c not in out.columns}
        return (out.withColumns(none) if none else out).select(*TEXT_COLUMNS)

    return (
        shape(tickets, "ticket", ticket_id="text_id", created_at="ts")
        .unionByName(shape(chats.drop("text"), "chat", chat_id="text_id", started_at="ts", customer_text="text"))
        .unionByName(shape(reviews, "review", review_id="text_id", created_at="ts"))
    )


def risk_frame(prefixes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Prefixes of shopping sessions; label 1 = the session did not convert."""
    kept = sessions.filter("session_kind = 'shopping'").select("user_id", "session_id", "converted")
    return prefixes.join(kept, ["user_id", "session_id"]).withColumn("label", (~F.col("converted")).cast("double"))


def first_visits(events: DataFrame) -> DataFrame:
    """Order -> the post-purchase session about it (the smallest session id when there are several)."""
    return (
        events.filter(F.col("page").isin(*vocab.POST_PURCHASE_PAGES) & F.col("order_id").isNotNull())
        .groupBy("order_id").agg(F.min("session_id").alias("visit_session_id"))
    )


def size_chart_outcomes(events: DataFrame) -> DataFrame:
    """(session, product) pairs with an opened size chart; `added` tells whether the same product went to the cart.

    One aggregation answers the semi / anti question: both events sit on the same (session, product) key.
    """
    opened = F.col("event") == "size_chart_open"
    return (
        events.filter(F.col("event").isin("size_chart_open", "add_to_cart") & F.col("product_id").isNotNull())
        .groupBy("session_id", "product_id")
        .agg(F.min(F.when(opened, F.col("timestamp"))).alias("ts"), F.bool_or(~opened).alias("added"))
        .filter("ts IS NOT NULL")
    )
