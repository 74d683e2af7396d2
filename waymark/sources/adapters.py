"""The benchmark tables seen as clickstream, payments and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.vocab import EVENTS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The same text runs on Spark and, for the checks, on DuckDB.
EVENTS_SQL = """
WITH raw AS (
  SELECT event_id AS seq, ts, user_id AS uid, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS int) AS k
  FROM events
), named AS (
  SELECT *, CASE
    WHEN event_type = 'view'  AND k % 4 = 0 THEN 'page_view'
    WHEN event_type = 'view'  AND k % 4 = 1 THEN 'size_chart_open'
    WHEN event_type = 'view'                THEN 'product_view'
    WHEN event_type = 'click' AND k % 8 = 0 THEN 'add_to_cart'
    WHEN event_type = 'click' AND k % 8 = 1 THEN 'checkout_start'
    WHEN event_type = 'click' AND k % 8 = 2 THEN 'payment_attempt'
    WHEN event_type = 'click' AND k % 8 = 3 THEN 'search'
    WHEN event_type = 'click' AND k % 8 = 4 THEN 'pincode_check'
    WHEN event_type = 'click' AND k % 8 = 5 THEN 'delivery_info_view'
    WHEN event_type = 'click' AND k % 8 = 6 THEN 'total_shown'
    WHEN event_type = 'click'               THEN 'rec_impression'
    WHEN event_type = 'error' AND k % 4 = 0 THEN 'js_error'
    WHEN event_type = 'error' AND k % 4 = 1 THEN 'payment_failed'
    WHEN event_type = 'error' AND k % 4 = 2 THEN 'coupon_failed'
    WHEN event_type = 'error'               THEN 'otp_resend'
    WHEN event_type = 'signup' AND k % 10 = 9 THEN 'not_in_vocabulary'
    WHEN event_type = 'signup' AND k % 5 = 0  THEN 'exit'
    WHEN event_type = 'signup'                THEN 'login_success'
    WHEN event_type = 'purchase' AND k % 3 = 1 THEN 'tracking_view'
    ELSE 'order_placed' END AS event
  FROM raw
)
SELECT seq, ts AS timestamp,
  concat('u_', CAST(uid AS string)) AS user_id,
  concat('s_', CAST(uid AS string), '_', substring(CAST(CAST(ts AS date) AS string), 1, 9)) AS session_id,
  event,
  CASE WHEN event IN ('product_view','size_chart_open','add_to_cart','pincode_check') THEN 'product'
       WHEN event = 'checkout_start' THEN 'cart'
       WHEN event = 'search' THEN 'search'
       WHEN event = 'delivery_info_view' THEN 'checkout_delivery'
       WHEN event IN ('total_shown','coupon_failed') THEN 'checkout_summary'
       WHEN event IN ('otp_resend','login_success') THEN 'checkout_login'
       WHEN event IN ('payment_attempt','payment_failed','order_placed','js_error') THEN 'checkout_payment'
       WHEN event = 'tracking_view' THEN 'order_tracking'
       ELSE 'home' END AS page,
  CASE WHEN event IN ('product_view','size_chart_open','add_to_cart')
       THEN concat('p_', CAST(k % 20 AS string)) END AS product_id,
  CASE WHEN event IN ('order_placed','tracking_view') THEN concat('o_', CAST(k AS string)) END AS order_id,
  CASE WHEN event IN ('add_to_cart','checkout_start') THEN value END AS cart_value,
  CASE WHEN event IN ('pincode_check','delivery_info_view') THEN k % 12 END AS eta_days,
  CASE WHEN event = 'delivery_info_view' THEN concat('courier_', CAST(uid % 2 AS string)) END AS courier,
  CASE WHEN event IN ('payment_attempt','payment_failed')
       THEN substring('ABC', CAST(uid % 3 AS int) + 1, 1) END AS gateway,
  CASE WHEN event = 'payment_attempt' THEN CASE WHEN k % 3 = 0 THEN 'UPI' ELSE 'card' END END AS method,
  CASE WHEN event = 'page_view' THEN CASE uid % 4 WHEN 0 THEN 'mobile_web' WHEN 1 THEN 'android_app'
       WHEN 2 THEN 'ios_app' ELSE 'desktop' END END AS device
FROM named
"""

# Events of every name with every metadata field. A user's number gives the user a theme, from which most of their events come,
# so that also rules about several events of one kind are met. The same text runs on Spark and on DuckDB.
BEHAVIOUR_THEMES = [
    ["product_view", "product_view", "product_view", "size_chart_open", "spec_open", "review_open"],
    ["payment_attempt", "payment_failed", "payment_failed", "payment_attempt", "order_placed", "payment_success"],
    ["coupon_apply", "coupon_failed", "coupon_failed", "coupon_applied", "total_shown", "cart_view"],
    ["login_wall", "otp_sent", "otp_resend", "otp_resend", "otp_failed", "login_success"],
    ["rage_click", "rage_click", "js_error", "slow_load", "dead_click", "dead_click"],
    ["pincode_check", "pincode_check", "delivery_info_view", "delivery_info_view", "checkout_start", "cart_view"],
    ["search", "search_zero_results", "search_zero_results", "rec_click", "rec_click", "product_view"],
    ["size_unavailable_click", "size_unavailable_click", "notify_me", "remove_from_cart", "add_to_cart", "product_view"],
    ["tracking_view", "tracking_view", "return_initiated", "order_cancelled", "help_view", "chat_open"],
    ["page_view", "exit", "rec_impression", "rec_impression", "rec_impression", "add_to_cart"],
]
_THEME_CASE = " ".join(
    f"WHEN theme = {t} AND pick = {i} THEN '{name}'" for t, names in enumerate(BEHAVIOUR_THEMES) for i, name in enumerate(names))
_ANY_CASE = " ".join(f"WHEN any_pick = {i} THEN '{name}'" for i, name in enumerate(EVENTS))
BEHAVIOUR_SQL = f"""
WITH raw AS (
  SELECT event_id AS seq, ts, user_id AS uid, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events
), numbered AS (
  SELECT *, CASE WHEN k % 5 < 3 THEN CAST(uid % 10 AS int) ELSE -1 END AS theme, CAST((seq * 31 + k) % 6 AS int) AS pick,
    CAST((seq * 17 + k) % {len(EVENTS)} AS int) AS any_pick, CAST((seq * 13 + k * 7) % 60 AS int) AS v FROM raw
), named AS (
  SELECT *, CASE {_THEME_CASE} {_ANY_CASE} END AS event FROM numbered
)
SELECT seq, ts AS timestamp, concat('u_', CAST(uid AS string)) AS user_id,
  concat('b_', CAST(uid AS string), '_', substring(CAST(CAST(ts AS date) AS string), 1, 9)) AS session_id, event,
  CASE WHEN event IN ('product_view','size_chart_open','spec_open','review_open','size_unavailable_click','notify_me','add_to_cart') THEN 'product'
       WHEN event IN ('search','search_zero_results') THEN 'search'
       WHEN event IN ('cart_view','remove_from_cart','checkout_start') THEN 'cart'
       WHEN event IN ('login_wall','otp_sent','otp_resend','otp_failed','login_success') THEN 'checkout_login'
       WHEN event = 'pincode_check' THEN 'checkout_address'
       WHEN event = 'delivery_info_view' THEN 'checkout_delivery'
       WHEN event IN ('total_shown','coupon_apply','coupon_failed','coupon_applied') THEN 'checkout_summary'
       WHEN event IN ('payment_attempt','payment_failed','payment_success') THEN 'checkout_payment'
       WHEN event = 'order_placed' THEN 'order_confirmation'
       WHEN event = 'tracking_view' THEN 'order_tracking'
       WHEN event IN ('return_initiated','order_cancelled') THEN 'returns'
       WHEN event IN ('help_view','chat_open') THEN 'help'
       WHEN event IN ('rage_click','dead_click','js_error','slow_load') AND v % 3 = 0 THEN 'checkout_payment'
       WHEN event IN ('rage_click','dead_click','js_error','slow_load') AND v % 3 = 1 THEN 'cart'
       WHEN v % 2 = 0 THEN 'category' ELSE 'home' END AS page,
  CASE WHEN event IN ('product_view','size_chart_open','add_to_cart','return_initiated','remove_from_cart') THEN concat('p_', CAST(v % 3 AS string)) END AS product_id,
  CASE WHEN event IN ('order_placed','tracking_view','return_initiated') THEN concat('o_', CAST(k AS string)) END AS order_id,
  CASE WHEN event = 'page_view' THEN CASE v % 5 WHEN 0 THEN 'mobile_web' WHEN 1 THEN 'android_app' WHEN 2 THEN 'ios_app' WHEN 3 THEN 'desktop' ELSE 'smart_tv' END END AS device,
  CASE WHEN event = 'page_view' AND v % 5 IN (1, 2) THEN concat('7.', CAST(v % 3 AS string)) END AS app_version,
  CASE WHEN event = 'page_view' THEN concat('city_', CAST(v % 4 AS string)) END AS city,
  CASE WHEN event = 'page_view' AND v % 4 < 3 THEN concat('tier_', CAST(v % 4 + 1 AS string)) END AS city_tier,
  CASE WHEN event = 'page_view' THEN CASE v % 7 WHEN 0 THEN 'direct' WHEN 1 THEN 'organic_search' WHEN 2 THEN 'paid_ads' WHEN 3 THEN 'social' WHEN 4 THEN 'email'
       WHEN 5 THEN 'push' ELSE 'unknown' END END AS source,
  CASE WHEN event = 'page_view' THEN CASE WHEN v % 3 = 0 THEN 'true' ELSE 'false' END END AS is_logged_in,
  CASE WHEN event = 'size_chart_open' THEN CASE WHEN v % 3 = 0 THEN 'false' ELSE 'true' END END AS available,
  CASE WHEN event = 'product_view' THEN CASE WHEN v < 30 THEN 'false' ELSE 'true' END END AS in_stock,
  CASE WHEN event = 'review_open' AND v % 4 > 0 THEN CAST(v % 9 AS string) END AS review_page,
  CASE WHEN event IN ('pincode_check','delivery_info_view') THEN CAST(v % 12 AS string) END AS eta_days,
  CASE WHEN event IN ('pincode_check','delivery_info_view') THEN CAST(v % 80 AS string) END AS delivery_fee,
  CASE WHEN event = 'delivery_info_view' THEN CASE WHEN v % 4 = 0 THEN 'true' ELSE 'false' END END AS fee_first_shown,
  CASE WHEN event = 'delivery_info_view' THEN concat('courier_', CAST(uid % 2 AS string)) END AS courier,
  CASE WHEN event IN ('payment_attempt','payment_failed') THEN substring('ABC', CAST(uid % 3 AS int) + 1, 1) END AS gateway,
  CASE WHEN event = 'payment_attempt' THEN CASE WHEN v % 3 = 0 THEN 'UPI' ELSE 'card' END END AS method,
  CASE WHEN event = 'payment_failed' THEN CASE WHEN v % 4 = 0 THEN 'gateway_timeout' ELSE 'declined' END END AS error,
  CASE WHEN event = 'payment_failed' THEN CASE WHEN v % 3 = 0 THEN 'true' ELSE 'false' END END AS debited,
  CASE WHEN event = 'slow_load' THEN CAST(v * 150 AS string) END AS load_ms,
  CASE WHEN event = 'js_error' THEN CASE WHEN v % 3 = 0 THEN 'true' ELSE 'false' END END AS fatal,
  CASE WHEN event = 'remove_from_cart' THEN CASE WHEN v % 2 = 0 THEN 'out_of_stock' ELSE 'changed_mind' END
       WHEN event = 'return_initiated' THEN CASE v % 7 WHEN 0 THEN 'not_as_described' WHEN 1 THEN 'size_mismatch' WHEN 2 THEN 'colour_different' WHEN 3 THEN 'damaged'
       WHEN 4 THEN 'defective' WHEN 5 THEN 'poor_quality' ELSE 'changed_mind' END END AS reason,
  CASE WHEN event = 'tracking_view' THEN CASE WHEN v % 5 = 0 THEN 'pending' ELSE 'none' END END AS refund_status,
  CASE WHEN event = 'tracking_view' THEN CASE WHEN v % 4 = 1 THEN 'delayed' ELSE 'in_transit' END END AS status,
  CASE WHEN event = 'tracking_view' THEN CAST(v * 2 AS string) END AS last_update_hours,
  CASE WHEN event = 'total_shown' THEN CAST(v * 10 AS string) END AS subtotal,
  CASE WHEN event = 'total_shown' THEN CAST(v - 20 AS string) END AS delta_pct,
  CASE WHEN event = 'total_shown' AND v % 3 = 0 THEN CAST(v % 30 AS string) END AS packaging_fee,
  CASE WHEN event = 'total_shown' AND v % 4 = 0 THEN '15' END AS gift_wrap,
  CASE WHEN event = 'total_shown' AND v % 5 = 0 THEN 'free of charge' END AS note,
  CASE WHEN event = 'total_shown' THEN CASE WHEN v % 3 = 1 THEN 'COD' ELSE 'UPI' END END AS payment_method,
  CASE WHEN event IN ('add_to_cart','checkout_start','cart_view') THEN value END AS cart_value
FROM named
"""
BEHAVIOUR_META = [
    "device", "app_version", "city", "city_tier", "source", "is_logged_in", "available", "in_stock", "review_page", "eta_days", "delivery_fee", "fee_first_shown",
    "courier", "gateway", "method", "error", "debited", "load_ms", "fatal", "reason", "refund_status", "status", "last_update_hours", "subtotal", "delta_pct",
    "packaging_fee", "gift_wrap", "note", "payment_method", "cart_value",
]

PAYMENTS_SQL = """
SELECT concat(CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string), '-', CAST(l_partkey AS string))
         AS payment_id,
  concat('s_', CAST(l_orderkey AS string)) AS session_id,
  l_shipdate AS timestamp,
  concat('G', CAST(l_suppkey % 5 AS string)) AS gateway,
  l_extendedprice AS amount,
  CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status,
  l_linestatus = 'F' AS amount_debited
FROM lineitem
"""

ORDERS_SQL = """
SELECT concat('o_', CAST(o_orderkey AS string)) AS order_id,
  concat('s_', CAST(o_orderkey AS string)) AS session_id,
  concat('u_', CAST(o_custkey AS string)) AS user_id,
  o_orderdate AS placed_at, o_totalprice AS order_value,
  n_name AS city, o_orderpriority AS courier,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'in_transit' ELSE 'delayed' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 3 END AS delay_days
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

_META = ["cart_value", "eta_days", "courier", "gateway", "method", "device"]


def clickstream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw events in the canonical schema, optional fields folded into the metadata map."""
    return _raw_events(spark, folder, EVENTS_SQL, _META)


def behaviour(spark: SparkSession, folder: str) -> DataFrame:
    """Raw events of every name, with every metadata field."""
    return _raw_events(spark, folder, BEHAVIOUR_SQL, BEHAVIOUR_META)


def _raw_events(spark: SparkSession, folder: str, sql: str, fields: list[str]) -> DataFrame:
    flat = spark.sql(sql.replace("FROM events", "FROM {events}"), events=table(spark, folder, "events"))
    pairs = [x for k in fields for x in (F.lit(k), F.col(k).cast("string"))]
    metadata = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    # Filters on names and pages stay above an explode. Pushed below, they would repeat all cases of an event, each with its regular
    # expression, for all cases of a page, in every row.
    named = F.explode(F.array(F.struct("event", "page"))).alias("_named")
    flat = flat.select(*[c for c in flat.columns if c not in ("event", "page")], metadata.alias("metadata"), named).select("*", "_named.*")
    return flat.withColumn("timestamp", F.col("timestamp").cast("timestamp")).select(
        "seq", "timestamp", "user_id", "session_id", "event", "page", "product_id", "order_id", "metadata")


def payments(spark: SparkSession, folder: str) -> DataFrame:
    out = spark.sql(PAYMENTS_SQL.replace("FROM lineitem", "FROM {lineitem}"),
                    lineitem=table(spark, folder, "lineitem"))
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    sql = (ORDERS_SQL.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}")
           .replace("JOIN nation", "JOIN {nation}"))
    out = spark.sql(sql, **{n: table(spark, folder, n) for n in ("orders", "customer", "nation")})
    return out.withColumn("placed_at", F.col("placed_at").cast("timestamp"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as customer texts; the language stands for the theme label."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("text_id"), "text", F.col("lang").alias("language"),
        F.col("lang").alias("theme_label"), "source")


def chats(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with the user turns joined in turn order."""
    turns = table(spark, folder, "conversations").filter("role = 'user'")
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(
        F.concat_ws(" ", F.transform(said, lambda t: t["text"])).alias("customer_text"))
