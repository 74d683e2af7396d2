"""DuckDB SQL with the same results as the queries in `checks`, written independently of the Spark plans."""

from __future__ import annotations

from waymark import vocab
from waymark.plans import checks
from waymark.sources.adapters import BEHAVIOUR_SQL, EVENTS_SQL, ORDERS_SQL, PAYMENTS_SQL

ORACLE: dict[str, str] = {}
REPLY_LIMIT = 700  # characters of a reply draft


def _case(expr: str, values: dict, quote: bool = True) -> str:
    q = (lambda v: f"'{v}'") if quote else str
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in values.items()) + " END"


STEP_IDX = {s: i for i, s in enumerate(vocab.STEPS)}
STEP_NAME = "[" + ",".join(f"'{s}'" for s in vocab.STEPS) + "]"
LANGS = "['en','fr','de','es']"


def segments(gap: int, source: str = EVENTS_SQL) -> str:
    """CTEs up to `s`: sessionized events with idx (place in the session) and us (microseconds)."""
    return f"""
ev AS ({source}),
cl AS (SELECT *, {_case('page', vocab.PAGE_STEP)} AS step FROM ev WHERE event <> 'not_in_vocabulary'),
s1 AS (SELECT *, lag(timestamp) OVER w AS pt, lag(session_id) OVER w AS ps FROM cl
       WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, seq)),
s2 AS (SELECT *, CASE WHEN pt IS NULL OR timestamp - pt > INTERVAL {gap} MINUTE OR session_id <> ps THEN 1 ELSE 0 END AS nw FROM s1),
s3 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY timestamp, seq) AS segno FROM s2),
s4 AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY user_id, segno) AS k FROM s3),
s5 AS (SELECT * EXCLUDE (session_id, pt, ps, nw, segno, k), CASE WHEN k > 1 THEN session_id || '_' || k ELSE session_id END AS session_id,
       epoch_us(timestamp) AS us, {_case('step', STEP_IDX, False)} AS step_idx FROM s4),
s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, seq) AS idx FROM s5)"""


TABLE = f"""
t0 AS (SELECT session_id, any_value(user_id) AS user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events,
  max(CASE WHEN idx = 1 THEN device END) AS device, bool_or(page IN ('order_tracking', 'returns')) AS pp,
  bool_or(event = 'add_to_cart') AS reached_cart, bool_or(event = 'checkout_start') AS co, bool_or(event = 'order_placed') AS converted,
  max(CASE WHEN event <> 'exit' AND step_idx < 6 THEN step_idx END) AS furthest,
  arg_max(step, CASE WHEN event <> 'exit' THEN idx END) AS xstep, arg_max(page, CASE WHEN event <> 'exit' THEN idx END) AS xpage,
  arg_min(step, idx) AS fstep, arg_min(page, idx) AS fpage, arg_max(event, idx) AS last_event,
  arg_max(gateway, CASE WHEN event = 'payment_attempt' THEN idx END) AS gateway,
  arg_max(method, CASE WHEN event = 'payment_attempt' THEN idx END) AS payment_method,
  arg_max(courier, CASE WHEN event = 'delivery_info_view' THEN idx END) AS courier,
  arg_min(order_id, CASE WHEN order_id IS NOT NULL THEN idx END) AS order_id, coalesce(max(cart_value), 0.0) AS cart_value
  FROM s GROUP BY session_id),
t AS (SELECT *, CASE WHEN pp AND NOT reached_cart AND NOT co THEN 'post_purchase' ELSE 'shopping' END AS session_kind,
  CASE WHEN pp AND NOT reached_cart AND NOT co THEN 'post_purchase' ELSE {STEP_NAME}[coalesce(furthest, 0) + 1] END AS furthest_step,
  coalesce(xstep, fstep) AS exit_step, coalesce(xpage, fpage) AS exit_page, reached_cart AND NOT converted AS abandoned,
  last_event = 'exit' AS has_exit_event, 'city_' || right(user_id, 1) AS city FROM t0)"""

COUNTS = ",\n  ".join(f"CAST(count(*) FILTER (event = '{e}') AS BIGINT) AS {c}" for c, e in vocab.COUNTERS.items())
GROUP_CASE = "CASE " + " ".join(
    f"WHEN e IN ({','.join(repr(x) for x in es)}) THEN '{g}'" for g, es in vocab.EXIT_GROUPS.items()) + " ELSE '' END"
FEATURES = f"""
fl AS (SELECT *, lead(us) OVER (PARTITION BY session_id ORDER BY idx) - us AS delta FROM s),
fb AS (SELECT *, lag(page) OVER w AS ppage FROM s WHERE event <> 'exit' WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
fv AS (SELECT session_id, product_id AS p0, lag(product_id, 1) OVER w AS p1, lag(product_id, 2) OVER w AS p2 FROM s
       WHERE event = 'product_view' AND product_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
fm AS (SELECT session_id, method AS m0, lag(method) OVER (PARTITION BY session_id ORDER BY idx) AS m1 FROM s WHERE event = 'payment_attempt'),
f1 AS (SELECT session_id, {COUNTS},
  greatest(count(*) FILTER (event <> 'exit'), 1) AS n_body, count(*) AS n_all, max(us) - min(us) AS duration_us, min(us) AS start_us,
  CASE WHEN arg_max(event, idx) = 'exit' AND count(*) > 1 THEN max(us) - coalesce(max(us) FILTER (event <> 'exit'), min(us)) ELSE 0 END AS exit_dwell_us,
  coalesce(max(step_idx) FILTER (event <> 'exit'), arg_min(step_idx, idx)) AS furthest_step_idx,
  coalesce(arg_max(step_idx, CASE WHEN event <> 'exit' THEN idx END), arg_min(step_idx, idx)) AS current_step_idx,
  coalesce(arg_max(event, CASE WHEN event <> 'exit' THEN idx END), 'exit') AS e,
  coalesce(max(eta_days), 0) AS max_eta_days, coalesce(max(cart_value) FILTER (event <> 'exit'), 0.0) AS cart_value,
  max(CASE WHEN idx = 1 AND event = 'page_view' THEN device END) AS device,
  bool_or(event <> 'exit' AND page IN ('order_tracking', 'returns')) AS pp FROM s GROUP BY session_id),
f2 AS (SELECT session_id, coalesce(max(delta), 0) AS max_gap_us, {", ".join(
    f"CAST(coalesce(sum(delta) FILTER (step = '{x}'), 0) AS BIGINT) AS dwell_{x}_us" for x in vocab.STEPS)} FROM fl GROUP BY session_id),
f3 AS (SELECT session_id, count(DISTINCT p0) AS unique_products, count(*) FILTER (p0 = p2 AND p0 <> p1) AS pdp_loops FROM fv GROUP BY session_id),
f4 AS (SELECT session_id, count(*) FILTER (page = 'cart' AND ppage LIKE 'checkout%') AS checkout_cart_loops FROM fb GROUP BY session_id),
f5 AS (SELECT session_id, count(*) FILTER (m0 <> m1) AS method_switches FROM fm GROUP BY session_id),
f AS (SELECT f1.*, f2.* EXCLUDE session_id, coalesce(unique_products, 0) AS unique_products, coalesce(pdp_loops, 0) AS pdp_loops,
  coalesce(checkout_cart_loops, 0) AS checkout_cart_loops, coalesce(method_switches, 0) AS method_switches, {GROUP_CASE} AS grp
  FROM f1 JOIN f2 USING (session_id) LEFT JOIN f3 USING (session_id) LEFT JOIN f4 USING (session_id) LEFT JOIN f5 USING (session_id))"""

# rules that can fire on these tables; the others need fields the tables do not have
_RULE_SQL = []
for _name, _friction, _pred, _ in vocab.RULES:
    _p = _pred
    for _g in vocab.EXIT_GROUPS:
        _p = _p.replace(f"{_g} = 1", f"grp = '{_g}'")
    if any(x in _p for x in ("failed_debited", "rage_clicks_checkout", "max_load_ms", "max_extra_fees", "info_mismatch", "fee_first",
                             "oos_", "refund_pending", "delayed_status", "quality_returns")):
        continue
    _RULE_SQL.append((_name, _friction, _p))
FLAGS = "concat_ws('|', " + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, _, p in _RULE_SQL) + ")"
FLAG_FRICTIONS = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{fr}' END" for _, fr, p in _RULE_SQL) + "], lambda x: x IS NOT NULL))"


def exact_rounding(sql: str) -> str:
    """Round the printed number instead of the binary one, so that 1.275 becomes 1.28 as it does in Spark."""
    out, i = [], 0
    while (start := sql.find("round(", i)) >= 0:
        end, depth = start + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        value, digits = sql[start + 6:end - 1].rsplit(",", 1)
        out.append(f"{sql[i:start]}CAST(round(CAST(CAST(CAST({exact_rounding(value)} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)),{digits}) AS DOUBLE)")
        i = end
    return "".join(out) + sql[i:]


def q(name: str, ctes: str, select: str) -> None:
    ORACLE[name] = exact_rounding((f"WITH {ctes.strip()}\n{select}" if ctes else select).strip())


S720, S2880 = segments(720), segments(2880)
F720, F2880 = f"{S720},{FEATURES}", f"{S2880},{FEATURES}"
T720 = f"{S720},{TABLE}"

# --- cleaning ----------------------------------------------------------------------------------------------
q("dedup_events", f"ev AS ({EVENTS_SQL})", "SELECT event, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM ev GROUP BY event")
q("clean_vocab", S720, "SELECT event, page, step, count(*) AS n, count(product_id) AS products FROM cl GROUP BY ALL")
q("metadata_redact", "", "SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, 'true' AS ok, CAST(2 AS BIGINT) AS n_keys, count(*) AS n FROM events GROUP BY ALL")
q("hash_users", "", "SELECT CAST(user_id AS VARCHAR) AS user_id, 'u_' || substr(sha256('live:' || CAST(user_id AS VARCHAR)), 1, 12) AS hashed, count(*) AS n FROM events GROUP BY ALL")
q("live_validation", f"ev AS ({EVENTS_SQL})", "SELECT CASE WHEN event = 'not_in_vocabulary' THEN 'event' ELSE 'accepted' END AS verdict, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY ALL")

# --- sessions ----------------------------------------------------------------------------------------------
q("sessionize", S720, "SELECT user_id, session_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY ALL")
q("session_table", T720, """SELECT session_id, user_id, start_us, end_us, n_events, coalesce(device, '-') AS device, coalesce(gateway, '-') AS gateway,
  coalesce(payment_method, '-') AS payment_method, coalesce(courier, '-') AS courier, coalesce(order_id, '-') AS order_id, session_kind, furthest_step,
  exit_step, exit_page, reached_cart, converted, abandoned, has_exit_event, round(cart_value, 2) AS cart_value FROM t""")
q("returning_flag", T720, "SELECT session_id, row_number() OVER (PARTITION BY user_id ORDER BY start_us, session_id) > 1 AS is_returning FROM t")
q("primary_product", S2880, """, p AS (SELECT session_id, product_id, count(*) AS n, min(idx) AS i FROM s WHERE product_id IS NOT NULL GROUP BY ALL)
SELECT session_id, product_id AS primary_product_id FROM p QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, i) = 1""")
q("ordered_events", S720, "SELECT session_id, idx, event, seq FROM s")
q("collapsed_journeys", S2880, """, j1 AS (SELECT *, lag(event) OVER (PARTITION BY session_id ORDER BY idx) AS pe FROM s),
j2 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS i FROM j1 WHERE pe IS NULL OR pe <> event)
SELECT session_id, string_agg(replace(event, '_', ' '), '|' ORDER BY i) AS journey FROM j2 WHERE i <= 25 GROUP BY session_id""")
q("rage_clicks", """c AS (SELECT 'u_' || user_id AS session_id, event_type AS element, epoch_us(ts) // 1000 AS ms, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT *, sum(n) OVER x AS total, min(ms) OVER x AS first_ms FROM c WINDOW x AS (PARTITION BY session_id, element ORDER BY ms RANGE BETWEEN 28799999 PRECEDING AND CURRENT ROW))""",
  "SELECT session_id, element, ms AS at_ms, CAST(4 AS BIGINT) AS clicks, ms - first_ms AS window_ms FROM w WHERE total >= 4 AND total - n < 4")

# --- features ----------------------------------------------------------------------------------------------
q("event_counts", F2880, "SELECT session_id, " + ", ".join(vocab.COUNTERS) + " FROM f")
q("dwell_by_step", F2880, "SELECT session_id, CAST(n_body AS BIGINT) AS n_events, duration_us, max_gap_us, exit_dwell_us, " + ", ".join(f"dwell_{x}_us" for x in vocab.STEPS) + " FROM f")
q("loops", F2880, "SELECT session_id, unique_products, pdp_loops, checkout_cart_loops, method_switches FROM f")
q("metadata_features", F2880, """SELECT session_id, CAST(max_eta_days AS DOUBLE) AS max_eta_days, round(cart_value, 4) AS cart_value, 0.0::DOUBLE AS max_extra_fees,
  0.0::DOUBLE AS max_review_page, 0.0::DOUBLE AS payment_timeouts, 0.0::DOUBLE AS size_chart_unavailable FROM f""")
q("exit_after", F2880, "SELECT session_id, CAST(furthest_step_idx AS BIGINT) AS furthest_step_idx, CAST(current_step_idx AS BIGINT) AS current_step_idx, "
  + ", ".join(f"CAST(grp = '{g}' AS BIGINT) AS {g}" for g in vocab.EXIT_GROUPS) + " FROM f")
q("context_features", F2880, """SELECT session_id, CAST(CASE device WHEN 'mobile_web' THEN 0 WHEN 'android_app' THEN 1 WHEN 'ios_app' THEN 2 WHEN 'desktop' THEN 3 ELSE -1 END AS BIGINT) AS device_code,
  CAST(coalesce(device = 'android_app', false) AS BIGINT) AS is_android_app, CAST(0 AS BIGINT) AS city_tier_num, CAST(-1 AS BIGINT) AS source_code, CAST(0 AS BIGINT) AS logged_in_at_start,
  hour(make_timestamp(start_us)) AS hour, CAST(isodow(make_timestamp(start_us)) >= 6 AS BIGINT) AS is_weekend,
  CAST(pp AND add_to_carts = 0 AND checkout_starts = 0 AS BIGINT) AS is_post_purchase FROM f""")
_BASE = "bl AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS step, coalesce(avg(ln(1 + dwell_{x}_us / 1e6)) FILTER (dwell_{x}_us > 0), 0) AS mean, coalesce(stddev_samp(ln(1 + dwell_{x}_us / 1e6)) FILTER (dwell_{x}_us > 0), 1) AS std FROM f"
    for x in vocab.STEPS) + ")"
q("dwell_baseline", f"{F2880}, {_BASE}", "SELECT step, round(mean, 6) AS mean, round(std, 6) AS std FROM bl")
_Z = {x: f"CASE WHEN dwell_{x}_us > 0 THEN (ln(1 + dwell_{x}_us / 1e6) - (SELECT mean FROM bl WHERE step = '{x}')) / greatest((SELECT std FROM bl WHERE step = '{x}'), 1e-6) ELSE 0 END" for x in vocab.STEPS}
q("dwell_z", f"{F2880}, {_BASE}, z AS (SELECT session_id, " + ", ".join(f"{e} AS z_{x}" for x, e in _Z.items()) + " FROM f)",
  "SELECT session_id, " + ", ".join(f"round(z_{x}, 4) AS dwell_z_{x}" for x in vocab.STEPS) + ", round(greatest(" + ", ".join(f"z_{x}" for x in vocab.STEPS) + "), 4) AS max_dwell_z FROM z")
PREFIX = f"""{S2880},
o1 AS (SELECT *, sum(CASE WHEN event IN ('payment_success', 'order_placed') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS oc FROM s WHERE event <> 'exit'),
o2 AS (SELECT * EXCLUDE idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS i FROM o1 WHERE oc = 0),
o3 AS (SELECT *, lead(step) OVER w AS nstep, max(i) OVER (PARTITION BY session_id) AS len FROM o2 WINDOW w AS (PARTITION BY session_id ORDER BY i)),
cuts AS (SELECT session_id, i AS prefix_len, us AS end_us, i = len AS is_final FROM o3 WHERE nstep IS NULL OR nstep <> step
         QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i DESC) <= 8)"""
q("prefix_cuts", PREFIX, "SELECT * FROM cuts")
_DW = ", ".join(f"CAST(coalesce(sum(delta) FILTER (step = '{x}' AND i < prefix_len), 0) AS BIGINT) AS dwell_{x}_us" for x in vocab.STEPS)
q("prefix_features", f"""{PREFIX},
g0 AS (SELECT c.session_id, c.prefix_len, e.* EXCLUDE session_id, e.i FROM cuts c JOIN o3 e ON e.session_id = c.session_id AND e.i <= c.prefix_len),
gd AS (SELECT session_id, i, lead(us) OVER (PARTITION BY session_id ORDER BY i) - us AS delta FROM o3),
gv AS (SELECT session_id, prefix_len, product_id AS p0, lag(product_id, 1) OVER w AS p1, lag(product_id, 2) OVER w AS p2 FROM g0 WHERE event = 'product_view' AND product_id IS NOT NULL
       WINDOW w AS (PARTITION BY session_id, prefix_len ORDER BY i)),
gv2 AS (SELECT session_id, prefix_len, count(DISTINCT p0) AS unique_products, count(*) FILTER (p0 = p2 AND p0 <> p1) AS pdp_loops FROM gv GROUP BY ALL),
gp AS (SELECT session_id, prefix_len, page, lag(page) OVER (PARTITION BY session_id, prefix_len ORDER BY i) AS pp FROM g0),
gp2 AS (SELECT session_id, prefix_len, count(*) FILTER (page = 'cart' AND pp LIKE 'checkout%') AS checkout_cart_loops FROM gp GROUP BY ALL),
gm AS (SELECT session_id, prefix_len, method, lag(method) OVER (PARTITION BY session_id, prefix_len ORDER BY i) AS pm FROM g0 WHERE event = 'payment_attempt'),
gm2 AS (SELECT session_id, prefix_len, count(*) FILTER (method <> pm) AS method_switches FROM gm GROUP BY ALL),
ga AS (SELECT session_id, prefix_len, max(us) - min(us) AS duration_us, coalesce(max(delta) FILTER (i < prefix_len), 0) AS max_gap_us, {_DW}, count(*) AS n_events,
  max(step_idx)::BIGINT AS furthest_step_idx, arg_max(step_idx, i)::BIGINT AS current_step_idx, count(*) FILTER (event = 'product_view') AS product_views,
  count(*) FILTER (event = 'size_chart_open') AS size_chart_opens, count(*) FILTER (event = 'search') AS searches, count(*) FILTER (event = 'payment_failed') AS payment_failures,
  count(*) FILTER (event = 'js_error') AS js_errors, round(coalesce(max(cart_value), 0.0), 4) AS cart_value, coalesce(max(eta_days), 0)::DOUBLE AS max_eta_days
  FROM g0 JOIN gd USING (session_id, i) GROUP BY ALL)""",
  """SELECT ga.*, coalesce(unique_products, 0) AS unique_products, coalesce(pdp_loops, 0) AS pdp_loops, checkout_cart_loops, coalesce(method_switches, 0) AS method_switches
FROM ga LEFT JOIN gv2 USING (session_id, prefix_len) JOIN gp2 USING (session_id, prefix_len) LEFT JOIN gm2 USING (session_id, prefix_len)""")

# --- every event name, every metadata field ------------------------------------------------------------------
# features and rules of the stream that has them all, written out by hand
BEHAVIOUR = f"""{segments(2880, BEHAVIOUR_SQL)},
nx AS (SELECT *, lead(us) OVER (PARTITION BY session_id ORDER BY idx) - us AS delta FROM s),
bp AS (SELECT session_id, page, lag(page) OVER (PARTITION BY session_id ORDER BY idx) AS ppage FROM s WHERE event <> 'exit'),
pv AS (SELECT session_id, product_id AS p0, lag(product_id, 1) OVER w AS p1, lag(product_id, 2) OVER w AS p2 FROM s
       WHERE event = 'product_view' AND product_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
pm AS (SELECT session_id, method AS m0, lag(method) OVER (PARTITION BY session_id ORDER BY idx) AS m1 FROM s WHERE event = 'payment_attempt'),
a1 AS (SELECT session_id, any_value(user_id) AS user_id, greatest(count(*) FILTER (event <> 'exit'), 1) AS n_events, (max(us) - min(us)) / 1e6 AS duration_s,
  CASE WHEN arg_max(event, idx) = 'exit' AND count(*) > 1 THEN (max(us) - coalesce(max(us) FILTER (event <> 'exit'), min(us))) / 1e6 ELSE 0 END AS exit_dwell_s,
  coalesce(max(step_idx) FILTER (event <> 'exit'), arg_min(step_idx, idx)) AS furthest_step_idx,
  coalesce(arg_max(step_idx, CASE WHEN event <> 'exit' THEN idx END), arg_min(step_idx, idx)) AS current_step_idx,
  coalesce(arg_max(event, CASE WHEN event <> 'exit' THEN idx END), 'exit') AS e,
  count(*) FILTER (event = 'product_view') AS product_views, count(*) FILTER (event = 'size_chart_open') AS size_chart_opens, count(*) FILTER (event = 'spec_open') AS spec_opens,
  count(*) FILTER (event = 'review_open') AS review_opens, count(*) FILTER (event = 'pincode_check') AS pincode_checks, count(*) FILTER (event = 'delivery_info_view') AS delivery_info_views,
  count(*) FILTER (event = 'search') AS searches, count(*) FILTER (event = 'search_zero_results') AS zero_result_searches, count(*) FILTER (event = 'rec_impression') AS rec_impressions,
  count(*) FILTER (event = 'rec_click') AS rec_clicks, count(*) FILTER (event = 'payment_attempt') AS payment_attempts, count(*) FILTER (event = 'payment_failed') AS payment_failures,
  count(*) FILTER (event = 'coupon_apply') AS coupon_attempts, count(*) FILTER (event = 'coupon_failed') AS coupon_failures, count(*) FILTER (event = 'coupon_applied') AS coupons_applied,
  count(*) FILTER (event = 'login_wall') AS login_walls, count(*) FILTER (event = 'otp_sent') AS otp_sends, count(*) FILTER (event = 'otp_resend') AS otp_resends,
  count(*) FILTER (event = 'otp_failed') AS otp_failures, count(*) FILTER (event = 'login_success') AS login_successes, count(*) FILTER (event = 'rage_click') AS rage_clicks,
  count(*) FILTER (event = 'dead_click') AS dead_clicks, count(*) FILTER (event = 'js_error') AS js_errors, count(*) FILTER (event = 'slow_load') AS slow_loads,
  count(*) FILTER (event = 'size_unavailable_click') AS size_unavailable_clicks, count(*) FILTER (event = 'notify_me') AS notify_me, count(*) FILTER (event = 'remove_from_cart') AS cart_removals,
  count(*) FILTER (event = 'add_to_cart') AS add_to_carts, count(*) FILTER (event = 'total_shown') AS total_shown_count, count(*) FILTER (event = 'chat_open') AS chat_opens,
  count(*) FILTER (event = 'help_view') AS help_views, count(*) FILTER (event = 'tracking_view') AS tracking_views, count(*) FILTER (event = 'return_initiated') AS returns_initiated,
  count(*) FILTER (event = 'order_cancelled') AS orders_cancelled, count(*) FILTER (event = 'checkout_start') AS checkout_starts,
  count(*) FILTER (event = 'size_chart_open' AND available = 'false') AS size_chart_unavailable,
  coalesce(max(CASE WHEN event = 'review_open' THEN coalesce(CAST(review_page AS DOUBLE), 1) END), 0) AS max_review_page, coalesce(max(CAST(eta_days AS DOUBLE)), 0) AS max_eta_days,
  coalesce(max(CAST(delivery_fee AS DOUBLE)), 0) AS max_delivery_fee, CAST(coalesce(bool_or(fee_first_shown = 'true'), false) AS INT) AS fee_first_shown,
  count(*) FILTER (event = 'product_view' AND in_stock = 'false') AS oos_product_views, count(*) FILTER (error LIKE '%timeout%') AS payment_timeouts,
  count(*) FILTER (event = 'rage_click' AND page LIKE 'checkout%') AS rage_clicks_checkout, coalesce(max(CAST(load_ms AS DOUBLE)), 0) AS max_load_ms,
  count(*) FILTER (fatal = 'true') AS fatal_errors, count(*) FILTER (event = 'remove_from_cart' AND reason = 'out_of_stock') AS oos_removals, coalesce(max(cart_value), 0) AS cart_value,
  greatest(coalesce(max(CAST(delta_pct AS DOUBLE)), 0), 0) AS max_total_delta_pct,
  coalesce(max(coalesce(CAST(packaging_fee AS DOUBLE), 0) + coalesce(CAST(gift_wrap AS DOUBLE), 0)) FILTER (event = 'total_shown'), 0) AS max_extra_fees,
  CAST(coalesce(bool_or(payment_method = 'COD'), false) AS INT) AS cod_selected, count(*) FILTER (refund_status = 'pending') AS refund_pending_views,
  count(*) FILTER (status = 'delayed') AS delayed_status_views, coalesce(max(CAST(last_update_hours AS DOUBLE)), 0) AS max_last_update_hours,
  count(*) FILTER (event = 'return_initiated' AND reason IN ('not_as_described', 'size_mismatch', 'colour_different')) AS info_mismatch_returns,
  count(*) FILTER (event = 'return_initiated' AND reason IN ('damaged', 'defective', 'poor_quality')) AS quality_returns,
  arg_min(event, idx) AS first_event, min(device) FILTER (idx = 1) AS device, min(city_tier) FILTER (idx = 1) AS tier, min(source) FILTER (idx = 1) AS src,
  min(is_logged_in) FILTER (idx = 1) AS logged, min(city) FILTER (idx = 1) AS city, min(app_version) FILTER (idx = 1) AS app_version, min(us) AS start_us,
  CASE WHEN count(*) FILTER (event <> 'exit') > 0 THEN bool_or(event <> 'exit' AND page IN ('order_tracking', 'returns')) ELSE bool_or(idx = 1 AND page IN ('order_tracking', 'returns')) END AS pp,
  count(*) FILTER (event = 'payment_failed' AND debited = 'true') AS failed_debited_payments, bool_or(event = 'order_placed') AS converted
  FROM s GROUP BY session_id),
a2 AS (SELECT session_id, coalesce(max(delta), 0) / 1e6 AS max_gap_s, {", ".join(f"coalesce(sum(delta) FILTER (step = '{x}'), 0) / 1e6 AS dwell_{x}_s" for x in vocab.STEPS)} FROM nx GROUP BY 1),
a3 AS (SELECT session_id, count(DISTINCT p0) AS unique_products, count(*) FILTER (p0 = p2 AND p0 <> p1) AS pdp_loops FROM pv GROUP BY 1),
a4 AS (SELECT session_id, count(*) FILTER (page = 'cart' AND ppage LIKE 'checkout%') AS checkout_cart_loops FROM bp GROUP BY 1),
a5 AS (SELECT session_id, count(*) FILTER (m0 <> m1) AS method_switches FROM pm GROUP BY 1),
b AS (SELECT a1.*, a2.* EXCLUDE session_id, coalesce(unique_products, 0) AS unique_products, coalesce(pdp_loops, 0) AS pdp_loops, coalesce(checkout_cart_loops, 0) AS checkout_cart_loops,
  coalesce(method_switches, 0) AS method_switches, {", ".join(f"CAST(e IN ({','.join(repr(x) for x in es)}) AS INT) AS {g}" for g, es in vocab.EXIT_GROUPS.items())},
  CASE device WHEN 'mobile_web' THEN 0 WHEN 'android_app' THEN 1 WHEN 'ios_app' THEN 2 WHEN 'desktop' THEN 3 ELSE -1 END AS device_code, CAST(coalesce(device = 'android_app', false) AS INT) AS is_android_app,
  CASE tier WHEN 'tier_1' THEN 1 WHEN 'tier_2' THEN 2 WHEN 'tier_3' THEN 3 ELSE 0 END AS city_tier_num,
  CASE src WHEN 'direct' THEN 0 WHEN 'organic_search' THEN 1 WHEN 'paid_ads' THEN 2 WHEN 'social' THEN 3 WHEN 'email' THEN 4 WHEN 'push' THEN 5 ELSE -1 END AS source_code,
  CAST(coalesce(logged = 'true', false) AS INT) AS logged_in_at_start, hour(make_timestamp(start_us)) AS hour, CAST(isodow(make_timestamp(start_us)) >= 6 AS INT) AS is_weekend,
  CAST(pp AND add_to_carts = 0 AND checkout_starts = 0 AS INT) AS is_post_purchase
  FROM a1 JOIN a2 USING (session_id) LEFT JOIN a3 USING (session_id) LEFT JOIN a4 USING (session_id) LEFT JOIN a5 USING (session_id))"""
RULE_PREDICATES = """
payment_retry_x2: payment_failures >= 2
money_deducted_failed_payment: failed_debited_payments >= 1
exit_after_payment_failure: e = 'payment_failed'
coupon_retry_x2: coupon_failures >= 2
exit_after_coupon_failure: e = 'coupon_failed'
otp_resend_x2: otp_resends >= 2
otp_failed: otp_failures > 0
exit_at_login_wall: e IN ('login_wall', 'otp_sent', 'otp_resend', 'otp_failed') AND login_successes = 0
rage_click_checkout: rage_clicks_checkout > 0
js_error: js_errors > 0
slow_load_x2: slow_loads >= 2 OR max_load_ms >= 6000
dead_click_x3: dead_clicks >= 3
rage_click_x2: rage_clicks >= 2
exit_after_total_shown: e = 'total_shown'
checkout_cart_loop: checkout_cart_loops > 0 AND total_shown_count > 0
hidden_fees_shown: max_extra_fees > 0
size_chart_x3: size_chart_opens >= 3
spec_open_x3: spec_opens >= 3
pdp_compare_loop_x2: pdp_loops >= 2
review_scan_x3: review_opens >= 3
return_not_as_described: info_mismatch_returns > 0
pincode_check_x3: pincode_checks >= 3
long_eta_exit: max_eta_days >= 7 AND e IN ('delivery_info_view', 'pincode_check')
exit_after_delivery_info: e IN ('delivery_info_view', 'pincode_check')
delivery_fee_revealed_late: fee_first_shown > 0
zero_result_search_x2: zero_result_searches >= 2
search_reformulation_x3: searches + zero_result_searches >= 3
recs_ignored_x4: rec_impressions >= 4 AND rec_clicks = 0
oos_recs_clicked: oos_product_views >= 2 AND rec_clicks >= 2
size_unavailable_x2: size_unavailable_clicks >= 2
notify_me_clicked: notify_me > 0
cart_item_oos_removed: oos_removals > 0
tracking_view_x3: tracking_views >= 3
order_cancelled: orders_cancelled > 0
refund_pending_check: refund_pending_views > 0
delayed_order_viewed: delayed_status_views > 0
return_quality_issue: quality_returns > 0
"""
_HITS = [line.split(": ", 1) for line in RULE_PREDICATES.strip().splitlines()]
q("behaviour_features", BEHAVIOUR, "SELECT session_id, " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in [*vocab.BEHAVIOUR_COLUMNS, *vocab.CONTEXT_COLUMNS]) + " FROM b")
q("rule_hits", BEHAVIOUR, " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER ({p}) AS sessions, count(*) FILTER ({p}) > 0 AS fires FROM b" for name, p in _HITS))
q("feature_coverage", BEHAVIOUR, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER ({c} > 0) AS sessions FROM b" for c in [*vocab.BEHAVIOUR_COLUMNS, *vocab.CONTEXT_COLUMNS]))
q("typed_fees", BEHAVIOUR, """SELECT session_id, round(CAST(coalesce(max(seq * 13 % 60 + CAST(seq * 13 % 60 % 2 = 0 AS INT) + CASE WHEN seq * 13 % 60 % 3 = 0 THEN seq * 13 % 60 / 4 ELSE 0 END) FILTER (event = 'total_shown'), 0) AS DOUBLE), 4) AS max_extra_fees
FROM s GROUP BY 1""")
q("session_context", BEHAVIOUR, """SELECT session_id, coalesce(device, '-') AS device, coalesce(app_version, '-') AS app_version, coalesce(city, '-') AS city, coalesce(tier, '-') AS city_tier,
  coalesce(src, '-') AS source, coalesce(logged, '-') AS is_logged_in,
  row_number() OVER (PARTITION BY user_id ORDER BY start_us, session_id) > 1 OR coalesce(logged = 'true', false) AS is_returning FROM b""")
q("custom_rules", BEHAVIOUR, """SELECT session_id, concat_ws('|', CASE WHEN chat_opens + help_views >= 2 THEN 'asked_for_help' END, CASE WHEN cod_selected = 1 AND converted THEN 'cod_buyer' END) AS flags FROM b""")

# --- joins -------------------------------------------------------------------------------------------------
ORD = f"od AS ({ORDERS_SQL})"
PAY = f"py AS ({PAYMENTS_SQL})"
q("session_joins", f"""{ORD}, {PAY},
b AS (SELECT 's_' || o_orderkey AS session_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'o_' || o_orderkey END AS order_id FROM orders),
p AS (SELECT session_id, count(*) AS np, count(*) FILTER (status = 'failed' AND amount_debited) AS nf, count(DISTINCT gateway) AS ng FROM py GROUP BY 1),
k AS (SELECT 's_' || (doc_id % 200) AS session_id, count(*) AS nt FROM documents GROUP BY 1),
r AS (SELECT 's_' || (doc_id % 150) AS session_id, count(*) AS nr, min(quality * 3 + toxic + 1) AS mr FROM labels GROUP BY 1)""",
  """SELECT b.session_id, coalesce(np, 0) AS n_payment_records, coalesce(nf, 0) AS failed_debited_payments, coalesce(ng, 0) AS n_gateways, coalesce(nt, 0) AS n_tickets,
  coalesce(nr, 0) AS n_reviews, CAST(coalesce(mr, 0) AS BIGINT) AS min_review_rating, CAST(coalesce(delay_days, 0) AS BIGINT) AS order_delay_days,
  CAST(coalesce(status = 'delayed' OR delay_days > 0, false) AS BIGINT) AS order_is_delayed, CAST(coalesce(delay_days = 3, false) AS BIGINT) AS order_refund_pending,
  CAST(0 AS BIGINT) AS order_return_requested
FROM b LEFT JOIN p USING (session_id) LEFT JOIN k USING (session_id) LEFT JOIN r USING (session_id) LEFT JOIN od ON od.order_id = b.order_id""")
q("text_union", """x AS (SELECT 'ticket' AS source, lang AS language, length(text) AS n FROM documents
UNION ALL SELECT 'review', lang, length(text) FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'chat', '-', length(string_agg(text, ' ')) FROM conversations WHERE role = 'user' GROUP BY conv_id)""",
  "SELECT source, language, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS with_session FROM x GROUP BY 1, 2")
q("risk_frame", f"{PREFIX},{TABLE}", """SELECT CASE WHEN converted THEN 0.0 ELSE 1.0 END::DOUBLE AS label, count(*) AS prefixes, CAST(sum(prefix_len) AS BIGINT) AS events
FROM cuts JOIN t USING (session_id) WHERE session_kind = 'shopping' GROUP BY 1""")
q("first_visit_lookup", f"{S720}, {ORD}, v AS (SELECT order_id, min(session_id) AS vs FROM s WHERE page IN ('order_tracking', 'returns') AND order_id IS NOT NULL GROUP BY 1)",
  """SELECT courier || '|' || city AS segment, delay_days >= 2 AS bad, count(*) AS n, min(coalesce(vs, session_id)) AS first_session, max(coalesce(vs, session_id)) AS last_session
FROM od LEFT JOIN v USING (order_id) GROUP BY 1, 2""")
q("added_or_not", S2880, """SELECT session_id, product_id, min(us) FILTER (event = 'size_chart_open') AS ts_us, bool_or(event = 'add_to_cart') AS added FROM s
WHERE event IN ('size_chart_open', 'add_to_cart') AND product_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (event = 'size_chart_open') > 0""")

# --- rules -------------------------------------------------------------------------------------------------
q("rules_flags", F2880, f"SELECT session_id, {FLAGS} AS flags FROM f")
q("rule_friction_counts", f"{F2880}, r AS (SELECT unnest({FLAG_FRICTIONS}) AS friction FROM f)", "SELECT friction, count(*) AS sessions FROM r GROUP BY 1")

# --- anomalies ---------------------------------------------------------------------------------------------
OVERLAY = f"""{PAY},
ov AS (SELECT * REPLACE (CASE WHEN gateway = 'G1' AND timestamp BETWEEN TIMESTAMP '1998-06-01 00:00:00' AND TIMESTAMP '1998-06-14 23:59:59' THEN 'failed' ELSE status END AS status) FROM py),
un AS (SELECT timestamp AS ts, gateway AS segment, status = 'failed' AS bad, session_id, false AS converted, amount AS value FROM ov)"""


def temporal(widths: list[int], baseline: int, min_count: int, z: float, ratio: float, slug: str, kind: str = "gateway") -> str:
    """CTEs from `un` (units) to `an` (measured anomalies) and `mb` (their sessions)."""
    grain = min(widths)
    parts = []
    for w in widths:
        span = max(baseline // w, 2) * w
        parts.append(f"""
b{w} AS (SELECT segment, m_at // {w} * {w} AS m_at, sum(n) AS n, sum(bad) AS bad FROM bins GROUP BY ALL),
h{w} AS (SELECT *, sum(n) OVER x AS nb, sum(bad) OVER x AS bb, min(m_at) OVER (PARTITION BY segment) AS f FROM b{w}
  WINDOW x AS (PARTITION BY segment ORDER BY m_at RANGE BETWEEN {span} PRECEDING AND 1 PRECEDING)),
w{w} AS (SELECT segment, m_at AS start, m_at + {w} AS stop, n, bad, nb, bb FROM h{w} WHERE nb > 0 AND (m_at - f) / {w} >= greatest({span // w} // 4, 1) AND bad >= {min_count}
  AND ((bad / n - least(greatest(bb / nb, 1e-3), 0.999)) / sqrt(least(greatest(bb / nb, 1e-3), 0.999) * (1 - least(greatest(bb / nb, 1e-3), 0.999)) / n) > {z} OR (bad / n) / greatest(bb / nb, 1e-3) >= {ratio}))""")
    union = " UNION ALL ".join(f"SELECT * FROM w{w}" for w in widths)
    return f"""
bins AS (SELECT segment, epoch_us(ts) // 60000000 // {grain} * {grain} AS m_at, count(*) AS n, count(*) FILTER (bad) AS bad,
  sum(CASE WHEN bad AND NOT converted THEN CAST(value AS DECIMAL(28, 4)) ELSE 0 END) AS lost FROM un WHERE segment IS NOT NULL GROUP BY ALL),{",".join(parts)},
fw AS ({union}),
i1 AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY segment ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM fw),
i2 AS (SELECT *, sum(nw) OVER (PARTITION BY segment ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl FROM i1),
iv AS (SELECT segment, min(start) AS start, max(stop) AS stop FROM i2 GROUP BY segment, isl),
ms AS (SELECT i.segment, i.start, i.stop, sum(n) FILTER (m_at >= i.start) AS n, sum(bad) FILTER (m_at >= i.start) AS bad, sum(lost) FILTER (m_at >= i.start) AS lost,
  sum(n) FILTER (m_at < i.start) AS nb, sum(bad) FILTER (m_at < i.start) AS bb FROM iv i JOIN bins b ON b.segment = i.segment AND m_at >= i.start - {baseline} AND m_at < i.stop GROUP BY ALL),
m0 AS (SELECT *, bad / n AS p, coalesce(bb / nb, (SELECT sum(bad) / sum(n) FROM bins g WHERE g.segment = ms.segment)) AS p0 FROM ms),
m1 AS (SELECT *, least(greatest(p0, 1e-3), 0.999) AS pc, 'agg_{kind}-' || trim(regexp_replace(lower(segment), '[^a-z0-9]+', '-', 'g'), '-') || '-{slug}_' || strftime(make_timestamp(CAST(start AS BIGINT) * 60000000), '%Y%m%d%H%M') AS packet_id FROM m0),
mb AS (SELECT DISTINCT packet_id, session_id FROM un JOIN m1 ON un.segment = m1.segment AND epoch_us(ts) // 60000000 >= start AND epoch_us(ts) // 60000000 < stop WHERE un.bad AND session_id IS NOT NULL),
an AS (SELECT packet_id, segment AS segment_value, round(p, 4) AS observed, round(p0, 4) AS baseline, round((p - pc) / sqrt(pc * (1 - pc) / n), 2) AS z_score,
  round(p / greatest(p0, 1e-3), 2) AS multiplier, (SELECT count(*) FROM mb WHERE mb.packet_id = m1.packet_id) AS affected_sessions, round(CAST(lost AS DOUBLE), 2) AS revenue_at_risk,
  CASE WHEN p >= 2 * p0 THEN 'rising' ELSE 'elevated' END AS trend, CAST(bad AS BIGINT) AS bad_units FROM m1)"""


SLUG = "payment-session-failure-rate"
DAILY = f"{OVERLAY},{temporal([1440], 86400, 5, 3, 2.5, SLUG)}"
STREAM_UNITS = f"""
un0 AS (SELECT session_id, gateway AS segment, min(timestamp) AS ts, bool_or(event = 'payment_failed') AS bad FROM s WHERE event IN ('payment_attempt', 'payment_failed') GROUP BY 1, 2),
un AS (SELECT ts, segment, bad, un0.session_id, converted, cart_value AS value FROM un0 JOIN t USING (session_id))"""
STREAM = f"{T720},{STREAM_UNITS},{temporal([1440], 14400, 3, 1.5, 2.0, SLUG)}"
q("gateway_units", PAY, "SELECT session_id, gateway AS segment, epoch_us(min(timestamp)) AS ts_us, bool_or(status = 'failed') AS bad FROM py GROUP BY 1, 2")
q("courier_eta_units", f"""{T720},
e1 AS (SELECT session_id, min(us) AS ts_us, arg_max(courier, idx) AS courier, max(eta_days) AS eta FROM s WHERE event = 'delivery_info_view' GROUP BY 1),
e2 AS (SELECT e1.*, e1.courier || '|' || city AS segment, converted, cart_value FROM e1 JOIN t USING (session_id)),
e3 AS (SELECT segment, median(eta) AS m FROM e2 GROUP BY 1)""",
  "SELECT session_id, segment, ts_us, eta >= m + 3 AS bad, converted, round(cart_value, 2) AS value FROM e2 JOIN e3 USING (segment)")
q("rate_bins", DAILY, "SELECT segment, m_at // 1440 AS day, n, bad, CAST(lost AS DOUBLE) AS lost FROM bins")
q("temporal_flags", DAILY, "SELECT segment, start // 1440 AS day, CAST(n AS BIGINT) AS n, CAST(bad AS BIGINT) AS bad, CAST(nb AS BIGINT) AS n_before, CAST(bb AS BIGINT) AS bad_before FROM fw")
q("merged_intervals", f"{OVERLAY},{temporal([1440], 86400, 3, 3, 2.5, SLUG)}", "SELECT segment, start // 1440 AS start, stop // 1440 AS stop FROM iv")
q("gateway_anomalies", DAILY, "SELECT * FROM an")
q("anomaly_members", DAILY, "SELECT * FROM mb")
q("anomaly_samples", DAILY, "SELECT packet_id, string_agg(session_id, '|' ORDER BY session_id) AS sample_sessions FROM (SELECT * FROM mb QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY session_id) <= 20) GROUP BY 1")
q("intraday_anomalies", f"{T720},{STREAM_UNITS},{temporal([360, 720, 1440], 14400, 3, 1.5, 2.0, SLUG)}",
  "SELECT packet_id, observed, baseline, z_score, affected_sessions, revenue_at_risk, trend FROM an")


def one_out(units: str) -> str:
    return f"""SELECT segment, n, bad, tn - n AS n_other, tb - bad AS bad_other, bad / n AS p, (tb - bad) / (tn - n) AS p0 FROM
(SELECT segment, count(*) AS n, count(*) FILTER (bad) AS bad FROM ({units}) WHERE segment IS NOT NULL GROUP BY 1),
(SELECT count(*) AS tn, count(*) FILTER (bad) AS tb FROM ({units}) WHERE segment IS NOT NULL) WHERE tn > n"""


DEV_UNITS = "SELECT device AS segment, session_id IN (SELECT session_id FROM s WHERE event = 'js_error') AS bad FROM t"
SIZE_UNITS = """SELECT product_id AS segment, NOT bool_or(event = 'add_to_cart') AS bad FROM s WHERE event IN ('size_chart_open', 'add_to_cart') AND product_id IS NOT NULL
GROUP BY session_id, product_id HAVING count(*) FILTER (event = 'size_chart_open') > 0"""
q("cross_sectional", f"{T720}, x AS (SELECT 'device' AS kind, * FROM ({one_out(DEV_UNITS)}) UNION ALL SELECT 'product', * FROM ({one_out(SIZE_UNITS)}))",
  """SELECT kind, segment, n, bad, round(p, 6) AS p, round(p0, 6) AS p0,
  round((p - least(greatest(p0, 1e-3), 0.999)) / sqrt(least(greatest(p0, 1e-3), 0.999) * (1 - least(greatest(p0, 1e-3), 0.999)) / n), 4) AS z FROM x""")
_TREES = "nd AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {n}, {lo}, {hi}, '{checks.WALKED[f] if f >= 0 else ''}', {th}, {v})" for _, t, n, lo, hi, f, th, v in checks.SMALL_TREES
                                                      if t >= 0) + ") AS v(tree, node, lo, hi, feature, threshold, value))"
_AT = "CASE p.feature " + " ".join(f"WHEN '{f}' THEN {f}" for f in checks.WALKED) + " END <= p.threshold"
q("attribution_walk", f"""RECURSIVE {BEHAVIOUR}, {_TREES},
wk AS (SELECT session_id, nd.tree, 0 AS node, '' AS feature, CAST(0 AS DOUBLE) AS gain FROM b, nd WHERE nd.node = 0
  UNION ALL SELECT w.session_id, w.tree, c.node, p.feature, CAST(c.value - p.value AS DOUBLE) FROM wk w JOIN nd p ON p.tree = w.tree AND p.node = w.node AND p.lo >= 0
  JOIN b ON b.session_id = w.session_id JOIN nd c ON c.tree = w.tree AND c.node = CASE WHEN {_AT} THEN p.lo ELSE p.hi END)""",
  "SELECT session_id, feature, round(sum(gain), 4) AS value FROM wk WHERE feature <> '' GROUP BY ALL HAVING sum(gain) > 0")
q("top_two_frictions", F720, "SELECT session_id, array_to_string(list_transform(list_sort([" + ", ".join(
    f"{{'p': -(((n_body * 7 + product_views * 11 + {i} * 13) % 100) / 100.0), 'i': {i}, 'f': '{f}'}}" for i, f in enumerate(vocab.FRICTIONS)) + "])[1:2], lambda x: x.f), '|') AS top FROM f")
q("features_with_joins", f"""{BEHAVIOUR}, od AS ({ORDERS_SQL}),
p AS (SELECT session_id, count(*) AS np, count(*) FILTER (event = 'payment_failed' AND debited = 'true') AS nf, count(DISTINCT gateway) AS ng FROM s WHERE event IN ('payment_attempt', 'payment_failed') GROUP BY 1),
k AS (SELECT 'b_' || (doc_id % 200) || '_2024-01-0' AS session_id, count(*) AS nt FROM documents GROUP BY 1),
r AS (SELECT 'b_' || (doc_id % 150) || '_2024-01-0' AS session_id, count(*) AS nr, min(quality * 3 + toxic + 1) AS mr FROM labels GROUP BY 1),
fo AS (SELECT session_id, arg_min(order_id, idx) AS order_id FROM s WHERE order_id IS NOT NULL GROUP BY 1)""",
  """SELECT b.session_id, coalesce(np, 0) AS n_payment_records, coalesce(nf, 0) AS failed_debited_payments, coalesce(ng, 0) AS n_gateways, coalesce(nt, 0) AS n_tickets, coalesce(nr, 0) AS n_reviews,
  CAST(coalesce(mr, 0) AS BIGINT) AS min_review_rating, CAST(coalesce(delay_days, 0) AS BIGINT) AS order_delay_days, CAST(coalesce(status = 'delayed' OR delay_days > 0, false) AS BIGINT) AS order_is_delayed,
  CAST(coalesce(delay_days = 3, false) AS BIGINT) AS order_refund_pending, CAST(0 AS BIGINT) AS order_return_requested, round(b.cart_value, 4) AS cart_value, CAST(n_events AS BIGINT) AS n_events
FROM b LEFT JOIN p USING (session_id) LEFT JOIN k USING (session_id) LEFT JOIN r USING (session_id) LEFT JOIN fo USING (session_id) LEFT JOIN od ON od.order_id = fo.order_id""")
CLAMPED = "least(greatest(p0, 1e-3), 0.999)"


def across(units: str, kind: str, slug: str, min_count: int, z: float, ratio: float) -> str:
    """Packets of the segments that are worse than all others; units: ts, segment, bad, session_id, converted, value."""
    return f"""WITH uu AS ({units}),
tt AS (SELECT segment, count(*) AS n, count(*) FILTER (bad) AS bad, sum(CASE WHEN bad AND NOT converted THEN CAST(value AS DECIMAL(28, 4)) ELSE 0 END) AS lost, min(ts) AS t0,
  count(DISTINCT session_id) FILTER (bad) AS touched FROM uu WHERE segment IS NOT NULL GROUP BY 1),
pp AS (SELECT *, bad / n AS p, ((SELECT sum(bad) FROM tt) - bad) / ((SELECT sum(n) FROM tt) - n) AS p0 FROM tt WHERE (SELECT sum(n) FROM tt) > n)
SELECT 'agg_{kind}-' || trim(regexp_replace(lower(segment), '[^a-z0-9]+', '-', 'g'), '-') || '-{slug}_' || strftime(t0, '%Y%m%d%H%M') AS packet_id, round(p, 4) AS observed, round(p0, 4) AS baseline,
  round((p - {CLAMPED}) / sqrt({CLAMPED} * (1 - {CLAMPED}) / n), 2) AS z_score, round(p / greatest(p0, 1e-3), 2) AS multiplier, touched AS affected_sessions,
  round(CAST(lost AS DOUBLE), 2) AS revenue_at_risk, 'persistent' AS trend, CAST(bad AS BIGINT) AS bad_units FROM pp
WHERE bad >= {min_count} AND ((p - {CLAMPED}) / sqrt({CLAMPED} * (1 - {CLAMPED}) / n) > {z} OR p / greatest(p0, 1e-3) >= {ratio})"""


def over_time(units: str, kind: str, slug: str, widths: list[int], baseline: int, min_count: int, z: float, ratio: float) -> str:
    return f"""WITH un AS ({units}),{temporal(widths, baseline, min_count, z, ratio, slug, kind)}
SELECT packet_id, observed, baseline, z_score, multiplier, affected_sessions, revenue_at_risk, trend, bad_units FROM an"""


ALL_UNITS = f"""{BEHAVIOUR},
bt AS (SELECT b.session_id, converted, cart_value, start_us, 'city_' || right(user_id, 1) AS town, device, app_version FROM b),
oq AS (SELECT o_orderkey AS k, 'o_' || o_orderkey AS order_id, 's_' || o_orderkey AS session_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (o_orderkey % 720) AS ts, o_orderpriority || '|' || n_name AS segment,
  o_totalprice AS value, o_orderkey % 720 >= 600 AND o_orderkey % 2 = 0 AND o_orderpriority = '1-URGENT' OR o_orderkey % 23 = 0 AS bad
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
vs AS (SELECT order_id, min(session_id) AS visit FROM s WHERE page IN ('order_tracking', 'returns') AND order_id IS NOT NULL GROUP BY 1),
eq AS (SELECT session_id, min(timestamp) AS ts, arg_max(courier, idx) AS courier, max(CAST(eta_days AS INT)) AS eta FROM s WHERE event = 'delivery_info_view' GROUP BY 1),
eu AS (SELECT eq.*, eq.courier || '|' || town AS segment, converted, cart_value FROM eq JOIN bt USING (session_id)),
u_gateway AS (SELECT ts, segment, bad, x.session_id, converted, cart_value AS value FROM (SELECT session_id, gateway AS segment, min(timestamp) AS ts, bool_or(event = 'payment_failed') AS bad FROM s
  WHERE event IN ('payment_attempt', 'payment_failed') GROUP BY 1, 2) x JOIN bt USING (session_id)),
u_eta AS (SELECT ts, segment, eta >= m + 3 AS bad, session_id, converted, cart_value AS value FROM eu JOIN (SELECT segment, median(eta) AS m FROM eu GROUP BY 1) USING (segment)),
u_delay AS (SELECT ts, segment, bad, coalesce(visit, oq.session_id) AS session_id, false AS converted, value FROM oq LEFT JOIN vs USING (order_id) WHERE ts >= (SELECT make_timestamp(min(start_us)) FROM bt)),
u_size AS (SELECT ts, segment, bad, session_id, converted, cart_value AS value FROM (SELECT session_id, product_id AS segment, min(timestamp) FILTER (event = 'size_chart_open') AS ts, NOT bool_or(event = 'add_to_cart') AS bad
  FROM s WHERE event IN ('size_chart_open', 'add_to_cart') AND product_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (event = 'size_chart_open') > 0) JOIN bt USING (session_id)),
u_feedback AS (SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * doc_id AS ts, 'p_' || (doc_id % 3) AS segment, quality = 0 OR doc_id % 3 = 1 AND doc_id % 2 = 0 AS bad, CAST(NULL AS VARCHAR) AS session_id, false AS converted, 0.0 AS value FROM labels
  UNION ALL SELECT timestamp, product_id, reason IN ('not_as_described', 'size_mismatch', 'colour_different'), s.session_id, converted, bt.cart_value FROM s JOIN bt USING (session_id) WHERE event = 'return_initiated'),
u_device AS (SELECT make_timestamp(start_us) AS ts, device || coalesce(' ' || app_version, '') AS segment, session_id IN (SELECT session_id FROM s WHERE event = 'js_error') AS bad, session_id, converted, cart_value AS value FROM bt)"""
_LOW = (3, 1.0, 1.2)
q("detect_anomalies", ALL_UNITS, " UNION ALL ".join(f"SELECT * FROM ({x})" for x in [
    over_time("SELECT * FROM u_gateway", "gateway", SLUG, [15, 30, 60], 2880, *_LOW),
    over_time("SELECT * FROM u_eta", "courier-city", "long-eta-share", [1440], 7 * 1440, *_LOW),
    over_time("SELECT * FROM u_delay", "courier-city", "delayed-order-share", [1440], 7 * 1440, *_LOW),
    across("SELECT * FROM u_size", "product", "size-chart-no-add-rate", *_LOW), across("SELECT * FROM u_feedback", "product", "negative-feedback-rate", *_LOW),
    across("SELECT * FROM u_device", "device", "error-session-rate", *_LOW)]))
q("anomalies_by_detector", ALL_UNITS, "SELECT detector, count(*) AS units, count(*) FILTER (bad) AS bad, count(DISTINCT segment) AS segments FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS detector, segment, bad FROM {u}" for m, u in [("payment_session_failure_rate", "u_gateway"), ("long_eta_share", "u_eta"), ("delayed_order_share", "u_delay"),
    ("size_chart_no_add_rate", "u_size"), ("negative_feedback_rate", "u_feedback"), ("error_session_rate", "u_device")]) + ") GROUP BY 1")
q("product_feedback", "", f"SELECT segment, n, bad, n_other, bad_other FROM ({one_out('SELECT concat(chr(112), chr(95), doc_id % 10) AS segment, quality = 0 AS bad FROM labels')})")
q("incident_overlap", f"""{DAILY},
ic AS (SELECT 'i_' || s_suppkey AS incident_id, 'G' || (s_suppkey % 5) AS g, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (s_suppkey * 20) AS st, TIMESTAMP '1995-03-01' + INTERVAL 1 DAY * (s_suppkey * 20) AS en FROM supplier)""",
  """SELECT incident_id, count(m1.packet_id) AS packets, count(m1.packet_id) > 0 AS detected FROM ic LEFT JOIN m1 ON m1.segment = g
AND make_timestamp(CAST(start AS BIGINT) * 60000000) < en AND make_timestamp(CAST(stop AS BIGINT) * 60000000) > st GROUP BY 1""")

_INCIDENTS = """inc AS (SELECT 'i_' || s_suppkey AS incident_id, s_suppkey % 3 AS kind, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (s_suppkey % 28) AS st, s_suppkey AS n FROM supplier),
seg AS (SELECT incident_id, kind, st, 'gateway' AS segment_type, 'a' AS segment FROM inc WHERE kind = 0 UNION ALL SELECT incident_id, kind, st, 'courier-city', 'courier-' || (n % 2) || '-city-' || (n % 10) FROM inc WHERE kind = 1
  UNION ALL SELECT incident_id, kind, st, 'courier-city', 'courier-' || (n % 2) || '-city-' || ((n + 5) % 10) FROM inc WHERE kind = 1 UNION ALL SELECT incident_id, kind, st, 'product', 'p-' || (n % 4) FROM inc WHERE kind = 2)"""


def _detected() -> str:
    """All packets of all detectors with their window: CTE `dt` (packet_id, stem, from_ts, to_ts), found by the id's beginning."""
    timed = lambda units, kind, slug, widths, base: (
        f"SELECT packet_id, regexp_replace(packet_id, '^agg_|-{slug}_[0-9]+$', '', 'g') AS stem, make_timestamp(CAST(start AS BIGINT) * 60000000) AS from_ts, make_timestamp(CAST(stop AS BIGINT) * 60000000) AS to_ts "
        f"FROM (WITH un AS (SELECT * FROM {units}),{temporal(widths, base, *_LOW, slug, kind)} SELECT * FROM m1)")
    whole = lambda units, kind, slug: (
        f"SELECT packet_id, regexp_replace(packet_id, '^agg_|-{slug}_[0-9]+$', '', 'g'), NULL, NULL FROM ({across(f'SELECT * FROM {units}', kind, slug, *_LOW)})")
    return "dt AS (" + " UNION ALL ".join([
        timed("u_gateway", "gateway", SLUG, [15, 30, 60], 2880), timed("u_eta", "courier-city", "long-eta-share", [1440], 7 * 1440), timed("u_delay", "courier-city", "delayed-order-share", [1440], 7 * 1440),
        whole("u_size", "product", "size-chart-no-add-rate"), whole("u_feedback", "product", "negative-feedback-rate"), whole("u_device", "device", "error-session-rate")]) + ")"


MATCHED = f"""{ALL_UNITS}, {_INCIDENTS}, {_detected()},
mt AS (SELECT DISTINCT incident_id, packet_id FROM seg JOIN dt ON dt.stem IN (seg.segment_type || '-' || seg.segment) AND (kind = 2 OR from_ts < st + INTERVAL 3 DAY AND to_ts > st))"""
q("incident_matches", MATCHED, "SELECT * FROM mt")
q("unmatched_anomalies", MATCHED, "SELECT packet_id FROM dt WHERE packet_id NOT IN (SELECT packet_id FROM mt)")
q("planted_products_flagged", MATCHED, """SELECT count(*) AS planted, count(*) FILTER (EXISTS (SELECT 1 FROM mt JOIN dt USING (packet_id) WHERE dt.stem = 'product-' || x.segment)) AS flagged
FROM (SELECT DISTINCT segment FROM seg WHERE kind = 2) x""")

# --- packets and decisions -----------------------------------------------------------------------------------
THEMES = list(vocab.THEME_FRICTIONS)
THEME_LIST = "[" + ",".join(f"'{x}'" for x in THEMES) + "]"
FRICTION_ROWS = "fr AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{f}', {vocab.FRICTION_STAGE[f]}, '{vocab.OWNER_TEAM[f]}')" for i, f in enumerate(vocab.FRICTIONS)) + ") AS v(place, friction, stage, team))"
THEME_ROWS = "tf AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{f}', {n})" for t, fs in vocab.THEME_FRICTIONS.items() for n, f in enumerate(fs)) + ") AS v(theme, friction, n))"
RULE_ROWS = "rf AS (SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', '{r[1]}')" for r in vocab.RULES) + ") AS v(flag, friction))"
PACKETS = f"""{STREAM},{FEATURES}, {ORD}, {FRICTION_ROWS}, {THEME_ROWS}, {RULE_ROWS},
sc AS (SELECT f.*, n_body AS n_ev, ((n_body * 17 + searches * 5) % 100) / 100.0 AS risk_score, {FLAGS} AS flags FROM f),
tx AS (SELECT 'o_' || (doc_id % 300) AS order_id, {THEME_LIST}[doc_id % {len(THEMES)} + 1] AS theme, min(doc_id) AS d FROM documents GROUP BY 1, 2),
th AS (SELECT session_id, list(theme ORDER BY d) AS themes FROM t JOIN tx USING (order_id) GROUP BY 1),
hc AS (SELECT session_id, arg_max(multiplier, z_score * 1000000) AS mult FROM (SELECT mb.session_id, an.* FROM mb JOIN an USING (packet_id)) GROUP BY 1),
pk0 AS (SELECT t.*, sc.risk_score, sc.flags, sc.n_ev, sc.product_views, sc.payment_failures, sc.searches, sc.js_errors, coalesce(themes, []) AS themes, mult,
  list_filter(coalesce(themes, []), lambda x: x <> 'other') AS real_themes FROM sc JOIN t USING (session_id) LEFT JOIN th USING (session_id) LEFT JOIN hc USING (session_id)),
pk AS (SELECT 'pk_' || pk0.session_id AS packet_id, pk0.*, order_value FROM pk0 LEFT JOIN od USING (order_id)
  WHERE flags <> '' OR len(real_themes) > 0 OR (risk_score >= 0.5 AND NOT converted))"""
# one row per packet and friction with everything that speaks for it
CAND = f"""{PACKETS},
c0 AS (SELECT packet_id, fr.*, ((n_ev * 7 + product_views * 11 + place * 13) % 100) / 100.0 AS prob,
  EXISTS (SELECT 1 FROM rf WHERE rf.friction = fr.friction AND list_contains(string_split(flags, '|'), rf.flag)) AS is_rule,
  (SELECT min(list_position(themes, tf.theme) * 10 + tf.n) FROM tf WHERE tf.friction = fr.friction AND list_contains(themes, tf.theme)) AS theme_at FROM pk, fr),
c1 AS (SELECT *, bool_or(is_rule) OVER w AS any_rule, bool_or(prob >= 0.6) OVER w AS any_model, bool_or(theme_at IS NOT NULL) OVER w AS any_theme FROM c0 WINDOW w AS (PARTITION BY packet_id)),
c2 AS (SELECT *, CASE WHEN any_rule THEN 'rules' WHEN any_model THEN 'classifier' WHEN any_theme THEN 'themes' ELSE 'weak_classifier' END AS src,
  CASE WHEN any_rule THEN CASE WHEN is_rule THEN 0 WHEN prob >= 0.6 THEN 1 WHEN theme_at IS NOT NULL THEN 2 ELSE 9 END
       WHEN any_model THEN CASE WHEN prob >= 0.6 THEN 0 WHEN theme_at IS NOT NULL THEN 2 ELSE 9 END
       WHEN any_theme THEN CASE WHEN theme_at IS NOT NULL THEN 0 ELSE 9 END ELSE 0 END AS tier FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY tier, CASE WHEN tier = 0 AND src = 'rules' THEN -stage ELSE 0 END,
  CASE WHEN tier = 2 THEN theme_at ELSE 0 END, CASE WHEN tier = 2 THEN 0 ELSE -prob END, place) AS r FROM c2 WHERE tier < 9),
d0 AS (SELECT packet_id, max(friction) FILTER (r = 1) AS friction_type, max(friction) FILTER (r = 2) AS secondary_friction, any_value(src) AS classification_source FROM c3 GROUP BY 1)"""
SIGNAL_OF = {"payment_failures": "payment_failure", "searches": "poor_recommendations", "product_views": "unclear_product_info", "js_errors": "technical_glitch"}
_SIG = " OR ".join(f"({c} > 0 AND d0.friction_type = '{f}')" for c, f in SIGNAL_OF.items())
DECIDED = f"""{CAND},
d1 AS (SELECT pk.*, d0.* EXCLUDE packet_id, c0.team AS owner_team, c0.is_rule AS rule_supports, c0.prob >= 0.6 AND ({_SIG}) AS model_supports, c0.theme_at IS NOT NULL AS text_supports,
  mult IS NOT NULL AND d0.friction_type = 'payment_failure' AS aggregate_supports,
  CASE WHEN session_kind = 'post_purchase' THEN coalesce(order_value, 0.0) WHEN converted THEN 0.0 ELSE cart_value END AS rev,
  CASE WHEN mult IS NULL THEN 1.0 ELSE round(least(greatest(mult, 1.0), 5.0), 2) END AS trend_factor
  FROM pk JOIN d0 USING (packet_id) JOIN c0 ON c0.packet_id = pk.packet_id AND c0.friction = d0.friction_type),
d2 AS (SELECT *, round(0.3 * rule_supports::INT + 0.3 * model_supports::INT + 0.2 * text_supports::INT + 0.2 * aggregate_supports::INT, 4)::DOUBLE AS confidence,
  round(rev, 2) AS revenue_at_risk, round(rev * ln(2) * trend_factor, 2) AS impact FROM d1),
d3 AS (SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS gate,
  CASE WHEN impact >= 500000 THEN 'critical' WHEN impact >= 50000 THEN 'high' ELSE 'normal' END AS priority,
  CASE WHEN session_kind = 'post_purchase' THEN 'post_purchase' ELSE 'post_session' END AS moment FROM d2)"""
PLAYBOOK = "pb AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', '{r[3] or ''}', '{r[4]}', {str(r[5]).lower()}, '{r[6]}', '{r[7] or ''}', [{','.join(repr(v) for v in r[8])}]::VARCHAR[])"
    for i, r in enumerate(vocab.PLAYBOOK)) + ") AS v(i, friction, kind, action, moment, channel, auto, template, wkey, wvals))"
_OK = "(wkey = '' OR (wkey = 'packet_type' AND list_contains(wvals, 'session')) OR (wkey = 'rule_any' AND list_has_any(wvals, string_split(flags, '|'))))"
ACTED = f"""{DECIDED}, {PLAYBOOK},
a1 AS (SELECT d3.*, (SELECT arg_min(action, i) FROM pb WHERE kind = 'customer' AND pb.friction = friction_type AND pb.moment = d3.moment AND {_OK}) AS customer_action,
  (SELECT arg_min(action, i) FROM pb WHERE kind = 'team' AND pb.friction = friction_type AND {_OK}) AS team_action,
  (SELECT arg_min(action, i) FROM pb WHERE kind = 'customer' AND pb.friction = friction_type AND pb.moment = 'in_session' AND {_OK}) AS live_action FROM d3)"""
q("session_packets", PACKETS, """SELECT packet_id, session_kind, CAST(risk_score AS DOUBLE) AS risk_score, flags, array_to_string(themes, '|') AS themes, CASE WHEN mult IS NULL THEN '-' ELSE 'payment_failure' END AS hint,
  coalesce(order_value, -1.0) AS order_value FROM pk""")
q("classify", CAND, "SELECT * FROM d0")
q("confidence_gate", DECIDED, "SELECT packet_id, rule_supports, model_supports, text_supports, aggregate_supports, confidence, gate FROM d3")
q("priority", DECIDED, "SELECT packet_id, revenue_at_risk, CAST(trend_factor AS DOUBLE) AS trend_factor, round(impact, 1) AS impact, priority, owner_team FROM d3")
q("playbook_pick", ACTED, """SELECT packet_id, moment, coalesce(customer_action, '-') AS customer_action, team_action FROM a1
UNION ALL SELECT packet_id, 'in_session', coalesce(live_action, '-'), team_action FROM a1""")
q("decision_summary", DECIDED, """SELECT 'gate' AS section, gate AS value, count(*) AS packets FROM d3 GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM d3 GROUP BY 2
UNION ALL SELECT 'owner_team', owner_team, count(*) FROM d3 GROUP BY 2""")
q("second_pass", f"""{DECIDED},
ch AS (SELECT packet_id FROM d3 WHERE gate = 'medium' ORDER BY risk_score DESC, packet_id LIMIT 400),
e1 AS (SELECT d3.*, ch.packet_id IS NOT NULL AS investigated FROM d3 LEFT JOIN ch USING (packet_id)),
e2 AS (SELECT *, round(0.3 * rule_supports::INT + 0.3 * model_supports::INT + 0.2 * text_supports::INT + 0.2 * (aggregate_supports OR (investigated AND friction_type = CASE ascii(right(packet_id, 1)) % 3 WHEN 0 THEN 'payment_failure' WHEN 1 THEN 'delivery_uncertainty' ELSE '' END))::INT, 4) AS c2 FROM e1)""",
  "SELECT investigated, CASE WHEN c2 >= 0.8 THEN 'high' WHEN c2 >= 0.5 THEN 'medium' ELSE 'low' END AS gate, friction_type, count(*) AS n FROM e2 GROUP BY ALL")
ENRICHED = f"""{PACKETS},
n1 AS (SELECT mb.packet_id, sc.*, ((n_ev * 7 + product_views * 11 + 26) % 100) / 100.0 AS pf FROM mb JOIN sc USING (session_id)),
n2 AS (SELECT packet_id, count(*) AS sessions_scored, round(count(*) FILTER (EXISTS (SELECT 1 FROM rf WHERE rf.friction = 'payment_failure' AND list_contains(string_split(flags, '|'), rf.flag))) / count(*), 3) AS rule_support_share,
  round(count(*) FILTER (pf >= 0.6) / count(*), 3) AS model_support_share, round(CAST(sum(CAST(pf AS DECIMAL(20, 4))) AS DOUBLE) / count(*), 4) AS p_payment FROM n1 GROUP BY 1),
n3 AS (SELECT packet_id, unnest(string_split(flags, '|')) AS flag FROM n1 WHERE flags <> ''),
n4 AS (SELECT packet_id, flag, count(*) AS c FROM n3 GROUP BY ALL),
n5 AS (SELECT packet_id, string_agg(flag, '|' ORDER BY c DESC, flag) AS flags FROM n4 JOIN n2 USING (packet_id) WHERE c / sessions_scored >= 0.2 GROUP BY 1),
n6 AS (SELECT packet_id, unnest(themes) AS theme FROM mb JOIN th USING (session_id)),
n7 AS (SELECT packet_id, theme, count(*) AS c FROM n6 WHERE theme <> 'other' GROUP BY packet_id, theme QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY count(*) DESC, theme) <= 3),
n8 AS (SELECT packet_id, string_agg(theme, '|' ORDER BY c DESC, theme) AS themes FROM n7 GROUP BY 1),
n9 AS (SELECT packet_id, feature, sum(v) AS w FROM (UNPIVOT (SELECT packet_id, session_id, payment_failures, searches, product_views, js_errors FROM n1) ON payment_failures, searches, product_views, js_errors INTO NAME feature VALUE v) WHERE v > 0 GROUP BY ALL),
n10 AS (SELECT packet_id, string_agg(feature, '|' ORDER BY w DESC, feature) AS signals FROM n9 GROUP BY 1)"""
q("aggregate_enrich", ENRICHED, """SELECT packet_id, sessions_scored, rule_support_share, model_support_share, coalesce(flags, '') AS flags, coalesce(themes, '') AS themes, p_payment, coalesce(signals, '') AS signals
FROM n2 LEFT JOIN n5 USING (packet_id) LEFT JOIN n8 USING (packet_id) LEFT JOIN n10 USING (packet_id)""")
q("aggregate_decisions", f"""{ENRICHED},
g1 AS (SELECT an.*, rule_support_share >= 0.2 AS rs, model_support_share >= 0.3 AND contains(coalesce(signals, ''), 'payment_failures') AS ms,
  contains(coalesce(themes, ''), 'payment_trust') OR contains(coalesce(themes, ''), 'money_deducted') AS ts, least(greatest(multiplier, 1.0), 5.0) AS tr
  FROM an JOIN n2 USING (packet_id) LEFT JOIN n8 USING (packet_id) LEFT JOIN n10 USING (packet_id)),
g2 AS (SELECT *, round(0.3 * rs::INT + 0.3 * ms::INT + 0.2 * ts::INT + 0.2, 4)::DOUBLE AS confidence, round(revenue_at_risk * ln(1 + affected_sessions) * tr, 2) AS impact FROM g1)""",
  """SELECT packet_id, 'payment_failure' AS friction_type, 'aggregate_metric' AS classification_source, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS gate,
  impact, CASE WHEN impact >= 500000 THEN 'critical' WHEN impact >= 50000 THEN 'high' ELSE 'normal' END AS priority, tr AS trend_factor, 'check_or_switch_gateway' AS team_action FROM g2""")

# --- investigation -------------------------------------------------------------------------------------------
q("drop_off_by_segment", f"""{T720},
r AS (SELECT x.step, t.device, t.exit_step = x.step AND NOT converted AS gone FROM t, (VALUES ('browse', 0), ('product', 1), ('checkout', 3), ('payment', 4)) AS x(step, i)
  WHERE session_kind = 'shopping' AND {_case('furthest_step', STEP_IDX, False)} >= x.i)""",
  """SELECT step, device AS segment, count(*) AS reached, count(*) FILTER (gone) AS left, round(count(*) FILTER (gone) / count(*), 4) AS exit_rate,
  (SELECT round(count(*) FILTER (gone) / count(*), 4) FROM r r2 WHERE r2.step = r.step) AS overall_exit_rate FROM r WHERE device IS NOT NULL GROUP BY step, device""")
_CMP = ["payment_failures", "coupon_failures", "otp_resends", "size_chart_opens", "pincode_checks", "max_eta_days", "max_extra_fees", "rage_clicks", "js_errors", "dwell_checkout_s"]
q("converters_vs_abandoners", f"""{S2880},{TABLE},{FEATURES},
x AS (SELECT f.*, 0 AS max_extra_fees, dwell_checkout_us / 1e6 AS dwell_checkout_s, converted FROM f JOIN t USING (session_id) WHERE reached_cart),
y AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) FILTER (converted) AS c, avg({c}) FILTER (NOT converted) AS a FROM x" for c in _CMP)})""",
  "SELECT feature, (SELECT count(*) FILTER (converted) FROM x) AS n_converters, (SELECT count(*) FILTER (NOT converted) FROM x) AS n_abandoners, round(c, 3) AS converters, round(a, 3) AS abandoners, coalesce(CASE WHEN c <> 0 THEN round(a / c, 2) END, -1.0) AS ratio FROM y")
q("sample_feedback", "", f"SELECT {THEME_LIST}[doc_id % {len(THEMES)} + 1] AS theme, count(*) AS texts FROM documents WHERE doc_id % 50 = 7 OR doc_id % 40 = 3 GROUP BY 1")
q("newest_feedback", "", f"SELECT doc_id AS text_id, 'app_bug' AS theme, lang AS language FROM documents WHERE {THEME_LIST}[doc_id % {len(THEMES)} + 1] = 'app_bug' ORDER BY doc_id DESC LIMIT 20")
q("order_status", ORD, """SELECT 'pk_' || user_id AS packet_id, count(*) AS orders, count(*) FILTER (delay_days > 0) AS delayed, round(sum(delay_days) / count(*), 2) AS mean_delay_days,
  count(*) FILTER (delay_days = 3) AS refunds_pending FROM od GROUP BY 1""")
q("gateway_health", f"""{OVERLAY}, {ORD},
u AS (SELECT session_id, gateway, min(timestamp) AS ts, bool_or(status = 'failed') AS bad FROM ov GROUP BY 1, 2), bs AS (SELECT gateway, count(*) FILTER (bad) / count(*) AS base FROM u GROUP BY 1),
pr AS (SELECT order_id, 'G' || (CAST(right(order_id, 1) AS INT) % 5) AS gateway, placed_at FROM od),
c AS (SELECT order_id, any_value(pr.gateway) AS gateway, count(u.ts) AS n, count(*) FILTER (u.bad) AS nf FROM pr LEFT JOIN u ON u.gateway = pr.gateway AND u.ts BETWEEN placed_at - INTERVAL 10 DAY AND placed_at + INTERVAL 10 DAY GROUP BY 1)""",
  """SELECT order_id AS probe_id, n AS sessions_in_window, nf AS failed_sessions, round(CASE WHEN n > 0 THEN nf / n ELSE 0 END, 4) AS failure_rate, round(base, 4) AS baseline_failure_rate,
  round(CASE WHEN n > 0 THEN nf / n ELSE 0 END / base, 2) AS multiplier FROM c JOIN bs USING (gateway)""")
q("gateway_health_live", f"""{BEHAVIOUR},
gp AS (SELECT *, timestamp >= TIMESTAMP '2024-01-16' AS late FROM s WHERE event IN ('payment_attempt', 'payment_failed')),
gu AS (SELECT session_id, gateway, late, min(timestamp) AS ts, bool_or(event = 'payment_failed') AS bad FROM gp GROUP BY 1, 2, 3),
bs AS (SELECT gateway, count(*) FILTER (bad) / count(*) AS base FROM gu WHERE NOT late GROUP BY 1),
c AS (SELECT p.seq, p.gateway, count(gu.ts) AS n, count(*) FILTER (gu.bad) AS nf FROM gp p LEFT JOIN gu ON gu.gateway = p.gateway AND gu.ts BETWEEN p.timestamp - INTERVAL 600 MINUTE AND p.timestamp + INTERVAL 600 MINUTE
  WHERE p.event = 'payment_failed' GROUP BY 1, 2)""",
  """SELECT CAST(seq AS VARCHAR) AS probe_id, n AS sessions_in_window, nf AS failed_sessions, round(CASE WHEN n > 0 THEN nf / n ELSE 0 END, 4) AS failure_rate, round(coalesce(base, 0), 4) AS baseline_failure_rate,
  round(CASE WHEN n > 0 THEN nf / n ELSE 0 END / nullif(base, 0), 2) AS multiplier FROM c LEFT JOIN bs USING (gateway)""")
q("courier_health", f"""{ORD},
pr AS (SELECT order_id AS pid, courier AS pc, CASE WHEN CAST(right(order_id, 1) AS INT) % 2 = 0 THEN city END AS pcity, placed_at AS pat FROM od),
b1 AS (SELECT courier, city, count(*) FILTER (delay_days >= 2) / count(*) AS base FROM od GROUP BY 1, 2), b2 AS (SELECT courier, count(*) FILTER (delay_days >= 2) / count(*) AS base FROM od GROUP BY 1),
c AS (SELECT pid, pc, pcity, count(o.order_id) AS n, count(*) FILTER (o.delay_days >= 2) AS nd, sum(o.delay_days) AS dd FROM pr LEFT JOIN od o ON o.courier = pc AND (pcity IS NULL OR o.city = pcity)
  AND o.placed_at BETWEEN pat - INTERVAL 30 DAY AND pat + INTERVAL 30 DAY GROUP BY 1, 2, 3)""",
  """SELECT pid AS probe_id, n AS orders_in_window, round(nd / n, 4) AS delayed_share, round(coalesce(b1.base, b2.base), 4) AS baseline_delayed_share, round((nd / n) / coalesce(b1.base, b2.base), 2) AS multiplier,
  round(dd / n, 2) AS mean_delay_days FROM c LEFT JOIN b1 ON b1.courier = pc AND b1.city = pcity LEFT JOIN b2 ON b2.courier = pc""")
q("delivery_eta", f"{T720}, e AS (SELECT t.city, s.courier, s.eta_days FROM s JOIN t USING (session_id) WHERE event = 'delivery_info_view')",
  "SELECT city, courier, count(eta_days) AS quotes, round(quantile_cont(eta_days, 0.5), 4) AS median_eta_days, round(quantile_cont(eta_days, 0.9), 4) AS p90_eta_days FROM e GROUP BY 1, 2")
q("stock_check", "", """SELECT 'p_' || p_partkey AS product_id, p_size > 5 AS in_stock, concat_ws('|', CASE WHEN p_size % 5 = 0 THEN 'L' END, CASE WHEN p_size % 4 = 0 THEN 'M' END, CASE WHEN p_size % 3 = 0 THEN 'S' END) AS out,
  round(((p_size % 3 = 0)::INT + (p_size % 4 = 0)::INT + (p_size % 5 = 0)::INT) / 3, 2) AS share_sizes_out FROM part""")
q("catalog_changes", "", "SELECT 'p_' || p_partkey AS product_id, p_partkey * 3600000000 AS at_us FROM part WHERE p_partkey >= (SELECT max(p_partkey) FROM part) - 72")
q("top_frictions_tool", DECIDED, "SELECT friction_type, count(*) AS sessions, round(CAST(sum(CAST(revenue_at_risk AS DECIMAL(28, 2))) AS DOUBLE), 2) AS revenue_at_risk FROM d3 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5")
q("customer_context", f"""{T720}, {ORD},
p AS (SELECT session_id, count(*) AS a, count(*) FILTER (event = 'payment_failed') AS b, count(*) FILTER (event = 'payment_failed' AND gateway = 'A') AS c FROM s WHERE event IN ('payment_attempt', 'payment_failed') GROUP BY 1),
j AS (SELECT session_id, least(count(*) FILTER (pe IS NULL OR pe <> event), 25) AS steps FROM (SELECT session_id, event, lag(event) OVER (PARTITION BY session_id ORDER BY idx) AS pe FROM s) GROUP BY 1)""",
  """SELECT session_id, coalesce(a, 0) AS attempts, coalesce(b, 0) AS failed, coalesce(c, 0) AS debited_without_order, coalesce(od.status, '-') AS order_status, CAST(coalesce(od.delay_days, -1) AS BIGINT) AS delay_days,
  CAST(steps AS BIGINT) AS steps FROM t LEFT JOIN p USING (session_id) JOIN j USING (session_id) LEFT JOIN od ON od.order_id = t.order_id""".replace("SELECT session_id", "SELECT t.session_id"))

# --- actions -------------------------------------------------------------------------------------------------
LABEL = _case("friction_type", {k: v.replace("'", "''") for k, v in vocab.FRICTION_LABELS.items()})
q("alert_rows", DECIDED, f"""SELECT 'al_' || packet_id AS alert_id, {LABEL} || ' - session ' || session_id || ' (' || concat_ws(', ', device, city) || ')' AS title, gate,
  CASE gate WHEN 'high' THEN 'open' ELSE 'needs_review' END AS status, priority, {LABEL} || ' (confidence ' || printf('%.2f', confidence) || ') routed to ' || replace(owner_team, '_', ' ') || '.' AS summary FROM d3 WHERE gate <> 'low'""")
q("alert_list", DECIDED, """SELECT packet_id, owner_team, CASE gate WHEN 'high' THEN 'open' ELSE 'needs_review' END AS status, round(impact, 1) AS impact, count(*) OVER () AS total FROM d3
WHERE gate <> 'low' AND owner_team IN ('operations', 'operations_tech') ORDER BY d3.impact DESC, start_us DESC, packet_id LIMIT 100""")
q("at_risk_list", DECIDED, "SELECT packet_id, gate, start_us FROM d3 WHERE gate <> 'low' ORDER BY start_us DESC, packet_id LIMIT 100")


def capped(source: str) -> str:
    """Recursive walk through each user's messages, carrying the last two accepted times."""
    return f"""
mc0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_us, pid) AS rn FROM ({source})),
wk AS (SELECT user_id, rn, pid, start_us, true AS accepted, CAST(-1e18 AS BIGINT) AS a1, start_us AS a2 FROM mc0 WHERE rn = 1
  UNION ALL SELECT m.user_id, m.rn, m.pid, m.start_us, m.start_us - w.a1 >= 86400000000, CASE WHEN m.start_us - w.a1 >= 86400000000 THEN w.a2 ELSE w.a1 END,
  CASE WHEN m.start_us - w.a1 >= 86400000000 THEN m.start_us ELSE w.a2 END FROM wk w JOIN mc0 m ON m.user_id = w.user_id AND m.rn = w.rn + 1)"""


q("message_cap", f"RECURSIVE {T720}, {capped('SELECT user_id, session_id AS pid, start_us FROM t')}", "SELECT pid AS packet_id, accepted FROM wk")
q("recent_messages", T720, "SELECT session_id AS packet_id, count(*) OVER (PARTITION BY user_id ORDER BY start_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM t")
RECOVERY = f"""RECURSIVE {ACTED},
r0 AS (SELECT *, ('0x' || substr(sha256('holdout:' || session_id), 1, 8))::BIGINT / 4294967295 < 0.1 AS holdout, ('0x' || substr(sha256('consent:' || user_id), 1, 8))::BIGINT / 4294967295 < 0.85 AS consent
  FROM a1 WHERE gate <> 'low' AND customer_action IS NOT NULL AND (session_kind = 'post_purchase' OR NOT converted)),
{capped("SELECT user_id, packet_id AS pid, start_us FROM r0 WHERE NOT holdout AND consent")},
r1 AS (SELECT r0.*, pb.channel, pb.template, coalesce(accepted, false) AS ok, gate = 'high' AND pb.auto AS au FROM r0 LEFT JOIN wk ON pid = packet_id JOIN pb ON pb.action = customer_action),
r2 AS (SELECT *, CASE WHEN holdout THEN 'holdout' WHEN NOT consent THEN 'suppressed_consent' WHEN NOT ok THEN 'suppressed_cap' WHEN au THEN 'sent' ELSE 'pending_approval' END AS status FROM r1)"""
q("recovery_plan", RECOVERY, """SELECT packet_id, customer_action AS action_id, channel, status, ok AND au AS auto, holdout,
  round(coalesce(nullif(order_value, 0.0), nullif(cart_value, 0.0), 0.0), 2) AS value FROM r2""")
_TPL = _case("template", {k: v.replace("'", "''").replace("{product}", "item") for k, v in vocab.TEMPLATES.items()})
q("recovery_messages", RECOVERY, f"SELECT customer_action AS action_id, CASE WHEN ok THEN replace({_TPL}, '{{method}}', coalesce(payment_method, 'this method')) ELSE '-' END AS message, count(*) AS n FROM r2 GROUP BY ALL")
OBSERVED = """ob AS (SELECT *, CASE WHEN holdout THEN 'holdout' WHEN o_orderkey % 7 = 0 THEN 'suppressed_cap' ELSE 'sent' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 'recovered' WHEN 'O' THEN 'not_recovered' END AS outcome FROM
  (SELECT *, ('0x' || substr(sha256('holdout:s_' || o_orderkey), 1, 8))::BIGINT / 4294967295 < 0.1 AS holdout FROM orders))"""
q("recovery_stats", f"""{OBSERVED}, a AS (SELECT count(*) AS total, count(*) FILTER (status = 'sent' AND outcome IS NOT NULL) AS treated, count(*) FILTER (holdout AND outcome IS NOT NULL) AS held,
  count(*) FILTER (status = 'sent' AND outcome = 'recovered') AS tw, count(*) FILTER (holdout AND outcome = 'recovered') AS hw,
  CAST(sum(CAST(o_totalprice AS DECIMAL(28, 2))) FILTER (status = 'sent' AND outcome = 'recovered') AS DOUBLE) AS money FROM ob)""",
  """SELECT total, treated, held AS holdout, round(tw / treated, 4) AS treated_recovery_rate, round(hw / held, 4) AS holdout_recovery_rate, round((tw / treated - hw / held) * 100, 2) AS lift_pp,
  money AS recovered_revenue FROM a""")
q("recovery_by_friction", OBSERVED, """SELECT o_orderpriority AS friction_type, count(*) FILTER (status = 'sent') AS treated, count(*) FILTER (status = 'sent' AND outcome = 'recovered') AS treated_recovered,
  count(*) FILTER (holdout) AS holdout, count(*) FILTER (holdout AND outcome = 'recovered') AS holdout_recovered FROM ob WHERE outcome IS NOT NULL AND (status = 'sent' OR holdout) GROUP BY 1""")
_ALLOWED = " OR ".join(f"(action = '{a}' AND st IN ({','.join(repr(x) for x in allowed)}))" for a, (allowed, _) in vocab.TRANSITIONS.items())
_TARGET = "CASE action " + " ".join(f"WHEN '{a}' THEN '{t}'" for a, (_, t) in vocab.TRANSITIONS.items() if t) + " ELSE st END"


def _next(st: str) -> str:
    return f"CASE WHEN {_ALLOWED} THEN {_TARGET} ELSE st END".replace("st IN", f"{st} IN").replace("ELSE st END", f"ELSE {st} END")


FLOW = f"""RECURSIVE rq AS MATERIALIZED (SELECT event_id AS request_id, 'al_' || user_id AS alert_id, ['approve', 'assign', 'create_ticket', 'dismiss', 'resolve', 'escalate'][CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 6 + 1] AS action, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
fl AS (SELECT rn, request_id, alert_id, action, ts, 'open' AS before, {_next("'open'")} AS after FROM rq WHERE rn = 1
  UNION ALL SELECT r.rn, r.request_id, r.alert_id, r.action, r.ts, f.after, {_next("f.after").replace('action', 'r.action')} FROM fl f JOIN rq r ON r.alert_id = f.alert_id AND r.rn = f.rn + 1),
f2 AS (SELECT *, {_ALLOWED.replace('st IN', 'before IN')} AS ok FROM fl),
f3 AS (SELECT request_id, row_number() OVER (ORDER BY ts, request_id) AS n FROM f2 WHERE ok AND action = 'create_ticket')"""
q("workflow_fold", FLOW, """SELECT f2.request_id, alert_id, action, before AS from_status, after AS to_status, CASE WHEN ok THEN '-' WHEN action = 'escalate' THEN 'unknown action escalate' ELSE 'cannot ' || action || ' an alert that is ' || before END AS rejected,
  coalesce('TKT-' || alert_id || '-' || printf('%03d', n), '-') AS ticket_ref FROM f2 LEFT JOIN f3 USING (request_id)""")
q("workflow_state", FLOW, """SELECT u.alert_id, coalesce(arg_max(after, rn) FILTER (ok), 'open') AS status, CASE WHEN bool_or(ok AND action = 'assign') THEN 'product_queue' ELSE '-' END AS assigned_to
FROM (SELECT DISTINCT 'al_' || user_id AS alert_id FROM events) u LEFT JOIN f2 USING (alert_id) GROUP BY 1""")
q("release_pending", FLOW, """SELECT packet_id, CASE WHEN status = 'pending_approval' AND who IS NOT NULL THEN 'approved' ELSE status END AS status, CASE WHEN status = 'pending_approval' AND who IS NOT NULL THEN who ELSE '-' END AS approved_by
FROM (SELECT DISTINCT 'pk_' || user_id AS packet_id, CASE user_id % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'holdout' ELSE 'pending_approval' END AS status FROM events)
LEFT JOIN (SELECT replace(alert_id, 'al_', 'pk_') AS packet_id, 'agent' AS who FROM f2 WHERE ok AND action = 'approve' GROUP BY 1) USING (packet_id)""")
q("recovery_by_status", OBSERVED, "SELECT status, count(*) AS messages FROM ob GROUP BY 1")
q("approve_drafts", "", """SELECT conv_id || '-' || turn AS draft_id, CASE WHEN conv_id % 4 = 0 THEN 'sent' WHEN (conv_id + turn) % 3 = 0 THEN 'approved' ELSE 'pending_approval' END AS status,
  CASE WHEN conv_id % 4 <> 0 AND (conv_id + turn) % 3 = 0 THEN 'agent_1' ELSE '-' END AS approved_by FROM conversations WHERE role = 'assistant'""")
_REPLIES = "rp AS (SELECT conv_id || '-' || turn AS draft_id, conv_id AS n FROM conversations WHERE role = 'assistant')"
q("audit_events", f"{RECOVERY}, {_REPLIES}", """SELECT 'decision' AS event_type, 'packet' AS entity_type, 'system' AS actor, count(*) AS n, count(*) FILTER (rule_supports) AS by_rule, CAST(0 AS BIGINT) AS investigated FROM a1
UNION ALL SELECT 'alert_created', 'alert', 'system', count(*), 0, 0 FROM a1 WHERE gate <> 'low' UNION ALL SELECT 'recovery_planned', 'session', 'system', count(*), 0, 0 FROM r2
UNION ALL SELECT 'recovery_message_drafted', 'session', 'system', count(*), 0, 0 FROM r2 WHERE ok
UNION ALL SELECT * FROM (SELECT 'recovery_approved', 'session', 'ann', count(*) AS n, 0, 0 FROM r2 WHERE status = 'pending_approval' AND session_id LIKE '%1') WHERE n > 0
UNION ALL SELECT 'cs_reply_drafted', 'cs_draft', 'system', count(*), 0, 0 FROM rp UNION ALL SELECT 'cs_reply_approved', 'cs_draft', 'kim', count(*), 0, 0 FROM rp WHERE n % 5 = 0""")
q("audit_trail", f"{_REPLIES}, ids AS (SELECT DISTINCT draft_id FROM rp ORDER BY 1 LIMIT 3), e AS (SELECT 'cs_reply_drafted' AS event_type, draft_id AS entity_id, 'system' AS actor, n FROM rp UNION ALL SELECT 'cs_reply_approved', draft_id, 'kim', n FROM rp WHERE n % 5 = 0)",
  "SELECT event_type, entity_id, actor, CAST(n AS BIGINT) * 1000000 AS at_us FROM e WHERE entity_id IN (FROM ids) ORDER BY n DESC, event_type, entity_id LIMIT 5")
q("draft_pass_rate", _REPLIES, """SELECT count(*) FILTER (n % 2 = 0 OR n % 3 = 0) AS drafted, count(*) FILTER (n % 2 = 0 AND n % 3 <> 0) AS passed,
  round(count(*) FILTER (n % 2 = 0 AND n % 3 <> 0) / count(*) FILTER (n % 2 = 0 OR n % 3 = 0), 4) AS pass_rate FROM rp""")
q("anomalies_ordered", DAILY, "SELECT packet_id, z_score FROM an ORDER BY z_score DESC, packet_id LIMIT 25")
q("gate_counts", DECIDED, "SELECT 'session' AS packet_type, gate, count(*) AS packets FROM d3 GROUP BY ALL")
q("audit_counts", RECOVERY, """SELECT 'decision' AS event_type, 'packet' AS entity_type, count(*) AS n FROM a1 UNION ALL SELECT 'alert_created', 'alert', count(*) FROM a1 WHERE gate <> 'low'
UNION ALL SELECT 'recovery_planned', 'session', count(*) FROM r2 UNION ALL SELECT 'recovery_message_drafted', 'session', count(*) FROM r2 WHERE ok""")

# --- read models -----------------------------------------------------------------------------------------------
_REACH = f"""x AS (SELECT v.step, v.i, t.*, exit_step = v.step AND NOT converted AS gone FROM t, (VALUES ('browse', 0), ('product', 1), ('cart', 2), ('checkout', 3), ('payment', 4)) AS v(step, i)
  WHERE session_kind = 'shopping' AND {_case('furthest_step', STEP_IDX, False)} >= v.i)"""
q("funnel", f"{T720}, {_REACH}", """SELECT step, count(*) AS sessions, count(*) FILTER (gone) AS dropped, round(count(*) FILTER (gone) / count(*), 4) AS drop_rate FROM x GROUP BY 1
UNION ALL SELECT 'order', count(*) FILTER (converted), 0, 0.0 FROM t WHERE session_kind = 'shopping'""")
q("heatmap", f"{T720}, {_REACH}", "SELECT step, device AS segment, round(count(*) FILTER (gone) / count(*), 4) AS drop_rate, count(*) AS sessions FROM x WHERE device IS NOT NULL GROUP BY 1, 2")
RISKY = f"{DECIDED}, k AS (SELECT *, CAST(make_timestamp(start_us) AS DATE) AS day FROM d3 WHERE gate <> 'low')"
q("health", f"""{RISKY}, l AS (SELECT max(day) AS last FROM k),
h AS (SELECT friction_type, count(*) FILTER (day > last - 3) / 3 AS rec, count(*) FILTER (day <= last - 3) / greatest(datediff('day', min(day), any_value(last)) - 2, 1) AS base,
  bool_or(priority IN ('critical', 'high')) AS crit FROM k, l GROUP BY 1)""",
  """SELECT friction AS friction_type, CASE WHEN crit THEN 'critical' WHEN CASE WHEN base > 0 THEN rec / base ELSE 1.0 END >= 1.3 AND rec IS NOT NULL THEN 'rising' ELSE 'normal' END AS status,
  round(coalesce(rec, 0), 1) AS recent_per_day, round(coalesce(base, 0), 1) AS baseline_per_day, coalesce(CASE WHEN rec IS NOT NULL THEN round(CASE WHEN base > 0 THEN rec / base ELSE 1.0 END, 2) END, -1.0) AS ratio
FROM fr LEFT JOIN h ON h.friction_type = fr.friction""")
_MONEY = "round(coalesce(CAST(sum(CAST(revenue_at_risk AS DECIMAL(28, 2))) AS DOUBLE), 0.0), 2)"
q("overview_kpis", RISKY, f"""SELECT (SELECT count(*) FROM t) AS sessions, (SELECT count(*) FROM t WHERE session_kind = 'shopping') AS shopping_sessions,
  (SELECT round(count(*) FILTER (converted) / count(*), 4) FROM t WHERE session_kind = 'shopping') AS conversion_rate,
  (SELECT round(count(*) FILTER (abandoned) / greatest(count(*) FILTER (reached_cart), 1), 4) FROM t WHERE session_kind = 'shopping') AS cart_abandonment_rate,
  count(*) AS at_risk_sessions, {_MONEY} AS revenue_at_risk, CAST(0 AS BIGINT) AS live_sessions, count(*) FILTER (gate = 'high') AS open_alerts, count(*) FILTER (gate = 'medium') AS needs_review FROM k""")
q("top_frictions", RISKY, f"""SELECT friction AS friction_type, {_case('friction', {k: v for k, v in vocab.FRICTION_LABELS.items()})} AS label, team AS owner_team, count(k.packet_id) AS sessions, {_MONEY} AS revenue_at_risk,
  count(*) FILTER (gate = 'high') AS high, count(*) FILTER (gate = 'medium') AS needs_review FROM fr LEFT JOIN k ON k.friction_type = fr.friction GROUP BY 1, 2, 3""")
q("daily_pivot", RISKY, "SELECT strftime(day, '%m-%d') AS day, " + ", ".join(f"count(*) FILTER (friction_type = '{f}') AS {f}" for f in vocab.FRICTIONS) + " FROM k GROUP BY 1")
_SIGS = "list_filter([" + ",".join(f"CASE WHEN {c} > 0 THEN '{c}' END" for c in SIGNAL_OF) + "], lambda x: x IS NOT NULL)"
q("team_top_values", f"""{RISKY}, v AS ({" UNION ALL ".join(f"SELECT friction_type, '{n}' AS dimension, {c} AS value, 3 AS lim FROM k" for n, c in (("device", "device"), ("city", "city"), ("gateway", "gateway"), ("courier", "courier")))}
  UNION ALL SELECT friction_type, 'product', pp2.product_id, 3 FROM k JOIN (SELECT session_id, product_id FROM (SELECT session_id, product_id, count(*) AS n, min(idx) AS i FROM s WHERE product_id IS NOT NULL GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, i) = 1) pp2 USING (session_id)
  UNION ALL SELECT friction_type, 'flag', unnest(string_split(flags, '|')), 4 FROM k WHERE flags <> '' UNION ALL SELECT friction_type, 'theme', unnest(real_themes), 3 FROM k
  UNION ALL SELECT friction_type, 'signal', unnest({_SIGS}), 4 FROM k)""",
  """SELECT friction_type, dimension, value, count(*) AS sessions, row_number() OVER (PARTITION BY friction_type, dimension ORDER BY count(*) DESC, value) AS rank FROM v WHERE value IS NOT NULL GROUP BY ALL
QUALIFY rank <= any_value(lim)""".replace("GROUP BY ALL", "GROUP BY friction_type, dimension, value"))
q("best_alerts", RISKY, "SELECT friction_type, packet_id, row_number() OVER (PARTITION BY friction_type ORDER BY impact DESC, packet_id) AS rank FROM k QUALIFY rank <= 6")
q("team_insights", RISKY, f"""SELECT CASE team WHEN 'operations_tech' THEN 'operations' ELSE team END AS team, friction AS friction_type, count(k.packet_id) AS sessions, {_MONEY} AS revenue_at_risk,
  count(*) FILTER (gate = 'high') AS high_confidence, count(*) FILTER (gate = 'medium') AS needs_review, CAST(0 AS BIGINT) AS aggregate_anomalies FROM fr LEFT JOIN k ON k.friction_type = fr.friction GROUP BY 1, 2""")
q("alert_quality", RISKY, "SELECT gate, count(*) AS alerts, round(count(*) / (SELECT count(*) FROM k), 4) AS share FROM k GROUP BY 1")
_NONZERO = [*vocab.BEHAVIOUR_COLUMNS, *(c for c in vocab.CONTEXT_COLUMNS if c not in ("device_code", "source_code", "hour"))]
q("nonzero_features", f"{BEHAVIOUR}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM b" for c in _NONZERO) + ")",
  "SELECT feature, count(*) AS sessions, round(sum(v), 2) AS total FROM u WHERE v <> 0 GROUP BY 1")
q("top_n_per_category", "", """SELECT * FROM (SELECT p_type AS category, 'p_' || p_partkey AS product_id, row_number() OVER (PARTITION BY p_type ORDER BY p_size > 5 DESC, p_retailprice DESC, 'p_' || p_partkey) AS rank FROM part
QUALIFY rank <= 200) ORDER BY category, rank LIMIT 1000""")

# --- metrics -----------------------------------------------------------------------------------------------------
q("split_buckets", "d AS (SELECT 's_' || doc_id AS k FROM documents)", """SELECT ('0x' || substr(sha256(k), 1, 8))::BIGINT % 5 = 0 AS test, ('0x' || substr(sha256(k || ':calibration'), 1, 8))::BIGINT % 5 = 0 AS calibration, count(*) AS n FROM d GROUP BY ALL""")
SCORED = "sl AS (SELECT l.*, lang, (n_chars % 97) / 97.0 AS score FROM labels l JOIN documents USING (doc_id))"
q("ranking_metrics", f"""{SCORED}, g AS (SELECT lang, score, sum(quality) AS p, count(*) - sum(quality) AS n FROM sl GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
a AS (SELECT lang, sum(p) AS pp, sum(n) AS nn, sum(p * tp / (tp + fp)) AS ap, sum(p * (fp - n) * 2 + p * n) AS ab, sum(p * (score - 1) * (score - 1) + n * score * score) AS sq FROM c GROUP BY 1)""",
  "SELECT lang, CAST(pp + nn AS BIGINT) AS n, round(pp / (pp + nn), 6) AS positive_rate, round(ap / pp, 6) AS average_precision, round(1 - ab / (pp * nn * 2), 6) AS roc_auc, round(sq / (pp + nn), 6) AS brier FROM a")
_PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, CAST(tp + fn AS BIGINT) AS support"""
q("prf_per_class", f"""{SCORED}, l AS (SELECT 'quality' AS class, quality = 1 AS t, score >= 0.3 AS p FROM sl UNION ALL SELECT 'toxic', toxic = 1, score >= 0.8 FROM sl),
c AS (SELECT class, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM l GROUP BY 1)""", f"SELECT class, {_PRF} FROM c")
q("multiclass_prf", """e AS (SELECT label AS l, (vec_id * 7) % 10 AS p FROM embeddings),
c AS (SELECT k AS class, count(*) FILTER (l = k AND p = k) AS tp, count(*) FILTER (l <> k AND p = k) AS fp, count(*) FILTER (l = k AND p <> k) AS fn FROM e, (SELECT CAST(unnest(range(10)) AS INT) AS k) GROUP BY 1)""",
  f"SELECT CAST(class AS VARCHAR) AS class, {_PRF} FROM c")
q("text_quality", f"x AS (SELECT source AS language, lang AS label, {LANGS}[doc_id % 4 + 1] AS p, (n_chars % 100) / 100.0 AS prob FROM documents)",
  """SELECT language, count(*) AS texts, round(count(*) FILTER (label = p) / count(*), 4) AS accuracy, round(count(*) FILTER (prob >= 0.6) / count(*), 4) AS coverage_at_min_prob,
  round(coalesce(count(*) FILTER (prob >= 0.6 AND label = p) / nullif(count(*) FILTER (prob >= 0.6), 0), 0), 4) AS accuracy_when_confident, round(count(*) FILTER (prob >= 0.6 AND label = p) / count(*), 4) AS accuracy_with_fallback
FROM x GROUP BY 1""")
_FL = "[" + ",".join(f"'{f}'" for f in vocab.FRICTIONS) + "]"
TRUTH = f"tr AS (SELECT session_id, n_all % 3 = 0 AS is_clean, {_FL}[n_all % 10 + 1] AS one, {_FL}[(n_all * 3 + 1) % 10 + 1] AS two FROM f)"
q("rule_quality", f"""{F2880}, {TRUTH}, {FRICTION_ROWS}, y AS (SELECT fr.friction AS class, NOT is_clean AND (one = fr.friction OR two = fr.friction) AS t, list_contains(fs, fr.friction) AS p
  FROM (SELECT session_id, {FLAG_FRICTIONS} AS fs FROM f) x JOIN tr USING (session_id), fr),
c AS (SELECT class, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM y GROUP BY 1)""", f"SELECT class, {_PRF} FROM c")
q("label_prevalence", f"{F2880}, {TRUTH}, {FRICTION_ROWS}, m AS (SELECT 'clean' AS label FROM tr WHERE is_clean UNION ALL SELECT 'double' FROM tr WHERE NOT is_clean UNION ALL SELECT fr.friction FROM tr, fr WHERE NOT is_clean AND (one = fr.friction OR two = fr.friction))",
  "SELECT label, count(*) AS sessions, round(count(*) / (SELECT count(*) FROM tr), 4) AS share FROM m GROUP BY 1")
q("decision_quality", f"""{DECIDED}, b AS (SELECT t.session_id, t.n_events % 3 = 0 AS is_clean, {_FL}[t.n_events % 10 + 1] AS pf, d3.friction_type, gate FROM t LEFT JOIN d3 USING (session_id)),
c AS (SELECT *, NOT is_clean AND friction_type IS NOT NULL AS cov, coalesce(gate <> 'low', false) AS al FROM b)""",
  """SELECT count(*) FILTER (NOT is_clean) AS friction_sessions, round(count(*) FILTER (cov) / count(*) FILTER (NOT is_clean), 4) AS detection_coverage,
  round(count(*) FILTER (cov AND friction_type = pf) / count(*) FILTER (cov), 4) AS cause_accuracy_primary,
  round(count(*) FILTER (cov AND (friction_type = pf OR friction_type = 'payment_failure')) / count(*) FILTER (cov), 4) AS cause_accuracy_any_planted,
  round(count(*) FILTER (is_clean AND al) / count(*) FILTER (is_clean), 4) AS clean_sessions_alerted, round(count(*) FILTER (gate = 'high') / count(*) FILTER (al), 4) AS alerts_high_confidence_share FROM c""")

q("affected_per_incident", f"{F2880}, {TRUTH}", "SELECT 'i_' || right(session_id, 1) AS incident_id, count(*) AS affected_sessions FROM tr WHERE NOT is_clean GROUP BY 1")
q("clean_sessions_with_rules", f"{F2880}, {TRUTH}", f"SELECT round(count(*) FILTER (len({FLAG_FRICTIONS}) > 0) / count(*), 4) AS clean_sessions_with_any_rule FROM f JOIN tr USING (session_id) WHERE is_clean")
q("metrics_report", DECIDED, """SELECT 'gates' AS section, 'packets' AS metric, 'session|' || gate AS key, CAST(count(*) AS DOUBLE) AS value FROM d3 GROUP BY gate
UNION ALL SELECT 'risk', 'packets', '', count(*) FROM d3 UNION ALL SELECT 'risk', 'highest', '', max(risk_score) FROM d3""")
_PLAY = "pl AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', {str(r[7] == 'packet_type' and 'aggregate' in r[8]).lower()})" for i, r in enumerate(vocab.PLAYBOOK)) + ") AS v(i, friction_type, kind, id, incident))"
q("recommended_actions", f"{DECIDED}, {_PLAY}", """SELECT friction_type, arg_max(id, i) FILTER (kind = 'team') AS team, coalesce(arg_min(id, i) FILTER (kind = 'team' AND incident), '-') AS incident,
  string_agg(id, '|' ORDER BY i) FILTER (kind = 'customer') AS customer FROM pl WHERE friction_type IN (SELECT friction_type FROM d3) GROUP BY 1""")
q("evidence_keys", "", """SELECT event_id, concat_ws('|', 'grounding: evidence key ''absent'' is not in the packet', 'grounding: evidence key ''k' || (event_id % 2) || chr(39) || ' is not in the packet') AS what FROM events""")

# --- drafts --------------------------------------------------------------------------------------------------------
_OFFERS = ", ".join(f"CASE WHEN contains(low, '{t}') THEN 'policy: offer/money term ''{t}'' is not allowed for this action' END" for t in vocab.OFFER_TERMS if t != "refund")
_BANNED = ", ".join(f"CASE WHEN contains(low, '{p}') THEN 'policy: banned phrase ''{p}''' END" for p in vocab.BANNED_PHRASES)
_PRIVATE = ", ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN 'policy: contains {w}' END" for c, p, w in (
    ("text", vocab.EMAIL_PATTERN, "an email address"), ("text", vocab.PHONE_PATTERN, "a phone number"), ("text", vocab.ID_PATTERN, "a customer/session/order identifier"), ("low", vocab.URL_PATTERN, "a link")))
q("draft_policy", f"d AS (SELECT doc_id, text, lower(text) AS low FROM documents), x AS (SELECT doc_id, list_filter([{_OFFERS}, {_BANNED}, {_PRIVATE}], lambda z: z IS NOT NULL) AS w FROM d)",
  "SELECT doc_id, len(w) AS failures, array_to_string(w, '|') AS what FROM x")
# RE2 has no lookbehind: a letter followed by a digit is consumed as a token of its own and dropped
q("draft_grounding", """d AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z_]\\d|\\d[\\d,]*(?:\\.\\d+)?%?'), lambda z: NOT regexp_matches(z, '^[A-Za-z_]')) AS tk FROM documents),
u AS (SELECT doc_id, unnest(tk) AS z FROM d), v AS (SELECT *, CAST(replace(rtrim(z, '%'), ',', '') AS DOUBLE) AS x FROM u),
g AS (SELECT doc_id, z, len(list_filter([0.82, 0.2, 4.1, 41500.0, 2024.0]::DOUBLE[], lambda n: abs(x - n) <= 0.5 OR abs(x - n) <= 0.01 * abs(n) OR ((z LIKE '%\\%' ESCAPE '\\' OR x > 1) AND abs(x / 100 - n) <= 0.005))) > 0 AS ok FROM v)""",
  "SELECT d.doc_id, any_value(len(tk)) AS numbers, count(g.z) FILTER (NOT ok) AS ungrounded FROM d LEFT JOIN g USING (doc_id) GROUP BY 1")

# replies about payment_failure with the action retry_payment_link; refund is allowed, the evidence holds 0.82 and 0.2
_FRICTIONS = " + ".join(f"CAST(contains(low, '{f}') OR " + " OR ".join(f"contains(low, '{p}')" for p in ps) + " AS INT)"
                        for f, ps in vocab.FRICTION_PHRASES.items() if f != "payment_failure")
_ACTIONS = " + ".join(f"CAST(contains(low, '{a}') AS INT)" for a in sorted({r[2] for r in vocab.PLAYBOOK} - {"retry_payment_link"}))
q("draft_validation", f"""a AS (SELECT conv_id || '-' || turn AS draft_id, text, lower(text) AS low FROM conversations WHERE role = 'assistant'),
tk AS (SELECT draft_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z_]\\d|\\d[\\d,]*(?:\\.\\d+)?%?'), lambda z: NOT regexp_matches(z, '^[A-Za-z_]'))) AS z FROM a),
v AS (SELECT *, CAST(replace(rtrim(z, '%'), ',', '') AS DOUBLE) AS x FROM tk),
g AS (SELECT draft_id, count(*) AS loose FROM v WHERE len(list_filter([0.82, 0.2]::DOUBLE[], lambda n: abs(x - n) <= 0.5 OR abs(x - n) <= 0.01 * abs(n)
  OR ((z LIKE '%\\%' ESCAPE '\\' OR x > 1) AND abs(x / 100 - n) <= 0.005))) = 0 GROUP BY 1),
c AS (SELECT draft_id, CASE WHEN length(text) BETWEEN 1 AND {REPLY_LIMIT} THEN coalesce(loose, 0) + {_FRICTIONS} + {_ACTIONS}
  + len(list_filter([{_OFFERS}, {_BANNED}, {_PRIVATE}], lambda w: w IS NOT NULL)) ELSE 1 END AS n FROM a LEFT JOIN g USING (draft_id))""",
  "SELECT draft_id, n = 0 AS ok, CAST(n AS BIGINT) AS failures, CASE WHEN n = 0 THEN 'draft' ELSE 'fallback' END AS source FROM c")

# --- streams ---------------------------------------------------------------------------------------------------------
q("stream_rates", f"ev AS ({EVENTS_SQL})", """SELECT epoch_us(date_trunc('day', timestamp)) AS start_us, gateway, count(*) FILTER (event = 'payment_attempt') AS attempts, count(*) FILTER (event = 'payment_failed') AS failed
FROM ev WHERE event IN ('payment_attempt', 'payment_failed') GROUP BY 1, 2""")
q("stream_sessions", f"""ev AS ({EVENTS_SQL}), c AS (SELECT *, epoch_us(timestamp) AS us FROM ev WHERE event <> 'not_in_vocabulary'),
p AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session_id ORDER BY us) < 86400000000 THEN 0 ELSE 1 END AS nw FROM c),
g AS (SELECT *, sum(nw) OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS i FROM p)""",
  "SELECT session_id, min(us) AS start_us, count(*) AS events, bool_or(event = 'order_placed') AS converted FROM g GROUP BY session_id, i")
q("live_packets", f"""{T720},{FEATURES}, lc AS (SELECT session_id, arg_min(event, idx) AS e0, arg_min(device, CASE WHEN device IS NOT NULL OR idx = 1 THEN idx END) AS d0,
  max(CASE WHEN event = 'delivery_info_view' THEN idx END) AS qi FROM s GROUP BY session_id),
lq AS (SELECT s.session_id, s.courier AS quoted FROM s JOIN lc ON s.session_id = lc.session_id AND s.idx = lc.qi)""",
  f"""SELECT 'pk_live_' || f.session_id AS packet_id, {FLAGS} AS flags, round(f.cart_value, 2) AS cart_value, exit_step, exit_step AS furthest_step,
CASE WHEN e0 = 'page_view' THEN f.device END AS device, 'live' AS source,
CASE WHEN f.pp AND f.add_to_carts = 0 AND f.checkout_starts = 0 THEN 'post_purchase' ELSE 'shopping' END AS session_kind,
quoted AS courier, t.gateway, t.payment_method, t.converted
FROM f JOIN t ON f.session_id = t.session_id JOIN lc ON lc.session_id = f.session_id LEFT JOIN lq ON lq.session_id = f.session_id WHERE {FLAGS} <> ''""")
_OUTCOMES = ", ".join(f"'{e}'" for e in vocab.OUTCOME_EVENTS)
q("live_risk_view", f"""{S720}, o AS (SELECT session_id, min(idx) FILTER (event IN ({_OUTCOMES}) AND event <> 'exit') AS oi FROM s GROUP BY session_id),
v AS (SELECT s.session_id, s.seq, s.idx, s.event <> 'exit' AND (oi IS NULL OR s.idx < oi) AS shown FROM s JOIN o ON s.session_id = o.session_id),
w AS (SELECT *, bool_or(shown) OVER (PARTITION BY session_id) AS filled FROM v)""",
  "SELECT session_id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM w WHERE shown OR (NOT filled AND idx = 1) GROUP BY session_id")
