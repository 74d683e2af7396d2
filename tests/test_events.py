"""Cleaning, sessions, features and prefixes on hand-made events."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import ev, rows
from waymark.config import Settings
from waymark.operators import clean, features, models, ordered, sessions
from waymark.plans import checks
from waymark.session import configure
from waymark.sources import adapters

HOT = Settings(hot_rows=20, max_chunks=50)


def test_clean_drops_copies_unknown_names_and_secret_keys(frame):
    pay = ev(10, "payment_attempt", "checkout_payment", method="UPI", OTP="1234", card_number="4111")
    out = rows(clean.clean_events(frame([ev(0, "page_view", "home"), pay, pay, ev(20, "teleport", "home")])), "seq")
    assert [r["event"] for r in out] == ["page_view", "payment_attempt"]
    assert out[1]["metadata"] == {"method": "UPI"}
    assert all(r["product_id"] is None for r in out)
    assert [r["step"] for r in out] == ["browse", "payment"]


def test_text_metadata_is_parsed(spark, frame):
    df = frame([ev(0, "page_view", "home")]).withColumn("metadata", F.lit('{"a": 1.5, "pin": "x", "b": true}'))
    assert rows(clean.clean_events(df))[0]["metadata"] == {"a": "1.5", "b": "true"}


def test_live_validation_refuses_instead_of_dropping(frame):
    bad_id = ev(0, "page_view", "home", session="x" * 65)
    df = clean.validated(frame([ev(0, "page_view", "home", user="u_0123456789ab"), ev(1, "page_view", "home", Pin=1),
                                ev(2, "nope", "home"), ev(3, "page_view", "nowhere"), bad_id]))
    out = rows(df, "seq")
    assert [r["reject_reason"] for r in out] == [None, "forbidden_metadata", "event", "page", "session_id"]
    assert out[0]["user_id"] == "u_0123456789ab"
    assert out[1]["user_id"].startswith("u_") and len(out[1]["user_id"]) == 14 and out[1]["user_id"] != "u_1"


def sessionized(df, gap=30, settings=Settings()):
    return sessions.sessionize(clean.with_step(df), gap, settings)


def test_sessions_split_on_gap_and_tracker_change(frame):
    df = frame([ev(0, "page_view", "home"), ev(60, "search", "search"), ev(1920, "page_view", "home"),
                ev(1980, "page_view", "home", session="s_2")])
    assert [r["session_id"] for r in rows(sessionized(df), "seq")] == ["s_1", "s_1", "s_1_2", "s_2"]


def test_gap_of_exactly_the_limit_does_not_split_and_interleaving_counts(frame):
    df = frame([ev(0, "page_view", "home"), ev(1800, "page_view", "home")])
    assert [r["session_id"] for r in rows(sessionized(df), "seq")] == ["s_1", "s_1"]
    df = frame([ev(t, "page_view", "home", session=s) for t, s in enumerate("ABA")])
    assert [r["session_id"] for r in rows(sessionized(df), "seq")] == ["A", "B", "A_2"]


def test_shared_tracker_ids_count_on_across_users(frame):
    df = frame([ev(0, "page_view", "home", session="T", user="u_b"), ev(4000, "page_view", "home", session="T", user="u_b"),
                ev(10, "page_view", "home", session="T", user="u_a"), ev(20, "page_view", "home", session="T", user="u_c")])
    assert [r["session_id"] for r in rows(sessionized(df), "seq")] == ["T_2", "T_3", "T", "T_4"]


CASE = [
    ev(0, "page_view", "home", device="android_app", city_tier="tier_2", source="email", is_logged_in="true"),
    ev(10, "product_view", "product", "p_1", in_stock="true"), ev(40, "product_view", "product", "p_2", in_stock="true"),
    ev(70, "product_view", "product", "p_1", in_stock="true"), ev(80, "size_chart_open", "product", "p_1", available="false"),
    ev(90, "add_to_cart", "product", "p_1", cart_value=1999), ev(100, "checkout_start", "cart"),
    ev(110, "total_shown", "checkout_summary", delta_pct=12.5, handling_fee=99, total=2250), ev(120, "cart_view", "cart"),
    ev(130, "payment_attempt", "checkout_payment", method="UPI", gateway="B"),
    ev(160, "payment_failed", "checkout_payment", method="UPI", error="timeout"),
    ev(170, "payment_attempt", "checkout_payment", method="card", gateway="B"),
    ev(175, "payment_failed", "checkout_payment", method="card", error="card_declined"),
    ev(400, "exit", "checkout_payment"),
]


def test_features_of_one_session(frame):
    f = rows(features.session_features(sessionized(frame(CASE))))[0]
    expected = {"pdp_loops": 1, "unique_products": 2, "checkout_cart_loops": 1, "payment_failures": 2,
                "method_switches": 1, "payment_timeouts": 1, "size_chart_unavailable": 1, "max_extra_fees": 99,
                "max_total_delta_pct": 12.5, "exit_after_payment_failure": 1, "exit_dwell_s": 225, "cart_value": 1999,
                "n_events": 13, "is_android_app": 1, "city_tier_num": 2, "logged_in_at_start": 1,
                "dwell_payment_s": 270, "source_code": 4, "device_code": 1, "hour": 10, "is_weekend": 1,
                "max_gap_s": 225, "furthest_step_idx": 4, "current_step_idx": 4}
    assert {k: f[k] for k in expected} == expected


def test_session_of_only_exit_beacons(frame):
    df = frame([ev(0, "exit", "product", cart_value=5), ev(30, "exit", "cart")])
    f = rows(features.session_features(sessionized(df)))[0]
    assert (f["n_events"], f["exit_dwell_s"], f["furthest_step_idx"], f["cart_value"], f["dwell_product_s"]) == (1, 30, 1, 5, 30)
    t = rows(sessions.session_table(sessionized(df)))[0]
    assert (t["exit_step"], t["furthest_step"], t["n_events"]) == ("product", "product", 2)


def test_session_table(frame):
    t = rows(sessions.with_returning(sessions.session_table(sessionized(frame(CASE)))))[0]
    expected = {"n_events": 14, "duration_s": 400.0, "device": "android_app", "session_kind": "shopping",
                "furthest_step": "payment", "exit_step": "payment", "exit_page": "checkout_payment",
                "reached_cart": True, "converted": False, "abandoned": True, "has_exit_event": True, "gateway": "B",
                "payment_method": "card", "courier": None, "primary_product_id": "p_1", "order_id": None,
                "cart_value": 1999.0, "is_returning": True}
    assert {k: t[k] for k in expected} == expected


def walk(*pages):
    return [ev(i, e, p) for i, (e, p) in enumerate(pages)]


@pytest.mark.parametrize("pages,cuts", [
    ([("page_view", "home"), ("product_view", "product"), ("add_to_cart", "product"), ("cart_view", "cart"),
      ("payment_attempt", "checkout_payment"), ("payment_success", "checkout_payment"),
      ("order_placed", "order_confirmation"), ("page_view", "order_confirmation")], [1, 3, 4, 5]),
    ([("page_view", "home"), ("product_view", "product"), ("exit", "product")], [1, 2]),
])
def test_prefix_cuts(frame, pages, cuts):
    out = rows(features.prefix_cuts(sessionized(frame(walk(*pages)))), "prefix_len")
    assert [r["prefix_len"] for r in out] == cuts
    assert [r["is_final"] for r in out] == [False] * (len(cuts) - 1) + [True]


def test_last_eight_cuts_are_kept(frame):
    pages = [("page_view", "home"), ("product_view", "product")] * 6
    out = rows(features.prefix_cuts(sessionized(frame(walk(*pages)))), "prefix_len")
    assert [r["prefix_len"] for r in out] == list(range(5, 13))


def test_prefix_features_equal_features_of_the_cut_session(frame):
    events = CASE[:-1]
    prefixes = rows(features.prefix_features(sessionized(frame(events))), "prefix_len")
    assert len(prefixes) > 3
    for p in prefixes:
        full = rows(features.session_features(sessionized(frame(events[: p["prefix_len"]]))))[0]
        assert {k: p[k] for k in full} == full


def random_events(n, users, seed):
    rng = random.Random(seed)
    kinds = [("page_view", "home"), ("product_view", "product"), ("add_to_cart", "product"), ("cart_view", "cart"),
             ("total_shown", "checkout_summary"), ("payment_attempt", "checkout_payment"), ("exit", "home"),
             ("order_placed", "checkout_payment"), ("tracking_view", "order_tracking")]
    out = []
    for _ in range(n):
        e, p = rng.choice(kinds)
        u = rng.choice(users)
        out.append(ev(rng.randint(0, 40_000), e, p, rng.choice(["p_1", "p_2", None]), session=f"s_{u}_{rng.choice('ab')}"
                      if rng.random() < .2 else f"s_{u}_a", user=f"u_{u}", method=rng.choice(["UPI", "card"]),
                      cart_value=rng.randint(1, 99)))
    return out


def test_hot_users_give_the_same_results_in_chunks(frame):
    events = frame(random_events(400, ["x", "x", "x", "y", "z"], 7)).cache()
    plain, hot = sessionized(events, 15), sessionized(events, 15, HOT)
    assert ordered.CHUNK in hot.columns and ordered.CHUNK not in plain.columns
    assert hot.filter("chunk >= 0").select("chunk").distinct().count() > 5
    ids = lambda df: rows(df.select("seq", "session_id"), "seq")
    assert ids(plain) == ids(hot)
    for make, order in ((features.session_features, ["session_id"]), (sessions.session_table, ["session_id"]),
                        (features.prefix_features, ["session_id", "prefix_len"]),
                        (features.prefix_cuts, ["session_id", "prefix_len"]), (sessions.journeys, ["session_id"]),
                        (sessions.timeline, ["session_id", "idx"])):
        a, b = rows(make(plain), *order), rows(make(hot), *order)
        assert a == b, make.__name__


def test_sessionize_is_stable_and_keeps_every_event(frame):
    once = sessionized(frame(random_events(200, ["x", "y"], 3)), 15)
    twice = sessions.sessionize(once, 15)
    assert rows(once, "seq") == rows(twice, "seq") and once.count() == 200


def test_journey_collapses_repeats(frame):
    out = rows(sessions.journeys(sessionized(frame(CASE)), 4))[0]
    assert out["journey"] == ["page view", "product view", "size chart open", "add to cart"]


def test_rage_clicks(spark):
    from datetime import timedelta

    from conftest import T0
    at = [0, 500, 900, 1800, 1900, 5000, 5500, 6000, 7001, 599_500, 599_900, 600_100, 600_200]
    df = spark.createDataFrame([("s", "buy", T0 + timedelta(milliseconds=m)) for m in at], "session_id string, element string, timestamp timestamp")
    out = rows(sessions.rage_clicks(df), "timestamp")
    assert [(r["timestamp"] - T0).total_seconds() for r in out] == [1.8, 600.2]
    assert [r["window_ms"] for r in out] == [1800, 700]


def test_dwell_scores(frame):
    f = features.session_features(sessionized(frame(CASE + [ev(9000, "page_view", "home"), ev(9030, "page_view", "home")])))
    base = features.baseline_values(features.dwell_baselines(f))
    assert base["order"] == (0.0, 1.0) and base["payment"][1] == 1.0
    z = rows(features.add_dwell_z(f, base), "session_id")
    assert z[0]["dwell_z_order"] == 0.0 and abs(z[0]["dwell_z_browse"] + z[1]["dwell_z_browse"]) < 1e-9


@pytest.mark.parametrize("source", [adapters.clickstream, adapters.behaviour])
def test_filters_on_names_do_not_repeat_how_names_are_made(spark, tmp_path, source):
    made = spark.range(200).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 60) AS ts", "id % 7 AS user_id",
        "element_at(array('view', 'click', 'error', 'signup', 'purchase'), cast(id % 5 + 1 AS int)) AS event_type",
        "id / 4 AS value", "concat('{\"k\": ', id % 100, '}') AS props")
    made.write.parquet(str(tmp_path / "events.parquet"))
    raw = source(spark, str(tmp_path))
    kept = clean.valid_vocabulary(raw)
    assert kept.groupBy("user_id").count()._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 1
    names = {r["event"] for r in kept.select("event").distinct().collect()}
    assert "product_view" in names and "not_in_vocabulary" not in names
    assert raw.count() == 200 and kept.count() == raw.filter("event <> 'not_in_vocabulary'").count()


def test_shared_frames_are_built_once_for_equal_arguments(spark):
    built = []

    @checks.shared
    def frame_of(spark, folder, gap=5):
        built.append(gap)
        return gap

    assert [frame_of(spark, "a"), frame_of(spark, "a", 5), frame_of(spark, "a", 6)] == [5, 5, 6] and built == [5, 6]


def test_code_too_long_for_the_compiler_is_not_fused(spark):
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_themes_are_fitted_on_rows_dealt_out_evenly(spark):
    texts = spark.createDataFrame([(w, w) for w in ("one red", "two blue", "two green", "one pink") * 5], "text string, theme_label string").coalesce(1)
    model = models.ThemeModel.fit(texts)
    assert model.regression.summary.predictions.rdd.getNumPartitions() >= 4
    assert {(r["text"], r["predicted"]) for r in model.classify(texts).collect()} == {(c, c) for c in model.classes}


def test_message_cap_reads_sessions_that_are_stored(spark, tmp_path):
    spark.range(60).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id * 3600) AS ts", "id % 4 AS user_id", "'view' AS event_type",
                               "id / 4 AS value", "concat('{\"k\": ', id % 100, '}') AS props").write.parquet(str(tmp_path / "events.parquet"))
    out = checks.QUERIES["message_cap"](spark, str(tmp_path))
    assert "Relation [" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == checks._bare_sessions(spark, str(tmp_path)).count() > 0


def test_rule_and_risk_queries_clean_their_events_once(spark, tmp_path):
    spark.sql("SELECT id AS event_id, timestamp_seconds(1704067200 + id * 5000) AS ts, id % 7 AS user_id, element_at(array('view', 'click', 'error', 'purchase'), "
              "cast(id % 4 AS int) + 1) AS event_type, cast(id AS double) AS value, concat('{\"k\": ', id * 7 % 100, '}') AS props FROM range(600)") \
         .write.parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path)
    checks.forget()
    frames = [checks.QUERIES["rule_quality"](spark, folder), checks.QUERIES["clean_sessions_with_rules"](spark, folder), *checks._risk_training(spark, folder)]
    assert not any("Relation" in f._jdf.queryExecution().optimizedPlan().toString() for f in frames)
    assert sorted(map(tuple, checks._stored_flags(spark, folder).collect())) == sorted(map(tuple, checks._flags(spark, folder).collect()))
    wide = checks.session_rows(spark, folder, checks.SEQUENCE_GAP)
    assert {r.session_id: r.is_clean for r in checks._truth(spark, folder).collect()} == {r.session_id: r.n_events % 3 == 0 for r in wide.collect()}
    checks.forget()
