"""The decision layer on hand-made packets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from waymark import vocab
from waymark.config import Settings
from waymark.functions import decision as d
from waymark.functions.rules import evaluate_rules, rule_frictions
from waymark.operators import decide as dec
from waymark.operators import fusion

SCHEMA = ", ".join(f"{n} {t}" for n, t in dec.PACKET.items())


def packet(**kw):
    base = {"packet_id": "pk_s_1", "packet_type": "session", "session_id": "s_1", "user_id": "u_x",
            "session_kind": "shopping", "risk_score": .8, "cart_value": 2499.0, "converted": False, "rule_flags": [],
            "text_themes": [], "friction_probs": {}, "top_signals": [], "friction_signals": {}, "findings": []}
    return {**{k: None for k in dec.PACKET}, **base, **kw}


def aggregate(**kw):
    return packet(**{"packet_type": "aggregate", "packet_id": "agg_1", "session_kind": None, "friction_hint": "payment_failure",
                     "multiplier": 4.0, "affected_sessions": 40, "revenue_at_risk": 100000.0, **kw})


def sig(name, value=.3):
    return [(name, value)]


def finding(supports, kind):
    return ("t", "s", supports, kind, [("gateway", "A")], [("failed_sessions", 3.0)])


@pytest.fixture(scope="module")
def decided(spark):
    def run(*packets, moment=None):
        named = [dict(p, packet_id=f"{i:03d}") for i, p in enumerate(packets)]
        df = spark.createDataFrame([tuple(p[k] for k in dec.PACKET) for p in named], SCHEMA)
        return rows(dec.decide(df, moment=moment), "packet_id")

    return run


def test_classification(decided):
    cases = [
        (packet(rule_flags=["coupon_retry_x2"], friction_probs={"payment_failure": .95}, text_themes=["app_bug"]),
         ("coupon_failure", "payment_failure", "rules")),
        (packet(rule_flags=["size_chart_x3", "payment_retry_x2"]), ("payment_failure", "unclear_product_info", "rules")),
        (packet(friction_probs={"price_shock": .7, "coupon_failure": .65}), ("price_shock", "coupon_failure", "classifier")),
        (packet(text_themes=["login_issue"], friction_probs={"login_otp_issue": .3}), ("login_otp_issue", None, "themes")),
        (packet(friction_probs={"technical_glitch": .2}), ("technical_glitch", "unclear_product_info", "weak_classifier")),
        (aggregate(rule_flags=["coupon_retry_x2"]), ("payment_failure", "coupon_failure", "aggregate_metric")),
    ]
    out = decided(*[p for p, _ in cases])
    got = [(r["friction_type"], r["secondary_friction"], r["classification_source"]) for r in out]
    assert got == [e for _, e in cases]


def test_confidence(decided):
    nine = {"payment_failure": .9}
    full = packet(rule_flags=["payment_retry_x2"], friction_probs=nine, top_signals=sig("payment_failures"),
                  text_themes=["money_deducted"], friction_hint="payment_failure", multiplier=4.0)
    cases = [
        (full, 1.0),
        (packet(rule_flags=["payment_retry_x2"]), .3),
        (packet(friction_probs=nine, top_signals=sig("searches")), 0.0),
        (packet(friction_probs=nine, friction_signals={"payment_failure": sig("payment_failures")}), .3),
        (packet(friction_probs={"payment_failure": .59}, top_signals=sig("payment_failures")), 0.0),
        (packet(rule_flags=["tracking_view_x3"], session_kind="post_purchase", findings=[
            finding("post_purchase_concern", "text"), finding("post_purchase_concern", "aggregate")]), .7),
        (packet(rule_flags=["payment_retry_x2"], findings=[finding("coupon_failure", "text")]), .3),
        (aggregate(rule_support_share=.6, model_support_share=.5, top_signals=sig("payment_failures")), .8),
        (aggregate(rule_support_share=.1, model_support_share=.1, top_signals=sig("payment_failures")), .2),
    ]
    assert [r["confidence"] for r in decided(*[p for p, _ in cases])] == [e for _, e in cases]


def test_gates_and_priority(spark):
    scores = spark.createDataFrame([(x,) for x in (1.0, .8, .79, .5, .49, 0.0)], "s double")
    assert [r["g"] for r in rows(scores.select(d.gate(F.col("s")).alias("g")))] == ["high", "high", "medium", "medium", "low", "low"]
    cases = [(100000.0, 40, 4.0), (30000.0, 5, 1.5), (2499.0, 1, 1.0)]
    df = spark.createDataFrame(cases, "r double, n int, t double").withColumn("i", d.impact(F.col("r"), F.col("n"), F.col("t")))
    out = rows(df.withColumn("p", d.priority(F.col("i"))))
    assert out[0]["i"] == pytest.approx(1.4854e6, rel=1e-3)
    assert [r["p"] for r in out] == ["critical", "high", "normal"]
    trend = spark.createDataFrame([(None,), (.4,), (12.0,)], "m double").select(d.trend_factor(F.col("m")).alias("t"))
    assert [r["t"] for r in rows(trend)] == [1.0, 1.0, 5.0]


def test_playbook(decided):
    out = decided(packet(rule_flags=["money_deducted_failed_payment"]), packet(rule_flags=["payment_retry_x2"]), aggregate(),
                  packet(rule_flags=["hidden_fees_shown"], session_kind="post_purchase"))
    assert [r["customer_action"] and r["customer_action"]["id"] for r in out] == [
        "refund_reassurance", "retry_payment_link", "retry_payment_link", None]
    assert [r["team_action"]["id"] for r in out] == [
        "review_payment_errors", "review_payment_errors", "check_or_switch_gateway", "show_full_cost_early"]
    assert decided(packet(rule_flags=["otp_failed"]), moment="in_session")[0]["customer_action"]["id"] == "alternate_otp_channel"


def test_money_actions_never_run_alone():
    for friction, kind, name, _, _, auto, template, _, _, terms, _ in vocab.PLAYBOOK:
        assert template in vocab.TEMPLATES and friction in vocab.FRICTIONS
        if {"refund", "coupon"} & set(terms):
            assert not auto or name == "explain_coupon_rejection"


def test_medium_packets_are_decided_again(spark):
    base = dict(rule_flags=["payment_retry_x2"], friction_probs={"payment_failure": .9}, top_signals=sig("payment_failures"))
    ps = [packet(packet_id="a", **base), packet(packet_id="b", **base, ), packet(packet_id="c")]
    df = spark.createDataFrame([tuple(p[k] for k in dec.PACKET) for p in ps], SCHEMA)
    found = spark.createDataFrame([("a", [finding("payment_failure", "aggregate")])], f"packet_id string, findings {dec.FINDINGS}")
    out = rows(dec.decide_with_findings(df, found), "packet_id")
    assert [(r["gate"], r["confidence"], r["investigated"]) for r in out] == [("high", .8, True), ("medium", .6, True), ("low", 0.0, False)]
    one = rows(dec.decide_with_findings(df, found, limit=1), "packet_id")
    assert [r["investigated"] for r in one] == [True, False, False]


def test_rules(spark):
    df = spark.createDataFrame(
        [(2.0, 1.0, 3.0, 1.0), (0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 0.0)],
        "payment_failures double, coupon_failures double, otp_resends double, exit_after_total_shown double")
    out = rows(evaluate_rules(df).withColumn("f", rule_frictions(F.col("rule_flags"))))
    assert out[0]["rule_flags"] == ["payment_retry_x2", "otp_resend_x2", "exit_after_total_shown"]
    assert out[0]["f"] == ["payment_failure", "login_otp_issue", "price_shock"]
    assert out[1]["rule_flags"] == out[2]["rule_flags"] == []
    assert {r[1] for r in vocab.RULES} == set(vocab.FRICTIONS) and len(vocab.RULES) == 37


def test_at_risk(spark):
    df = spark.createDataFrame(
        [(.1, ["x"], [], True), (.1, [], ["money_deducted"], True), (.1, [], ["other"], False), (.7, [], [], False), (.7, [], [], True)],
        "risk_score double, rule_flags array<string>, text_themes array<string>, converted boolean")
    assert [r["a"] for r in rows(df.select(fusion.at_risk().alias("a")))] == [True, True, False, True, False]


def test_themes_by_session_and_order(spark):
    texts = spark.createDataFrame([("t1", "s_1", None, "app_bug", 1), ("t2", None, "o_9", "delivery_delay", 2)],
                                  "text_id string, session_id string, order_id string, theme string, ts int")
    sess = spark.createDataFrame([("s_1", None), ("s_2", "o_9")], "session_id string, order_id string")
    assert rows(fusion.session_themes(texts, sess), "session_id") == [
        {"session_id": "s_1", "themes": ["app_bug"]}, {"session_id": "s_2", "themes": ["delivery_delay"]}]


def test_enrichment_and_context(spark):
    from datetime import datetime
    packets = spark.createDataFrame(
        [("agg_1", "gateway", "B", "m", "payment_failure", datetime(2026, 9, 22), datetime(2026, 9, 23), .8, .2, 7.0, 4.0, 2)],
        "packet_id string, segment_type string, segment_value string, metric string, friction_hint string, window_start timestamp, "
        "window_end timestamp, observed double, baseline double, z_score double, multiplier double, affected_sessions bigint")
    members = spark.createDataFrame([("agg_1", "s_1"), ("agg_1", "s_2")], "packet_id string, session_id string")
    scores = spark.createDataFrame(
        [("s_1", ["payment_retry_x2"], {"payment_failure": .9}, sig("payment_failures"), {}), ("s_2", [], {"payment_failure": 0.0}, [], {})],
        f"session_id string, rule_flags array<string>, friction_probs map<string,double>, top_signals {dec.SIGNALS}, friction_signals map<string,{dec.SIGNALS}>")
    themes = spark.createDataFrame([("s_1", ["money_deducted"])], "session_id string, themes array<string>")
    out = rows(fusion.enrich_aggregates(packets, members, scores, themes))[0]
    assert out["rule_support_share"] == .5 and out["model_support_share"] == .5
    assert out["text_themes"] == ["money_deducted"] and out["rule_flags"] == ["payment_retry_x2"]
    assert out["friction_probs"]["payment_failure"] == .45
    assert out["friction_signals"]["payment_failure"] == [{"feature": "payment_failures", "value": .15}]
    context = rows(fusion.session_context(packets, members), "session_id")
    assert context[0]["aggregate_context"]["friction_hint"] == "payment_failure" and context[0]["aggregate_context"]["multiplier"] == 4.0


def test_settings_keep_their_invariants():
    for bad in (dict(weight_rule=.5), dict(gate_medium=.9), dict(impact_high=1e6)):
        with pytest.raises(ValueError):
            Settings(**bad)
