"""Actions, drafts, investigation, metrics and models on small hand-made tables."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from waymark import vocab
from waymark.config import Settings
from waymark.operators import actions, boosting, drafts, fusion, investigate, metrics, models, readmodels
from waymark.operators.ranges import range_sums

NOW = datetime(2026, 9, 20, 10)


def brute_cap(messages, limit=2):
    sent, out = {}, {}
    for pid, user, at in sorted(messages, key=lambda m: (m[2], m[0])):
        recent = [t for t in sent.get(user, []) if at - t < timedelta(hours=24)]
        out[pid] = len(recent) < limit
        if out[pid]:
            sent[user] = [*recent, at]
    return out


@pytest.mark.parametrize("settings", [Settings(), Settings(hot_rows=20, max_chunks=20)])
def test_message_cap_equals_a_plain_walk(spark, settings):
    rng = random.Random(5)
    messages = [(f"p{i:03d}", rng.choice("aaab"), NOW + timedelta(minutes=rng.choice([60, 7]) * rng.randint(0, 300))) for i in range(150)]
    df = spark.createDataFrame(messages, "packet_id string, user_id string, created_at timestamp")
    got = {r["packet_id"]: r["accepted"] for r in rows(actions.message_cap(df, settings))}
    assert got == brute_cap(messages) and not all(got.values())


def test_message_cap_of_one_crowded_user_needs_no_walk(spark):
    """A million messages of one user in many chunks, against a plain walk; earlier messages count and are not judged."""
    n = 1_000_000
    messages = spark.range(n).select(
        F.format_string("p%07d", "id").alias("packet_id"), F.lit("u").alias("user_id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 7_000_000 + F.pmod(F.xxhash64("id"), F.lit(40_000_000))).alias("created_at"))
    earlier = spark.createDataFrame([("u", datetime(2023, 11, 20, 5)), ("u", datetime(2023, 11, 20, 6)), ("u", datetime(2023, 11, 20, 7))],
                                    "user_id string, created_at timestamp")
    out = actions.message_cap(messages, Settings(hot_rows=60_000, max_chunks=40), earlier)
    got = {r.packet_id for r in out.filter("accepted").collect()}
    walk = [(r.at, r.packet_id) for r in messages.select(F.unix_micros("created_at").alias("at"), "packet_id").collect()]
    walk += [(r.at, None) for r in earlier.select(F.unix_micros("created_at").alias("at")).collect()]
    sent, expected = [], set()
    for at, pid in sorted(walk, key=lambda m: (m[0], m[1] or "")):
        if pid is None or sum(at - t < 86_400_000_000 for t in sent[-2:]) < 2:
            sent.append(at)
            expected |= {pid} - {None}
    assert got == expected and out.count() == n


def plain_workflow(status, assigned, team, requests):
    for rid, action, assignee in requests:
        before = status
        if action not in vocab.TRANSITIONS:
            yield rid, before, before, f"unknown action {action or 'null'}", assigned
            continue
        allowed, target = vocab.TRANSITIONS[action]
        if before not in allowed:
            yield rid, before, before, f"cannot {action} an alert that is {before}", assigned
            continue
        if action == "assign":
            assigned = assignee or f"{team}_queue"
        status = target or before
        yield rid, before, status, None, assigned


@pytest.mark.parametrize("settings", [Settings(), Settings(hot_rows=40, max_chunks=30)])
def test_workflow_equals_a_plain_walk(spark, settings):
    rng = random.Random(9)
    starts = [("open", None), ("needs_review", "kim"), ("assigned", None), ("resolved", None), ("archived", None)]
    alerts = [(f"al_{i}", f"pk_{i}", "ops", *starts[i]) for i in range(5)]
    choice = [*["assign", "create_ticket"] * 6, "approve", "dismiss", "resolve", "unheard_of", None]
    requests = [(k, f"al_{rng.choice([0, 0, 0, 1, 2, 3, 4])}", rng.choice(choice), rng.choice([None, "", "lee"]), NOW + timedelta(seconds=rng.randint(0, 400)))
                for k in range(400)]
    df = spark.createDataFrame(requests, "request_id bigint, alert_id string, action string, assignee string, requested_at timestamp").selectExpr(
        "*", "'ann' actor", "cast(null as string) note")
    out = rows(actions.workflow(spark.createDataFrame(alerts, "alert_id string, packet_id string, owner_team string, status string, assigned_to string"), df, settings))
    got = {r["request_id"]: (r["from_status"], r["to_status"], r["rejected"], r["assignee_after"]) for r in out}
    expected = {}
    for alert, _, team, status, assigned in alerts:
        mine = sorted((at, k, action, who) for k, a, action, who, at in requests if a == alert)
        expected |= {rid: tuple(rest) for rid, *rest in plain_workflow(status, assigned, team, [(k, action, who) for _, k, action, who in mine])}
    assert got == expected and sum(v[2] is None for v in got.values()) > 20


def test_workflow_states_and_tickets(spark):
    alerts = spark.createDataFrame([("al_1", "pk_1", "product", "open", None, None)],
                                   "alert_id string, packet_id string, owner_team string, status string, assigned_to string, updated_at timestamp")
    names = ["resolve", "create_ticket", "assign", "approve", "resolve", "dismiss", "create_ticket"]
    reqs = spark.createDataFrame([(i, "al_1", a, "ann", None, None, NOW + timedelta(minutes=i)) for i, a in enumerate(names)],
                                 "request_id bigint, alert_id string, action string, actor string, assignee string, note string, requested_at timestamp")
    done = actions.workflow(alerts, reqs)
    out = rows(done, "request_id")
    assert [r["to_status"] for r in out] == ["open", "open", "assigned", "approved", "resolved", "resolved", "resolved"]
    assert out[0]["rejected"] == "cannot resolve an alert that is open" and out[5]["rejected"] and out[1]["ticket_ref"] == "TKT-al_1-001"
    state = rows(actions.apply_workflow(alerts, done))[0]
    assert (state["status"], state["assigned_to"]) == ("resolved", "product_queue")
    rec = spark.createDataFrame([("pk_1", "pending_approval"), ("pk_2", "pending_approval"), ("pk_1", "sent")], "packet_id string, status string")
    assert sorted(r["status"] for r in rows(actions.release_pending(rec, done))) == ["approved", "pending_approval", "sent"]


@pytest.mark.parametrize("settings", [Settings(), Settings(hot_rows=50, max_chunks=20)])
def test_range_sums_equal_pairing(spark, settings):
    rng = random.Random(1)
    facts = [(rng.choice("aab"), NOW + timedelta(minutes=rng.randint(0, 500)), 1) for _ in range(300)]
    probes = [(i, rng.choice("abc"), NOW + timedelta(minutes=rng.randint(0, 500))) for i in range(60)]
    f = spark.createDataFrame(facts, "k string, at timestamp, n bigint")
    p = spark.createDataFrame([(i, k, t - timedelta(minutes=30), t + timedelta(minutes=30)) for i, k, t in probes], "probe_id int, k string, lo timestamp, hi timestamp")
    got = {r["probe_id"]: r["n"] for r in rows(range_sums(p, f, "k", ["n"], settings))}
    for i, k, t in probes:
        assert got[i] == sum(1 for fk, at, _ in facts if fk == k and abs(at - t) <= timedelta(minutes=30))


GOOD = {"summary": "Payment failures on gateway B are 4.0x the baseline.",
        "behavior_observed": "The customer had 2 failed payment attempts with a cart of 2499 and then left.",
        "likely_business_cause": "Gateway B instability, not price.", "evidence_used": ["rule_flags", "multiplier", "cart_value"]}
EVIDENCE = {"rule_flags": ["payment_retry_x2"], "cart_value": 2499.0, "failed": 2, "aggregate_context": {"multiplier": 4.0}}
BAD = [
    ("{not json", "schema"), (json.dumps({"summary": "x"}), "schema"), (json.dumps({**GOOD, "extra_field": "x"}), "schema"),
    (json.dumps({**GOOD, "behavior_observed": "The customer failed 7 payments worth 9,999."}), "grounding: number"),
    (json.dumps({**GOOD, "evidence_used": ["gateway_latency_ms"]}), "grounding: evidence key"),
    (json.dumps({**GOOD, "likely_business_cause": "A coupon failure on checkout."}), "consistency"),
    (json.dumps({**GOOD, "summary": "Recommend check_or_switch_gateway right away."}), "consistency: mentions a different action"),
    (json.dumps({**GOOD, "summary": "Give every customer a 20% discount."}), "policy"),
    (json.dumps({**GOOD, "summary": "Offer cashback to affected users."}), "policy"),
    (json.dumps({**GOOD, "summary": "Customer u_0123456789ab failed twice."}), "policy: contains a customer"),
    (json.dumps({**GOOD, "summary": "Call the customer at 9876543210."}), "policy"),
    (json.dumps({**GOOD, "summary": "We guarantee it is fixed."}), "policy: banned phrase"),
]


def test_bad_drafts_fall_back(spark):
    cases = [(json.dumps(GOOD), None), *BAD]
    df = spark.createDataFrame(
        [(i, "explanation", draft, json.dumps(EVIDENCE), "payment_failure", ["review_payment_errors"], ["reversed"], [], "plain text") for i, (draft, _) in enumerate(cases)],
        "draft_id int, kind string, draft string, evidence string, friction_type string, action_ids array<string>, allowed_terms array<string>, allowed_frictions array<string>, fallback string")
    out = rows(drafts.validate(df), "draft_id")
    assert out[0]["ok"] and out[0]["final"] == json.dumps(GOOD), out[0]["failures"]
    for r, (_, reason) in zip(out[1:], BAD):
        assert not r["ok"] and r["final"] == "plain text" and any(f.startswith(reason) for f in r["failures"]), (reason, r["failures"])


def test_grounding_accepts_rounding_and_percentages(spark):
    df = spark.createDataFrame([("82% vs 20% baseline, 4.1x, about 41,500",), ("95% of sessions",), ("code x12",)], "t string")
    evidence = F.lit(json.dumps({"observed": 0.82, "baseline": 0.2, "multiplier": 4.1, "revenue": 41500.0}))
    out = rows(df.select(F.size(drafts.grounding_failures(F.array("t"), evidence, F.lit(None).cast("array<string>"))).alias("n")))
    assert [r["n"] for r in out] == [0, 1, 1]


def test_policy_terms(spark):
    df = spark.createDataFrame([("Any debited amount will be reversed",), ("Visit www.shop.example",)], "t string")
    count = lambda terms: [r["n"] for r in rows(df.select(F.size(drafts.policy_failures(F.col("t"), F.array(*[F.lit(x) for x in terms]).cast("array<string>"))).alias("n")))]
    assert count(["reversed"]) == [0, 1] and count([]) == [1, 1]


def test_ranking_metrics_equal_a_plain_loop(spark):
    rng = random.Random(3)
    data = [(rng.choice([.1, .1, .4, .4, .7, 1.5, -2.0]), int(rng.random() < .4)) for _ in range(200)]
    got = rows(metrics.ranking_metrics(spark.createDataFrame(data, "score double, label int")))[0]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auc = sum((p > n) + .5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ap, seen = 0.0, 0
    for s in sorted({s for s, _ in data}, reverse=True):
        hit = sum(1 for p in pos if p >= s)
        ap += (hit - seen) / len(pos) * hit / sum(1 for x, _ in data if x >= s)
        seen = hit
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap)
    assert got["brier"] == pytest.approx(sum((s - y) ** 2 for s, y in data) / 200)


def test_models_learn_and_explain(spark, tmp_path):
    df = spark.range(1500).select(
        F.concat(F.lit("s_"), "id").alias("session_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c")).cache()
    frame = df.withColumn("label", (F.col("a") > 0.5).cast("double"))
    model = models.RiskModel.fit(frame, features=["a", "b", "c"], rounds=8, leaves=6)
    test = model.score(frame.filter(metrics.is_test(F.col("session_id"))))
    assert rows(metrics.ranking_metrics(test, "risk"))[0]["average_precision"] > 0.9
    model.save(str(tmp_path / "risk"))
    again = models.RiskModel.load(spark, str(tmp_path / "risk"), ["a", "b", "c"])
    assert rows(again.score(frame).select("risk")) == rows(model.score(frame).select("risk"))
    out = rows(models.attributed(frame, model.nodes, ["a", "b", "c"]).join(frame, "session_id").filter("a > 0.6"))
    assert all(r["signals"]["risk"][0]["feature"] == "a" for r in out)
    # several models at once: each row has the models it wants, and those say what they say alone
    labels = frame.select("session_id", F.col("label").cast("int").alias("x"), (F.col("b") > 0.7).cast("int").alias("y"))
    both = models.FrictionModel.fit(frame, labels, features=["a", "b", "c"], rounds=8, leaves=6, frictions=["x", "y"])
    wanted = frame.withColumn("_top", F.when(F.col("b") > 0.5, F.array(F.lit("x"), F.lit("y"))).when(F.col("b") > 0.2, F.array(F.lit("y"))))
    each = {r["session_id"]: r["signals"] for r in rows(models.attributed(wanted, both.nodes, ["a", "b", "c"], "_top"))}
    every = {r["session_id"]: r["signals"] for r in rows(models.attributed(frame, both.nodes, ["a", "b", "c"]))}
    assert all(each[r["session_id"]] == {f: every[r["session_id"]][f] for f in r["_top"] or []} for r in rows(wanted))
    probs = rows(both.score(frame))
    assert sum((r["friction_probs"]["y"] > 0.5) == (r["b"] > 0.7) for r in probs) > 1400
    # contributions add up to the difference between the score and the roots
    found = boosting.ensembles(both.nodes)["y"]
    x = np.array([[.2, .3, .4], [.9, .9, .5]])
    assert found.score(x) == pytest.approx(found.base + sum(t.value[0] for t in found.trees) + found.contributions(x).sum(1))


def test_boosting_needs_its_interactions_and_any_order_of_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    nodes = boosting.fitted(x[:2000], y[:2000], boosting.Growth(80))
    table = spark.createDataFrame([("m", *map(lambda v: v.item() if hasattr(v, "item") else v, n)) for n in nodes], boosting.NODES)
    odds = boosting.ensembles(table)["m"].score(x[2000:])
    assert ((odds > 0) == (y[2000:] > 0)).mean() > 0.95
    assert max(sum(1 for n in nodes if n[0] == t and n[2] < 0) for t in range(80)) <= 31
    frame = spark.createDataFrame([(f"s{i}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x[:400], y[:400]))], "k string, " + ", ".join(f"c{i} double" for i in range(6)) + ", y double")
    names = [f"c{i}" for i in range(6)]
    one, two = (sorted(map(tuple, boosting.fit(f, "k", names, ["y"], boosting.Growth(5, 8)).collect())) for f in (frame.repartition(1), frame.repartition(9)))
    assert one == two
    flat = boosting.fit(frame.withColumn("y", F.lit(1.0)), "k", names, ["y"], boosting.Growth(3, 8)).collect()
    assert len(flat) >= 4


def test_theme_gate_falls_back(spark):
    texts = spark.createDataFrame([("refund money card",)] * 20 + [("size chart small",)] * 20 + [("hello there",)], "text string").withColumn(
        "theme_label", F.when(F.contains("text", F.lit("refund")), "payment_trust").otherwise("size_fit"))
    model = models.ThemeModel.fit(texts.limit(40))
    out = {r["text"]: r for r in rows(models.classify_distinct(model, texts))}
    assert out["refund money card"]["theme"] == "payment_trust" and out["refund money card"]["theme_method"] == "classifier"
    assert out["hello there"]["theme"] == "other" and out["hello there"]["theme_method"] == "fallback"


def test_health_and_products(spark):
    stock = spark.createDataFrame([("p_1", True, {"S": 0, "M": 3})], "product_id string, in_stock boolean, stock map<string,int>")
    assert rows(investigate.stock_check(stock))[0]["sizes_out_of_stock"] == ["S"]
    packets = spark.createDataFrame(
        [("session", "price_shock", "high", NOW - timedelta(days=d)) for d in (0, 0, 1, 9)], "packet_type string, friction_type string, gate string, created_at timestamp")
    alerts = spark.createDataFrame([("coupon_failure", "high", "open")], "friction_type string, priority string, status string")
    out = {r["friction_type"]: r for r in rows(readmodels.health(packets, alerts))}
    assert out["price_shock"]["status"] == "rising" and out["price_shock"]["recent_per_day"] == 1.0
    assert out["coupon_failure"]["status"] == "normal" and set(out) == set(vocab.FRICTIONS)


def test_recent_messages_read_their_input_once(spark):
    sent = spark.range(40).selectExpr("concat('pk_', id) packet_id", "concat('u_', id % 3) user_id", "timestamp_seconds(id * 7200) created_at")
    out = actions.recent_messages(sent)
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    times = {i: i * 7200 for i in range(40)}
    expected = {f"pk_{i}": sum(j % 3 == i % 3 and t - 86400 <= times[j] <= t for j in times) for i, t in times.items()}
    assert {r.packet_id: r.recent for r in out.collect()} == expected


def test_themes_of_few_orders_go_to_the_sessions(spark):
    texts = spark.sql("SELECT id AS text_id, cast(null AS string) AS session_id, concat('o_', id % 4) AS order_id, concat('t', id % 2) AS theme, "
                      "timestamp_seconds(id) AS ts FROM range(12)")
    table = spark.sql("SELECT concat('s_', id) AS session_id, CASE WHEN id % 3 > 0 THEN concat('o_', id % 5) END AS order_id FROM range(30)")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fusion.session_themes(texts, table)
        assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
        found = {r.session_id: r.themes for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {f"s_{i}": [f"t{i % 5 % 2}"] for i in range(30) if i % 3 and i % 5 < 4}


def test_tasks_are_cut_by_bytes_however_few_partitions_a_session_has(spark):
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def _forest(rng, trees, leaves, features):
    """Random trees as rows of a node table."""
    out = [("m", -1, 0, -1, -1, -1, 0.0, 0.25)]
    for tree in range(trees):
        nodes = [[-1, -1, -1, 0.0, float(rng.normal())]]
        ends = [0]
        while len(ends) < leaves:
            node = ends.pop(int(rng.integers(len(ends))))
            nodes[node][:4] = [len(nodes), len(nodes) + 1, int(rng.integers(features)), float(rng.integers(40)) / 4]
            ends += [len(nodes), len(nodes) + 1]
            nodes += [[-1, -1, -1, 0.0, float(rng.normal())] for _ in range(2)]
        out += [("m", tree, n, *node) for n, node in enumerate(nodes)]
    return out


def _walked(table, x):
    """Scores and contributions, node by node."""
    score, moved = np.full(len(x), 0.25), np.zeros(x.shape)
    trees = {}
    for _, tree, *node in table[1:]:
        trees.setdefault(tree, []).append(node[1:])
    for nodes in trees.values():
        at = np.zeros(len(x), int)
        left, right, feature, threshold, value = (np.array(c) for c in zip(*nodes))
        while (r := np.flatnonzero(left[at] >= 0)).size:
            n = at[r]
            at[r] = np.where(x[r, feature[n]] <= threshold[n], left[n], right[n])
            np.add.at(moved, (r, feature[n]), value[at[r]] - value[n])
        score += value[at]
    return score, moved


@pytest.mark.parametrize("leaves", [1, 5, 31, 32, 33, 64, 90])
def test_leaf_tables_equal_a_walk(spark, leaves):
    rng = np.random.default_rng(leaves)
    table = _forest(rng, 6, leaves, 5)
    x = rng.integers(-4, 50, (700, 5)) / 4  # many values lie on a threshold
    x[::50, 2], x[1::50, 3] = np.nan, np.inf
    found = boosting.ensembles(spark.createDataFrame(table, boosting.NODES))["m"]
    score, moved = _walked(table, x)
    assert np.allclose(found.score(x), score, atol=1e-12)
    assert np.allclose(found.contributions(x), moved, atol=1e-12)
    assert found.score(x[:0]).shape == (0,) and found.contributions(x[:0]).shape == (0, 5)


def test_scoring_takes_no_step_per_level_of_a_tree(spark):
    rng = np.random.default_rng(3)
    table = _forest(rng, 60, 31, 20)
    x = rng.integers(-4, 50, (10_000, 20)) / 4
    found = boosting.ensembles(spark.createDataFrame(table, boosting.NODES))["m"]

    def best(fn):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            fn(x)
            took.append(time.perf_counter() - start)
        return min(took)

    assert best(found.score) * 2 < best(lambda rows_: _walked(table, rows_))
