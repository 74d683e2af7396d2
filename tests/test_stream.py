"""Live path on a file stream: ingest, scoring, restart, idle sessions."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import T0, rows
from waymark import vocab
from waymark.config import Settings
from waymark.operators import actions, drafts, features, investigate
from waymark.operators.clean import with_step
from waymark.sources.current import CurrentTable
from waymark.streaming import ingest, live, state

FLAT = {s: (0.0, 1.0) for s in vocab.STEPS}


def event(t, name, page, session="s_1", **more):
    return {"session_id": session, "user_id": "u_0123456789ab", "timestamp": (T0 + timedelta(seconds=t)).isoformat(),
            "event": name, "page": page, **more}


def drop(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in events))


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    first = [event(0, "page_view", "home", metadata={"device": "android_app"}), event(60, "payment_attempt", "checkout_payment", metadata={"method": "UPI"}),
             event(70, "payment_failed", "checkout_payment"), event(1, "page_view", "home", metadata={"Email": "x"}), event(2, "nope", "home"),
             event(3, "page_view", "home", surprise=1), event(5, "search", "search", session="s_2")]
    drop(inbox, "a.json", first)
    start = lambda: live.run(ingest.read_lines(spark, str(inbox)), out, str(tmp_path / "ck"), FLAT).awaitTermination()
    start()
    refused = rows(spark.read.parquet(f"{out}/quarantine"), "reject_reason")
    assert [r["reject_reason"] for r in refused] == ["event", "extra_field", "forbidden_metadata"]
    # one failure at the end is a packet already; a second one, and an earlier event that arrives late, in a list; the query is started again
    inbox.joinpath("b.json").write_text(json.dumps([event(80, "payment_failed", "checkout_payment"), event(30, "search", "search")]))
    start()
    packet = {r["session_id"]: r for r in rows(live.packets_table(spark, out).read())}["s_1"]
    assert packet["rule_flags"] == ["payment_retry_x2", "exit_after_payment_failure"]
    assert (packet["friction_type"], packet["gate"], packet["packet_id"]) == ("payment_failure", "low", "pk_live_s_1")
    stored = spark.read.parquet(f"{out}/live_events")
    assert stored.count() == 6
    f = rows(features.session_features(with_step(stored)).filter("session_id = 's_1'"))[0]
    assert (f["searches"], f["payment_failures"], f["duration_s"], f["dwell_browse_s"]) == (1, 2, 80, 60)
    drop(inbox, "c.json", [event(90, "exit", "checkout_payment")])
    start()
    # three batches give what one batch job over the stored events gives
    stored = spark.read.parquet(f"{out}/live_events")
    batch = rows(live.live_packets(stored, FLAT).select("packet_id", "rule_flags", "cart_value", "exit_step", "start"), "packet_id")
    streamed = rows(live.packets_table(spark, out).read().select("packet_id", "rule_flags", "cart_value", "exit_step", "start"), "packet_id")
    assert batch == streamed and streamed


def test_batches_read_their_own_sessions_only(spark, tmp_path):
    """What a batch hands to scoring is the history of its sessions, from the state; quiet sessions follow when their time is over."""
    inbox, seen = tmp_path / "in", []
    brief = Settings(idle_minutes=0.005)

    def go(name, events):
        drop(inbox, name, events)
        stream = state.with_history(ingest.validated(ingest.parsed(ingest.read_lines(spark, str(inbox)))), brief)
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(
            lambda b, _: seen.append(sorted((r["kind"], r["session_id"], r["event"] or "", r["seq"], r["fresh"]) for r in b.collect())))
        state.started(query, spark, wait_for_timers=False).awaitTermination()
        time.sleep(0.5)

    go("a.json", [event(5, "search", "search"), event(0, "page_view", "home"), event(0, "page_view", "home", session="s_2")])
    go("b.json", [event(3, "search", "search", session="s_3"), event(4, "nope", "home", session="s_3")])
    go("c.json", [event(2, "cart_view", "cart")])
    assert seen[0] == [("event", "s_1", "page_view", 0, True), ("event", "s_1", "search", 1, True), ("event", "s_2", "page_view", 0, True)]
    assert seen[1] == [("event", "s_3", "search", 0, True), ("idle", "s_1", "", None, False), ("idle", "s_2", "", None, False), ("refused", "s_3", "nope", None, True)]
    assert [r for r in seen[2] if r[0] == "event"] == [("event", "s_1", "cart_view", 2, True), ("event", "s_1", "page_view", 0, False), ("event", "s_1", "search", 1, False)]


def test_idle_sessions_close_and_rates_are_windowed(spark, tmp_path):
    inbox = tmp_path / "in"
    drop(inbox, "a.json", [event(0, "payment_attempt", "checkout_payment", metadata={"gateway": "B"}), event(10, "payment_failed", "checkout_payment", metadata={"gateway": "B"}),
                           event(400, "page_view", "home", session="s_2"), event(410, "order_placed", "checkout_payment", session="s_2")])
    drop(inbox, "b.json", [event(9000, "payment_attempt", "checkout_payment", session="s_3", metadata={"gateway": "B"})])

    def stream():
        return ingest.parsed(ingest.read_lines(spark, str(inbox), maxFilesPerTrigger="1"))

    got = []
    for i, df in enumerate((ingest.idle_sessions(stream()), ingest.failure_rates(stream()))):
        path = str(tmp_path / f"o{i}")
        q = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        q.awaitTermination()
        got.append(rows(spark.read.parquet(path)))
    assert sorted((r["session_id"], r["events"], r["converted"]) for r in got[0]) == [("s_1", 2, False), ("s_2", 2, True)]
    assert [(r["gateway"], r["attempts"], r["failed"]) for r in got[1]] == [("B", 1, 1)]


def always_high(full, risk_view):
    """Scores that make every session a certain payment failure; the number of events the risk model saw is kept."""
    seen = risk_view.select("session_id", F.col("n_events").cast("double").alias("risk_score"))
    return live.rules_only(full, risk_view).drop("risk_score").join(seen, "session_id").withColumns({
        "rule_flags": F.array(F.lit("payment_retry_x2"), F.lit("exit_after_payment_failure")),
        "friction_probs": F.create_map(F.lit("payment_failure"), F.lit(1.0)),
        "risk_score": F.least(F.col("risk_score") / 100, F.lit(1.0))})


def test_late_events_are_scored_and_recorded(spark, tmp_path):
    out = str(tmp_path / "out")
    for i, t in enumerate((7200, 0, 7100, 100)):
        ingest.store(spark.createDataFrame([(json.dumps(event(t, "search", "search")),)], "value string"), i, out)
    late = rows(spark.read.parquet(f"{out}/quarantine"), "batch")
    assert [(r["batch"], r["reject_reason"]) for r in late] == [(1, "late"), (3, "late")]
    assert spark.read.parquet(f"{out}/live_events").count() == 4


def test_live_context_follows_the_first_view_and_the_last_quote(spark, tmp_path):
    out = str(tmp_path / "out")
    mine = [event(0, "search", "search", metadata={"device": "android_app"}), event(5, "delivery_info_view", "checkout_delivery", metadata={"courier": "c1"}),
            event(9, "delivery_info_view", "checkout_delivery"), event(10, "checkout_start", "cart", metadata={"cart_value": "70"}),
            event(20, "exit", "cart", metadata={"cart_value": "999"})]
    other = [event(0, "page_view", "home", session="s_2", metadata={"device": "desktop", "source": "ads"}), event(1, "exit", "home", session="s_2")]
    ingest.store(spark.createDataFrame([(json.dumps(e),) for e in mine + other], "value string"), 0, out)
    ev = with_step(spark.read.parquet(f"{out}/live_events"))
    found = {r["session_id"]: r for r in rows(live.live_context(ev, features.session_features(ev)))}
    a, b = found["s_1"], found["s_2"]
    assert (a["device"], a["source"], a["courier"], a["cart_value"], a["abandoned"]) == (None, "live", None, 70.0, False)
    assert (b["device"], b["source"]) == ("desktop", "ads")
    assert {r["session_id"]: r["count"] for r in rows(live.risk_events(ev).groupBy("session_id").count())} == {"s_1": 4, "s_2": 1}


def test_the_daily_cap_counts_messages_of_earlier_batches(spark, frame):
    at = datetime(2026, 9, 20, 12, 0, 0)
    fresh = spark.createDataFrame([("p3", "u_1", at), ("p4", "u_2", at)], "packet_id string, user_id string, created_at timestamp")
    sent = [("u_1", at - timedelta(hours=23)), ("u_1", at - timedelta(hours=2)), ("u_2", at - timedelta(hours=25)), ("u_2", at - timedelta(hours=1))]
    earlier = spark.createDataFrame(sent, "user_id string, created_at timestamp")
    got = {r["packet_id"]: r["accepted"] for r in rows(actions.message_cap(fresh, earlier=earlier))}
    assert got == {"p3": False, "p4": True}
    assert {r["packet_id"] for r in rows(actions.message_cap(fresh)) if r["accepted"]} == {"p3", "p4"}


NOON = datetime(2026, 9, 20, 12, 0, 0)


def stored_events(spark, folder, events):
    ingest.store(spark.createDataFrame([(json.dumps(e),) for e in events], "value string"), 0, folder)
    return spark.read.parquet(f"{folder}/live_events").drop("event_date", "batch")


CHECKOUT = [event(0, "page_view", "home"), event(5, "payment_attempt", "checkout_payment", metadata={"gateway": "A", "method": "UPI"}),
            event(6, "payment_failed", "checkout_payment"), event(7, "exit", "checkout_payment")]


def test_a_session_is_told_once_and_the_cap_counts_all_messages(spark, tmp_path):
    out = str(tmp_path / "out")
    sure = Settings(gate_high=0.3, gate_medium=0.2, holdout_share=0.0, consent_share=1.0)
    events = stored_events(spark, out, [{**e, "session_id": f"s_{k}"} for k in range(4) for e in CHECKOUT])
    some = events.filter("session_id IN ('s_0', 's_1')")
    for batch_id in (0, 1, 1):  # a session scored again, and a batch repeated
        live.score_batch(some, batch_id, out, FLAT, NOON, always_high, sure)
    log = lambda: sorted((r["session_id"], r["stage"], r["status"]) for r in rows(live.messages_table(spark, out).read()))
    assert log() == [("s_0", "in_session", "sent"), ("s_1", "in_session", "sent")]
    live.score_batch(events, 2, out, FLAT, NOON, always_high, sure)  # the user's day is full
    assert log() == [("s_0", "in_session", "sent"), ("s_1", "in_session", "sent")]
    idle = events.select("user_id", "session_id").filter("session_id IN ('s_0', 's_2')")
    for batch_id in (2, 3):
        live.finalise(idle, out, batch_id, NOON, sure)
    assert log()[0:] == sorted([("s_0", "in_session", "sent"), ("s_1", "in_session", "sent"), ("s_0", "post_session", "suppressed_cap"), ("s_2", "post_session", "suppressed_cap")])
    live.finalise(events.select("user_id", "session_id").filter("session_id = 's_3'"), out, 4, NOON + timedelta(days=2), sure)
    assert ("s_3", "post_session", "sent") in log() or ("s_3", "post_session", "pending_approval") in log()


def test_closed_alerts_survive_later_batches(spark, tmp_path):
    out = str(tmp_path / "out")
    events = stored_events(spark, out, [{**e, "session_id": f"s_{k}"} for k in range(3) for e in CHECKOUT])
    s = Settings(gate_medium=0.25)
    live.score_batch(events, 0, out, FLAT, NOON, always_high, s)
    requests = spark.createDataFrame([("r1", "al_pk_live_s_1", "dismiss", NOON)], "request_id string, alert_id string, action string, requested_at timestamp").selectExpr(
        "*", "'ann' actor", "cast(null as string) assignee", "cast(null as string) note")
    assert [r["to_status"] for r in rows(live.close_alerts(spark, out, requests))] == ["dismissed"]
    for batch_id in range(1, 12):
        live.alerts_table(spark, out).upsert(live.alerts_table(spark, out).read(live.STEP * batch_id).filter("status <> 'dismissed'"), live.STEP * batch_id)
    live.score_batch(events, 12, out, FLAT, NOON, always_high, s)
    assert {r["packet_id"]: r["status"] for r in rows(live.alerts_table(spark, out).read())} == {
        "pk_live_s_0": "needs_review", "pk_live_s_1": "dismissed", "pk_live_s_2": "needs_review"}
    assert len(live.alerts_table(spark, out).versions("delta")) <= 16 and len(live.alerts_table(spark, out).versions("base")) <= 2
    assert rows(spark.read.parquet(f"{out}/workflow_executions"))[0]["to_status"] == "dismissed"


def test_current_tables_merge_compact_and_repeat(spark, tmp_path):
    rng = random.Random(4)
    table = CurrentTable(spark, str(tmp_path / "t"), ["k"], buckets=4, deltas=3)
    assert table.read() is None and table.next_version() == 0
    plain, past = {}, []
    for version in range(11):
        change = {rng.randrange(30): rng.randrange(1000) for _ in range(6)}
        frame_ = spark.createDataFrame(list(change.items()), "k int, v int")
        table.upsert(frame_, version)
        past.append(dict(plain))
        plain |= change
        if version in (4, 6):  # a batch that is repeated finds what was there before it
            assert {r["k"]: r["v"] for r in rows(table.read(before=version))} == past[version]
            table.upsert(frame_, version)
        assert {r["k"]: r["v"] for r in rows(table.read())} == plain
    some = spark.createDataFrame([(k,) for k in (1, 2, 99)], "k int")
    assert {r["k"]: r["v"] for r in rows(table.read(touched=some))} == {k: v for k, v in plain.items() if k in (1, 2)}
    assert len(table.versions("delta")) <= 6 and len(table.versions("base")) <= 2
    aged = CurrentTable(spark, str(tmp_path / "a"), ["k"], deltas=2, retain="at", retain_hours=24)
    for version in range(4):
        aged.upsert(spark.createDataFrame([(version, NOON + timedelta(hours=20 * version))], "k int, at timestamp"), version)
    assert sorted(r["k"] for r in rows(aged.read())) == [2, 3]


def test_findings_use_the_failures_of_earlier_batches(spark, tmp_path):
    out, pay = str(tmp_path / "out"), [event(0, "payment_attempt", "checkout_payment", metadata={"gateway": "A"}), event(1, "payment_failed", "checkout_payment", metadata={"gateway": "A"})]
    events = stored_events(spark, out, [{**e, "session_id": f"s_{k}"} for k in range(4) for e in (pay if k < 3 else pay[:1])])
    table = live.payments_table(spark, out)
    table.upsert(live.payment_units(events.filter("session_id IN ('s_0', 's_1')")), 0)
    table.upsert(live.payment_units(events.filter("session_id IN ('s_2', 's_3')")), live.STEP)
    known = spark.createDataFrame([(f"p_{i}", T0 - timedelta(days=9), "A", "failed" if i == 0 else "success") for i in range(10)], "session_id string, timestamp timestamp, gateway string, status string")
    probe = spark.createDataFrame([("x", "A", T0)], "probe_id string, gateway string, around timestamp")
    alone, both = (rows(investigate.gateway_health(probe, known, live=x))[0] for x in (None, table.read()))
    assert (alone["sessions_in_window"], alone["multiplier"]) == (0, 0.0)
    assert (both["sessions_in_window"], both["failed_sessions"], both["failure_rate"], both["baseline_failure_rate"], both["multiplier"]) == (4, 3, 0.75, 0.1, 7.5)


def test_medium_packets_are_investigated_and_decided_again(spark, tmp_path):
    def look(decided):
        return decided.filter("gate = 'medium'").select("packet_id", F.array(F.struct(
            F.lit("gateway_health").alias("tool"), F.lit("").alias("summary"), F.lit("payment_failure").alias("supports"),
            F.lit("aggregate").alias("evidence_kind"))).alias("findings"))

    out, plain = str(tmp_path / "out"), str(tmp_path / "plain")
    events = stored_events(spark, out, CHECKOUT)
    live.score_batch(events, 0, out, FLAT, NOON, always_high, Settings(gate_medium=0.25), look)
    live.score_batch(events, 0, plain, FLAT, NOON, always_high, Settings(gate_medium=0.25))
    with_look, without = (rows(live.packets_table(spark, f).read())[0] for f in (out, plain))
    assert (without["investigated"], without["gate"]) == (False, "medium")
    assert with_look["investigated"] and with_look["confidence"] > without["confidence"]
    assert with_look["risk_score"] == 0.03  # the risk model does not see the exit
    assert rows(spark.read.parquet(f"{out}/feed"))[0]["investigated"] is True


def test_numbers_of_the_evidence_are_read_as_json_writes_them(spark):
    got = spark.sql("""SELECT '{"a": -0.5, "b1": 1.0E-4, "c": "up 12% of 1,500", "d": [3, true, null], "e5": {"f": "x2"}}' AS e""").select(
        drafts.evidence_numbers(F.col("e")).alias("n")).first().n
    assert sorted(got) == [-0.5, 1.0e-4, 3.0, 12.0, 1500.0]
