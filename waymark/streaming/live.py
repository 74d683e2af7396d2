"""Live scoring: after every micro-batch the touched sessions are scored again with the batch functions.

A session's events are kept in the stream's keyed state (see state.py) and come with each batch that touches the session, so late
events are simply sorted in and no batch reads the event history. Packets, alerts and messages are current tables (see
sources/current.py): a batch opens the buckets of its own sessions and users, and a repeated batch replaces what it wrote. Quiet
sessions arrive in the same batches, so one writer decides about all messages, in the order of the batches. The time of sending
is the latest event time so far, which a repeated batch finds again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.functions.columns import meta
from waymark.functions.rules import evaluate_rules
from waymark.operators import actions, decide, features, fusion, sessions
from waymark.operators.clean import validated, with_step
from waymark.operators.ordered import ORDER, group_max, ordered
from waymark.operators.sessions import SESSION
from waymark.session import checkpointed
from waymark.sources.current import CurrentTable
from waymark.streaming import state
from waymark.streaming.ingest import parsed, store_rows

Scorer = Callable[[DataFrame, DataFrame], DataFrame]  # full features, features of the risk view -> scored sessions
Investigator = Callable[[DataFrame], DataFrame]  # decided packets -> packet_id, findings
QUOTES = "delivery_info_view"


def rules_only(full: DataFrame, risk_view: DataFrame) -> DataFrame:
    """Scores without learned models: rules decide alone."""
    return full.withColumns({
        "risk_score": F.lit(0.0), "friction_probs": F.create_map().cast("map<string,double>"),
        "top_signals": F.array().cast(decide.SIGNALS), "friction_signals": F.create_map().cast(f"map<string,{decide.SIGNALS}>")})


def risk_events(events: DataFrame) -> DataFrame:
    """What a risk model may see of a session: the live view, or the first event if that is empty."""
    body = F.col("event") != "exit"
    seen = ordered(events, SESSION, total={"_outcomes": F.when(body & F.col("event").isin(*vocab.OUTCOME_EVENTS), 1).otherwise(0),
                                           "_place": F.lit(1)})
    seen = seen.withColumn("_shown", F.when(body & (F.col("_outcomes") == 0), 1).otherwise(0))
    seen = group_max(seen, SESSION, "_shown", "_any")
    return seen.filter((F.col("_shown") == 1) | ((F.col("_any") == 0) & (F.col("_place") == 1))).drop(
        "_outcomes", "_place", "_shown", "_any")


def live_context(events: DataFrame, full: DataFrame) -> DataFrame:
    """Context of live sessions. It differs from the batch table: device, place and source count only when the first event is a
    page view, the courier is that of the last quote even if that has none, and the session's kind and cart come from the
    features."""
    at = F.struct(*ORDER)
    own = events.groupBy(*SESSION).agg(
        F.min_by("event", at).alias("_first"),
        F.max_by(F.struct(meta("courier").alias("courier")), F.when(F.col("event") == QUOTES, at)).alias("_quote"))
    kind = full.select(*SESSION, F.when(F.col("is_post_purchase") > 0, "post_purchase").otherwise("shopping").alias("_kind"),
                       F.col("cart_value").cast("double").alias("_cart"))
    table = sessions.session_table(events).join(own, list(SESSION)).join(kind, list(SESSION))
    opened = F.col("_first") == "page_view"
    context = {c: F.when(opened, F.col(c)) for c in ("device", "app_version", "city", "city_tier")}
    context["source"] = F.coalesce(F.when(opened, F.col("source")), F.lit("live"))
    return table.withColumns(context | {
        "courier": F.col("_quote.courier"), "session_kind": F.col("_kind"), "cart_value": F.coalesce("_cart", F.lit(0.0)),
        "furthest_step": F.col("exit_step"), "abandoned": F.lit(False)}).drop("_first", "_quote", "_kind", "_cart")


def live_packets(events: DataFrame, baselines: dict[str, tuple[float, float]], scorer: Scorer = rules_only,
                 s: Settings = DEFAULTS) -> DataFrame:
    """Packets of the sessions at risk, from all events the sessions have so far.

    The causes are scored on everything, the risk on what precedes the first outcome or exit.
    """
    ev = with_step(events)
    full = features.add_dwell_z(features.session_features(ev), baselines)
    view = features.add_dwell_z(features.session_features(risk_events(ev)), baselines)
    scored = scorer(evaluate_rules(full), view)
    context = live_context(ev, full)
    themes = context.select("session_id").limit(0).withColumn("themes", F.array().cast("array<string>"))
    keep = ["session_id", "risk_score", "rule_flags", "top_signals", "friction_probs", "friction_signals"]
    packets = fusion.session_packets(scored.select(*keep), context, themes, None, None, s)
    return packets.withColumns({"packet_id": F.concat(F.lit("pk_live_"), "session_id"), "order_value": F.lit(None).cast("double")})


def messages_table(spark: SparkSession, folder: str, s: Settings = DEFAULTS) -> CurrentTable:
    """Planned messages of live and closed sessions; those older than the sessions' time-out are dropped by the compaction."""
    return CurrentTable(spark, f"{folder}/messages", ["user_id", "session_id", "stage"], by=["user_id"], retain="created_at", retain_hours=s.state_hours)


def packets_table(spark: SparkSession, folder: str) -> CurrentTable:
    return CurrentTable(spark, f"{folder}/packets", ["packet_id"])


def alerts_table(spark: SparkSession, folder: str) -> CurrentTable:
    return CurrentTable(spark, f"{folder}/alerts", ["packet_id"])


def payments_table(spark: SparkSession, folder: str, s: Settings = DEFAULTS) -> CurrentTable:
    """session_id, gateway, ts, failed: payment sessions seen on the stream, for the health of a gateway right now."""
    return CurrentTable(spark, f"{folder}/live_payments", ["session_id", "gateway"], retain="ts", retain_hours=s.state_hours)


def payment_units(events: DataFrame) -> DataFrame:
    """One row per session and gateway from all events of the sessions: when it first paid, and whether a payment failed."""
    pay = events.filter(F.col("event").isin("payment_attempt", "payment_failed")).withColumn("gateway", meta("gateway")).filter("gateway IS NOT NULL")
    return pay.groupBy("session_id", "gateway").agg(F.min("timestamp").alias("ts"), F.bool_or(F.col("event") == "payment_failed").alias("failed"))


LIVE, CLOSED = "in_session", "post_session"
STEP = 1000  # versions of a batch: its own, its finaliser's, and those of jobs that run before the next one
ACTIVE = ["sent", "approved", "pending_approval"]


def messages_of(spark: SparkSession, folder: str, users: DataFrame, before: int, s: Settings = DEFAULTS) -> DataFrame:
    """user_id, session_id, stage, status, created_at of the users' messages among the versions below `before`."""
    rows = messages_table(spark, folder, s).read(before, users)
    if rows is None:
        return spark.createDataFrame([], "user_id string, session_id string, stage string, status string, created_at timestamp")
    return rows.select("user_id", "session_id", "stage", "status", "created_at")


def counted(messages: DataFrame, now: datetime) -> DataFrame:
    """user_id, created_at of the messages of the 24 hours before `now` that were sent or wait for approval."""
    since = F.lit(now) - F.make_dt_interval(hours=F.lit(24))
    return messages.filter(F.col("status").isin(*ACTIVE) & (F.col("created_at") > since)).select("user_id", "created_at")


def feed(decisions: DataFrame) -> DataFrame:
    """Records of the at-risk feed."""
    return decisions.filter("gate <> 'low'").select(
        F.lit("at_risk").alias("type"), "session_id", F.current_timestamp().alias("ts"), F.round("risk_score", 3).alias("risk_score"),
        "friction_type", "confidence", "gate", "owner_team", "priority", "rule_flags", F.concat(F.lit("al_"), "packet_id").alias("alert_id"),
        F.col("customer_action.id").alias("customer_action"), "nudge", F.coalesce("investigated", F.lit(False)).alias("investigated"), "cart_value", "device",
        F.col("exit_step").alias("step"))


def score_batch(events: DataFrame, batch_id: int, folder: str, baselines: dict[str, tuple[float, float]], now: datetime,
                scorer: Scorer = rules_only, s: Settings = DEFAULTS, investigator: Investigator | None = None) -> None:
    """Score sessions from all their events and write packets, alerts, messages and feed records.

    Medium packets are investigated, if there is an investigator, and decided again. A session gets one message while it lasts, and
    the daily cap counts what earlier batches have sent; `now` is the time of sending. Alerts that somebody has acted on stay.
    """
    spark, version = events.sparkSession, STEP * batch_id
    packets = live_packets(events, baselines, scorer, s)
    if investigator is None:
        decided = decide.decide(packets, s, moment=LIVE).withColumn("investigated", F.lit(False))
    else:
        packets = checkpointed(packets)
        decided = decide.decide_with_findings(packets, investigator(decide.decide(packets, s, moment=LIVE)), s, moment=LIVE)
    decided = decided.persist()
    try:
        before = messages_of(spark, folder, decided.select("user_id"), version, s)
        told_before = before.filter(F.col("stage") == LIVE).select("user_id", "session_id")
        open_for = decided.join(told_before, ["user_id", "session_id"], "left_anti")
        planned = actions.recovery_plan(open_for, s, earlier=counted(before, now), now=F.lit(now)).filter("status = 'sent'")
        _save_messages(planned, LIVE, version, folder, s)
        sent = spark.read.parquet(f"{folder}/message_log/version={version}").filter(F.col("stage") == LIVE)
        told = decided.join(sent.select("session_id", F.struct("action_id", "channel", "message").alias("nudge")), "session_id", "left")
        packets_table(spark, folder).upsert(told.drop("findings"), version)
        feed(told).write.mode("overwrite").parquet(f"{folder}/feed/batch={batch_id}")
        alerts = actions.alerts(decided).withColumn("source", F.lit("live"))
        known = alerts_table(spark, folder).read(version, alerts.select("packet_id"))
        if known is not None:
            closed = known.filter(~F.col("status").isin("open", "needs_review")).select("packet_id")
            alerts = alerts.join(closed, "packet_id", "left_anti")
        alerts_table(spark, folder).upsert(alerts.drop("key_evidence"), version)
    finally:
        decided.unpersist()


def _save_messages(planned: DataFrame, stage: str, version: int, folder: str, s: Settings) -> None:
    """Keep the plans in the log, which has everything, and as the newest of their session and stage."""
    log = f"{folder}/message_log/version={version}"
    planned.withColumn("stage", F.lit(stage)).write.mode("overwrite").parquet(log)
    rows = planned.sparkSession.read.parquet(log)
    messages_table(rows.sparkSession, folder, s).upsert(rows.select("user_id", "session_id", "stage", "packet_id", "status", "action_id", "created_at"), version)


def finalise(idle: DataFrame, folder: str, batch_id: int, now: datetime, s: Settings = DEFAULTS) -> DataFrame:
    """Post-session recovery of quiet sessions (user_id, session_id), once each; converted sessions need none. Runs after the batch's
    own messages, which count for the cap."""
    spark, version = idle.sparkSession, STEP * batch_id + 1
    quiet = idle.select("user_id", "session_id").distinct()
    packets = packets_table(spark, folder).read(version, quiet.select(F.concat(F.lit("pk_live_"), "session_id").alias("packet_id")))
    log = f"{folder}/message_log/version={version}"
    if packets is None:
        return spark.createDataFrame([], "session_id string")
    before = messages_of(spark, folder, quiet.select("user_id"), version, s)
    done = before.filter(F.col("stage") == CLOSED).select("user_id", "session_id")
    keep = [c for c in packets.columns if c not in ("moment", "customer_action", "team_action", "nudge")]
    over = packets.filter("NOT converted").select(*keep).join(quiet, ["user_id", "session_id"], "left_semi").join(done, ["user_id", "session_id"], "left_anti")
    planned = actions.recovery_plan(decide.with_actions(over, CLOSED), s, earlier=counted(before, now), now=F.lit(now))
    _save_messages(planned, CLOSED, version, folder, s)
    return spark.read.parquet(log)


def run(lines: DataFrame, folder: str, checkpoint: str, baselines: dict[str, tuple[float, float]], scorer: Scorer = rules_only,
        s: Settings = DEFAULTS, investigator: Investigator | None = None, every: str | None = None) -> StreamingQuery:
    """Store, score and finalise every micro-batch. Investigators find the stream's payments, this batch's too, in `payments_table`. Without `every` (a trigger interval) what is there is worked off and the query
    ends; sessions then go quiet in the batch that comes after their time."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            rows = state.as_events(batch.filter("fresh AND kind <> 'idle'"))
            now = store_rows(rows, batch_id, folder)
            if now is None:
                return
            events = state.as_events(batch.filter("kind = 'event'")).drop("raw", "reject_reason")
            payments_table(spark, folder, s).upsert(payment_units(events), STEP * batch_id)
            score_batch(events, batch_id, folder, baselines, now, scorer, s, investigator)
            finalise(batch.filter("kind = 'idle'"), folder, batch_id, now, s)
        finally:
            batch.unpersist()

    writer = state.with_history(validated(parsed(lines)), s).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return state.started(writer.foreachBatch(each), lines.sparkSession, wait_for_timers=every is not None)


def close_alerts(spark: SparkSession, folder: str, requests: DataFrame) -> DataFrame:
    """Workflow requests on live alerts: the alerts' new states, the executions, and the messages that an approval releases are
    written; returns the executions. One job at a time, between batches."""
    table = alerts_table(spark, folder)
    packets = requests.select(F.regexp_replace("alert_id", "^al_", "").alias("packet_id"))
    rows = table.read(touched=packets)
    if rows is None:
        raise ValueError("there are no live alerts yet")
    executed = actions.workflow(rows, requests)
    log = CurrentTable(spark, f"{folder}/workflow_executions", ["request_id"])
    log.upsert(executed, log.next_version())
    done = log.read(touched=requests.select("request_id"))
    table.upsert(checkpointed(actions.apply_workflow(rows, done)), table.next_version())
    messages = messages_table(spark, folder)
    known = messages.read()
    if known is not None:
        released = actions.release_pending(known, done).filter("approved_by IS NOT NULL").select(*known.columns)
        messages.upsert(checkpointed(released), messages.next_version())
    return done
