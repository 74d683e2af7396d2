"""Alerts, recovery plans, workflow events, audit rows and recovery statistics as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.functions import decision as d
from waymark.functions import wording
from waymark.functions.columns import any_of, micros, ratio
from waymark.operators.folds import budgeted, composed_before, machine
from waymark.operators.ordered import CHUNK, ordered, split_hot
from waymark.operators.ranges import range_sums
from waymark.session import checkpointed

DAY = 86_400_000_000
PAGE = 200  # rows a list request may ask for
CONTEXT_TYPE = ("struct<packet_id:string,segment_type:string,segment:string,metric:string,friction_hint:string,"
                "multiplier:double,observed_rate:double,baseline_rate:double,affected_sessions:bigint,"
                "window_start:timestamp,window_end:timestamp>")
_WORDED = {
    "segment_type": "string", "segment_value": "string", "metric": "string", "observed": "double",
    "baseline": "double", "z_score": "double", "window_start": "timestamp", "window_end": "timestamp",
    "device": "string", "city": "string", "payment_method": "string", "start": "timestamp",
    "aggregate_context": CONTEXT_TYPE,
}


def _complete(decisions: DataFrame) -> DataFrame:
    """Columns the wording reads, null where this kind of packet has none."""
    missing = {c: F.lit(None).cast(t) for c, t in _WORDED.items() if c not in decisions.columns}
    return decisions.withColumns(missing) if missing else decisions


def _page_size(limit: int) -> int:
    if limit > PAGE:
        raise ValueError(f"a page has at most {PAGE} rows; ask for more with offset")
    return limit


def happened_at() -> Column:
    """Event time of a packet: start of the session or end of the anomaly."""
    return F.when(d.is_aggregate(), F.col("window_end")).otherwise(F.col("start"))


def sample_sessions(members: DataFrame, n: int = 20) -> DataFrame:
    """packet_id, first n session ids. Parts of a packet are cut to n rows before they meet."""
    part = Window.partitionBy("packet_id", F.pmod(F.xxhash64("session_id"), F.lit(64))).orderBy("session_id")
    some = members.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= n)
    whole = Window.partitionBy("packet_id").orderBy("session_id")
    first = some.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= n)
    return first.groupBy("packet_id").agg(F.array_sort(F.collect_list("session_id")).alias("sample_sessions"))


def alerts(decisions: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One alert per decision that is not low: open at the high gate, else waiting for review."""
    rows = _complete(decisions.filter("gate <> 'low'"))
    if members is not None:
        rows = rows.join(sample_sessions(members), "packet_id", "left")
    else:
        rows = rows.withColumn("sample_sessions", F.lit(None).cast("array<string>"))
    evidence = F.struct(
        "rule_flags", "top_signals", d.prob(F.col("friction_type")).alias("friction_prob"), "text_themes",
        "aggregate_context", F.struct("rule_supports", "model_supports", "text_supports", "aggregate_supports",
                                      F.col("confidence").alias("score")).alias("confidence_breakdown"),
        "classification_source", "secondary_friction", F.col("findings").alias("investigation_findings"),
        "segment_type", "segment_value", "metric", "observed", "baseline", "multiplier", "z_score", "window_start",
        "window_end", "sample_sessions", "risk_score", "cart_value")
    return rows.select(
        F.concat(F.lit("al_"), "packet_id").alias("alert_id"), "packet_id", F.col("packet_type").alias("alert_type"),
        F.lit("batch").alias("source"), wording.alert_title().alias("title"), "friction_type", "confidence", "gate",
        "priority", "impact", "owner_team", F.when(F.col("gate") == "high", "open").otherwise("needs_review").alias("status"),
        "revenue_at_risk", F.col("customers_affected").alias("affected_sessions"), "session_id",
        wording.explanation().alias("explanation"), evidence.alias("key_evidence"), "team_action", "customer_action",
        F.lit(None).cast("string").alias("assigned_to"), happened_at().alias("created_at"),
        happened_at().alias("updated_at"))


def alert_list(rows: DataFrame, team: str | None = None, status: str | None = None, gate: str | None = None,
               friction: str | None = None, alert_type: str | None = None, source: str | None = None,
               limit: int = 50, offset: int = 0) -> DataFrame:
    """Filtered alerts with the total number of matches, most important first."""
    if team:
        rows = rows.filter(F.col("owner_team").isin(*vocab.TEAM_VIEWS.get(team, [team])))
    if status:
        rows = rows.filter(F.col("status").isin(*status.split(",")))
    for column, value in (("gate", gate), ("friction_type", friction), ("alert_type", alert_type), ("source", source)):
        if value:
            rows = rows.filter(F.col(column) == value)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = rows.orderBy("alert_type", F.desc("impact"), F.desc("created_at"), "packet_id")
    return page.offset(offset).limit(_page_size(limit)).withColumn("total", total)


def at_risk_list(decisions: DataFrame, source: str | None = None, gate: str | None = None,
                 limit: int = 50) -> DataFrame:
    """Sessions at risk, live ones first, newest first."""
    rows = decisions.filter("packet_type = 'session' AND gate <> 'low'")
    rows = rows if "source" in rows.columns else rows.withColumn("source", F.lit("batch"))
    for column, value in (("source", source), ("gate", gate)):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(F.desc("source"), F.desc("start"), "packet_id").limit(_page_size(limit))


# --- recovery ------------------------------------------------------------------------------------------------

def recovery_candidates(decisions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Decisions that may lead to a message: not low, still worth it, and the playbook has an action."""
    worth = (F.col("session_kind") == "post_purchase") | ~F.coalesce("converted", F.lit(False))
    return decisions.filter(
        (F.col("packet_type") == "session") & (F.col("gate") != "low") & worth & F.col("customer_action").isNotNull())


def recovery_plan(decisions: DataFrame, s: Settings = DEFAULTS, products: DataFrame | None = None,
                  earlier: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Status of each possible message: holdout, then consent, then the daily cap, then sent or waiting.

    Messages are planned at the session's start, or at `now` on the live path, where `earlier` holds the messages that earlier
    batches have sent or keep waiting (user_id, created_at); they count for the cap too.

    Only messages that reach the cap and pass it count for later ones, so the cap is a fold over the user's messages
    in time order. A pause of a day empties the cap, so each stretch without such a pause is a fold of its own.
    """
    rows = _complete(recovery_candidates(decisions, s)).withColumn("created_at", F.col("start") if now is None else now)
    rows = rows.withColumns({
        "holdout": d.in_holdout(F.col("session_id"), s),
        "_consent": d.has_consent(F.col("user_id"), s),
        "auto": (F.col("gate") == "high") & F.col("customer_action.auto_allowed"),
    })
    first = F.when(F.col("holdout"), "holdout").when(~F.col("_consent"), "suppressed_consent")
    rows = rows.withColumn("_early", first)
    capped = message_cap(rows.filter("_early IS NULL").select("packet_id", "user_id", "created_at"), s, earlier)
    rows = rows.join(capped.select("packet_id", "accepted"), "packet_id", "left")
    passed = F.coalesce("accepted", F.lit(False))
    status = F.coalesce("_early", F.when(~passed, "suppressed_cap").when(F.col("auto"), "sent")
                        .otherwise("pending_approval"))
    if products is not None:
        names = products.select(F.col("product_id").alias("primary_product_id"), F.col("subcategory").alias("_product"))
        rows = rows.join(names, "primary_product_id", "left")
    product = F.col("_product") if products is not None else F.lit(None).cast("string")
    text = wording.message(F.col("customer_action"), product, F.col("payment_method"))
    worth = F.coalesce(F.nullif("order_value", F.lit(0.0)), F.nullif("cart_value", F.lit(0.0)), F.lit(0.0))
    return rows.select(
        "packet_id", "session_id", "user_id", "friction_type", F.col("customer_action.id").alias("action_id"),
        "moment", F.col("customer_action.channel").alias("channel"), status.alias("status"),
        (passed & F.col("auto")).alias("auto"), "holdout", F.when(passed, text).alias("message"),
        worth.alias("value"), "created_at")


def message_cap(messages: DataFrame, s: Settings = DEFAULTS, earlier: DataFrame | None = None) -> DataFrame:
    """packet_id, user_id, accepted: fewer than the allowed number of accepted messages of the user in the 24 hours before.

    `earlier` (user_id, created_at) are messages accepted before, which count and are not judged again. A user with very many
    messages is worked on in chunks of time by many tasks (see folds.budgeted).
    """
    rows = messages.select("packet_id", "user_id", "created_at").withColumn("_given", F.lit(False))
    if earlier is not None:
        rows = rows.unionByName(earlier.select(
            F.lit(None).cast(rows.schema["packet_id"].dataType).alias("packet_id"), "user_id", "created_at", F.lit(True).alias("_given")))
    rows = rows.withColumn("_at", micros("created_at"))
    return budgeted(rows, "user_id", "packet_id", "created_at", "_given", s.messages_per_day, DAY, s.hot_rows, s.max_chunks)


def recent_messages(messages: DataFrame, hours: int = 24, s: Settings = DEFAULTS) -> DataFrame:
    """packet_id, recent: messages of the user in the trailing hours, borders and the message itself included.

    The messages' keys are stored once, since probes and facts, and the look for hot users, all read them.
    """
    span = F.make_dt_interval(hours=F.lit(hours))
    messages = checkpointed(messages.select("packet_id", "user_id", "created_at"))
    probes = messages.select(F.col("packet_id").alias("probe_id"), "user_id",
                             (F.col("created_at") - span).alias("lo"), F.col("created_at").alias("hi"))
    facts = messages.select("user_id", F.col("created_at").alias("at"), F.lit(1).cast("bigint").alias("recent"))
    return range_sums(probes, facts, "user_id", ["recent"], s).withColumnRenamed("probe_id", "packet_id")


def recovery_stats(recoveries: DataFrame) -> DataFrame:
    """One row: treated against holdout. `outcome` is observed: recovered, not_recovered or null."""
    known = F.col("outcome").isin("recovered", "not_recovered")
    treated = F.col("status").isin("sent", "approved") & known
    held = F.col("holdout") & known
    won = F.col("outcome") == "recovered"
    rate = lambda group: F.coalesce(ratio(F.count_if(group & won), F.count_if(group)), F.lit(0.0))
    return recoveries.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(treated).alias("treated"), F.count_if(held).alias("holdout"),
        F.round(rate(treated), 4).alias("treated_recovery_rate"), F.round(rate(held), 4).alias("holdout_recovery_rate"),
        F.round((rate(treated) - rate(held)) * 100, 2).alias("lift_pp"),
        F.coalesce(F.sum(F.when(treated & won, F.col("value").cast("decimal(28,2)"))).cast("double"), F.lit(0.0))
         .alias("recovered_revenue"))


def recovery_by_status(recoveries: DataFrame) -> DataFrame:
    return recoveries.groupBy("status").agg(F.count(F.lit(1)).alias("messages"))


def recovery_by_friction(recoveries: DataFrame) -> DataFrame:
    known = recoveries.filter(F.col("outcome").isin("recovered", "not_recovered"))
    won = F.col("outcome") == "recovered"
    treated = F.col("status").isin("sent", "approved")
    return known.filter(treated | F.col("holdout")).groupBy("friction_type").agg(
        F.count_if(treated & ~F.col("holdout")).alias("treated"),
        F.count_if(treated & ~F.col("holdout") & won).alias("treated_recovered"),
        F.count_if("holdout").alias("holdout"), F.count_if(F.col("holdout") & won).alias("holdout_recovered"))


# --- workflow ------------------------------------------------------------------------------------------------

def workflow(alert_rows: DataFrame, requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every request with the state it met and left, and why it was refused if it was.

    requests: request_id, alert_id, action, actor, assignee, note, requested_at. A request is a map over the states; the state a
    request meets is the composition of all earlier maps, applied to the alert's own state (see folds.composed_before), so an
    alert with very many requests is cut into chunks. A status that is no state of the machine never changes.
    """
    order, states = ("requested_at", "request_id"), [*vocab.OPEN_STATES, *vocab.CLOSED_STATES]
    state = alert_rows.select("alert_id", "packet_id", "owner_team", "status", "assigned_to")
    rows = split_hot(requests.join(state, "alert_id"), ["alert_id"], "requested_at", settings.hot_rows, settings.max_chunks)
    rows = composed_before(rows.withColumn("_map", machine(states, vocab.TRANSITIONS, F.col("action"))), ["alert_id"], order, "_map", "_before")
    named = F.array(*[F.lit(s) for s in states])
    at = F.array_position(named, F.col("status")).cast("int") - 1
    met = F.when(at >= 0, F.get("_before", at))
    before = F.coalesce(F.get(named, met), F.col("status"))
    known = any_of(F.col("action"), list(vocab.TRANSITIONS))
    may = F.lit(False)
    for name, (allowed, _) in vocab.TRANSITIONS.items():
        may = F.when(F.col("action") == name, any_of(before, allowed)).otherwise(may)
    rejected = F.when(~known, F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null")))).when(
        ~may, F.concat(F.lit("cannot "), "action", F.lit(" an alert that is "), F.coalesce(before, F.lit("null"))))
    rows = rows.withColumns({"from_status": before, "to_status": F.coalesce(F.get(named, F.get("_map", met)), F.col("status")), "rejected": rejected})
    given = F.coalesce(F.nullif("assignee", F.lit("")), F.concat("owner_team", F.lit("_queue")))
    took = F.when((F.col("action") == "assign") & F.col("rejected").isNull(), given)
    rows = ordered(rows.withColumn("_took", took), ["alert_id"], order, prior={"_assigned": F.col("_took")})
    rows = rows.withColumn("assignee_after", F.coalesce("_took", "_assigned", "assigned_to"))
    return _numbered_tickets(rows.drop("_map", "_before", "_took", "_assigned", CHUNK)).drop("status", "assigned_to", "owner_team")


def _numbered_tickets(done: DataFrame) -> DataFrame:
    """Ticket references count over all alerts in time order: per day first, then across days."""
    made = F.col("action").eqNullSafe("create_ticket") & F.col("rejected").isNull()
    tickets = done.filter(made).select("request_id", "requested_at", F.to_date("requested_at").alias("_day"))
    inside = Window.partitionBy("_day").orderBy("requested_at", "request_id")
    per_day = tickets.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    # a running sum over days: one row per calendar day
    earlier = per_day.select("_day", F.coalesce(F.sum("_n").over(
        Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = tickets.withColumn("_i", F.row_number().over(inside)).join(F.broadcast(earlier), "_day").select(
        "request_id", (F.col("_i") + F.col("_before")).alias("_ticket"))
    out = done.join(numbered, "request_id", "left")
    name = F.concat(F.lit("TKT-"), "alert_id", F.lit("-"), F.format_string("%03d", "_ticket"))
    return out.withColumn("ticket_ref", F.when(F.col("_ticket").isNotNull(), name)).drop("_ticket")


def apply_workflow(alert_rows: DataFrame, executed: DataFrame) -> DataFrame:
    """Alerts with the state their last accepted request left them in."""
    at = F.struct("requested_at", "request_id")
    last = executed.filter("rejected IS NULL").groupBy("alert_id").agg(
        F.max_by("to_status", at).alias("_status"), F.max_by("assignee_after", at).alias("_assigned"),
        F.max("requested_at").alias("_updated"))
    return alert_rows.join(last, "alert_id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "assigned_to": F.coalesce("_assigned", "assigned_to"),
        "updated_at": F.coalesce("_updated", "updated_at")}).drop("_status", "_assigned", "_updated")


def release_pending(recoveries: DataFrame, executed: DataFrame) -> DataFrame:
    """Approving an alert releases the messages that were waiting for it."""
    approved = executed.filter("action = 'approve' AND rejected IS NULL").groupBy("packet_id").agg(
        F.min_by("actor", F.struct("requested_at", "request_id")).alias("approved_by"))
    out = recoveries.join(approved, "packet_id", "left")
    waiting = (F.col("status") == "pending_approval") & F.col("approved_by").isNotNull()
    return out.withColumn("status", F.when(waiting, "approved").otherwise(F.col("status"))).withColumn(
        "approved_by", F.when(F.col("status") == "approved", F.col("approved_by")))


def approve_drafts(drafts: DataFrame, approvals: DataFrame) -> DataFrame:
    """Reply drafts waiting for approval are approved once, by the first request."""
    first = approvals.groupBy("draft_id").agg(
        F.min_by("actor", F.struct("requested_at", "request_id")).alias("_by"))
    out = drafts.join(first, "draft_id", "left")
    waiting = (F.col("status") == "pending_approval") & F.col("_by").isNotNull()
    return out.withColumns({"approved_by": F.when(waiting, F.col("_by")),
                            "status": F.when(waiting, "approved").otherwise(F.col("status"))}).drop("_by")


# --- audit ---------------------------------------------------------------------------------------------------

def audit_log(decisions: DataFrame, alert_rows: DataFrame | None = None, recoveries: DataFrame | None = None,
              executed: DataFrame | None = None, replies: DataFrame | None = None) -> DataFrame:
    """event_type, entity_type, entity_id, actor, ts, payload (JSON): one row per thing that happened.

    recoveries may have approved_by (see `release_pending`); replies: draft_id, session_id, status, source, guardrail_failures,
    created_at, approved_by.
    """
    def entry(df: DataFrame, event: Column, kind: str, entity: str, ts: Column, payload: Column,
              actor: Column = F.lit("system")) -> DataFrame:
        return df.select(event.alias("event_type"), F.lit(kind).alias("entity_type"), F.col(entity).alias("entity_id"),
                         actor.alias("actor"), ts.alias("ts"), F.to_json(payload).alias("payload"))

    looked = F.col("investigated") if "investigated" in decisions.columns else F.lit(False)
    breakdown = F.struct("rule_supports", "model_supports", "text_supports", "aggregate_supports")
    parts = [entry(_complete(decisions), F.lit("decision"), "packet", "packet_id", happened_at(), F.struct(
        "friction_type", "confidence", "gate", "priority", F.col("team_action.id").alias("team_action"), breakdown.alias("breakdown"),
        F.coalesce(looked, F.lit(False)).alias("investigated")))]
    if alert_rows is not None:
        parts.append(entry(alert_rows, F.lit("alert_created"), "alert", "alert_id", F.col("created_at"),
                           F.struct("packet_id", "gate", "priority", F.lit("fallback").alias("explanation_source"))))
    if recoveries is not None:
        payload = F.struct("action_id", "status", "moment", "channel", "holdout")
        parts.append(entry(recoveries, F.lit("recovery_planned"), "session", "session_id", F.col("created_at"), payload))
        parts.append(entry(recoveries.filter("message IS NOT NULL"), F.lit("recovery_message_drafted"), "session",
                           "session_id", F.col("created_at"), F.struct("action_id", F.lit("fallback").alias("source"))))
        if "approved_by" in recoveries.columns:
            parts.append(entry(recoveries.filter("approved_by IS NOT NULL"), F.lit("recovery_approved"), "session", "session_id", F.col("created_at"),
                               F.struct("action_id", "channel"), F.col("approved_by")))
    if replies is not None:
        draft = F.struct("session_id", "status", "source", "guardrail_failures")
        parts.append(entry(replies, F.lit("cs_reply_drafted"), "cs_draft", "draft_id", F.col("created_at"), draft))
        parts.append(entry(replies.filter("approved_by IS NOT NULL"), F.lit("cs_reply_approved"), "cs_draft", "draft_id", F.col("created_at"),
                           F.struct("session_id"), F.col("approved_by")))
    if executed is not None:
        parts.append(entry(executed.filter("rejected IS NULL"), F.concat(F.lit("workflow_"), "action"), "alert",
                           "alert_id", F.col("requested_at"), F.struct("from_status", "to_status", "note"), F.col("actor")))
    return reduce(DataFrame.unionByName, parts)


def trail(log: DataFrame, entity_ids: list[str], limit: int = 100) -> DataFrame:
    return log.filter(F.col("entity_id").isin(*entity_ids)).orderBy(F.desc("ts"), "event_type", "entity_id").limit(limit)

