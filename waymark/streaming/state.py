"""The keyed state of live sessions: their events so far, a time-out, and a timer that tells when a session has gone quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from waymark.config import DEFAULTS, Settings

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "at bigint, event string, page string, product_id string, order_id string, metadata string, seq bigint"
#: kind: `event` (fresh: of this batch, else remembered), `idle` (the session has gone quiet), `refused`
OUTPUT = f"kind string, user_id string, session_id string, {HELD}, fresh boolean, raw string, reject_reason string"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
_KEPT = [c.split()[0] for c in HELD.split(", ")]


class SessionState(StatefulProcessor):
    """Gives a touched session's whole history, as far as the time-out keeps it, with the new events marked.

    Events are numbered in the order in which they came. The time-out counts from the session's last event: with every event the
    history is put in anew, so a long session does not lose its beginning.
    """

    def __init__(self, idle_ms: int, state_ms: int):
        self.idle_ms, self.state_ms = idle_ms, state_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", HELD, self.state_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "raw"], kind="stable").astype(object)
        new = new.where(new.notna(), None)
        old = [tuple(r) for r in self.events.get()] if self.events.exists() else []
        number = max((r[-1] for r in old), default=-1) + 1
        made = [(int(at), event, page, product, order, metadata, number + i) for i, (at, event, page, product, order, metadata) in enumerate(
            zip(*(new[c] for c in _KEPT[:-1]), strict=True))]
        self.events.put(old + made)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows("event", key, old, [None] * len(old), False)
        yield self._rows("event", key, made, list(new["raw"]), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows("idle", key, [(None,) * len(_KEPT)], [None], False)

    @staticmethod
    def _rows(kind: str, key, rows: list[tuple], raw: list, fresh: bool) -> pd.DataFrame:
        return pd.DataFrame([(kind, key[0], key[1], *r, fresh, line, None) for r, line in zip(rows, raw, strict=True)], columns=_COLUMNS, dtype=object)

    def close(self) -> None:
        pass


def with_history(checked: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """A stream of validated events to OUTPUT rows: touched sessions with their history, quiet sessions, and refused events."""
    checked.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    flat = checked.select("user_id", "session_id", F.unix_micros("timestamp").alias("at"), "event", "page", "product_id", "order_id",
                          F.to_json("metadata").alias("metadata"), "raw", "reject_reason")
    processor = SessionState(int(s.idle_minutes * 60_000), int(s.state_hours * 3_600_000))
    known = flat.filter("reject_reason IS NULL").drop("reject_reason").groupBy("user_id", "session_id").transformWithStateInPandas(
        processor, OUTPUT, "Update", "ProcessingTime")
    refused = flat.filter("reject_reason IS NOT NULL").select(
        F.lit("refused").alias("kind"), "user_id", "session_id", *_KEPT[:-1], F.lit(None).cast("bigint").alias("seq"), F.lit(True).alias("fresh"),
        "raw", "reject_reason")
    return known.unionByName(refused)


def as_events(rows: DataFrame) -> DataFrame:
    """Event columns of OUTPUT rows."""
    metadata = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select("seq", "session_id", "user_id", F.timestamp_micros("at").alias("timestamp"), "event", "page", "product_id", "order_id",
                       metadata.alias("metadata"), "raw", "reject_reason")


def started(writer: DataStreamWriter, spark: SparkSession, wait_for_timers: bool) -> StreamingQuery:
    """Start a query with timers. One that only works off what is there must not go on for the sake of timers to come: it gets no
    batches without data. A query keeps the setting it was started with."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(wait_for_timers).lower())
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)
