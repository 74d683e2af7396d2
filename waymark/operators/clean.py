"""Cleaning of raw events, and validation of live ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.functions.columns import any_of, lookup, strings
from waymark.operators.ordered import CHUNK, split_hot

EVENT_COLUMNS = ["session_id", "user_id", "timestamp", "event", "page", "product_id", "order_id", "metadata"]


def safe_metadata(metadata: Column) -> Column:
    """Drop keys that must never be stored, whatever their case."""
    return F.map_filter(metadata, lambda k, _: ~F.lower(k).isin(*vocab.FORBIDDEN_KEYS))


def canonical_text(metadata: Column) -> Column:
    """A map as text with sorted keys, so that equal maps are equal texts."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(metadata))))


NUMBERS = "metadata_numbers"
_NUMERIC = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def parse_metadata(events: DataFrame, with_numbers: bool = True) -> DataFrame:
    """JSON text to a map of texts, and `metadata_numbers`, the values that are numbers in the JSON (true counts 1), so that 100 and
    "100" stay apart. A map stays as it is and has no such column."""
    if not isinstance(events.schema["metadata"].dataType, T.StringType):
        return events
    texts = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    if not with_numbers:
        return events.withColumn("metadata", texts)
    typed = F.from_json("metadata", "map<string,variant>")

    def value(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return F.when(kind.rlike(_NUMERIC), F.try_variant_get(v, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))

    numbers = F.map_filter(F.transform_values(typed, lambda _, v: value(v)), lambda _, v: v.isNotNull())
    return events.withColumns({"metadata": texts, NUMBERS: F.coalesce(numbers, F.create_map().cast("map<string,double>"))})


def dedup(events: DataFrame) -> DataFrame:
    """Keep the first of identical events. Text metadata is compared as it is, maps by content.

    The metadata travels as text: then the grouping keys are the whole row and the only value is the smallest ingest
    number, so copies are combined by a hash aggregation before the shuffle, however many there are.
    """
    if not isinstance(events.schema["metadata"].dataType, T.StringType):
        events = events.withColumn("metadata", canonical_text(F.col("metadata")))
    placed = [CHUNK] if CHUNK in events.columns else []
    return events.groupBy(*EVENT_COLUMNS, *placed).agg(F.min("seq").alias("seq"))


def valid_vocabulary(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event").isin(*vocab.EVENTS) & F.col("page").isin(*list(vocab.PAGE_STEP)))


def normalise_ids(events: DataFrame) -> DataFrame:
    """Missing ids are SQL nulls, not 'nan' or empty texts."""
    def tidy(c: str) -> Column:
        return F.when(~F.col(c).isin("", "nan"), F.col(c)).alias(c)

    return events.withColumns({c: tidy(c) for c in ("product_id", "order_id")})


def with_step(events: DataFrame) -> DataFrame:
    return events.withColumn("step", lookup(vocab.PAGE_STEP, F.col("page")))


def clean_events(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Raw events to clean ones: no copies, known names only, tidy ids, safe metadata, funnel step.

    The vocabulary filter runs before the dedup: it gives the same rows and shuffles fewer. Events are dealt out by user once, a
    hot user's by stretches of time; copies have one user and one time, so the dedup, the sessions and the features run inside
    that deal. The probe for hot users reads the raw key columns.
    """
    ev = valid_vocabulary(raw).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    ev = split_hot(ev, ["user_id"], limit=settings.hot_rows, max_chunks=settings.max_chunks)
    if not ev.isStreaming:
        ev = ev.repartition("user_id", *([CHUNK] if CHUNK in ev.columns else []))
    # the dedup writes a map as text, in which all values are texts
    ev = parse_metadata(normalise_ids(dedup(ev)), isinstance(raw.schema["metadata"].dataType, T.StringType))
    safe = {c: safe_metadata(F.col(c)) for c in ("metadata", NUMBERS) if c in ev.columns}
    return with_step(ev.withColumns(safe))


# --- live events -----------------------------------------------------------------------------------

def hashed_user(user_id: Column) -> Column:
    """Browser ids are hashed unless they already have the hashed form."""
    hashed = F.concat(F.lit("u_"), F.substring(F.sha2(F.concat(F.lit("live:"), user_id), 256), 1, 12))
    return F.when(user_id.rlike(r"^u_[0-9a-f]{12}\z"), user_id).otherwise(hashed)


def reject_reason(extra_fields: Column | None = None) -> Column:
    """Why a live event is refused, or null. Unlike batch cleaning, a forbidden key refuses the whole event."""
    def bad_id(c: str) -> Column:
        return F.col(c).isNull() | ~F.length(c).between(1, 64)

    leaked = F.exists(F.map_keys("metadata"), lambda k: any_of(F.lower(k), vocab.FORBIDDEN_KEYS))
    checks = [
        (bad_id("session_id"), "session_id"),
        (bad_id("user_id"), "user_id"),
        (F.col("timestamp").isNull(), "timestamp"),
        (~any_of(F.col("event"), vocab.EVENTS), "event"),
        (~any_of(F.col("page"), list(vocab.PAGE_STEP)), "page"),
        (F.coalesce(leaked, F.lit(False)), "forbidden_metadata"),
    ]
    if extra_fields is not None:
        checks.append((F.coalesce(extra_fields, F.lit(False)), "extra_field"))
    reason = F.lit(None).cast("string")
    for condition, name in reversed(checks):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    return reason


def validated(events: DataFrame) -> DataFrame:
    """Live events with `reject_reason` (null for accepted ones) and hashed user ids."""
    extra = F.size(F.array_except(F.col("fields"), strings(EVENT_COLUMNS))) > 0 if "fields" in events.columns else None
    checked = events.withColumn("reject_reason", reject_reason(extra))
    return checked.withColumn("user_id", hashed_user(F.col("user_id"))).drop("fields")
