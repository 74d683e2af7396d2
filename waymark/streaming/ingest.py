"""Live events: JSON lines in, accepted and refused events out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.operators.clean import EVENT_COLUMNS, validated
from waymark.sources.current import CurrentTable

LATENESS = "10 minutes"  # how far behind the latest event a windowed stream still counts an event
LIVE = ("struct<session_id:string,user_id:string,timestamp:timestamp,event:string,page:string,product_id:string,"
        "order_id:string,metadata:map<string,string>>")


def parsed(lines: DataFrame) -> DataFrame:
    """`value` (JSON text of one event or of a list of events) to event columns plus the field names it had."""
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    elements = F.when(is_list, F.transform(
        F.try_parse_json("value").cast("array<variant>"), lambda v: F.to_json(v))).otherwise(F.array("value"))
    one = lines.select(F.explode(elements).alias("value"))
    e = one.withColumns({"_e": F.from_json("value", LIVE), "fields": F.json_object_keys("value")})
    flat = e.select(*[F.col(f"_e.{c}").alias(c) for c in EVENT_COLUMNS], "fields", F.col("value").alias("raw"))
    return flat.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def read_lines(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A folder of JSON-lines files as a stream; any stream with a text `value` column works the same way."""
    return spark.readStream.format("text").options(**options).load(folder)


def progress(spark: SparkSession, folder: str) -> CurrentTable:
    """One row: the latest event time of all batches so far."""
    return CurrentTable(spark, f"{folder}/progress", ["stream"], buckets=1)


def high_water(spark: SparkSession, folder: str, batch_id: int) -> datetime | None:
    """The latest event time of the batches before this one."""
    rows = progress(spark, folder).read(before=batch_id)
    return None if rows is None else rows.agg(F.max("high")).first()[0]


def store_rows(rows: DataFrame, batch_id: int, folder: str, lateness: str = LATENESS) -> datetime | None:
    """Accepted events, and refused and late ones, of one micro-batch; returns the latest event time so far.

    rows: event columns, seq, raw, reject_reason. Writing a batch again replaces it. A late event is accepted and its session is
    scored again; windowed streams drop it, so it is recorded for them too.
    """
    spark = rows.sparkSession
    good = rows.filter("reject_reason IS NULL").drop("reject_reason", "raw").withColumn("event_date", F.to_date("timestamp"))
    good.write.mode("overwrite").partitionBy("event_date").parquet(f"{folder}/live_events/batch={batch_id}")
    high = high_water(spark, folder, batch_id)
    late = F.lit(False) if high is None else F.col("timestamp") < F.lit(high) - F.expr(f"INTERVAL {lateness}")
    refused = rows.withColumn("reject_reason", F.coalesce("reject_reason", F.when(late, "late")))
    refused.filter("reject_reason IS NOT NULL").select("raw", "reject_reason").write.mode("overwrite").parquet(f"{folder}/quarantine/batch={batch_id}")
    newest = good.agg(F.max("timestamp").alias("high")).select(
        F.lit("events").alias("stream"), F.greatest("high", F.lit(high).cast("timestamp")).alias("high"))
    progress(spark, folder).upsert(newest, batch_id)
    return high_water(spark, folder, batch_id + 1)


def store(batch: DataFrame, batch_id: int, folder: str, lateness: str = LATENESS) -> None:
    """Parse, validate and store the JSON lines of one micro-batch."""
    rows = validated(parsed(batch)).withColumn("seq", F.monotonically_increasing_id() + F.lit(batch_id) * F.lit(1 << 50)).persist()
    try:
        store_rows(rows, batch_id, folder, lateness)
    finally:
        rows.unpersist()


def ingest(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return (
        lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: store(batch, batch_id, folder)).start()
    )


def failure_rates(events: DataFrame, width: str = "15 minutes", lateness: str = LATENESS) -> DataFrame:
    """Failure rate of payment sessions' events per gateway and tumbling window, on a stream (or a table)."""
    pay = events.filter(F.col("event").isin("payment_attempt", "payment_failed"))
    pay = pay.withColumn("gateway", F.col("metadata")["gateway"]).filter("gateway IS NOT NULL")
    return pay.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", width), "gateway").agg(
        F.count_if(F.col("event") == "payment_attempt").alias("attempts"),
        F.count_if(F.col("event") == "payment_failed").alias("failed"))


def idle_sessions(events: DataFrame, idle_minutes: float = 2.0, lateness: str = LATENESS) -> DataFrame:
    """Sessions that have been quiet for the idle time: a session window that the watermark has closed."""
    gap = f"{int(idle_minutes * 60)} seconds"
    return events.withWatermark("timestamp", lateness).groupBy(
        F.session_window("timestamp", gap).alias("w"), "user_id", "session_id").agg(
        F.count(F.lit(1)).alias("events"), F.bool_or(F.col("event") == "order_placed").alias("converted"))
