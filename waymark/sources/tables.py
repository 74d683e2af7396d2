"""Readers and writers of the source, processed and operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_TEXT = "text string, language string, theme_label string"
SCHEMAS = {
    "events": "seq bigint, session_id string, user_id string, timestamp timestamp, event string, page string, "
              "product_id string, order_id string, metadata string",
    "payments": "payment_id string, session_id string, user_id string, order_id string, timestamp timestamp, "
                "method string, gateway string, bank string, amount double, status string, error_code string, "
                "latency_ms bigint, amount_debited boolean, refund_status string",
    "orders": "order_id string, session_id string, user_id string, placed_at timestamp, product_ids string, "
              "n_items int, order_value double, payment_method string, city string, city_tier string, courier string, "
              "promised_delivery_at timestamp, delivered_at timestamp, status string, delay_days int, "
              "cancel_reason string, return_reason string, refund_status string",
    "tickets": f"ticket_id string, session_id string, user_id string, order_id string, product_id string, "
               f"created_at timestamp, channel string, {_TEXT}, sentiment string, tone string, status string",
    "chats": "chat_id string, session_id string, user_id string, started_at timestamp, page string, "
             "transcript string, customer_text string, language string, theme_label string",
    "reviews": f"review_id string, session_id string, user_id string, order_id string, product_id string, "
               f"created_at timestamp, rating int, {_TEXT}",
    "products": "product_id string, name string, brand string, category string, subcategory string, color string, "
                "price double, mrp double, rating double, n_reviews int, sizes string, stock string, "
                "in_stock boolean, has_size_chart boolean, missing_attributes string, spec_completeness double, "
                "image_count int, warehouse_city string, return_window_days int, cod_allowed boolean, "
                "catalog_updated_at timestamp",
    "ground_truth": "session_id string, is_clean boolean, friction_types string, primary_friction string, "
                    "secondary_friction string, incident_id string, reached_cart boolean, converted boolean, "
                    "abandoned boolean, furthest_step string, exit_step string",
    "incidents": "incident_id string, kind string, scope string, start timestamp, `end` timestamp, "
                 "affected_sessions bigint",
}
FILES_A_DAY = 8
RAW = ["events", "payments", "orders", "tickets", "chats", "reviews", "products"]
LABELS = ["ground_truth", "incidents"]
JSON_COLUMNS = {
    "product_ids": "array<string>", "transcript": "array<struct<role:string,text:string>>", "sizes": "array<string>",
    "stock": "map<string,int>", "missing_attributes": "array<string>",
}


def _exists(spark: SparkSession, path: str) -> bool:
    """One look at the path itself; nothing below it is listed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def typed(df: DataFrame) -> DataFrame:
    """Decode JSON texts into arrays and maps, and turn NaN and empty ids into nulls."""
    out = {}
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if field.name in JSON_COLUMNS and kind == "string":
            out[field.name] = F.from_json(field.name, JSON_COLUMNS[field.name])
        elif kind == "double":
            out[field.name] = F.when(~F.isnan(field.name), F.col(field.name))
        elif kind == "string" and field.name.endswith("_id"):
            out[field.name] = F.nullif(field.name, F.lit(""))
        elif kind == "timestamp_ntz":
            out[field.name] = F.col(field.name).cast("timestamp")
    return df.withColumns(out) if out else df


def load(spark: SparkSession, folder: str, names: list[str] | None = None, suffix: str = ".parquet") -> dict[str, DataFrame]:
    """Source tables by name; one error names every missing table."""
    names = names or RAW
    paths = {n: f"{folder}/{n}{suffix}" for n in names}
    missing = [n for n, p in paths.items() if not _exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing tables in {folder}: {', '.join(missing)}")
    return {n: typed(spark.read.schema(SCHEMAS[n]).parquet(p)) for n, p in paths.items()}


def save(df: DataFrame, folder: str, name: str, day: str | None = None) -> DataFrame:
    """Write a table (by event date when `day` names its time column) and read it back, which cuts the lineage."""
    path = f"{folder}/{name}"
    if day:
        # a day's rows meet in a few tasks, so a day becomes a few files instead of one per task
        salt = F.pmod(F.hash(*[c for c, kind in df.dtypes if kind in ("string", "bigint", "timestamp")]), F.lit(FILES_A_DAY))
        (df.withColumn("event_date", F.to_date(day)).repartition("event_date", salt)
         .write.mode("overwrite").partitionBy("event_date").parquet(path))
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table written before, or None."""
    path = f"{folder}/{name}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
