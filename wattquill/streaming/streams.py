"""Turns and readings that keep arriving, with the same operators as for tables.

Parsing and checking need no state, so they take a stream as they are. Daily use keeps one row per
customer and day until the watermark has passed the day.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattquill.functions.numeric import kwh_decimal, watt_hours
from wattquill.operators.toolcalls import check_calls
from wattquill.operators.transcripts import action_calls, parse_turns
from wattquill.schemas import READINGS, TURNS
from wattquill.sources.tables import exact_kwh


def read_turns(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Turns from JSON lines that are added below `path`."""
    return spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_readings(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Readings from Parquet files that are added below `path`."""
    stream = spark.readStream.schema(READINGS).option("maxFilesPerTrigger", files_per_batch)
    return exact_kwh(stream.parquet(path))


def checked_calls(turns: DataFrame) -> DataFrame:
    """Tool calls of arriving turns with their check."""
    return check_calls(action_calls(parse_turns(turns)))


def daily_consumption(readings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """kWh per customer and day, given out once no reading within `lateness` can change it."""
    at = F.col("timestamp").cast("timestamp")
    days = (
        readings.withColumn("_at", at)
        .withWatermark("_at", lateness)
        .groupBy("customer_id", F.window("_at", "1 day").alias("_day"))
        .agg(F.coalesce(F.sum(watt_hours(F.col("consumption_kwh"))), F.lit(0)).alias("wh"))
    )
    return days.select(
        "customer_id",
        F.to_date("_day.start").alias("reading_date"),
        kwh_decimal(F.col("wh")).cast("double").alias("consumption_kwh"),
    )


def append_to(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to Parquet files; `checkpoint` lies in a folder all executors share."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
