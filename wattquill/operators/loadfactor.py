"""Load factor: mean over largest reading of a period, in 0..1 for non-negative readings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattquill.functions.numeric import rounded_ratio
from wattquill.operators.billing import PERIOD_KEY, REQUEST_KEY, charged_days
from wattquill.operators.periods import period_totals
from wattquill.operators.usage import (
    daily_profiles,
    in_period,
    readings_of_requests,
    usage_profiles,
)

_SUMMARY = ["wh", "max_wh", "reading_count", "row_count", "null_reading_count"]
LOAD_COLUMNS = [
    "load_factor",
    "average_load_kwh",
    "peak_load_kwh",
    "reading_count",
    "null_reading_count",
    "period_days",
    "status",
]


def load_factor_milli(wh: Column, max_wh: Column, reading_count: Column) -> Column:
    """The load factor in thousandths; 0 where the largest reading is not positive."""
    ratio = rounded_ratio(wh, reading_count.cast("decimal(20,0)") * max_wh.cast("decimal(18,0)"), 3)
    return F.when(max_wh > 0, ratio).when(max_wh <= 0, F.lit(0).cast("bigint"))


def _figures(usage: DataFrame, keys: list[str]) -> DataFrame:
    found = F.coalesce(F.col("row_count"), F.lit(0)) > 0
    wh, top, n = F.col("wh"), F.col("max_wh"), F.col("reading_count")
    thousand = F.lit(1000.0)
    return usage.select(
        *keys,
        (load_factor_milli(wh, top, n).cast("double") / thousand).alias("load_factor"),
        (rounded_ratio(wh, n, 0).cast("double") / thousand).alias("average_load_kwh"),
        (top.cast("double") / thousand).alias("peak_load_kwh"),
        F.when(found, n).alias("reading_count"),
        F.when(found, F.col("null_reading_count")).alias("null_reading_count"),
        F.when(found, charged_days(F.col("start_date"), F.col("end_date"))).alias("period_days"),
        F.when(found, F.lit("ok")).otherwise("no_readings").alias("status"),
    )


def load_factor(requests: DataFrame, readings: DataFrame) -> DataFrame:
    """One row per request (request_id, customer_id, start_date, end_date).

    The customer table is not consulted: an unknown customer simply has no readings.
    """
    return load_factor_from_profiles(requests, daily_profiles(readings_of_requests(readings, requests)))


def load_factor_from_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """`load_factor` from daily profiles, which may come from a table."""
    days = profiles.select("customer_id", "reading_date", *_SUMMARY)
    sums = [c for c in _SUMMARY if c != "max_wh"]
    totals = period_totals(days, requests, ["customer_id"], "reading_date", sums, {"max_wh": "max"})
    usage = requests.select(*REQUEST_KEY).join(totals, PERIOD_KEY, "left")
    return _figures(usage, REQUEST_KEY).select(*REQUEST_KEY, *LOAD_COLUMNS)


def load_factor_period(readings: DataFrame, start_date: str, end_date: str) -> DataFrame:
    """The load factor of every customer with readings in one period."""
    usage = (
        usage_profiles(in_period(readings, start_date, end_date))
        .withColumn("start_date", F.lit(start_date).cast("date"))
        .withColumn("end_date", F.lit(end_date).cast("date"))
    )
    return _figures(usage, PERIOD_KEY)


def compare_to(load_factors: DataFrame, base_customer_id: int) -> DataFrame:
    """Each load factor over that of the base customer, and a label: Good above 0.5, else Variable.

    The base is a single value, taken as a scalar subquery; there is no self join.
    """
    base = (
        load_factors.filter(F.col("customer_id") == base_customer_id)
        .agg(F.max("load_factor"))
        .scalar()
    )
    factor = F.col("load_factor")
    return load_factors.select(
        *PERIOD_KEY,
        "load_factor",
        F.when(base != 0, factor / base).alias("ratio_to_base"),
        F.when(factor > 0.5, "Good").otherwise("Variable").alias("efficiency"),
    )
