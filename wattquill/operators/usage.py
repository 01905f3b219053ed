"""Reading roll-ups that bills, load factors and plots are computed from.

All of them reduce the readings first, with partial aggregation before the shuffle, and join
customers or requests afterwards: raw readings are never shuffled, and a customer with a third of
all readings arrives at the shuffle as a few rows per map task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattquill.functions.numeric import watt_hours
from wattquill.functions.peaks import HOURS, masked_sum


def _between(readings: DataFrame, bounds: list[Column], days: list[Column]) -> DataFrame:
    """Readings in [lower, upper); tables partitioned by `reading_date` are pruned by the days."""
    lower, upper = bounds
    kept = readings.filter((F.col("timestamp") >= lower) & (F.col("timestamp") < upper))
    if "reading_date" in readings.columns:
        kept = kept.filter(F.col("reading_date").between(*days))
    return kept


def _as_bounds(start: Column, end: Column) -> list[Column]:
    """Start of the first day and start of the day after the last, so fractions of the last second
    belong to the period."""
    return [start.cast("timestamp_ntz"), F.date_add(end, 1).cast("timestamp_ntz")]


def in_period(readings: DataFrame, start_date: str, end_date: str) -> DataFrame:
    """Readings of the days start..end, both included."""
    days = [F.lit(start_date).cast("date"), F.lit(end_date).cast("date")]
    return _between(readings, _as_bounds(*days), days)


def readings_of_requests(readings: DataFrame, requests: DataFrame) -> DataFrame:
    """Readings between the first and the last requested day.

    The bounds are scalar subqueries of the column's own type, so that the scan can use their values.
    """
    days = [F.min("start_date"), F.max("end_date")]

    def value(column: Column) -> Column:
        return requests.agg(column).scalar()

    return _between(readings, [value(c) for c in _as_bounds(*days)], [value(c) for c in days])


def usage_profiles(readings: DataFrame, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """One row per key: energy by hour of day, total, extremes and counts.

    `wh_by_hour` has 24 entries, from which the energy in any peak hours can be summed. Columns
    nobody selects are pruned from the aggregate. Missing readings are skipped and counted in
    `null_reading_count`.
    """
    staged = readings.select(
        *keys, watt_hours(F.col("consumption_kwh")).alias("_wh"), F.hour("timestamp").alias("_hour")
    )
    names = [f"_part{hour}" for hour in HOURS]
    grouped = staged.groupBy(*keys).agg(
        *[F.expr(f"sum(CASE WHEN _hour = {hour} THEN _wh END) AS {n}") for hour, n in zip(HOURS, names, strict=True)],
        F.expr("coalesce(sum(_wh), 0L) AS wh"),
        F.max("_wh").alias("max_wh"),
        F.min("_wh").alias("min_wh"),
        F.count("_wh").alias("reading_count"),
        F.expr("count(*) AS row_count"),
    )
    return grouped.select(
        *keys,
        F.expr(f"array({', '.join(f'coalesce({name}, 0L)' for name in names)}) AS wh_by_hour"),
        "wh",
        "max_wh",
        "min_wh",
        "reading_count",
        "row_count",
        (F.col("row_count") - F.col("reading_count")).alias("null_reading_count"),
    )


def daily_profiles(readings: DataFrame) -> DataFrame:
    """`usage_profiles` per customer and day."""
    if "reading_date" not in readings.columns:
        readings = readings.withColumn("reading_date", F.to_date("timestamp"))
    return usage_profiles(readings, ("customer_id", "reading_date"))


def peak_wh() -> Column:
    """Energy of a profile in the peak hours of `peak_mask`; NULL where that is NULL."""
    return masked_sum(F.col("wh_by_hour"), F.col("peak_mask"))
