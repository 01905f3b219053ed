"""Synthetic meter data. Every value follows from (seed, key), so it does not depend on partitions."""

from datetime import date, datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill import fixed_values as fv
from wattquill.functions import digests
from wattquill.functions.hashing import digest, normal, uniform

_MINUTES_A_DAY = 24 * 60
ROWS_PER_TASK = 1_000_000


def _positive(**numbers: int) -> None:
    for name, number in numbers.items():
        if number <= 0:
            raise ValueError(f"{name} must be positive")


def customer_ids(spark: SparkSession, count: int) -> DataFrame:
    """Ids 1..count."""
    _positive(count=count)
    return spark.range(1, count + 1).withColumnRenamed("id", "customer_id")


def _segment(seed: int) -> Column:
    """The segment of a customer, which follows from the id alone."""
    drawn = uniform(digest(seed, "segment", F.col("customer_id")))
    return F.when(drawn < fv.RESIDENTIAL_SHARE, fv.SEGMENTS[0]).otherwise(fv.SEGMENTS[1])


def generate_customers(
    ids: DataFrame, as_of: date, seed: int = fv.DEFAULT_SEED
) -> DataFrame:
    """Segment, meter type and join date (within five years before `as_of`) for each customer_id."""

    def draw(purpose: str) -> Column:
        return uniform(digest(seed, purpose, F.col("customer_id")))

    days_back = F.floor(draw("join") * F.lit(float(fv.JOIN_DATE_SPAN_DAYS))).cast("int")
    base = F.date_sub(F.lit(as_of), fv.JOIN_DATE_SPAN_DAYS)
    return ids.select(
        "customer_id",
        _segment(seed).alias("segment"),
        F.when(draw("meter") < fv.SMART_SHARE, fv.METER_TYPES[0])
        .otherwise(fv.METER_TYPES[1])
        .alias("meter_type"),
        F.date_add(base, days_back).cast("timestamp_ntz").alias("join_date"),
    )


def base_load(segment: Column, timestamp: Column) -> Column:
    """Expected kWh of one interval before the season factor."""
    hour = F.hour(timestamp)
    workday = F.weekday(timestamp.cast("date")) < 5

    def within(window: tuple) -> Column:
        return (hour >= window[0]) & (hour < window[1])

    residential = (
        F.when(within(fv.RESIDENTIAL_MORNING), fv.RESIDENTIAL_MORNING[2])
        .when(within(fv.RESIDENTIAL_EVENING), fv.RESIDENTIAL_EVENING[2])
        .otherwise(fv.RESIDENTIAL_BASE)
    )
    commercial = F.when(
        workday & within(fv.COMMERCIAL_WORKDAY), fv.COMMERCIAL_WORKDAY[2]
    ).otherwise(fv.COMMERCIAL_BASE)
    return F.when(segment == fv.SEGMENTS[0], residential).otherwise(commercial)


def season_factor(timestamp: Column) -> Column:
    month = F.month(timestamp)
    return (
        F.when(month.isin(*fv.WINTER_MONTHS), fv.WINTER_FACTOR)
        .when(month.isin(*fv.SUMMER_MONTHS), fv.SUMMER_FACTOR)
        .otherwise(fv.MILD_FACTOR)
    )


def _steps_of_days(
    days: DataFrame, start: Column, per_day: int, interval_minutes: int
) -> DataFrame:
    """Rows with `_day` once for each step of the day: adds `step` and `timestamp`."""
    stepped = days.withColumn("_in_day", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))))
    return (
        stepped.withColumn("step", _step(per_day))
        .withColumn("timestamp", _time(start, interval_minutes))
        .drop("_day", "_in_day")
    )


def _step(per_day: int) -> Column:
    return (F.col("_day") * per_day + F.col("_in_day")).cast("bigint")


def _time(start: Column, interval_minutes: int) -> Column:
    """The timestamp of a `step`."""
    offset = F.make_dt_interval(mins=(F.col("step") * interval_minutes).cast("int"))
    return start.cast("timestamp_ntz") + offset


def _intervals(days: int, interval_minutes: int) -> int:
    """Intervals of a day."""
    _positive(days=days, interval_minutes=interval_minutes)
    per_day = _MINUTES_A_DAY // interval_minutes
    _positive(intervals_per_day=per_day)
    return per_day


def steps_of(days: int, interval_minutes: int = fv.DEFAULT_INTERVAL_MINUTES) -> int:
    """Intervals of so many days."""
    return days * _intervals(days, interval_minutes)


def with_time_axis(
    df: DataFrame,
    start: Column,
    days: int,
    interval_minutes: int = fv.DEFAULT_INTERVAL_MINUTES,
    partitions: int | None = None,
) -> DataFrame:
    """Every row once per interval: adds `step` (0, 1, ..) and `timestamp`.

    Rows are multiplied by day, dealt out evenly over `partitions` tasks (one for `ROWS_PER_TASK`
    resulting rows if not given), and only then multiplied by the steps of a day: a small customer file
    would otherwise leave all the work to the one task that reads it. Nothing is joined. For ids without
    gaps `range_time_axis` needs no dealing out.
    """
    per_day = _intervals(days, interval_minutes)
    tasks = partitions or max(1, -(-df.count() * days * per_day // ROWS_PER_TASK))
    dealt = df.withColumn("_day", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).repartition(tasks)
    return _steps_of_days(dealt, start, per_day, interval_minutes)


def range_time_axis(
    spark: SparkSession,
    first_id: int,
    count: int,
    start: Column,
    days: int,
    interval_minutes: int = fv.DEFAULT_INTERVAL_MINUTES,
    seed: int = fv.DEFAULT_SEED,
    rows_per_task: int = ROWS_PER_TASK,
    columns: dict[str, Column] | None = None,
) -> DataFrame:
    """customer_id, segment, step and timestamp of `count` customers with ids from `first_id` on.

    A range over customers times days, cut by rows a task: ids follow from the position, segments from
    the ids, so there is no table to read, nothing to deal out and no shuffle. More `columns` that follow
    from the id are worked out once a day, not once a step.
    """
    per_day = _intervals(days, interval_minutes)
    known = _range_days(spark, first_id, count, days, per_day, seed, rows_per_task, columns or {})
    return _steps_of_days(known, start, per_day, interval_minutes)


def _range_days(
    spark: SparkSession, first_id: int, count: int, days: int, per_day: int, seed: int, rows_per_task: int, columns: dict[str, Column]
) -> DataFrame:
    """customer_id, _day, segment and `columns` of `count` customers with ids from `first_id` on."""
    _positive(count=count, rows_per_task=rows_per_task)
    tasks = max(1, -(-count * days * per_day // rows_per_task))
    place = spark.range(0, count * days, 1, tasks)
    ids = place.select(
        (F.call_function("div", F.col("id"), F.lit(days)) + F.lit(first_id).cast("bigint")).alias("customer_id"),
        (F.col("id") % days).cast("int").alias("_day"),
    )
    return ids.withColumns({"segment": _segment(seed)} | columns)


def _start(start: datetime | str) -> Column:
    return F.lit(start).cast("timestamp_ntz") if isinstance(start, str) else F.lit(start)


def generate_readings(
    customers: DataFrame,
    start: datetime | str,
    days: int,
    interval_minutes: int = fv.DEFAULT_INTERVAL_MINUTES,
    seed: int = fv.DEFAULT_SEED,
) -> DataFrame:
    """Readings with 15 % noise around base load times season, never negative, three decimals.

    `reading_id` counts in customer-then-time order; it is computed, not sorted for.
    """
    known = customers.select("customer_id", "segment", _reading_key(seed).alias("_key"))
    axis = with_time_axis(known, _start(start), days, interval_minutes)
    return _readings(axis, steps_of(days, interval_minutes))


def generate_range_readings(
    spark: SparkSession,
    first_id: int,
    count: int,
    start: datetime | str,
    days: int,
    interval_minutes: int = fv.DEFAULT_INTERVAL_MINUTES,
    seed: int = fv.DEFAULT_SEED,
    rows_per_task: int = ROWS_PER_TASK,
    watt_hours: bool = False,
    hours: bool = False,
) -> DataFrame:
    """`generate_readings` of the customers that `generate_customers` makes of ids without gaps; with
    `watt_hours` also `wh`, the same energy in whole watt-hours, for sums without decimals, and with
    `hours` the `hour` of the timestamp. With `watt_hours` the noise comes from `digests`, several times
    faster, and hours are worked out once a step, not once a row."""
    per_day = _intervals(days, interval_minutes)
    steps = days * per_day
    prefix = _reading_prefix(seed)
    if watt_hours and len(f"{prefix}:{-(2**63)}:{steps}".encode()) <= digests.MOST_BYTES:
        known = _range_days(spark, first_id, count, days, per_day, seed, rows_per_task, {})
        kind = F.when(F.col("segment") == fv.SEGMENTS[0], 0).otherwise(1).alias("_kind")
        energy = digests.watt_hours_by_step(prefix, *_expected(spark, _start(start), days, per_day, interval_minutes), fv.NOISE_SHARE)
        drawn = known.select("customer_id", "_day", kind).mapInArrow(
            energy, "customer_id bigint, _day int, wh array<bigint>, hours array<int>"
        )
        stepped = drawn.select("customer_id", "_day", "hours", F.posexplode("wh").alias("_in_day", "wh"))
        made = stepped.withColumn("step", _step(per_day)).withColumn("timestamp", _time(_start(start), interval_minutes))
        return _with_energy(made, steps, F.col("wh"), True, F.get("hours", F.col("_in_day")) if hours else None)
    key = {"_key": _reading_key(seed)}
    axis = range_time_axis(spark, first_id, count, _start(start), days, interval_minutes, seed, rows_per_task, key)
    return _readings(axis, steps, watt_hours, F.hour("timestamp") if hours else None)


def _reading_prefix(seed: int) -> str:
    """What the digests of all readings begin with."""
    return f"{seed}:reading"


def _reading_key(seed: int) -> Column:
    """What the digests of all readings of a customer begin with."""
    return F.concat_ws(":", F.lit(_reading_prefix(seed)), F.col("customer_id").cast("string"))


def _mean() -> Column:
    return base_load(F.col("segment"), F.col("timestamp")) * season_factor(F.col("timestamp"))


def _expected(spark: SparkSession, start: Column, days: int, per_day: int, interval_minutes: int) -> tuple[np.ndarray, np.ndarray]:
    """The hour of each day and step of the day, and the expected kWh of each segment, day and step: as
    many as steps, whatever the customers."""
    steps = days * per_day
    axis = spark.range(len(fv.SEGMENTS) * steps).select(
        F.col("id"),
        F.when(F.col("id") < steps, fv.SEGMENTS[0]).otherwise(fv.SEGMENTS[1]).alias("segment"),
        (F.col("id") % steps).alias("step"),
    )
    timed = axis.withColumn("timestamp", _time(start, interval_minutes))
    rows = sorted(timed.select("id", F.hour("timestamp").alias("hour"), _mean().alias("mean")).collect())
    hours = np.array([row.hour for row in rows[:steps]], np.int32).reshape(days, per_day)
    return hours, np.array([row.mean for row in rows]).reshape(len(fv.SEGMENTS), days, per_day)


def _readings(axis: DataFrame, steps: int, watt_hours: bool = False, hour: Column | None = None) -> DataFrame:
    drawn = axis.withColumn("_digest", digest(F.col("_key"), F.col("step")))
    kwh = _mean() * (F.lit(1.0) + F.lit(fv.NOISE_SHARE) * normal(F.col("_digest")))
    wh = F.floor(F.greatest(kwh, F.lit(0.0)) * F.lit(1000.0) + F.lit(0.5))
    return _with_energy(drawn, steps, wh, watt_hours, hour)


def _with_energy(drawn: DataFrame, steps: int, wh: Column, watt_hours: bool, hour: Column | None) -> DataFrame:
    return drawn.select(
        ((F.col("customer_id") - 1) * steps + F.col("step") + 1).alias("reading_id"),
        "customer_id",
        "timestamp",
        (wh.cast("decimal(15,0)") / F.lit(1000)).cast("decimal(15,3)").alias("consumption_kwh"),
        *([wh.alias("wh")] if watt_hours else []),
        *([hour.alias("hour")] if hour is not None else []),
    )
