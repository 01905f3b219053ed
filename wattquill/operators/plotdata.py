"""Plot-ready series: two columns, whole, aggregated instead of cut off. Nothing is drawn here."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattquill.fixed_values import DEFAULT_SEED, PLOT_TYPES
from wattquill.functions.hashing import digest, uniform
from wattquill.functions.numeric import kwh_decimal
from wattquill.operators.aggregate import aggregate_by_lookup
from wattquill.operators.billing import peak_split
from wattquill.operators.usage import daily_profiles, in_period


def plot_title(x_column: str, y_column: str, title: str = "") -> str:
    return title or f"{y_column} vs {x_column}"


def plot_data(
    df: DataFrame,
    plot_type: str,
    x_column: str,
    y_column: str,
    sample: int | None = None,
    key: Sequence[str] | str | None = None,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """(series_x, series_y), in x order for a line.

    With `sample` a scatter has at most that many points: those whose hash of `key` (the columns that
    tell the rows apart) is lowest. Each task keeps its lowest ones and these are merged, so the sample
    is the same for any partitioning, and a row stays in it while fewer than `sample` rows hash lower.
    `sample_rate` is the hash below which all rows were taken, the share of rows to expect; 1 if all fit.
    """
    if plot_type not in PLOT_TYPES:
        raise ValueError(f"invalid plot type {plot_type!r}, allowed: {', '.join(PLOT_TYPES)}")
    keys = [key] if isinstance(key, str) else list(key or [])
    for axis, name in (("x", x_column), ("y", y_column), *(("key", k) for k in keys)):
        if name not in df.columns:
            raise ValueError(f"{axis} column {name!r} not found, available: {', '.join(df.columns)}")
    columns = [F.col(x_column).alias("series_x"), F.col(y_column).alias("series_y")]
    if sample is not None:
        if plot_type != "scatter" or not keys or sample < 1:
            raise ValueError("only a scatter is sampled, by the hash of its key, with one point or more")
        hashed = uniform(digest(seed, "plot", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
        lowest = df.select(*columns, hashed.alias("_hash")).orderBy("_hash", "series_x", "series_y").limit(sample)
        # a window over the sample only
        all_of_it = Window.partitionBy(F.lit(1))
        full = F.count(F.lit(1)).over(all_of_it) == sample
        rate = F.when(full, F.max("_hash").over(all_of_it)).otherwise(1.0)
        return lowest.select("series_x", "series_y", rate.alias("sample_rate"))
    series = df.select(*columns)
    return series.orderBy("series_x") if plot_type == "line" else series


def daily_consumption(readings: DataFrame) -> DataFrame:
    """kWh per customer and day."""
    return daily_profiles(readings).select(
        "customer_id",
        "reading_date",
        kwh_decimal(F.col("wh")).cast("double").alias("consumption_kwh"),
    )


def total_by_segment(readings: DataFrame, customers: DataFrame) -> DataFrame:
    totals = aggregate_by_lookup(
        readings, customers, "customer_id", "sum", "consumption_kwh", "segment"
    )
    return totals.withColumnRenamed("result", "total_consumption")


def month_trend(readings: DataFrame, start_date: str, end_date: str) -> DataFrame:
    """kWh of all customers per day of the period."""
    days = in_period(readings, start_date, end_date).groupBy(
        F.to_date("timestamp").alias("reading_date")
    )
    return days.agg(
        F.coalesce(F.sum("consumption_kwh"), F.lit(0)).cast("double").alias("consumption_kwh")
    )


def peak_vs_offpeak(customers: DataFrame, tariffs: DataFrame, readings: DataFrame) -> DataFrame:
    return peak_split(customers, tariffs, readings).select("customer_id", "peak_kwh", "off_peak_kwh")


def load_factor_histogram(load_factors: DataFrame, bins: int = 10) -> DataFrame:
    """Customers per load-factor bin 1..bins of equal width over 0..1; 1.0 is in the last bin."""
    bin_no = F.least(F.width_bucket("load_factor", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return (
        load_factors.filter(F.col("load_factor").isNotNull())
        .groupBy(bin_no.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("customers"))
        .select(
            "bin",
            ((F.col("bin") - 1) / F.lit(float(bins))).alias("bin_start"),
            (F.col("bin") / F.lit(float(bins))).alias("bin_end"),
            "customers",
        )
    )


def mean_by_meter_type(readings: DataFrame, customers: DataFrame) -> DataFrame:
    means = aggregate_by_lookup(
        readings, customers, "customer_id", "mean", "consumption_kwh", "meter_type"
    )
    return means.withColumnRenamed("result", "mean_consumption")
