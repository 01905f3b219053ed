"""Registered meter queries over the test tables: (spark, sf_dir) -> DataFrame."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.functions.numeric import kwh_decimal
from wattquill.operators import aggregate as ag
from wattquill.operators import billing as bl
from wattquill.operators import generate as gn
from wattquill.operators import loadfactor as lf
from wattquill.operators import plotdata as pd
from wattquill.operators import workload as wl
from wattquill.operators.sqlguard import guarded_sql
from wattquill.operators.usage import daily_profiles
from wattquill.sources import tables, testdata, workload_json

MONTH = ("2024-01-01", "2024-01-31")
MONTH_NAME = "January 2024"
BIG_PERIOD = ("1995-01-01", "2001-12-31")
AS_OF = date(2024, 1, 1)
GENERATED_DAYS = 30
BASE_CUSTOMER = 7
PLOT_POINTS = 100
# small tasks, so that test sizes use all cores; beyond so many tasks they grow, as each costs a fixed time
GENERATED_ROWS, GENERATED_MOST_ROWS = 300_000, 4_000_000
GENERATED_TASKS = 64
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"

Query = Callable[[SparkSession, str], DataFrame]


def _meter(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return testdata.customers(spark, d), testdata.tariffs(spark, d), testdata.readings(spark, d)


def _text_dates(df: DataFrame) -> DataFrame:
    dates = [name for name, kind in df.dtypes if kind == "date"]
    return df.withColumns({name: F.col(name).cast("string") for name in dates})


def _stamp(column: str) -> Column:
    return F.date_format(column, STAMP)


# --- sources and sinks ------------------------------------------------------------------------


def src_readings_scan(spark: SparkSession, d: str) -> DataFrame:
    return testdata.readings(spark, d).select(
        "reading_id",
        "customer_id",
        _stamp("timestamp").alias("timestamp"),
        F.col("consumption_kwh").cast("double").alias("consumption_kwh"),
    )


def table_stats(spark: SparkSession, d: str) -> DataFrame:
    customers, tariffs, readings = _meter(spark, d)
    return tables.table_stats({"customers": customers, "tariffs": tariffs, "readings": readings})


def sink_roundtrip_counts(spark: SparkSession, d: str) -> DataFrame:
    root = tables.temporary_path(spark, "meter")
    customers, tariffs, readings = _meter(spark, d)
    dated = customers.withColumn("join_date", F.lit(None).cast("timestamp_ntz"))
    tables.write_tables(dated, tariffs, readings, root)
    back = {name: tables.read_table(spark, root, name) for name in ("customers", "tariffs", "readings")}
    days = (
        back["readings"]
        .groupBy(F.col("reading_date").cast("string").alias("table_name"))
        .agg(F.count("consumption_kwh").alias("row_count"))
        .select(F.concat(F.lit("readings/"), F.col("table_name")).alias("table_name"), "row_count")
    )
    return tables.table_stats(back).unionByName(days)


def _ground_truth(spark: SparkSession, d: str) -> DataFrame:
    customers, tariffs, readings = _meter(spark, d)
    questions = tables.materialize(
        wl.workload_questions(customers, MONTH_NAME, *MONTH), "questions"
    )
    profiles = tables.materialize(daily_profiles(readings), "profiles")
    return wl.ground_truth(questions, customers, tariffs, profiles)


def ground_truth_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Medians, counts of values and grouped questions."""
    customers, tariffs, readings = _meter(spark, d)
    questions = tables.materialize(wl.statistics_questions(customers, MONTH_NAME, *MONTH), "questions")
    profiles = tables.materialize(daily_profiles(readings), "profiles")
    counts = tables.materialize(wl.value_counts(readings), "counts")
    return wl.ground_truth(questions, customers, tariffs, profiles, counts=counts)


def workload_by_category(spark: SparkSession, d: str) -> DataFrame:
    path = tables.temporary_path(spark, "workload")
    workload_json.write_workload(_ground_truth(spark, d), path)
    return wl.category_counts(workload_json.read_workload(spark, path, multi_line=False))


# --- guarded SQL ------------------------------------------------------------------------------


def _sql(query: str, row_limit: int | None = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        customers, tariffs, readings = _meter(spark, d)
        tables.register_views({"customers": customers, "tariffs": tariffs, "readings": readings})
        result = guarded_sql(spark, query, row_limit)
        plain = {n: F.col(n).cast("double") for n, kind in result.dtypes if kind.startswith("decimal")}
        stamps = {n: _stamp(n) for n, kind in result.dtypes if kind == "timestamp_ntz"}
        return result.withColumns(plain | stamps)

    return run


SQL_QUERIES = {
    "sql_select_filter": "SELECT * FROM customers WHERE segment = 'residential';",
    "sql_count_customers": "SELECT COUNT(*) AS n FROM customers",
    "sql_count_segment": "SELECT COUNT(*) AS n FROM customers WHERE segment = 'commercial'",
    "sql_time_range": (
        "SELECT reading_id, customer_id, consumption_kwh FROM readings "
        "WHERE timestamp >= '2024-01-08' AND timestamp < '2024-01-15'"
    ),
    "sql_time_range_closed": (
        "SELECT reading_id, timestamp, consumption_kwh FROM readings "
        "WHERE timestamp >= '2024-01-08' AND timestamp <= '2024-01-10 23:59:59'"
    ),
    "sql_in_list": "SELECT * FROM readings WHERE customer_id IN (5, 10, 15)",
    "sql_join_segment": (
        "SELECT * FROM readings r JOIN customers c ON r.customer_id = c.customer_id "
        "WHERE c.segment = 'residential'"
    ),
    "sql_cast_date": "SELECT COUNT(*) AS n FROM readings WHERE timestamp::date = '2024-01-15'",
}
SQL_ORDER_LIMIT = "SELECT reading_id, consumption_kwh FROM readings ORDER BY consumption_kwh DESC, reading_id"


# --- aggregation ------------------------------------------------------------------------------


def _global(operation: str) -> Query:
    return lambda spark, d: ag.aggregate(testdata.readings(spark, d), operation, "consumption_kwh")


def _by(operation: str, group: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return ag.aggregate_by_lookup(
            testdata.readings(spark, d),
            testdata.customers(spark, d),
            "customer_id",
            operation,
            "consumption_kwh",
            group,
        )

    return run


def _joined(operation: str, segment: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        wanted = testdata.customers(spark, d).filter(F.col("segment") == segment)
        return ag.aggregate_by_lookup(
            testdata.readings(spark, d), wanted, "customer_id", operation, "consumption_kwh"
        )

    return run


def agg_capped_ordered(spark: SparkSession, d: str) -> DataFrame:
    return ag.aggregate(
        testdata.readings(spark, d),
        "sum",
        "consumption_kwh",
        sample_rows=100,
        order_by=["timestamp", "reading_id"],
    )


# --- billing ----------------------------------------------------------------------------------


def bill_monthly(spark: SparkSession, d: str) -> DataFrame:
    return _text_dates(bl.bill_period(*_meter(spark, d), *MONTH))


def bill_order_lines(spark: SparkSession, d: str) -> DataFrame:
    """The larger table: all years of order lines as readings."""
    customers, tariffs, _ = _meter(spark, d)
    return _text_dates(
        bl.bill_period(customers, tariffs, testdata.order_readings(spark, d), *BIG_PERIOD)
    )


def bill_requests(spark: SparkSession, d: str) -> DataFrame:
    return _text_dates(bl.bill(testdata.requests(spark, d), *_meter(spark, d)))


def bill_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """With the residential tariff only, so that every status occurs."""
    customers, tariffs, readings = _meter(spark, d)
    residential = tariffs.filter(F.col("segment") == "residential")
    bills = bl.bill(testdata.requests(spark, d), customers, residential, readings)
    return bills.groupBy("status").agg(F.count(F.lit(1)).alias("requests"))


def bill_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return bl.bills_by_segment(bl.bill_period(*_meter(spark, d), *MONTH))


def standing_charge(spark: SparkSession, d: str) -> DataFrame:
    customers, tariffs, _ = _meter(spark, d)
    return _text_dates(bl.standing_charges(testdata.requests(spark, d), customers, tariffs))


def tariff_peak_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each peak window with the energy used in it."""
    customers, tariffs, readings = _meter(spark, d)
    shares = bl.hour_shares(customers, tariffs, readings).select("segment", "hour", "kwh")
    windows = bl.tariff_windows(tariffs)
    inside = (F.col("hour") >= F.col("start_hour")) & (F.col("hour") < F.col("end_hour"))
    return (
        windows.join(shares, "segment")
        .filter(inside)
        .groupBy("tariff_id", "segment", "start_hour", "end_hour")
        .agg(F.sum(F.col("kwh").cast("decimal(23,3)")).cast("double").alias("kwh"))
    )


def peak_share_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return bl.hour_shares(*_meter(spark, d))


def peak_offpeak_by_customer(spark: SparkSession, d: str) -> DataFrame:
    return bl.peak_split(*_meter(spark, d))


# --- load factor ------------------------------------------------------------------------------


def load_factor(spark: SparkSession, d: str) -> DataFrame:
    return _text_dates(lf.load_factor_period(testdata.readings(spark, d), *MONTH))


def load_factor_requests(spark: SparkSession, d: str) -> DataFrame:
    return _text_dates(lf.load_factor(testdata.requests(spark, d), testdata.readings(spark, d)))


def load_factor_status(spark: SparkSession, d: str) -> DataFrame:
    factors = lf.load_factor(testdata.requests(spark, d), testdata.readings(spark, d))
    return factors.groupBy("status").agg(F.count(F.lit(1)).alias("requests"))


def load_factor_ratio(spark: SparkSession, d: str) -> DataFrame:
    factors = lf.load_factor_period(testdata.readings(spark, d), *MONTH)
    return _text_dates(lf.compare_to(factors, BASE_CUSTOMER))


# --- plot data --------------------------------------------------------------------------------


def plot_daily_consumption(spark: SparkSession, d: str) -> DataFrame:
    return _text_dates(pd.daily_consumption(testdata.readings(spark, d)))


def plot_total_by_segment(spark: SparkSession, d: str) -> DataFrame:
    totals = pd.total_by_segment(testdata.readings(spark, d), testdata.customers(spark, d))
    return pd.plot_data(totals, "bar", "segment", "total_consumption")


def plot_month_trend(spark: SparkSession, d: str) -> DataFrame:
    trend = _text_dates(pd.month_trend(testdata.readings(spark, d), *MONTH))
    return pd.plot_data(trend, "line", "reading_date", "consumption_kwh")


def plot_peak_vs_offpeak(spark: SparkSession, d: str) -> DataFrame:
    return pd.plot_data(pd.peak_vs_offpeak(*_meter(spark, d)), "scatter", "peak_kwh", "off_peak_kwh")


def plot_peak_vs_offpeak_sample(spark: SparkSession, d: str) -> DataFrame:
    """The scatter for any number of customers: as many points as can be drawn."""
    split = pd.peak_vs_offpeak(*_meter(spark, d))
    return pd.plot_data(split, "scatter", "peak_kwh", "off_peak_kwh", sample=PLOT_POINTS, key="customer_id")


def plot_load_factor_hist(spark: SparkSession, d: str) -> DataFrame:
    return pd.load_factor_histogram(lf.load_factor_period(testdata.readings(spark, d), *MONTH))


def plot_mean_by_meter_type(spark: SparkSession, d: str) -> DataFrame:
    means = pd.mean_by_meter_type(testdata.readings(spark, d), testdata.customers(spark, d))
    return pd.plot_data(means, "bar", "meter_type", "mean_consumption")


# --- synthetic data, generated for the customers of the test tables ---------------------------


def _generated_customers(spark: SparkSession, d: str) -> DataFrame:
    ids = testdata.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("customer_id"))
    return gn.generate_customers(ids, AS_OF)


def _dense_ids(spark: SparkSession, d: str) -> tuple[int, int]:
    """First id and number of the generated customers, whose ids have no gaps."""
    ids = testdata.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"))
    found = ids.agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("id").alias("n")).first()
    if found.n and found.last - found.first + 1 != found.n:
        raise ValueError("the customer ids have gaps: use generate_readings")
    return found.first or 1, found.n


def gen_customers_profile(spark: SparkSession, d: str) -> DataFrame:
    return (
        _generated_customers(spark, d)
        .groupBy("segment", "meter_type")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            _stamp_of(F.min("join_date")).alias("first_join"),
            _stamp_of(F.max("join_date")).alias("last_join"),
        )
    )


def _stamp_of(column: Column) -> Column:
    return F.date_format(column, STAMP)


def gen_tariffs(spark: SparkSession, d: str) -> DataFrame:
    """The tariffs with the number of generated customers each applies to."""
    sizes = _generated_customers(spark, d).groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    return testdata.tariffs(spark, d).join(sizes, "segment", "left")


def gen_time_axis(spark: SparkSession, d: str) -> DataFrame:
    first, count = _dense_ids(spark, d)
    axis = gn.range_time_axis(
        spark, first, count, F.lit("2024-01-01"), GENERATED_DAYS, rows_per_task=GENERATED_ROWS
    )
    # written as text once a time, not once a row
    times = axis.groupBy("timestamp").agg(F.count(F.lit(1)).alias("customers"), F.max("step").alias("step"))
    return times.withColumn("timestamp", _stamp("timestamp"))


def gen_base_load(spark: SparkSession, d: str) -> DataFrame:
    """Expected load at the times of the readings, per segment and hour of day."""
    hours = (
        testdata.readings(spark, d)
        .groupBy("customer_id", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("at"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    load = gn.base_load(F.col("segment"), F.col("at")).cast("decimal(4,1)")
    return (
        hours.join(testdata.customers(spark, d), "customer_id")
        .groupBy("segment", F.hour("at").alias("hour"))
        .agg(F.sum("n").alias("readings"), F.sum(load * F.col("n")).cast("double").alias("base_kwh"))
    )


def gen_season_factor(spark: SparkSession, d: str) -> DataFrame:
    """The factor of each month in which there are orders."""
    at = F.col("o_orderdate")
    months = testdata.table(spark, d, "orders").groupBy(
        F.month(at).alias("month"), gn.season_factor(at).alias("factor")
    )
    return months.agg(F.count(F.lit(1)).alias("orders"))


def _generated_readings(spark: SparkSession, d: str, for_profile: bool = False) -> DataFrame:
    first, count = _dense_ids(spark, d)
    rows = count * gn.steps_of(GENERATED_DAYS) // GENERATED_TASKS
    rows = min(max(rows, GENERATED_ROWS), GENERATED_MOST_ROWS)
    return gn.generate_range_readings(
        spark, first, count, "2024-01-01", GENERATED_DAYS, rows_per_task=rows, watt_hours=for_profile, hours=for_profile
    )


def gen_readings_profile(spark: SparkSession, d: str) -> DataFrame:
    hours = _generated_readings(spark, d, for_profile=True).groupBy("customer_id", "hour")
    per_customer = hours.agg(
        F.count(F.lit(1)).alias("n"), F.sum("wh").alias("wh"), F.min("wh").alias("lo"), F.max("wh").alias("hi")
    )
    return (
        per_customer.join(_generated_customers(spark, d), "customer_id")
        .groupBy("segment", "hour")
        .agg(
            F.sum("n").alias("readings"),
            kwh_decimal(F.sum("wh")).cast("double").alias("kwh"),
            kwh_decimal(F.min("lo")).cast("double").alias("min_kwh"),
            kwh_decimal(F.max("hi")).cast("double").alias("max_kwh"),
        )
    )


def gen_readings_count(spark: SparkSession, d: str) -> DataFrame:
    return _generated_readings(spark, d).agg(
        F.count(F.lit(1)).alias("readings"),
        F.min("reading_id").alias("first_id"),
        F.max("reading_id").alias("last_id"),
        F.sum("reading_id").alias("id_sum"),
    )


# --- workload ---------------------------------------------------------------------------------


def workload_tolerances(spark: SparkSession, d: str) -> DataFrame:
    return (
        _ground_truth(spark, d)
        .groupBy("category", "tolerance_type", "tolerance")
        .agg(F.count(F.lit(1)).alias("questions"))
    )


def queries() -> dict[str, Query]:
    named = [
        src_readings_scan,
        table_stats,
        sink_roundtrip_counts,
        ground_truth_statistics,
        workload_by_category,
        agg_capped_ordered,
        bill_monthly,
        bill_order_lines,
        bill_requests,
        bill_status_counts,
        bill_by_segment,
        standing_charge,
        tariff_peak_windows,
        peak_share_by_hour,
        peak_offpeak_by_customer,
        load_factor,
        load_factor_requests,
        load_factor_status,
        load_factor_ratio,
        plot_daily_consumption,
        plot_total_by_segment,
        plot_month_trend,
        plot_peak_vs_offpeak,
        plot_peak_vs_offpeak_sample,
        plot_load_factor_hist,
        plot_mean_by_meter_type,
        gen_customers_profile,
        gen_tariffs,
        gen_time_axis,
        gen_base_load,
        gen_season_factor,
        gen_readings_profile,
        gen_readings_count,
        workload_tolerances,
    ]
    found: dict[str, Query] = {query.__name__: query for query in named}
    found["ground_truth"] = _ground_truth
    found |= {name: _sql(query) for name, query in SQL_QUERIES.items()}
    found["sql_order_limit"] = _sql(SQL_ORDER_LIMIT, row_limit=100)
    found |= {f"agg_global_{op}": _global(op) for op in ("sum", "mean", "median", "count", "max", "min")}
    found["agg_by_segment"] = _by("mean", "segment")
    found["agg_by_meter_type"] = _by("sum", "meter_type")
    found["agg_median_by_segment"] = _by("median", "segment")
    found["agg_join_mean_residential"] = _joined("mean", "residential")
    found["agg_join_sum_commercial"] = _joined("sum", "commercial")
    return found
