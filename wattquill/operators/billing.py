"""Time-of-use bills for a table of requests, or for all customers over one period."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattquill import fixed_values as fv
from wattquill.functions.numeric import kwh_decimal, money
from wattquill.functions.peaks import in_mask, peak_mask, peak_windows
from wattquill.operators.periods import period_totals
from wattquill.operators.usage import (
    daily_profiles,
    in_period,
    peak_wh,
    readings_of_requests,
    usage_profiles,
)

_RATE = "decimal(10,6)"
PERIOD_KEY = ["customer_id", "start_date", "end_date"]
REQUEST_KEY = ["request_id", *PERIOD_KEY]
BILL_COLUMNS = [
    "segment",
    "total_kwh",
    "peak_kwh",
    "off_peak_kwh",
    "peak_cost",
    "off_peak_cost",
    "standing_charge",
    "total_cost",
    "currency",
    "null_reading_count",
    "status",
]


def priced_segments(tariffs: DataFrame) -> DataFrame:
    """One row per segment with exact rates and the peak hours as a bit mask.

    Two tariffs for a segment would make the bill ambiguous, so that fails the job: the check is part
    of the segment itself, the key of every join, and no choice of columns removes it.
    """
    one = tariffs.groupBy("segment").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(
            F.struct("peak_hours", "peak_rate_per_kwh", "off_peak_rate_per_kwh", "standing_charge")
        ).alias("_t"),
    )
    ambiguous = F.raise_error(F.concat(F.lit("more than one tariff for segment "), F.col("segment")))
    return one.select(
        F.when(F.col("_n") > 1, ambiguous).otherwise(F.col("segment")).alias("segment"),
        peak_mask(peak_windows(F.col("_t.peak_hours"))).alias("peak_mask"),
        F.col("_t.peak_rate_per_kwh").cast(_RATE).alias("peak_rate"),
        F.col("_t.off_peak_rate_per_kwh").cast(_RATE).alias("off_peak_rate"),
        F.col("_t.standing_charge").cast(_RATE).alias("daily_charge"),
    )


def tariff_windows(tariffs: DataFrame) -> DataFrame:
    """One row per tariff and peak window."""
    return tariffs.select(
        "tariff_id", "segment", F.explode(peak_windows(F.col("peak_hours"))).alias("w")
    ).select("tariff_id", "segment", "w.start_hour", "w.end_hour")


def customer_tariffs(customers: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Customers with the tariff of their segment, if there is one.

    No broadcast hint: the optimizer broadcasts the tariffs as long as they are below
    `spark.sql.autoBroadcastJoinThreshold`, and shuffles beyond it.
    """
    return customers.select("customer_id", "segment").join(
        priced_segments(tariffs), "segment", "left"
    )


def charged_days(start: Column, end: Column) -> Column:
    """Requested days, both ends included, whether or not there are readings."""
    return F.datediff(end, start) + 1


def standing_charges(requests: DataFrame, customers: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Standing charge per request; NULL without customer or tariff."""
    priced = customer_tariffs(customers, tariffs)
    days = charged_days(F.col("start_date"), F.col("end_date"))
    return requests.join(priced, "customer_id", "left").select(
        *requests.columns,
        days.alias("days"),
        money(days * F.col("daily_charge")).alias("standing_charge"),
    )


def _with_costs(usage: DataFrame, known: Column, keys: list[str]) -> DataFrame:
    """Costs and status from peak_wh, off_peak_wh, row_count and the tariff columns."""
    peak, off_peak = kwh_decimal(F.col("peak_wh")), kwh_decimal(F.col("off_peak_wh"))
    days = charged_days(F.col("start_date"), F.col("end_date"))
    status = (
        F.when(~known, "customer_not_found")
        .when(F.col("peak_rate").isNull(), "no_tariff")
        .when(F.coalesce(F.col("row_count"), F.lit(0)) == 0, "no_readings")
        .otherwise("ok")
    )
    costed = usage.select(
        "*",
        status.alias("status"),
        peak.alias("_peak"),
        off_peak.alias("_off_peak"),
        (peak * F.col("peak_rate")).cast("decimal(36,9)").alias("_peak_cost"),
        (off_peak * F.col("off_peak_rate")).cast("decimal(36,9)").alias("_off_peak_cost"),
        (days * F.col("daily_charge")).cast("decimal(36,9)").alias("_standing"),
    )
    ok = F.col("status") == "ok"
    amounts = {
        "total_kwh": F.col("_peak") + F.col("_off_peak"),
        "peak_kwh": F.col("_peak"),
        "off_peak_kwh": F.col("_off_peak"),
        "peak_cost": F.col("_peak_cost"),
        "off_peak_cost": F.col("_off_peak_cost"),
        "standing_charge": F.col("_standing"),
        "total_cost": F.col("_peak_cost") + F.col("_off_peak_cost") + F.col("_standing"),
    }
    return costed.select(
        *keys,
        "segment",
        *[F.when(ok, money(amount)).alias(name) for name, amount in amounts.items()],
        F.when(ok, F.lit(fv.CURRENCY)).alias("currency"),
        F.when(ok, F.col("null_reading_count")).alias("null_reading_count"),
        "status",
    )


def bill(
    requests: DataFrame, customers: DataFrame, tariffs: DataFrame, readings: DataFrame
) -> DataFrame:
    """One bill per request (request_id, customer_id, start_date, end_date).

    `status` is the first of customer_not_found, no_tariff, no_readings that applies, else ok.
    """
    profiles = daily_profiles(readings_of_requests(readings, requests))
    return bill_from_profiles(requests, customers, tariffs, profiles)


def bill_from_profiles(
    requests: DataFrame, customers: DataFrame, tariffs: DataFrame, profiles: DataFrame
) -> DataFrame:
    """`bill` from daily profiles, which may come from a table.

    The peak energy of a day follows from the customer's tariff; from there on a period is two
    running totals, however many days it has.
    """
    priced = customer_tariffs(customers, tariffs)
    masks = priced.filter(F.col("peak_mask").isNotNull()).select("customer_id", "peak_mask")
    days = profiles.join(masks, "customer_id").select(
        "customer_id", "reading_date", peak_wh().alias("peak_wh"), "wh", "row_count", "null_reading_count"
    )
    sums = ["peak_wh", "wh", "row_count", "null_reading_count"]
    totals = period_totals(days, requests, ["customer_id"], "reading_date", sums)
    usage = (
        requests.select(*REQUEST_KEY)
        .join(priced.drop("peak_mask").withColumn("_known", F.lit(True)), "customer_id", "left")
        .join(totals, PERIOD_KEY, "left")
        .withColumn("off_peak_wh", F.col("wh") - F.col("peak_wh"))
    )
    costs = _with_costs(usage, F.coalesce(F.col("_known"), F.lit(False)), REQUEST_KEY)
    return costs.select(*REQUEST_KEY, *BILL_COLUMNS)


def bill_period(
    customers: DataFrame, tariffs: DataFrame, readings: DataFrame, start_date: str, end_date: str
) -> DataFrame:
    """The bill of every customer for one period: no request table, hence no day matching."""
    profiles = usage_profiles(in_period(readings, start_date, end_date))
    usage = (
        customer_tariffs(customers, tariffs)
        .join(profiles, "customer_id", "left")
        .withColumn("peak_wh", peak_wh())
        .withColumn("off_peak_wh", F.col("wh") - F.col("peak_wh"))
        .withColumn("start_date", F.lit(start_date).cast("date"))
        .withColumn("end_date", F.lit(end_date).cast("date"))
    )
    return _with_costs(usage, F.lit(True), PERIOD_KEY)


def bills_by_segment(bills: DataFrame) -> DataFrame:
    """Revenue and energy per segment over the bills with status ok."""
    exact = "decimal(28,2)"
    return (
        bills.filter(F.col("status") == "ok")
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("bills"),
            F.sum(F.col("total_kwh").cast(exact)).cast("double").alias("total_kwh"),
            F.sum(F.col("standing_charge").cast(exact)).cast("double").alias("standing_charge"),
            F.sum(F.col("total_cost").cast(exact)).cast("double").alias("total_cost"),
        )
    )


def peak_split(customers: DataFrame, tariffs: DataFrame, readings: DataFrame) -> DataFrame:
    """Peak and off-peak kWh per customer with readings and a tariff."""
    profiles = usage_profiles(readings)
    priced = customer_tariffs(customers, tariffs).filter(F.col("peak_mask").isNotNull())
    peak = peak_wh()
    return profiles.join(priced, "customer_id").select(
        "customer_id",
        "segment",
        kwh_decimal(peak).cast("double").alias("peak_kwh"),
        kwh_decimal(F.col("wh") - peak).cast("double").alias("off_peak_kwh"),
    )


def hour_shares(customers: DataFrame, tariffs: DataFrame, readings: DataFrame) -> DataFrame:
    """kWh per segment and hour of day, with the peak flag of the segment's tariff."""
    profiles = usage_profiles(readings).select("customer_id", "wh_by_hour")
    priced = customer_tariffs(customers, tariffs).filter(F.col("peak_mask").isNotNull())
    hours = (
        profiles.join(priced, "customer_id")
        .select("segment", "peak_mask", F.posexplode("wh_by_hour").alias("hour", "wh"))
        .groupBy("segment", "peak_mask", "hour")
        .agg(F.sum("wh").alias("wh"))
    )
    return hours.select(
        "segment",
        "hour",
        in_mask(F.col("hour"), F.col("peak_mask")).alias("is_peak"),
        kwh_decimal(F.col("wh")).cast("double").alias("kwh"),
    )
