"""Bills, load factors and plot series against a plain computation in Python."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from wattquill.operators import billing, loadfactor, plotdata
from wattquill.operators.aggregate import aggregate_by_lookup
from wattquill.operators.periods import day_lists, period_totals, sparse_table
from wattquill.operators.usage import daily_profiles, usage_profiles
from wattquill.sources import constants, testdata

READINGS = "reading_id bigint, customer_id bigint, timestamp timestamp_ntz, consumption_kwh decimal(12,3)"
REQUESTS = "request_id string, customer_id bigint, start_date date, end_date date"
RATES = {
    "residential": (Decimal("0.35"), Decimal("0.22"), Decimal("0.45"), {6, 7, 8, 18, 19, 20, 21}),
    "commercial": (Decimal("0.28"), Decimal("0.18"), Decimal("1.2"), set(range(9, 17))),
}


@pytest.fixture(scope="module")
def data():
    """Customer 1 holds two thirds of the readings and half of the requests; 4 has none."""
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    readings = []
    for i in range(1500):
        customer = 1 if rng.random() < 0.66 else rng.choice([2, 3, 5, 77])
        at = start + timedelta(seconds=rng.randint(0, 40 * 86400 - 1), microseconds=rng.randint(0, 999999))
        kwh = None if rng.random() < 0.03 else Decimal(rng.randint(0, 9999)).scaleb(-3)
        readings.append((i, customer, at, kwh))
    readings.append((9001, 2, datetime(2024, 1, 14, 23, 59, 59, 900000), Decimal("5.125")))
    customers = {1: "residential", 2: "commercial", 3: "residential", 4: "residential", 5: "industrial"}
    requests = []
    for i in range(60):
        customer = 1 if i % 2 else rng.choice([2, 3, 4, 5, 77, 88])
        first = date(2024, 1, 1) + timedelta(days=rng.randint(0, 30))
        requests.append((f"r{i}", customer, first, first + timedelta(days=rng.randint(-2, 20))))
    requests += [("same1", 1, date(2024, 1, 3), date(2024, 1, 9)), ("same2", 1, date(2024, 1, 3), date(2024, 1, 9))]
    requests += [("nodate", 1, None, date(2024, 1, 9)), ("lastsecond", 2, date(2024, 1, 14), date(2024, 1, 14))]
    return customers, readings, requests


@pytest.fixture(scope="module")
def frames(spark, data):
    customers, readings, requests = data
    return (
        spark.createDataFrame(list(customers.items()), "customer_id bigint, segment string"),
        constants.tariffs(spark),
        spark.createDataFrame(readings, READINGS).repartition(4),
        spark.createDataFrame(requests, REQUESTS),
    )


def cents(amount):
    return float(amount.quantize(Decimal("0.01"), ROUND_HALF_UP))


def expected_bill(data, customer, first, last):
    customers, readings, _ = data
    if customer not in customers:
        return "customer_not_found"
    if customers[customer] not in RATES:
        return "no_tariff"
    rows = [r for r in readings if r[1] == customer and first and first <= r[2].date() <= last]
    if not rows:
        return "no_readings"
    peak_rate, off_rate, daily, hours = RATES[customers[customer]]
    peak = sum((r[3] for r in rows if r[3] is not None and r[2].hour in hours), Decimal(0))
    off = sum((r[3] for r in rows if r[3] is not None and r[2].hour not in hours), Decimal(0))
    standing = ((last - first).days + 1) * daily
    parts = (peak + off, peak, off, peak * peak_rate, off * off_rate, standing)
    nulls = sum(r[3] is None for r in rows)
    return tuple(map(cents, (*parts, peak * peak_rate + off * off_rate + standing))) + (nulls,)


def test_bills_of_requests(data, frames):
    customers, tariffs, readings, requests = frames
    got = {r.request_id: r for r in billing.bill(requests, customers, tariffs, readings).collect()}
    assert len(got) == len(data[2])
    seen = set()
    for request_id, customer, first, last in data[2]:
        row, expected = got[request_id], expected_bill(data, customer, first, last)
        seen.add(row.status)
        assert (row.customer_id, row.start_date, row.end_date) == (customer, first, last)
        if isinstance(expected, str):
            assert row.status == expected and row.total_cost is None and row.currency is None
        else:
            assert row.status == "ok" and row.currency == "GBP"
            assert (
                row.total_kwh, row.peak_kwh, row.off_peak_kwh, row.peak_cost, row.off_peak_cost,
                row.standing_charge, row.total_cost, row.null_reading_count,
            ) == expected
    assert seen == {"ok", "customer_not_found", "no_tariff", "no_readings"}


def test_bills_of_a_period_equal_requests_for_it(frames, spark):
    customers, tariffs, readings, _ = frames
    all_month = customers.select(
        F.col("customer_id").cast("string").alias("request_id"),
        "customer_id",
        F.lit("2024-01-01").cast("date").alias("start_date"),
        F.lit("2024-01-31").cast("date").alias("end_date"),
    )
    one = billing.bill_period(customers, tariffs, readings, "2024-01-01", "2024-01-31")
    other = billing.bill(all_month, customers, tariffs, readings).drop("request_id")
    columns = sorted(one.columns)
    assert sorted(map(str, one.select(columns).collect())) == sorted(map(str, other.select(columns).collect()))


def test_bills_from_profiles(frames):
    customers, tariffs, readings, requests = frames
    direct = sorted(map(str, billing.bill(requests, customers, tariffs, readings).collect()))
    rolled = billing.bill_from_profiles(requests, customers, tariffs, daily_profiles(readings))
    assert direct == sorted(map(str, rolled.collect()))


def test_totals_of_odd_periods(frames, spark):
    profiles = daily_profiles(frames[2])
    rows = [
        ("0001-01-01", "9999-12-31"), ("2024-01-20", "2024-01-10"), (None, "2024-01-31"), ("2024-01-01", None),
        (None, None), ("1990-01-01", "1990-12-31"), ("2024-01-05", "2024-01-05"), ("2024-01-02", "2099-01-01"),
    ]
    periods = spark.createDataFrame([(1, *r) for r in rows] * 2, "customer_id bigint, start_date string, end_date string").withColumns(
        {c: F.col(c).cast("date") for c in ("start_date", "end_date")}
    )
    sums, extremes = ["wh", "row_count"], {"max_wh": "max", "min_wh": "min"}
    got = period_totals(profiles, periods, ["customer_id"], "reading_date", sums, extremes)
    days = [r for r in profiles.filter("customer_id = 1").collect()]
    found = {(str(r.start_date), str(r.end_date)): (r.wh, r.row_count, r.max_wh, r.min_wh) for r in got.collect()}
    assert set(found) == {r for r in rows if None not in r}
    assert found.pop(rows[1]) == (None, None, None, None)
    for (start, end), values in found.items():
        own = [d for d in days if start <= str(d.reading_date) <= end]
        top = [d.max_wh for d in own if d.max_wh is not None]
        low = [d.min_wh for d in own if d.min_wh is not None]
        assert values == (sum(d.wh for d in own), sum(d.row_count for d in own), max(top, default=None), min(low, default=None))
    none = period_totals(profiles.filter("false"), periods, ["customer_id"], "reading_date", sums, extremes)
    assert {(r.wh, r.row_count, r.max_wh) for r in none.collect()} == {(0, 0, None), (None, None, None)}


def test_sparse_table_covers_every_stretch(spark):
    import random

    rng = random.Random(1)
    values = [rng.choice([None, rng.randint(-9, 9)]) for _ in range(37)]
    rows = [("a", date(2024, 1, 1) + timedelta(days=3 * k), v) for k, v in enumerate(values)] + [("b", date(2024, 1, 1), 5)]
    rng.shuffle(rows)
    days = spark.createDataFrame(rows, "k string, day date, v bigint")
    table = {(r.k, r["rank"]): r.v for r in sparse_table(day_lists(days, ["k"], "day", ["v"]), ["k"], {"v": "max"}).collect()}
    assert table["b", 1] == [5] and len(table) == 38
    for start in range(37):
        for level, value in enumerate(table["a", start + 1]):
            own = [v for v in values[start : start + 2**level] if v is not None]
            assert value == max(own, default=None)


def test_rows_of_a_request_do_not_depend_on_its_length(frames, spark):
    """All years cost what one day costs: no generator makes a row per day."""
    profiles, counts = daily_profiles(frames[2]), []
    for last in ("2024-01-01", "9999-12-31"):
        requests = spark.createDataFrame([("a", 1, date(2024, 1, 1), date.fromisoformat(last))], REQUESTS)
        result = loadfactor.load_factor_from_profiles(requests, profiles)
        plan = result._jdf.queryExecution()
        result.collect()
        counts.append(plan.executedPlan().toString().count("sequence("))
        assert "sequence(start_date" not in plan.optimizedPlan().toString()
    assert counts[0] == counts[1]


def test_values_beyond_the_exact_range_are_counted_as_missing(frames, frame):
    customers, tariffs, *_ = frames
    from wattquill.sources.tables import exact_kwh

    values = [1.5, 1e9, 1e12, float("inf"), float("nan"), -1e300, None]
    rows = [(i, 1, f"2024-01-01 10:0{i}:00", v) for i, v in enumerate(values)]
    raw = frame(rows, "reading_id bigint, customer_id bigint, timestamp string, consumption_kwh double")
    readings = exact_kwh(raw.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))
    got = usage_profiles(readings).first()
    assert (got.wh, got.row_count, got.null_reading_count) == (10**12 + 1500, 7, 5)


def test_standing_charges_fail_on_two_tariffs(frames):
    customers, tariffs, _, requests = frames
    doubled = tariffs.union(tariffs.withColumn("tariff_id", F.lit(3).cast("bigint")))
    with pytest.raises(Exception, match="more than one tariff"):
        billing.standing_charges(requests, customers, doubled).collect()


def test_two_tariffs_for_a_segment_fail(frames):
    customers, tariffs, readings, _ = frames
    doubled = tariffs.union(tariffs.withColumn("tariff_id", F.lit(3).cast("bigint")))
    with pytest.raises(Exception, match="more than one tariff"):
        billing.bill_period(customers, doubled, readings, "2024-01-01", "2024-01-31").collect()


def test_split_adds_up(frames):
    customers, tariffs, readings, _ = frames
    split = {r.customer_id: r for r in billing.peak_split(customers, tariffs, readings).collect()}
    assert set(split) == {1, 2, 3}
    totals = {r.customer_id: r.s for r in readings.groupBy("customer_id").agg(F.sum("consumption_kwh").alias("s")).collect()}
    for customer, row in split.items():
        assert row.peak_kwh + row.off_peak_kwh == pytest.approx(float(totals[customer]))


def test_standing_charge_counts_requested_days(frames, spark):
    customers, tariffs, _, _ = frames
    requests = spark.createDataFrame([("a", 1, date(2024, 2, 1), date(2024, 2, 29)), ("b", 99, date(2024, 2, 1), date(2024, 2, 1))], REQUESTS)
    got = {r.request_id: (r.days, r.standing_charge) for r in billing.standing_charges(requests, customers, tariffs).collect()}
    assert got == {"a": (29, 13.05), "b": (1, None)}


def test_load_factors_of_requests(data, frames):
    _, _, readings, requests = frames
    got = {r.request_id: r for r in loadfactor.load_factor(requests, readings).collect()}
    assert len(got) == len(data[2])
    for request_id, customer, first, last in data[2]:
        rows = [r[3] for r in data[1] if r[1] == customer and first and first <= r[2].date() <= last]
        row, values = got[request_id], [v for v in rows if v is not None]
        if not rows:
            assert (row.status, row.load_factor, row.period_days) == ("no_readings", None, None)
            continue
        assert row.status == "ok" and row.reading_count == len(values)
        assert row.null_reading_count == len(rows) - len(values)
        assert row.period_days == (last - first).days + 1
        if values:
            mean, top = sum(values) / len(values), max(values)
            assert row.average_load_kwh == pytest.approx(float(mean), abs=0.00051)
            assert row.peak_load_kwh == float(top)
            assert row.load_factor == pytest.approx(float(mean / top) if top else 0.0, abs=0.00051)
            assert 0 <= row.load_factor <= 1


def test_load_factor_without_load(spark):
    rows = [(1, 1, datetime(2024, 1, 1), Decimal(0)), (2, 2, datetime(2024, 1, 1), None)]
    factors = loadfactor.load_factor_period(spark.createDataFrame(rows, READINGS), "2024-01-01", "2024-01-02")
    assert {r.customer_id: r.load_factor for r in factors.collect()} == {1: 0.0, 2: None}


def test_comparison_to_a_base_customer(spark):
    rows = [(1, 1, 2.0), (2, 1, 4.0), (3, 2, 1.0), (4, 2, 1.0), (5, 3, 1.0), (6, 3, 9.0), (7, 3, 1.0), (8, 3, 1.0)]
    readings = spark.createDataFrame([(i, c, datetime(2024, 1, 1, i), Decimal(v)) for i, c, v in rows], READINGS)
    factors = loadfactor.load_factor_period(readings, "2024-01-01", "2024-01-01")
    got = {r.customer_id: (r.ratio_to_base, r.efficiency) for r in loadfactor.compare_to(factors, 2).collect()}
    assert got == {1: (0.75, "Good"), 2: (1.0, "Good"), 3: (0.333, "Variable")}


def test_plot_data(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 3.0)], "day int, kwh double")
    line = plotdata.plot_data(df, "line", "day", "kwh")
    assert [tuple(r) for r in line.collect()] == [(1, 2.0), (2, 3.0), (3, 1.0)]
    assert line.columns == ["series_x", "series_y"]
    for bad in (("histogram", "day", "kwh"), ("bar", "x", "kwh"), ("bar", "day", "y")):
        with pytest.raises(ValueError):
            plotdata.plot_data(df, *bad)
    assert plotdata.plot_title("day", "kwh") == "kwh vs day"
    assert plotdata.plot_title("day", "kwh", "Use") == "Use"


def test_scatter_sample(spark):
    df = spark.range(5000).selectExpr("id", "id * 2.0D AS x", "id % 7 AS y")
    got = {}
    for parts in (1, 3, 11):
        sample = plotdata.plot_data(df.repartition(parts), "scatter", "x", "y", sample=500, key="id")
        got[parts] = sorted(map(tuple, sample.collect()))
    assert got[1] == got[3] == got[11] and len(got[1]) == 500
    assert {r[2] for r in got[1]} == {got[1][0][2]} and got[1][0][2] == pytest.approx(0.1, rel=0.2)
    # a smaller sample is part of a larger one
    few = plotdata.plot_data(df, "scatter", "x", "y", sample=50, key="id").collect()
    assert {tuple(r)[:2] for r in few} < {r[:2] for r in got[1]}
    rest = plotdata.plot_data(df.limit(20), "scatter", "x", "y", sample=50, key="id").collect()
    assert len(rest) == 20 and {r.sample_rate for r in rest} == {1.0}
    plan = plotdata.plot_data(df, "scatter", "x", "y", sample=50, key="id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    for bad in (dict(plot_type="bar", key="id"), dict(plot_type="scatter"), dict(plot_type="scatter", key="nope")):
        with pytest.raises(ValueError):
            plotdata.plot_data(df, x_column="x", y_column="y", sample=5, **bad)


def test_histogram_edges(spark):
    values = [0.0, 0.05, 0.1, 0.3, 0.6, 0.7, 0.999, 1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "load_factor double")
    got = {r.bin: r.customers for r in plotdata.load_factor_histogram(df).collect()}
    assert got == {1: 2, 2: 1, 4: 1, 7: 1, 8: 1, 10: 2}


def test_series_sum_to_the_readings(data, frames):
    customers, _, readings, _ = frames
    total = sum(r[3] for r in data[1] if r[3] is not None)
    daily = plotdata.daily_consumption(readings).agg(F.sum("consumption_kwh")).first()[0]
    assert daily == pytest.approx(float(total))
    by_segment = defaultdict(Decimal)
    for _, customer, _, kwh in data[1]:
        if customer in data[0]:
            by_segment[data[0][customer]] += kwh or 0
    got = {r.segment: r.total_consumption for r in plotdata.total_by_segment(readings, customers).collect()}
    assert got == {s: float(v) for s, v in by_segment.items()}


def test_control_values_of_peak_energy(spark):
    sf_dir = "/root/testdata/sf0.01"
    tables = [getattr(testdata, name)(spark, sf_dir) for name in ("customers", "tariffs", "readings")]
    shares = billing.hour_shares(*tables).filter("is_peak").groupBy("segment").agg(F.sum("kwh").alias("kwh"))
    got = {r.segment: round(r.kwh, 2) for r in shares.collect()}
    assert got == {"residential": 61363.91, "commercial": 98895.85}
    counts = aggregate_by_lookup(tables[2], tables[0], "customer_id", "count", "consumption_kwh", "segment")
    assert {r.segment: r.result for r in counts.collect()} == {"residential": 4141, "commercial": 5859}
