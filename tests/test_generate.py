from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattquill.functions import digests
from wattquill.functions.hashing import normal
from wattquill.operators import generate as gn
from wattquill.plans import meter


def made(spark, count=60, days=3, partitions=None):
    customers = gn.generate_customers(gn.customer_ids(spark, count), date(2024, 1, 1))
    return customers, gn.generate_readings(customers, "2024-01-05", days)


def test_counts_and_ids(spark):
    customers, readings = made(spark)
    assert customers.count() == 60
    row = readings.agg(F.count("*"), F.min("reading_id"), F.max("reading_id"), F.countDistinct("reading_id")).first()
    assert tuple(row) == (60 * 3 * 96, 1, 60 * 3 * 96, 60 * 3 * 96)
    ordered = readings.orderBy("reading_id").select("customer_id", "timestamp").collect()
    assert ordered == sorted(ordered), "ids follow customer, then time"


def test_values_do_not_depend_on_partitions(spark):
    ids = gn.customer_ids(spark, 40)
    sums = set()
    for n in (1, 4, 16):
        customers = gn.generate_customers(ids.repartition(n), date(2024, 1, 1))
        readings = gn.generate_readings(customers.repartition(n), "2024-01-05", 2)
        sums.add(
            tuple(
                readings.join(customers, "customer_id")
                .agg(F.sum("consumption_kwh"), F.sum(F.hash("segment", "meter_type", "join_date").cast("bigint")))
                .first()
            )
        )
    assert len(sums) == 1


def test_distributions(spark):
    customers = gn.generate_customers(gn.customer_ids(spark, 20000), date(2024, 1, 1))
    share = customers.agg(
        F.avg((F.col("segment") == "residential").cast("int")),
        F.avg((F.col("meter_type") == "smart").cast("int")),
        F.min("join_date"),
        F.max("join_date"),
    ).first()
    assert share[0] == pytest.approx(0.7, abs=0.02) and share[1] == pytest.approx(0.8, abs=0.02)
    assert share[2].date() >= date(2019, 1, 2) and share[3].date() < date(2024, 1, 1)


def test_noise_and_sign(spark):
    customers, readings = made(spark, 100, 7)
    joined = readings.join(customers, "customer_id")
    mean = gn.base_load(F.col("segment"), F.col("timestamp")) * gn.season_factor(F.col("timestamp"))
    ratio = F.col("consumption_kwh").cast("double") / mean
    row = joined.agg(F.avg(ratio), F.stddev(ratio), F.min("consumption_kwh")).first()
    assert row[0] == pytest.approx(1.0, abs=0.005)
    assert row[1] == pytest.approx(0.15, abs=0.005)
    assert row[2] >= 0


def test_base_load_and_season(frame):
    cases = [
        ("residential", "2024-01-06 05:59:00", 0.3, 1.3),
        ("residential", "2024-01-06 06:00:00", 0.8, 1.3),
        ("residential", "2024-04-06 18:00:00", 1.0, 0.85),
        ("residential", "2024-07-06 22:00:00", 0.3, 1.2),
        ("commercial", "2024-01-05 09:00:00", 2.5, 1.3),
        ("commercial", "2024-01-05 17:00:00", 0.8, 1.3),
        ("commercial", "2024-01-06 10:00:00", 0.8, 1.3),
        ("commercial", "2024-12-02 10:00:00", 2.5, 1.3),
    ]
    df = frame(cases, "segment string, at string, load double, season double")
    at = F.col("at").cast("timestamp_ntz")
    got = df.select(gn.base_load(F.col("segment"), at), gn.season_factor(at), "load", "season").collect()
    assert all(r[0] == r.load and r[1] == r.season for r in got)


def test_thirty_days_of_quarter_hours(spark):
    one = gn.customer_ids(spark, 1)
    axis = gn.with_time_axis(one, F.lit("2024-01-01"), 30)
    row = axis.agg(F.count("*"), F.min("timestamp").cast("string"), F.max("timestamp").cast("string")).first()
    assert tuple(row) == (2880, "2024-01-01 00:00:00", "2024-01-30 23:45:00")


@pytest.mark.parametrize("bad", [0, -1])
def test_parameters_must_be_positive(spark, bad):
    with pytest.raises(ValueError, match="positive"):
        gn.customer_ids(spark, bad)
    one = gn.customer_ids(spark, 1)
    with pytest.raises(ValueError, match="positive"):
        gn.with_time_axis(one, F.lit("2024-01-01"), bad)
    with pytest.raises(ValueError, match="positive"):
        gn.with_time_axis(one, F.lit("2024-01-01"), 1, bad)


def test_readings_of_an_id_range_need_no_shuffle(spark):
    ids = spark.range(5, 18).withColumnRenamed("id", "customer_id")
    customers = gn.generate_customers(ids, date(2024, 1, 1))
    start = "2024-03-30"
    expected = sorted(map(tuple, gn.generate_readings(customers, start, 3, 60).collect()))
    for rows in (100, 10**6):
        made = gn.generate_range_readings(spark, 5, 13, start, 3, 60, rows_per_task=rows)
        assert sorted(map(tuple, made.collect())) == expected
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.rdd.getNumPartitions() == -(-13 * 3 * 24 // rows)
    # tasks follow the rows, not the cores
    assert gn.generate_range_readings(spark, 1, 10**6, start, 365).rdd.getNumPartitions() == 35040
    for bad in (dict(count=0, days=1), dict(count=1, days=0), dict(count=1, days=1, interval_minutes=2000)):
        with pytest.raises(ValueError):
            gn.generate_range_readings(spark, 1, start=start, **bad)


def test_watt_hours_are_the_generated_energy(spark):
    rows = gn.generate_range_readings(spark, 5, 3, "2024-01-01", 2, watt_hours=True)
    plain = gn.generate_range_readings(spark, 5, 3, "2024-01-01", 2)
    assert "wh" not in plain.columns
    assert rows.filter("wh is null or wh != consumption_kwh * 1000").count() == 0
    assert sorted(map(tuple, rows.drop("wh").collect())) == sorted(map(tuple, plain.collect()))
    key = F.concat_ws(":", F.lit("42"), F.lit("reading"), F.col("customer_id").cast("string"))
    axis = gn.range_time_axis(spark, 5, 3, F.lit("2024-01-01"), 2, columns={"_key": key})
    text = axis.select("_key", "customer_id", "step").first()
    assert text._key == f"42:reading:{text.customer_id}"


def _aggregates(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Aggregate [" in line]


def test_times_are_written_as_text_after_they_are_counted(spark, small):
    (counted,) = _aggregates(meter.gen_time_axis(spark, small))
    assert "date_format" not in counted.split("],")[0]


def test_the_profile_of_generated_readings_needs_no_decimals_a_row(spark, small):
    plan = meter.gen_readings_profile(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(15,3)" not in plan and "42:reading" not in plan.split("Generate")[0]


def test_normals_of_many_steps_equal_the_expression(spark):
    keys, days = np.array([7, 7, 99, 100, 10**18, -5, 1]), np.array([0, 2, 1, 0, 2, 1, 2])
    got = {}
    for part, values in digests.normals_by_step("42:reading", 3, 500)(keys, days):
        for key, day, row in zip(keys[part].tolist(), days[part].tolist(), values.tolist(), strict=True):
            got |= {(key, 500 * day + k): value for k, value in enumerate(row)}
    text = F.concat_ws(":", F.lit("42:reading"), F.col("key"), F.col("step"))
    want = spark.createDataFrame(list(got), "key long, step long").select("key", "step", normal(F.md5(text)).alias("value"))
    assert len(got) == 7 * 500
    for key, step, value in want.collect():
        assert got[key, step] == pytest.approx(value, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("chunk", [1, 70, 100_000])
@pytest.mark.parametrize(("first", "days", "interval"), [(8, 3, 60), (997, 2, 15), (-3, 1, 1440)])
def test_watt_hours_equal_those_of_the_expression(spark, monkeypatch, chunk, first, days, interval):
    monkeypatch.setattr(digests, "CHUNK", chunk)
    made = gn.generate_range_readings(spark, first, 5, "2024-06-29", days, interval, rows_per_task=50, watt_hours=True)
    plain = gn.generate_range_readings(spark, first, 5, "2024-06-29", days, interval)
    timed = gn.generate_range_readings(spark, first, 5, "2024-06-29 22:10:00", days, interval, watt_hours=True, hours=True)
    assert timed.filter("hour != hour(timestamp) or hour is null").isEmpty() and timed.count() == plain.count()
    assert sorted(map(tuple, made.drop("wh").collect())) == sorted(map(tuple, plain.collect()))
    assert made.filter("wh is null or wh != consumption_kwh * 1000").isEmpty()


def test_a_seed_too_long_for_one_block_takes_the_expression(spark):
    odd = dict(days=70, interval_minutes=1, seed=-(10**18))
    made = gn.generate_range_readings(spark, 1, 1, "2024-01-01", **odd, watt_hours=True, hours=True)
    plain = gn.generate_range_readings(spark, 1, 1, "2024-01-01", **odd)
    assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.agg(F.sum("wh")).first()[0] == plain.agg(F.sum(F.col("consumption_kwh") * 1000)).first()[0]
    assert made.filter("hour != hour(timestamp)").isEmpty()


def test_the_profile_draws_its_noise_without_text_a_row(spark, small, monkeypatch):
    plan = meter.gen_readings_profile(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "step" not in "".join(x for x in plan.splitlines() if "md5" in x)
    assert "hour(" not in plan
    # tasks grow with the table beyond some number of them
    for count, tasks in ((15, 1), (15_000, 64), (5_400_000, 3888)):
        monkeypatch.setattr(meter, "_dense_ids", lambda spark, d, count=count: (1, count))
        assert meter._generated_readings(spark, small, True).rdd.getNumPartitions() == tasks
