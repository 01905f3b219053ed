import json
from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wattquill.operators import workload as wl
from wattquill.operators.usage import daily_profiles, in_period
from wattquill.session import shared_dir
from wattquill.sources import artifacts, constants, tables, testdata, workload_json

CUSTOMERS = "customer_id bigint, segment string, meter_type string, join_date timestamp_ntz"
READINGS = "reading_id bigint, customer_id bigint, timestamp timestamp_ntz, consumption_kwh double"


@pytest.fixture()
def meter(spark):
    customers = spark.createDataFrame([(1, "residential", "smart", datetime(2020, 1, 1))], CUSTOMERS)
    rows = [(i, i % 5, datetime(2024, 1, 1 + i % 9, i % 24), i / 4) for i in range(200)]
    rows.append((999, 1, datetime(2024, 1, 3), float("nan")))
    return customers, constants.tariffs(spark), spark.createDataFrame(rows, READINGS)


def test_write_policy_and_layout(spark, meter, tmp_path):
    root = str(tmp_path / "meter")
    assert tables.write_tables(*meter, root)
    assert not tables.write_tables(*meter, root), "existing tables stay"
    customers, tariffs, readings = meter
    more = readings.union(readings.withColumn("reading_id", F.col("reading_id") + 1000))
    assert not tables.write_tables(customers, tariffs, more, root)
    assert tables.read_table(spark, root, "readings").count() == 201
    assert tables.write_tables(customers, tariffs, more, root, overwrite=True)
    back = tables.read_table(spark, root, "readings")
    assert back.count() == 402
    assert back.schema["consumption_kwh"].dataType.simpleString() == "decimal(15,3)"
    assert back.filter("consumption_kwh IS NULL").count() == 2, "NaN is NULL"
    assert tables.read_table(spark, root, "customers").schema == customers.schema
    stats = tables.table_stats({n: tables.read_table(spark, root, n) for n in ("customers", "tariffs", "readings")})
    assert {tuple(r) for r in stats.collect()} == {("customers", 1), ("tariffs", 2), ("readings", 402)}


def test_days_are_pruned(spark, meter, tmp_path):
    root = str(tmp_path / "meter")
    tables.write_tables(*meter, root)
    readings = tables.read_table(spark, root, "readings")
    january = in_period(readings, "2024-01-02", "2024-01-03")
    plan = january._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reading_date" in plan
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    whole = in_period(tables.exact_kwh(meter[2]), "2024-01-02", "2024-01-03")
    key = ["customer_id", "reading_date", "wh", "row_count"]
    assert sorted(daily_profiles(january).select(key).collect()) == sorted(daily_profiles(whole).select(key).collect())


def test_energy_filters_reach_the_scan(spark, meter, tmp_path):
    root = str(tmp_path / "meter")
    tables.write_tables(*meter, root)
    high = tables.read_table(spark, root, "readings").filter("consumption_kwh > 1.5")
    plan = high._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(consumption_kwh,1.500)" in plan
    from_doubles = tables.exact_kwh(meter[2]).filter("consumption_kwh > 1.5")
    assert high.count() == from_doubles.count()


def test_unknown_table(spark):
    with pytest.raises(ValueError, match="customers, tariffs, readings"):
        tables.read_table(spark, "/nowhere", "meters")


def test_intermediate_tables_go_to_the_shared_folder(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    assert shared_dir(spark) == str(folder)
    assert tables.materialize(spark.range(10), "ids").count() == 10
    assert list(folder.glob("ids-*/*.parquet"))


def _session(master, app):
    context = SimpleNamespace(master=master, applicationId=app)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)


def test_without_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_session("yarn", "a"))
    local = shared_dir(_session("local[2]", "a"))
    assert local == shared_dir(_session("local[2]", "a")) != shared_dir(_session("local[2]", "b"))


def _rows_read(df):
    """Rows of the row groups that a scan has read, before any filter on rows."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("dictionary", ["true", "false"])
def test_row_groups_read_for_one_customer_over_a_month(spark, tmp_path, dictionary):
    """Customer 77 has readings on three days of thirty; the ranges of all days include it."""
    customers = spark.createDataFrame([(1, "residential", "smart", datetime(2020, 1, 1))], CUSTOMERS)
    every = spark.range(200).filter("id != 77").selectExpr("id AS customer_id", "explode(sequence(0, 29)) AS day")
    some = spark.range(1).selectExpr("77L AS customer_id", "explode(array(3, 11, 28)) AS day")
    readings = every.union(some).selectExpr(
        "customer_id * 100 + day AS reading_id",
        "customer_id",
        "CAST(date_add(DATE '2024-01-01', day) AS TIMESTAMP_NTZ) AS timestamp",
        "CAST(1.5 AS DOUBLE) AS consumption_kwh",
    )
    root = str(tmp_path / "meter")
    tables.write_tables(customers, constants.tariffs(spark), readings, root)
    version = tables.current_version(spark, root)
    written = spark.read.option("parquet.filter.dictionary.enabled", dictionary).parquet(f"{root}/{version}/readings")
    month = written.filter("reading_date BETWEEN '2024-01-01' AND '2024-01-30'")
    one = month.filter("customer_id = 77")
    assert one.count() == 3
    assert _rows_read(one) <= 3 * 200
    assert _rows_read(month) == 199 * 30 + 3


def test_a_failing_write_leaves_the_old_tables(spark, meter, tmp_path):
    root = str(tmp_path / "meter")
    customers, tariffs, readings = meter
    assert tables.write_tables(*meter, root)
    old = {n: sorted(map(str, tables.read_table(spark, root, n).collect())) for n in ("customers", "tariffs", "readings")}
    broken = readings.withColumn("customer_id", F.when(F.col("customer_id") > 0, F.raise_error(F.lit("lost"))).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        tables.write_tables(customers.limit(1), tariffs.limit(1), broken, root, overwrite=True)
    for name, rows in old.items():
        assert sorted(map(str, tables.read_table(spark, root, name).collect())) == rows
    begun = tables.read_table(spark, root, "customers")
    assert tables.write_tables(customers.limit(1), tariffs, readings, root, overwrite=True)
    assert tables.read_table(spark, root, "customers").count() == 1
    assert begun.count() == len(old["customers"]), "a reader that began with the old version finishes"
    versions = [p.name for p in (tmp_path / "meter").iterdir() if p.name.startswith("version-")]
    assert len(versions) == 2


def test_workload_json(spark, tmp_path):
    entries = [
        {"query": "a?", "category": "count", "expected_value": 100.0, "tolerance": 0.0, "tolerance_type": "exact"},
        {"query": "b?", "category": "plot", "expected_value": True, "tolerance": 0.0, "tolerance_type": "plot_exists"},
        {"query": "c?", "category": "billing", "expected_value": 12, "tolerance": 0.05},
    ]
    path = tmp_path / "workload.json"
    path.write_text(json.dumps(entries, indent=2))
    loaded = workload_json.read_workload(spark, str(path))
    assert {r.query: (r.expected_value, r.tolerance_type) for r in loaded.collect()} == {
        "a?": (100.0, "exact"), "b?": (1.0, "plot_exists"), "c?": (12.0, None),
    }
    workload_json.write_workload(loaded, str(tmp_path / "out"))
    again = workload_json.read_workload(spark, str(tmp_path / "out"), multi_line=False)
    assert sorted(map(str, again.collect())) == sorted(map(str, loaded.collect()))
    assert {tuple(r) for r in wl.category_counts(again).collect()} == {("count", 1), ("plot", 1), ("billing", 1)}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        workload_json.read_workload(spark, str(tmp_path / "missing.json"))


def test_plot_artifacts(spark, tmp_path):
    plots, beside = tmp_path / "plots", tmp_path / "plots2"
    plots.mkdir(), beside.mkdir()
    (plots / "good.png").write_bytes(b"x")
    (plots / "empty.png").write_bytes(b"")
    (beside / "other.png").write_bytes(b"x")
    calls = spark.createDataFrame(
        [
            (1, "plot_generator", True, f"{plots}/good.png"),
            (2, "plot_generator", False, f"{plots}/good.png"),
            (3, "sql_executor", True, f"{plots}/good.png"),
            (4, "plot_generator", True, f"{plots}/empty.png"),
            (5, "plot_generator", True, f"{plots}/missing.png"),
            (6, "plot_generator", True, f"{beside}/other.png"),
            (7, "plot_generator", True, None),
            (8, "plot_generator", True, f"file:{plots}/good.png"),
        ],
        "episode_id bigint, tool string, success boolean, result string",
    )
    files = artifacts.list_artifacts(spark, str(tmp_path)).cache()
    assert files.count() == 2, "the reader leaves empty files out"
    verified = artifacts.verified_plot_calls(calls, files, str(plots))
    assert sorted(r.episode_id for r in verified.collect()) == [1, 8]


def test_ground_truth_options(spark, small):
    customers = testdata.customers(spark, small)
    questions = wl.workload_questions(customers, "January 2024", "2024-01-01", "2024-01-31")
    assert questions.count() == questions.select("query").distinct().count() == 150 * 10 + 2 * 6 + 6 + 3
    half = questions.filter(F.col("query").contains(" between 2024-01-01 and 2024-01-15")).first()
    assert (str(half.start_date), str(half.end_date), half.tool) == ("2024-01-01", "2024-01-15", "calculate_load_factor")
    profiles = daily_profiles(testdata.readings(spark, small))
    minimum = F.col("query").contains("minimum consumption")
    true = wl.ground_truth(questions, customers, testdata.tariffs(spark, small), profiles).filter(minimum)
    assert {(r.tolerance, r.tolerance_type) for r in true.collect()} == {(0.0, "exact")}
    assert min(r.expected_value for r in true.collect()) > 0
    forced = wl.with_tolerance(true, force_zero_minimum=True)
    assert {r.expected_value for r in forced.collect()} == {0.0}


def test_an_unknown_operation_is_not_left_out(spark, small):
    customers = testdata.customers(spark, small)
    asked = wl.workload_questions(customers, "January 2024", "2024-01-01", "2024-01-31")
    odd = asked.filter(F.col("operation") == "mean").withColumn("operation", F.lit("median"))
    profiles = daily_profiles(testdata.readings(spark, small))
    with pytest.raises(Exception, match="no answer for the operation median"):
        wl.ground_truth(odd, customers, testdata.tariffs(spark, small), profiles).collect()
