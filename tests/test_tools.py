from datetime import date

import pytest

from wattquill.operators import generate as gn
from wattquill.sources import constants, tables
from wattquill.tools import MeterTools


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    """Generated tables, written and opened again."""
    root = str(tmp_path_factory.mktemp("tools"))
    customers = gn.generate_customers(gn.customer_ids(spark, 20), date(2026, 1, 1))
    tables.write_tables(customers, constants.tariffs(spark), gn.generate_readings(customers, "2026-01-01", 10), root)
    return MeterTools.open(spark, root)


def test_counts(tools):
    result = tools.sql_executor("SELECT COUNT(*) AS n FROM readings")
    assert result == {"columns": ["n"], "rows": [[20 * 10 * 96]], "row_count": 1}
    assert tools.sql_executor("SELECT * FROM customers WHERE customer_id IN (5, 10, 15)")["row_count"] == 3
    assert tools.sql_executor("SELECT * FROM readings")["row_count"] == 100
    halves = [
        tools.sql_executor(f"SELECT COUNT(*) FROM customers WHERE segment = '{s}'")["rows"][0][0]
        for s in ("residential", "commercial")
    ]
    assert sum(halves) == 20


def test_every_row_is_aggregated(tools):
    query = "SELECT * FROM readings r JOIN customers c ON r.customer_id = c.customer_id"
    count = tools.pandas_aggregator(query, "count", "consumption_kwh")
    assert count == {"operation": "count", "column": "consumption_kwh", "result": 19200}
    groups = tools.pandas_aggregator(query, "sum", "consumption_kwh", "segment")["results"]
    cut = tools.pandas_aggregator(query, "sum", "consumption_kwh", "segment", group_limit=1)
    assert len(cut["results"]) == 1 and cut["truncated"]
    total = tools.pandas_aggregator("SELECT * FROM readings", "sum", "consumption_kwh")["result"]
    assert list(groups) == sorted(groups) and sum(groups.values()) == pytest.approx(total)
    mean = tools.pandas_aggregator("SELECT * FROM readings", "mean", "consumption_kwh")["result"]
    assert mean == pytest.approx(total / 19200)


def test_bill_and_load_factor(tools):
    bill = tools.tariff_calculator(3, "2026-01-01", "2026-01-05")
    assert bill["total_kwh"] == pytest.approx(bill["peak_kwh"] + bill["off_peak_kwh"], abs=0.011)
    parts = bill["peak_cost"] + bill["off_peak_cost"] + bill["standing_charge"]
    assert bill["total_cost"] == pytest.approx(parts, abs=0.016)
    assert (bill["currency"], bill["start_date"], bill["end_date"]) == ("GBP", "2026-01-01", "2026-01-05")
    factor = tools.calculate_load_factor(3, "2026-01-01", "2026-01-05")
    assert (factor["reading_count"], factor["period_days"]) == (480, 5)
    assert factor["load_factor"] == pytest.approx(factor["average_load_kwh"] / factor["peak_load_kwh"], abs=0.001)


def test_problems_are_errors(tools):
    with pytest.raises(ValueError, match="there is no customer 9999"):
        tools.tariff_calculator(9999, "2026-01-01", "2026-01-05")
    with pytest.raises(ValueError, match="customer 3 has no readings"):
        tools.tariff_calculator(3, "2020-01-01", "2020-01-05")
    with pytest.raises(ValueError, match="customer 9999 has no readings"):
        tools.calculate_load_factor(9999, "2026-01-01", "2026-01-05")
    with pytest.raises(ValueError, match="only"):
        tools.sql_executor("DELETE FROM customers")


def test_plot_series_is_whole(tools):
    query = "SELECT timestamp, consumption_kwh FROM readings WHERE customer_id = 5"
    assert tools.plot_series(query, "line", "timestamp", "consumption_kwh").count() == 960
    titles = {
        tools.plot_series(query, "line", "timestamp", "consumption_kwh", *t).first().title for t in ((), ("Mine",))
    }
    assert titles == {"consumption_kwh vs timestamp", "Mine"}
