import json

import pytest
from pyspark.sql import functions as F

from wattquill.operators.toolcalls import call_records, check_calls, unknown_tool_calls
from wattquill.sources.constants import tool_parameters, tool_specs

DATES = '"start_date": "2026-01-01", "end_date": "2026-01-31"'
# tool, action input -> status, parameter at fault, converted arguments, extra arguments
CASES = [
    ("tariff_calculator", '{"customer_id": "1", %s}' % DATES, "ok", None,
     {"customer_id": "1", "start_date": "2026-01-01", "end_date": "2026-01-31"}, 0),
    ("sql_executor", '{"query": "SELECT 1"}', "ok", None, {"query": "SELECT 1", "row_limit": "100"}, 0),
    ("sql_executor", '{"query": "SELECT 1", "row_limit": " +7 ", "x": 1, "y": 2}', "ok", None,
     {"query": "SELECT 1", "row_limit": "7"}, 2),
    ("sql_executor", '{"query": "q", "row_limit": 1.9}', "ok", None, {"query": "q", "row_limit": "1"}, 0),
    ("sql_executor", '{"query": "q", "row_limit": -1.9}', "ok", None, {"query": "q", "row_limit": "-1"}, 0),
    ("sql_executor", '{"query": "q", "row_limit": true}', "ok", None, {"query": "q", "row_limit": "1"}, 0),
    ("sql_executor", '{"query": "q", "row_limit": "1_000"}', "ok", None, {"query": "q", "row_limit": "1000"}, 0),
    ("sql_executor", '{"query": "q", "row_limit": null}', "ok", None, {"query": "q", "row_limit": None}, 0),
    ("sql_executor", '{"query": 5}', "ok", None, {"query": "5", "row_limit": "100"}, 0),
    ("sql_executor", '{"query": true}', "ok", None, {"query": "True", "row_limit": "100"}, 0),
    ("sql_executor", '{"query": 1.0}', "ok", None, {"query": "1.0", "row_limit": "100"}, 0),
    ("sql_executor", '{"query": "q", "row_limit": 123456789012345678901234567890123456789012}', "ok", None,
     {"query": "q", "row_limit": "123456789012345678901234567890123456789012"}, 0),
    ("sql_executor", '{"query": "q", "row_limit": "-00123456789012345678901234567890123456789012"}', "ok", None,
     {"query": "q", "row_limit": "-123456789012345678901234567890123456789012"}, 0),
    ("sql_executor", '{"query": "q", "row_limit": 1e30}', "ok", None,
     {"query": "q", "row_limit": "1000000000000000019884624838656"}, 0),
    ("sql_executor", '{"query": "q", "row_limit": NaN}', "bad_type", "row_limit", None, 0),
    ("sql_executor", '{"query": null}', "ok", None, {"query": None, "row_limit": "100"}, 0),
    ("sql_executor", '{"query": "q", "row_limit": "1.5"}', "bad_type", "row_limit", None, 0),
    ("sql_executor", '{"query": "q", "row_limit": "many"}', "bad_type", "row_limit", None, 0),
    ("sql_executor", '{"query": "q", "row_limit": [1]}', "bad_type", "row_limit", None, 0),
    ("sql_executor", '{"query": "q", "row_limit": 1e400}', "bad_type", "row_limit", None, 0),
    ("sql_executor", '{"row_limit": "many"}', "missing_parameter", "query", None, 0),
    ("tariff_calculator", '{"customer_id": "one"}', "bad_type", "customer_id", None, 0),
    ("tariff_calculator", '{"customer_id": 1}', "missing_parameter", "start_date", None, 0),
    ("pandas_aggregator", '{"query": "q", "operation": "sum", "column": "x"}', "ok", None,
     {"query": "q", "operation": "sum", "column": "x", "group_by": None}, 0),
    ("plot_generator", '{"query": "q", "plot_type": "bar", "x_column": "a", "y_column": "b"}', "ok", None,
     {"query": "q", "plot_type": "bar", "x_column": "a", "y_column": "b", "title": ""}, 0),
    ("nonexistent_tool", '{"a": 1}', "unknown_tool", None, None, None),
    ("nonexistent_tool", "[1]", "unknown_tool", None, None, None),
    ("sql_executor", "[1]", "arguments_not_object", None, None, None),
    ("sql_executor", "null", "arguments_not_object", None, None, None),
    ("calculate_load_factor", "{}", "missing_parameter", "customer_id", None, 0),
]


@pytest.fixture()
def calls(frame):
    rows = [(1, i, tool, args) for i, (tool, args, *_) in enumerate(CASES)]
    return frame(rows, "episode_id bigint, step int, tool string, action_input string")


def test_cases(calls):
    got = {r.step: r for r in check_calls(calls).collect()}
    for i, (tool, args, status, param, arguments, extra) in enumerate(CASES):
        row = got[i]
        assert (row.status, row.problem_param, row.arguments, row.extra_arguments) == (
            status, param, arguments, extra,
        ), (tool, args)


def test_checking_shuffles_nothing(calls):
    plan = check_calls(calls)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_unknown_tools(calls):
    assert unknown_tool_calls(calls).count() == 2


def test_records(calls):
    records = {r.step: r for r in call_records(check_calls(calls)).collect()}
    assert records[0].success and records[0].error is None
    at = {(tool, args): i for i, (tool, args, *_) in enumerate(CASES)}
    missing = records[at["sql_executor", '{"row_limit": "many"}']]
    assert missing.error == "parameter 'query' of tool 'sql_executor' is not given"
    unknown = records[at["nonexistent_tool", '{"a": 1}']].error
    assert unknown.startswith("no tool is called 'nonexistent_tool', there are sql_executor, pandas_aggregator")
    bad = records[at["tariff_calculator", '{"customer_id": "one"}']]
    assert not bad.success and "customer_id" in bad.error


def test_five_tools_with_seventeen_parameters(spark):
    assert tool_parameters(spark).count() == 17
    sizes = {r.tool: r.n for r in tool_specs(spark).select("tool", F.size("specs").alias("n")).collect()}
    assert sizes == {
        "sql_executor": 2, "pandas_aggregator": 4, "tariff_calculator": 3, "plot_generator": 5,
        "calculate_load_factor": 3,
    }


def test_integers_of_doubles_are_exact(frame):
    """As Python's int: every digit of the double, towards zero."""
    import random

    rng = random.Random(4)
    values = [float(2**k + d) for k in range(49, 126) for d in (-1, 0, 1)] + [1e15 + 0.5, 9.99e37, 2.0**53 - 0.5]
    values += [rng.uniform(1, 10) * 10.0 ** rng.randint(15, 36) for _ in range(200)]
    values = [v * s for v in values for s in (1, -1)]
    rows = [(k, "sql_executor", json.dumps({"query": "q", "row_limit": v}).replace("e+", "e")) for k, v in enumerate(values)]
    df = frame(rows, "episode_id bigint, tool string, action_input string")
    got = {r.episode_id: (r.status, r.arguments["row_limit"]) for r in check_calls(df).collect()}
    assert got == {k: ("ok", str(int(v))) for k, v in enumerate(values)}
