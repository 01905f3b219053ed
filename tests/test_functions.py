from decimal import ROUND_HALF_UP, Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from wattquill.functions import numeric, peaks, ranking, text


def column(frame, expression, values, kind="string"):
    rows = frame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    found = rows.select("i", expression.alias("y")).collect()
    return [r.y for r in sorted(found, key=lambda r: r.i)]


def test_strip_is_pythons_strip(frame):
    values = ["", " ", "a", "  a b \n", "\x1c\x1fx ", "​x ", "é　", "\t\r\n"]
    assert column(frame, text.strip(F.col("x")), values) == [v.strip() for v in values]


def test_last_number(frame):
    cases = {
        "The answer is 42": 42.0,
        "Value: 123.45": 123.45,
        "I found 5 items and the total is 100.50": 100.5,
        "The cost is £250.00": 250.0,
        "No value found": None,
        "-5": 5.0,
        "-5.5": -5.5,
        "on 2026-01-01": 1.0,
        "1,250.00.": 1250.0,
        "1e5": 5.0,
        "": None,
    }
    assert column(frame, text.last_number(F.col("x")), list(cases)) == list(cases.values())


def test_section_ends_at_first_stop_marker_of_the_list(frame):
    body = text.strip(text.until_stop(text.tail_after(F.col("x"), "Thought:")))
    cases = {
        "Thought: a\nAction: t\nAction Input: {}": "a\nAction: t",
        "Thought: a\nAction: t": "a",
        "Thought: a Answer: b Observation: c": "a",
        "Thought: a Observation: b Thought: c": "a Observation: b",
        "Thought:": "",
        "no marker": None,
    }
    assert column(frame, body, list(cases)) == list(cases.values())


def test_json_validity(frame):
    cases = {
        '{"a": 1}': True,
        "[1, 2]": True,
        "3": True,
        '"x"': True,
        "null": True,
        '{"a": 1} trailing': False,
        '{"a": 1}{"b": 2}': False,
        '{"a": 1}]': False,
        '{"a": 1}}': False,
        "1, 2": False,
        '1, "y": 2': False,
        "1],[2": False,
        "1},{2": False,
        "": False,
        "{'a': 1}": False,
        "{bad json": False,
        '{"a": NaN}': True,
        '{"a": 1, "a": 2}': True,
        '{"a": 1,}': False,
    }
    valid = F.coalesce(text.is_json(F.col("x")), F.lit(False))
    assert column(frame, valid, list(cases)) == list(cases.values())


def test_json_repair(frame):
    cases = {
        ' {"a": 1,} ': '{"a": 1}',
        '{"a": [1, 2,\n ],\t}': '{"a": [1, 2]}',
        '{"a": "x,y"}': '{"a": "x,y"}',
    }
    assert column(frame, text.repair_json(F.col("x")), list(cases)) == list(cases.values())


def test_peak_windows(frame):
    windows = "06:00-09:00,18:30-22:45"
    got = column(frame, peaks.peak_windows(F.col("x")), [windows])[0]
    assert [(w.start_hour, w.end_hour) for w in got] == [(6, 9), (18, 22)]
    masks = column(frame, peaks.peak_mask(peaks.peak_windows(F.col("x"))), [windows, "22:00-06:00", None])
    hours = {h for h in range(24) if masks[0] >> h & 1}
    assert hours == {6, 7, 8, 18, 19, 20, 21}
    assert masks[1] == 0, "a window over midnight matches no hour"
    assert masks[2] is None


@pytest.mark.parametrize("places", [0, 2, 3])
def test_rounded_ratio_is_exact(frame, places):
    pairs = [p for p in product([0, 1, 5, 7, -5, 2500, 10**14], [1, 2, 8, -16, 1000, 3]) if p[1]]
    rows = frame([(i, *p) for i, p in enumerate(pairs)], "i int, n bigint, d bigint")
    ratio = numeric.rounded_ratio(F.col("n"), F.col("d"), places)
    got = {r.i: r.y for r in rows.select("i", ratio.alias("y")).collect()}
    for i, (n, d) in enumerate(pairs):
        scaled = Decimal(n) * 10**places / Decimal(d)
        assert got[i] == int(scaled.quantize(Decimal(1), ROUND_HALF_UP)), (n, d)


def test_ratio_by_zero_is_null(frame):
    rows = frame([(1, 0)], "n bigint, d bigint")
    assert rows.select(numeric.rounded_ratio(F.col("n"), F.col("d"), 2)).first()[0] is None


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("levels", [["bucket"], ["wide", "bucket"]])
def test_bucketed_row_number_with_a_hot_key(frame, levels, partitions):
    """One key holds most rows; numbers must be those of one ordered pass."""
    rows = [("hot", i // 7, (i * 31) % 500, i) for i in range(500)]
    rows += [(f"k{i % 20}", i % 3, i % 5, 1000 + i) for i in range(100)]
    rows += [(None, 1, i, 2000 + i) for i in range(5)]
    df = frame(rows, "k string, bucket int, o int, id int").repartition(partitions)
    df = df.withColumn("wide", F.floor(F.col("bucket") / 10))
    got = ranking.bucketed_row_number(df, ["k"], levels, ["o", "id"], "rn").collect()
    expected, seen = {}, {}
    for k, bucket, o, i in sorted(rows, key=lambda r: r[1:]):
        seen[k] = seen.get(k, 0) + 1
        expected[i] = seen[k]
    assert {r.id: r.rn for r in got} == expected
