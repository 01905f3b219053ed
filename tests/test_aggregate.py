import random
import statistics

import pytest

from wattquill.operators import aggregate as ag
from wattquill.operators.aggregate import aggregate, aggregate_by_lookup

NAN = float("nan")


def result(df):
    return df.first()["result"]


def test_null_and_nan_are_skipped(frame):
    df = frame([(1.0,), (NAN,), (3.0,), (None,)], "x double")
    got = {op: result(aggregate(df, op, "x")) for op in ("sum", "mean", "median", "count", "max", "min")}
    assert got == {"sum": 4.0, "mean": 2.0, "median": 2.0, "count": 2, "max": 3.0, "min": 1.0}


def test_no_rows(frame):
    df = frame([], "x double")
    got = {op: result(aggregate(df, op, "x")) for op in ("sum", "mean", "median", "count", "max", "min")}
    assert got == {"sum": 0.0, "mean": None, "median": None, "count": 0, "max": None, "min": None}


def test_groups(frame):
    rows = [("a", 1.0), ("a", 4.0), ("b", NAN), (None, 9.0)]
    df = frame(rows, "g string, x double")
    for op, expected in {
        "sum": {"a": 5.0, "b": 0.0},
        "mean": {"a": 2.5, "b": None},
        "median": {"a": 2.5, "b": None},
        "count": {"a": 2, "b": 0},
    }.items():
        assert {r.g: r.result for r in aggregate(df, op, "x", "g").collect()} == expected, op
    assert aggregate(df, "sum", "x", "").columns == ["result"]


def test_any_orderable_type(frame):
    df = frame([("x",), ("b",), (None,)], "s string")
    assert result(aggregate(df, "max", "s")) == "x"
    assert result(aggregate(df, "min", "s")) == "b"


def test_validation(frame):
    df = frame([(1,)], "x int")
    with pytest.raises(ValueError, match="sum, mean, median, count, max, min"):
        aggregate(df, "mode", "x")
    with pytest.raises(ValueError, match="available: x"):
        aggregate(df, "sum", "y")
    with pytest.raises(ValueError, match="group column 'z'"):
        aggregate(df, "sum", "x", "z")
    with pytest.raises(ValueError, match="order_by"):
        aggregate(df, "sum", "x", sample_rows=3)


def test_ordered_sample(frame):
    df = frame([(i, i) for i in range(20)], "i int, x int")
    assert result(aggregate(df, "sum", "x", sample_rows=3, order_by="i")) == 3


@pytest.mark.parametrize("kind", ["double", "decimal(12,3)", "int"])
def test_median_against_sorting(frame, kind):
    from decimal import Decimal

    rng = random.Random(7)
    draws = {
        "few": [rng.choice([1, 2, 2, 2, 900]) for _ in range(301)],
        "wide": [rng.randint(-(10**6), 10**6) for _ in range(400)],
        "one": [5],
        "two": [-3, 8],
        "dense": [1000 + rng.randint(0, 3) for _ in range(250)],
    }
    cast = {"double": lambda v: v / 7, "decimal(12,3)": lambda v: Decimal(v) / 8, "int": int}[kind]
    values = {g: [cast(v) for v in vs] for g, vs in draws.items()}
    df = frame([(g, v) for g, vs in values.items() for v in vs], f"g string, x {kind}").repartition(5)
    got = {r.g: r.result for r in aggregate(df, "median", "x", "g").collect()}
    assert got == {g: pytest.approx(float(statistics.median(vs)), abs=1e-12) for g, vs in values.items()}
    everything = [v for vs in values.values() for v in vs]
    assert result(aggregate(df, "median", "x")) == pytest.approx(float(statistics.median(everything)))


@pytest.mark.parametrize("op", ["sum", "mean", "median", "count", "max", "min"])
def test_lookup_equals_join_then_aggregate(frame, op):
    rng = random.Random(3)
    facts = frame([(0 if rng.random() < 0.4 else rng.randint(1, 30), rng.randint(0, 50)) for _ in range(600)], "k int, x int")
    lookup = frame([(k, None if k == 9 else f"g{k % 3}") for k in range(25)], "k int, g string")
    joined = facts.join(lookup, "k")
    got = {r.g: r.result for r in aggregate_by_lookup(facts, lookup, "k", op, "x", "g").collect()}
    assert got == {r.g: r.result for r in aggregate(joined, op, "x", "g").collect()}
    assert result(aggregate_by_lookup(facts, lookup, "k", op, "x")) == result(aggregate(joined, op, "x"))


@pytest.mark.parametrize(
    "values",
    [
        [230 + k * 1e-9 for k in range(5001)],
        [-(2.0**k) for k in range(-60, 60)] + [0.0, 5e-324, -5e-324, 1.7e308],
        [float(k // 3) - 50 for k in range(301)] + [0.1] * 40,
        [1.0, 2.0],
        [7.25],
    ],
)
def test_median_of_any_distribution(frame, values):
    from statistics import median

    rows = frame([("a", v) for v in values] + [("b", v + 1) for v in values[:9]], "k string, x double")
    got = {r.k: r.result for r in aggregate(rows, "median", "x", "k").collect()}
    assert got == {"a": median(values), "b": median([v + 1 for v in values[:9]])}
    assert aggregate(rows.filter("k = 'a'"), "median", "x").first().result == median(values)


def test_large_whole_numbers(frame):
    top = 2**63 - 1
    rows = frame([(top,), (top - 2,), (top - 4,), (top - 4,)], "x bigint")
    assert aggregate(rows, "median", "x").first().result == float(top - 3)
    assert aggregate(rows, "mean", "x").first().result == float(top)
    mixed = frame([(-top - 1,), (top,)], "x bigint")
    assert aggregate(mixed, "median", "x").first().result == -0.5
    assert aggregate(mixed, "mean", "x").first().result == -0.5


def test_sum_of_whole_numbers_beyond_64_bits(frame):
    rows = frame([("a", 2**62)] * 3 + [("b", -(2**63))] * 2, "k string, x bigint")
    assert {r.k: r.result for r in aggregate(rows, "sum", "x", "k").collect()} == {"a": 3 * 2**62, "b": -(2**64)}
    lookup = frame([("a", 1), ("b", 1)], "k string, g int")
    assert aggregate_by_lookup(rows, lookup, "k", "sum", "x", "g").first().result == 3 * 2**62 - 2**64


def test_median_with_infinities(frame):
    inf = float("inf")
    cases = {
        "up": ([1.0, inf, inf], inf),
        "down": ([-inf, -inf, 3.0, NAN], -inf),
        "middle": ([-inf, 1.0, 2.0, inf], 1.5),
        "one side": ([-inf, -inf, 5.0, 7.0, 9.0, inf, inf], 7.0),
        "wide": ([-1.7e308, 1.0, 1.7e308, inf], (1.0 + 1.7e308) / 2),
    }
    rows = frame([(k, v) for k, (vs, _) in cases.items() for v in vs], "k string, x double")
    got = {r.k: r.result for r in aggregate(rows, "median", "x", "k").collect()}
    assert got == {k: expected for k, (_, expected) in cases.items()}
    both = aggregate(frame([(-inf,), (inf,)], "x double"), "median", "x").first().result
    assert both != both


def test_median_of_many_rows_in_a_narrow_band(spark):
    """A summary of bounded size is not exact by itself here: the bracket and the second scan are."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 300_001, 1, 7).select((230 + F.col("id") * 1e-9).alias("x"), (F.col("id") % 2).alias("k"))
    assert aggregate(rows, "median", "x").first().result == 230 + 150_000 * 1e-9
    got = {r.k: r.result for r in aggregate(rows, "median", "x", "k").collect()}
    assert got == {0: 230 + 150_000 * 1e-9, 1: ((230 + 149_999 * 1e-9) + (230 + 150_001 * 1e-9)) / 2}


def test_median_reads_its_input_twice(spark, tmp_path):
    spark.range(0, 50_000, 1, 3).selectExpr("id % 5 as k", "id * 0.5 as x").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    for keys in (None, "k"):
        result = aggregate(df, "median", "x", keys)
        result.collect()
        final = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        scanned = final.count("FileScan parquet")
        reused = final.count("ReusedExchange")
        assert scanned == 2 or (scanned == 3 and reused), final
        # windows hold the places of a key or the values of one place, never a key's values
        assert "percentile(" not in final


def test_median_of_counts_ranks_small_groups_at_once(frame, monkeypatch):
    """Groups of few counts take no pass per digit; large ones beside them do; both are exact."""
    rows = [("small", 3, 1), ("small", -4, 2), ("small", 10, 1), ("one", 7, 1), ("odd", 5, 2), ("odd", 9, 3), (None, 1, 1), ("none", None, 4)]
    rows += [("large", 3 * k, 1 + k % 2) for k in range(5000)]
    counts = frame(rows, "k string, v long, n long")
    by_digits, asked = ag._median_by_digits, []

    def digits(counts, *rest):
        asked.extend(r.k for r in counts.select("k").distinct().collect())
        return by_digits(counts, *rest)

    monkeypatch.setattr(ag, "_median_by_digits", digits)
    found = {r.k: r.result for r in ag.median_of_counts(counts, ["k"], "v", "n").collect()}
    values = sorted(v for k, v, n in rows if k == "large" for _ in range(n))
    middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    assert found == {"small": -0.5, "one": 7.0, "odd": 9.0, "large": middle}
    assert asked == ["large"]
