"""One aggregate over a column, whole or by group, over all rows of the input."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattquill.fixed_values import AGGREGATIONS
from wattquill.functions.numeric import skip_nan

_FLOATS = (T.FloatType, T.DoubleType)
# the fraction of a double, 52 bits, in digits of 18 bits
_FRACTION_DIGITS, _PER_DIGIT = 3, 262144.0
# the quantile summary of the median: one in so many ranks of error, and places inside its bracket
_ACCURACY, _PLACES, _BELOW = 10_000, 4096, -2
_LARGEST = 1.7976931348623157e308


def _check(df: DataFrame, operation: str, column: str, group_by: str | None) -> None:
    if operation not in AGGREGATIONS:
        raise ValueError(f"invalid operation {operation!r}, allowed: {', '.join(AGGREGATIONS)}")
    for role, name in (("column", column), ("group column", group_by)):
        if name and name not in df.columns:
            raise ValueError(f"{role} {name!r} not found, available: {', '.join(df.columns)}")


def _present(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL."""
    return skip_nan(F.col(name)) if isinstance(df.schema[name].dataType, _FLOATS) else F.col(name)


def _summable(df: DataFrame, name: str) -> Column:
    """The column for a sum: whole numbers as DECIMAL, which large ones don't overflow."""
    whole = isinstance(df.schema[name].dataType, T.IntegralType)
    return F.col(name).cast("decimal(20,0)") if whole else F.col(name)


def _plain(df: DataFrame, name: str) -> DataFrame:
    """DECIMAL results are handed out as DOUBLE; sums of whole numbers stay exact."""
    kind = df.schema[name].dataType
    is_decimal = isinstance(kind, T.DecimalType) and kind.scale > 0
    return df.withColumn(name, F.col(name).cast("double")) if is_decimal else df


def _digits(value: Column) -> list[Column]:
    """A value as four digits that order it: sign and power of two, then the 52 bits of the fraction,
    18 at a time. Every step is monotone, so equal leading digits mean neighbours."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    sign = F.signum(value).cast("bigint")
    digits = [F.when(size > 0, sign * (power + 2000)).otherwise(F.lit(0).cast("bigint"))]
    rest = F.when(size > 0, size / F.pow(F.lit(2.0), power.cast("double")) - 1).otherwise(F.lit(0.0))
    for _ in range(_FRACTION_DIGITS):
        scaled = rest * _PER_DIGIT
        digit = F.floor(scaled)
        digits.append(sign * digit)
        rest = scaled - digit
    return digits


def exact_median(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, result): exact median of `value` per key, the mean of the two middle values; NULL where
    there is none. Infinities are values like others, so between -oo and oo lies NaN.

    Built-in `median` keeps all different values of a group in one task. Here a first scan makes a
    mergeable quantile summary, which brackets the middle within a rank error of one in `_ACCURACY`.
    A second one counts what lies below the bracket and the values inside it, which `_PLACES` places of
    equal width part again: a window holds the places, another the different values of one place. Equal
    values are one row, however many there are.
    """
    keys, v, d = list(keys), F.col(value), F.col(value).cast("double")
    margin = 2 / _ACCURACY
    ends = F.percentile_approx(d, [0.5 - margin, 0.5 + margin], _ACCURACY)
    summary = rows.groupBy(*keys).agg(F.count(v).alias("_total"), ends.alias("_ends"))
    summary = summary.select(*keys, "_total", F.get("_ends", F.lit(0)).alias("_low"), F.get("_ends", F.lit(1)).alias("_high"))
    seen = rows.filter(v.isNotNull()).join(summary, keys) if keys else rows.filter(v.isNotNull()).crossJoin(summary)
    # halves, so that the width of the widest bracket is finite
    lowest, highest = (F.least(F.greatest(F.col(c), F.lit(-_LARGEST)), F.lit(_LARGEST)) * 0.5 for c in ("_low", "_high"))
    place = F.floor((d * 0.5 - lowest) / (highest - lowest) * _PLACES)
    place = (
        F.when(d == F.lit(float("-inf")), -1)
        .when(d == F.lit(float("inf")), _PLACES + 1)
        .when(highest <= lowest, 0)
        .otherwise(place)
    )
    below = d < F.col("_low")
    counts = (
        seen.filter(d <= F.col("_high"))
        .groupBy(
            *keys,
            "_total",
            F.when(below, _BELOW).otherwise(place).cast("bigint").alias("_place"),
            F.when(~below, v).alias("_v"),
        )
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    places = counts.groupBy(*keys, "_total", "_place").agg(F.sum("_n").alias("_n"))
    ranks = F.array(F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1)
    ranked = places.select(*keys, "_place", "_n", F.posexplode(ranks).alias("_which", "_rank"))
    held = _holding_rank(ranked, [*keys, "_which"], "_place", "_n").select(
        *keys, "_place", "_which", (F.col("_rank") - F.col("_before")).alias("_rank")
    )
    middle = _holding_rank(counts.join(held, [*keys, "_place"]), [*keys, "_which"], "_v", "_n")
    exact = F.col("_v")
    if isinstance(rows.schema[value].dataType, T.IntegralType):
        exact = exact.cast("decimal(20,0)")
    both = middle.groupBy(*keys).agg(F.min(exact).alias("_min"), F.max(exact).alias("_max"), F.count("_v").alias("_found"))
    totals = summary.select(*keys, "_total")
    ended = totals.join(both, keys, "left") if keys else totals.crossJoin(both)
    between = ((F.col("_min") + F.col("_max")) / F.lit(2)).cast("double")
    missed = F.raise_error(F.lit("the middle lies outside the bracket of the summary"))
    result = F.when(F.col("_total") > 0, F.when(F.col("_found") == 2, between).otherwise(missed))
    return ended.select(*keys, result.alias("result"))


def median_of_counts(counts: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """Exact median per group from (keys, value, count) rows: the mean of the two middle values.

    Groups of at most `_PLACES` rows are ranked by one window, whatever their number. Only larger ones,
    of which there are few for the rows, take a pass for each digit. Floats all do.
    """
    keys = list(keys)
    if not keys or isinstance(counts.schema[value].dataType, _FLOATS):
        return _median_by_digits(counts, keys, value, count)
    rows = counts.filter(F.col(value).isNotNull())
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > _PLACES).select(*keys)
    by_digits = _median_by_digits(rows.join(large, keys, "left_semi"), keys, value, count)
    small = rows.join(large, keys, "left_anti")
    for key in keys:
        small = small.filter(F.col(key).isNotNull())
    return _median_by_rank(small, keys, value, count).unionByName(by_digits)


def _median_by_rank(rows: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """`median_of_counts` of groups that one window may hold."""
    exact = F.col(value)
    if isinstance(rows.schema[value].dataType, T.IntegralType):
        exact = exact.cast("decimal(20,0)")
    group = Window.partitionBy(*keys)
    so_far = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.select(
        *keys, exact.alias("_exact"), F.col(count).alias("_n"), F.sum(count).over(so_far).alias("_upto"), F.sum(count).over(group).alias("_size")
    )
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    first, last = F.col("_upto") - F.col("_n") + 1, F.col("_upto")
    middle = ranked.filter(low.between(first, last) | high.between(first, last))
    both = middle.groupBy(*keys).agg(F.min("_exact").alias("_low"), F.max("_exact").alias("_high"))
    return both.select(*keys, ((F.col("_low") + F.col("_high")) / 2).cast("double").alias("result"))


def _median_by_digits(counts: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """`median_of_counts` of groups of any size.

    Built-in `median` keeps all different values of a group in one task. Here each pass fixes one
    digit of the middle values: it counts the rows that share the digits found so far by their next
    digit, and goes on with the digit that holds the middle rank. No window holds more than the
    digits of one place (262,144, or the powers of two), or in the end the values that are one double,
    whatever the distribution.
    """
    exact = F.col(value)
    if isinstance(counts.schema[value].dataType, T.IntegralType):
        exact = exact.cast("decimal(20,0)")
    rows = counts.withColumn("_exact", exact).filter(F.col(value).isNotNull())
    for k, digit in enumerate(_digits(F.col(value).cast("double"))):
        rows = rows.withColumn(f"_d{k}", digit)
    names = [f"_d{k}" for k in range(1 + _FRACTION_DIGITS)]
    state = None
    for k, name in enumerate(names):
        path = [*keys, *names[:k]]
        if state is None:
            totals = rows.groupBy(*path, name).agg(F.sum(count).alias("_n"))
            size = F.sum("_n").over(Window.partitionBy(*keys))
            ranks = F.array(F.floor((size + 1) / 2), F.floor(size / 2) + 1)
            ranked = totals.withColumn("_ranks", ranks).select(
                *path, name, "_n", F.posexplode("_ranks").alias("_which", "_rank")
            )
        else:
            # the state is read once in each pass, so that the plan grows with the passes only
            ranked = (
                rows.join(state, path)
                .groupBy(*path, name, "_which", "_rank")
                .agg(F.sum(count).alias("_n"))
            )
        state = _holding_rank(ranked, [*keys, "_which"], name, "_n").select(
            *path, name, "_which", (F.col("_rank") - F.col("_before")).alias("_rank")
        )
    found = rows.join(state, [*keys, *names])
    middle = _holding_rank(found, [*keys, "_which"], value, count)
    both = middle.groupBy(*keys).agg(F.min("_exact").alias("_low"), F.max("_exact").alias("_high"))
    return both.select(*keys, ((F.col("_low") + F.col("_high")) / 2).cast("double").alias("result"))


def _holding_rank(ranked: DataFrame, keys: Sequence[str], order: str, count: str) -> DataFrame:
    """The row of each group in whose span of ranks `_rank` lies, with the ranks `_before` it."""
    running = F.sum(count).over(
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = ranked.withColumn("_before", running - F.col(count))
    at = F.col("_rank")
    return seen.filter((at > F.col("_before")) & (at <= F.col("_before") + F.col(count)))


def _combined(operation: str, total: Column, n: Column, low: Column, high: Column) -> Column:
    return {
        "sum": F.coalesce(total, F.lit(0)),
        "mean": F.when(n > 0, total.cast("double") / n),
        "count": n,
        "min": low,
        "max": high,
    }[operation]


def aggregate(
    df: DataFrame,
    operation: str,
    column: str,
    group_by: str | None = None,
    sample_rows: int | None = None,
    order_by: Sequence[str] | str | None = None,
) -> DataFrame:
    """`operation` over `column` as (result) or (group_by, result).

    NULL and NaN are skipped, NULL groups dropped; over no rows the sum is 0, the count 0 and the
    rest NULL. `sample_rows` with `order_by` aggregates the first rows in that order only.
    """
    _check(df, operation, column, group_by)
    if sample_rows is not None:
        if not order_by:
            raise ValueError("sample_rows needs order_by, or the sample is arbitrary")
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        df = df.orderBy(*order).limit(sample_rows)
    keys = [group_by] if group_by else []
    values = df.select(*[_present(df, k).alias(k) for k in keys], _present(df, column).alias("_v"))
    for key in keys:
        values = values.filter(F.col(key).isNotNull())
    v = F.col("_v")
    if operation == "median":
        return exact_median(values, keys, "_v")
    parts = {"min": F.min, "max": F.max, "count": F.count}
    if operation in ("sum", "mean"):
        result = _combined(operation, F.sum(_summable(values, "_v")), F.count(v), v, v)
    else:
        result = parts[operation](v)
    return _plain(values.groupBy(*keys).agg(result.alias("result")), "result")


def aggregate_by_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    operation: str,
    column: str,
    group_by: str | None = None,
) -> DataFrame:
    """The aggregate over `facts JOIN lookup USING (key)`, grouped by a column of the lookup.

    Facts are reduced to one row per key before the join, so neither a large lookup nor a key with
    very many facts makes the facts themselves travel; for the median they join as they are, since
    most values differ.
    The lookup has one row per key.
    """
    _check(facts, operation, column, None)
    if group_by and group_by not in lookup.columns:
        raise ValueError(
            f"group column {group_by!r} not found, available: {', '.join(lookup.columns)}"
        )
    keys = [group_by] if group_by else []
    side = lookup.select(key, *keys)
    if group_by:
        side = side.filter(F.col(group_by).isNotNull())
    values = facts.select(key, _present(facts, column).alias("_v"))
    v = F.col("_v")
    if operation == "median":
        return exact_median(values.join(side, key), keys, "_v")
    per_key = values.groupBy(key).agg(
        F.sum(_summable(values, "_v")).alias("_sum") if operation in ("sum", "mean") else F.lit(None).alias("_sum"),
        F.count(v).alias("_n"),
        F.min(v).alias("_min"),
        F.max(v).alias("_max"),
    )
    total = F.sum("_sum") if operation in ("sum", "mean") else F.lit(None)
    result = _combined(
        operation, total, F.coalesce(F.sum("_n"), F.lit(0)), F.min("_min"), F.max("_max")
    )
    return _plain(per_key.join(side, key).groupBy(*keys).agg(result.alias("result")), "result")
