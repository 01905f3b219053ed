"""Totals and extremes of days over many periods, in work that does not depend on how long they are.

A period is the difference of two running totals: up to its last day, and up to the day before its
first. The running totals at just the requested days come from one window over days and requested days
together, whose groups hold calendar days, never readings or requests.

The extremes come from a sparse table: for each day and each power of two the extreme of that many
days from there on. Any period is covered by two such stretches of the same length, which may overlap.
Days are numbered among those a key has, so days without readings take no room.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattquill.functions.once import computed_once

_WIDE = "decimal(28,0)"
_PERIOD = ["start_date", "end_date"]


def _floor_log2(n: Column) -> Column:
    """Exact for any positive whole number: the binary digits are counted."""
    return F.length(F.bin(n)) - 1


def _power_of_two(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def _field(name: str) -> Callable[[Column], Column]:
    return lambda row: row[name]


def _doubling(pick: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    """A table of extremes and a step to the table with one level more, of twice the days."""

    def doubled(table: Column, level: Column) -> Column:
        last, ahead = F.element_at(table, -1), _power_of_two(level - 1)
        further = F.transform(last, lambda value, at: pick(value, F.get(last, at + ahead)))
        return F.concat(table, F.array(further))

    return doubled


def day_lists(days: DataFrame, keys: Sequence[str], day: str, columns: Sequence[str]) -> DataFrame:
    """(keys, _days): the days of each key in order, one entry per day of the calendar at most."""
    return days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(day, *columns))).alias("_days"))


def sparse_table(lists: DataFrame, keys: Sequence[str], extremes: dict[str, str]) -> DataFrame:
    """(keys, rank, one array per extreme): entry k is the extreme of 2^k days from the rank-th on.

    `lists` are `day_lists`; `extremes` maps columns to `max` or `min`. A row per day of a key,
    whatever its readings.
    """
    columns = list(extremes)
    doublings = F.when(F.size("_days") > 1, F.sequence(F.lit(1), _floor_log2(F.size("_days"))))
    tables = {}
    for column, kind in extremes.items():
        first = F.array(F.transform("_days", _field(column)))
        doubled = _doubling(F.greatest if kind == "max" else F.least)
        tables[column] = F.aggregate(F.coalesce(doublings, F.array().cast("array<int>")), first, doubled)
    # each table is built once per key, not once per entry that is taken from it
    rows = computed_once(lists, list(keys), _n=F.size("_days"), **tables)

    def entry(at: Column) -> Column:
        levels = [F.transform(c, lambda level: F.get(level, at)).alias(c) for c in columns]
        return F.struct((at + 1).alias("rank"), *levels)

    return rows.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), entry)))


def period_totals(
    days: DataFrame,
    periods: DataFrame,
    keys: Sequence[str],
    day: str,
    sums: Sequence[str],
    extremes: dict[str, str] | None = None,
) -> DataFrame:
    """(keys, start_date, end_date, sums, extremes) of the periods with both dates, each once.

    `days` has one row per key and day, `periods` the keys with start_date and end_date, both days
    included. A period without days has sums of 0 and extremes of NULL, a reversed one only NULLs.
    """
    keys, extremes = list(keys), extremes or {}
    wanted = periods.select(*keys, *_PERIOD).filter("start_date is not null and end_date is not null").distinct()
    ends = F.array(
        F.struct(F.col("end_date").alias("_at"), F.lit(1).alias("_sign")),
        F.struct(F.date_sub("start_date", 1).alias("_at"), F.lit(-1).alias("_sign")),
    )
    ends = wanted.select(*keys, *_PERIOD, F.inline(ends))
    points = ends.select(*keys, "_at").distinct()
    counted = [*sums, "_rank"]
    if extremes:
        # totals and extremes start from the same lists, so that the days are worked out once
        lists = day_lists(days, keys, day, [*sums, *extremes])
        days = lists.select(*keys, F.inline("_days"))
    events = days.select(
        *keys, F.col(day).alias("_at"), *[F.col(c).cast(_WIDE).alias(c) for c in sums], F.lit(1).alias("_rank"), F.lit(False).alias("_point")
    ).unionByName(points.withColumn("_point", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    running = events.select(*keys, "_at", "_point", *[F.sum(c).over(so_far).alias(c) for c in counted])
    running = running.filter("_point").drop("_point")
    sign, forward = F.col("_sign"), F.col("start_date") <= F.col("end_date")
    found = (
        ends.join(running, [*keys, "_at"])
        .groupBy(*keys, *_PERIOD)
        .agg(
            *[F.sum(F.when(forward, sign * F.coalesce(F.col(c), F.lit(0).cast(_WIDE)))).cast("bigint").alias(c) for c in sums],
            F.max(F.when(sign > 0, F.coalesce("_rank", F.lit(0)))).alias("_last"),
            (F.max(F.when(sign < 0, F.coalesce("_rank", F.lit(0)))) + 1).alias("_first"),
        )
    )
    if not extremes:
        return found.drop("_first", "_last")
    first, last = F.col("_first"), F.col("_last")
    level = _floor_log2(last - first + 1)
    covering = F.array(first, last - _power_of_two(level) + 1)
    stretches = found.filter(first <= last).filter(forward).select(*keys, *_PERIOD, level.alias("_level"), F.explode(covering.cast("array<int>")).alias("rank"))
    table = sparse_table(lists, keys, extremes)
    picks = {"max": F.max, "min": F.min}
    extreme = (
        stretches.join(table, [*keys, "rank"])
        .groupBy(*keys, *_PERIOD)
        .agg(*[picks[kind](F.get(c, F.col("_level"))).alias(c) for c, kind in extremes.items()])
    )
    return found.drop("_first", "_last").join(extreme, [*keys, *_PERIOD], "left")
