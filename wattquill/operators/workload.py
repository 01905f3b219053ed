"""The question workload and its true answers, worked out as batches instead of one call each."""

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattquill import fixed_values as fv
from wattquill.functions.numeric import rounded_ratio, watt_hours
from wattquill.operators.aggregate import median_of_counts
from wattquill.operators.billing import bill_from_profiles
from wattquill.operators.loadfactor import load_factor_from_profiles
from wattquill.operators.periods import period_totals
from wattquill.sources.constants import literal_rows
from wattquill.sources.tables import materialize

QUESTION_COLUMNS = [
    "query", "category", "tool", "operation", "scope", "scope_key", "customer_id", "start_date", "end_date",
]
_ENTRY = ["query", "category", "expected_value", "tolerance", "tolerance_type"]
_STATS = ["wh", "n", "rows", "min_wh", "max_wh"]
_TOOLS = {
    "bill": ("billing", "tariff_calculator"),
    "load_factor": ("load_factor", "calculate_load_factor"),
    "count_customers": ("count", "sql_executor"),
    "count_readings": ("count", "sql_executor"),
    "plot": ("plot", "plot_generator"),
}


def _question(name: str) -> tuple[str, str, str, bool]:
    """(category, tool, operation, whether it is about the month)."""
    operation = name.removeprefix("month_").removeprefix("half_").removeprefix("trend_")
    category, tool = _TOOLS.get(operation, ("aggregation", "pandas_aggregator"))
    return category, tool, operation, "{month}" in fv.CUSTOMER_QUESTIONS.get(name, "") or name != operation


def workload_questions(
    customers: DataFrame, month: str, start_date: str, end_date: str
) -> DataFrame:
    """All questions about one month: a fixed number per customer, per segment and in general.

    One load factor is asked for the first half of the month. For several months join the results
    with `unionByName` and `distinct`: undated questions are the same in each.
    """
    spark = customers.sparkSession
    middle = (date.fromisoformat(start_date) + timedelta(days=fv.HALF_MONTH_DAYS - 1)).isoformat()

    def asked(templates: dict[str, str], scope: str, key: Column, slot: str, customer_id: Column) -> Column:
        structs = []
        for name, template in templates.items():
            category, tool, operation, monthly = _question(name)
            text = template.replace("{month}", month).replace("{start}", start_date).replace("{middle}", middle)
            last = middle if name.startswith("half_") else end_date
            start, end = (start_date, last) if monthly else (None, None)
            structs.append(
                F.struct(
                    F.replace(F.lit(text), F.lit(slot), key).alias("query"),
                    F.lit(category).alias("category"),
                    F.lit(tool).alias("tool"),
                    F.lit(operation).alias("operation"),
                    F.lit(scope).alias("scope"),
                    key.alias("scope_key"),
                    customer_id.cast("bigint").alias("customer_id"),
                    F.lit(start).cast("date").alias("start_date"),
                    F.lit(end).cast("date").alias("end_date"),
                )
            )
        return F.inline(F.array(*structs))

    per_customer = customers.select(
        asked(
            fv.CUSTOMER_QUESTIONS,
            "customer",
            F.col("customer_id").cast("string"),
            "{id}",
            F.col("customer_id"),
        )
    )
    segments = literal_rows(spark, [("segment", "string")], [(s,) for s in fv.SEGMENTS])
    per_segment = segments.select(
        asked(fv.SEGMENT_QUESTIONS, "segment", F.col("segment"), "{segment}", F.lit(None))
    )
    once = literal_rows(spark, [("scope_key", "string")], [("",)])
    plots = {f"plot_{i}": text for i, text in enumerate(fv.PLOT_QUESTIONS)}
    general = once.select(
        asked(fv.GENERAL_QUESTIONS, "all", F.col("scope_key"), "{}", F.lit(None))
    )
    plot = once.select(asked(plots, "all", F.col("scope_key"), "{}", F.lit(None)))
    plot = plot.withColumns(
        {"category": F.lit("plot"), "tool": F.lit("plot_generator"), "operation": F.lit("plot")}
    )
    questions = per_customer.unionByName(per_segment).unionByName(general).unionByName(plot)
    return questions.select(*QUESTION_COLUMNS)


def with_tolerance(answers: DataFrame, force_zero_minimum: bool = False) -> DataFrame:
    """Tolerance by category: counts and minima exact, plots by existence, the rest within 5 %.

    The minimum keeps its true value unless `force_zero_minimum` asks for 0.
    """
    plot, count = F.col("category") == "plot", F.col("category") == "count"
    minimum = F.contains(F.col("query"), F.lit(fv.MINIMUM_QUESTION))
    exact = count | minimum
    value = F.round(F.col("expected_value"), fv.ANSWER_DECIMALS)
    if force_zero_minimum:
        value = F.when(~plot & ~count & minimum, 0.0).otherwise(value)
    return answers.select(
        *[c for c in answers.columns if c != "expected_value"],
        value.alias("expected_value"),
        F.when(plot | exact, 0.0).otherwise(fv.DEFAULT_TOLERANCE).alias("tolerance"),
        F.when(plot, "plot_exists")
        .when(exact, "exact")
        .otherwise(fv.DEFAULT_TOLERANCE_TYPE)
        .alias("tolerance_type"),
    )


STATISTICS_QUESTIONS = {
    "customer": {
        "median": "What is the median consumption for customer {id}?",
        "month_median": "What is the median consumption for customer {id} in {month}?",
        "half_median": "What is the median consumption for customer {id} between {start} and {middle}?",
        "month_count": "How many consumption values are there for customer {id} in {month}?",
    },
    "segment": {
        "median": "What is the median consumption for {segment} customers?",
        "month_median": "What is the median consumption for {segment} customers in {month}?",
        "count": "How many consumption values are there for {segment} customers?",
    },
    "all": {
        "month_median": "What is the median consumption in {month}?",
        "half_median": "What is the median consumption between {start} and {middle}?",
        "count": "How many consumption values are in the database?",
    },
}
GROUPED_QUESTIONS = {
    "mean": "What is the average consumption by {group}?",
    "median": "What is the median consumption by {group}?",
    "month_median": "What is the median consumption by {group} in {month}?",
    "month_sum": "What is the total consumption by {group} in {month}?",
    "count": "How many consumption values are there by {group}?",
}
GROUPS = ("segment", "meter_type")


def statistics_questions(customers: DataFrame, month: str, start_date: str, end_date: str) -> DataFrame:
    """Questions about medians, counts of the column and groups, with a column `group_by`.

    A grouped question names the column of the customers it is grouped by; it has an answer for each
    of its values.
    """
    spark = customers.sparkSession
    middle = (date.fromisoformat(start_date) + timedelta(days=fv.HALF_MONTH_DAYS - 1)).isoformat()

    def asked(templates: dict[str, str], scope: str, key: Column, slot: str, customer_id: Column, group: str | None) -> Column:
        structs = []
        for name, template in templates.items():
            operation = name.removeprefix("month_").removeprefix("half_")
            text = template.replace("{month}", month).replace("{start}", start_date).replace("{middle}", middle)
            text = text.replace("{group}", (group or "").replace("_", " "))
            dated = name != operation
            structs.append(
                F.struct(
                    F.replace(F.lit(text), F.lit(slot), key).alias("query"),
                    F.lit("aggregation").alias("category"),
                    F.lit("pandas_aggregator").alias("tool"),
                    F.lit(operation).alias("operation"),
                    F.lit(scope).alias("scope"),
                    key.alias("scope_key"),
                    customer_id.cast("bigint").alias("customer_id"),
                    F.lit(start_date if dated else None).cast("date").alias("start_date"),
                    F.lit((middle if name.startswith("half_") else end_date) if dated else None).cast("date").alias("end_date"),
                    F.lit(group).cast("string").alias("group_by"),
                )
            )
        return F.inline(F.array(*structs))

    none = F.lit(None)
    customer, texts = F.col("customer_id"), STATISTICS_QUESTIONS
    asked_of = [customers.select(asked(texts["customer"], "customer", customer.cast("string"), "{id}", customer, None))]
    segments = literal_rows(spark, [("segment", "string")], [(s,) for s in fv.SEGMENTS])
    asked_of.append(segments.select(asked(texts["segment"], "segment", F.col("segment"), "{segment}", none, None)))
    once = literal_rows(spark, [("scope_key", "string")], [("",)])
    asked_of.append(once.select(asked(texts["all"], "all", F.col("scope_key"), "{}", none, None)))
    asked_of += [once.select(asked(GROUPED_QUESTIONS, "all", F.col("scope_key"), "{}", none, g)) for g in GROUPS]
    return reduce(DataFrame.unionByName, asked_of).select(*QUESTION_COLUMNS, "group_by")


def _scopes(columns: list[str]) -> Column:
    """The scopes a row belongs to: all of them, and the value it has in each of the columns."""
    scopes = [F.struct(F.lit("all").alias("scope"), F.lit("").alias("scope_key"))]
    for name in columns:
        scope = "customer" if name == "customer_id" else name
        scopes.append(F.struct(F.lit(scope).alias("scope"), F.col(name).cast("string").alias("scope_key")))
    return F.inline(F.array(*scopes))


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("wh").alias("wh"),
        F.sum("n").alias("n"),
        F.sum("rows").alias("rows"),
        F.min("min_wh").alias("min_wh"),
        F.max("max_wh").alias("max_wh"),
    )


def _group_columns(customers: DataFrame) -> list[str]:
    return [c for c in ("segment", *GROUPS[1:]) if c in customers.columns]


def _scoped(rows: DataFrame, customers: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of customers once for each scope they belong to."""
    groups = _group_columns(customers)
    joined = rows.join(customers.select("customer_id", *groups), "customer_id", "left")
    scoped = joined.select("reading_date", *columns, _scopes([*groups, "customer_id"]))
    return scoped.filter(F.col("scope_key").isNotNull())


def _scope_days(customers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Reading statistics per scope and day."""
    daily = profiles.select(
        "customer_id",
        "reading_date",
        "wh",
        F.col("reading_count").alias("n"),
        F.col("row_count").alias("rows"),
        "min_wh",
        "max_wh",
    )
    return _merge(_scoped(daily, customers, _STATS), ["scope", "scope_key", "reading_date"])


def value_counts(readings: DataFrame) -> DataFrame:
    """(customer_id, reading_date, wh, n): how often each value was read on a day."""
    day = F.col("reading_date") if "reading_date" in readings.columns else F.to_date("timestamp")
    wh = watt_hours(F.col("consumption_kwh"))
    counts = readings.groupBy("customer_id", day.alias("reading_date"), wh.alias("wh")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("wh").isNotNull())


def period_value_counts(counts: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_date, end_date, wh, n) of the different, complete periods.

    First and last days of all periods of a key cut the calendar into spans no period divides. Counts
    are added up per span once, and each period takes the spans it covers: periods that overlap share
    the work of their common days.
    """
    ends = ["start_date", "end_date"]
    wanted = periods.select(*keys, *ends).filter(F.col("start_date") <= F.col("end_date")).distinct()
    cuts = wanted.select(*keys, F.explode(F.array("start_date", F.date_add("end_date", 1))).alias("_at")).distinct()
    days = counts.join(wanted.select(*keys).distinct(), keys, "left_semi")
    marks = days.select(*keys, F.col("reading_date").alias("_at")).distinct().withColumn("_cut", F.lit(0))
    marks = marks.unionByName(cuts.withColumn("_cut", F.lit(1)))
    # the groups of this window hold days and requested days
    order = Window.partitionBy(*keys).orderBy("_at", F.desc("_cut")).rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("_span", F.sum("_cut").over(order))
    of_day = marks.filter("_cut = 0").select(*keys, F.col("_at").alias("reading_date"), "_span")
    of_cut = marks.filter("_cut = 1").select(*keys, "_at", "_span")
    per_span = days.join(of_day, [*keys, "reading_date"]).groupBy(*keys, "_span", "wh").agg(F.sum("n").alias("n"))
    first = of_cut.select(*keys, F.col("_at").alias("start_date"), F.col("_span").alias("_first"))
    after = of_cut.select(*keys, F.date_sub("_at", 1).alias("end_date"), F.col("_span").alias("_after"))
    covered = wanted.join(first, [*keys, "start_date"]).join(after, [*keys, "end_date"])
    covered = covered.select(*keys, *ends, F.explode(F.sequence(F.col("_first"), F.col("_after") - 1)).alias("_span"))
    return covered.join(per_span, [*keys, "_span"]).groupBy(*keys, *ends, "wh").agg(F.sum("n").alias("n"))


def _medians(questions: DataFrame, customers: DataFrame, counts: DataFrame) -> DataFrame:
    """(scope, scope_key, start_date, end_date, median_wh) of the median questions, both dates NULL for
    all time."""
    scope, ends = ["scope", "scope_key"], ["start_date", "end_date"]
    wanted = questions.filter(F.col("operation") == "median").select(*scope, *ends)
    scoped = _scoped(counts, customers, ["wh", "n"]).join(wanted.select(*scope).distinct(), scope, "left_semi")
    scoped = scoped.groupBy(*scope, "reading_date", "wh").agg(F.sum("n").alias("n"))
    dated = period_value_counts(scoped, wanted, scope)
    always = wanted.filter("start_date is null and end_date is null").select(*scope).distinct()
    undated = scoped.join(always, scope, "left_semi").groupBy(*scope, "wh").agg(F.sum("n").alias("n"))
    # days as text, so that all time is a key like a period
    keys = [*scope, "_from", "_to"]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(ends, keys[2:], strict=True)]
    never = undated.select(*scope, *[F.lit(None).cast("date").alias(c) for c in ends], "wh", "n")
    rows = dated.select(*scope, *ends, "wh", "n").unionByName(never)
    # written once: the median reads its counts once for each digit
    rows = materialize(rows.select(*scope, *text, "wh", "n"), "counts")
    medians = median_of_counts(rows, keys, "wh", "n")
    return medians.withColumnRenamed("result", "median_wh")


def _scope_answers(
    questions: DataFrame, customers: DataFrame, profiles: DataFrame, counts: DataFrame | None
) -> DataFrame:
    """Values of the aggregation and counting questions, from per-scope statistics."""
    scope = ["scope", "scope_key"]
    days = _scope_days(customers, profiles)
    dated = questions.filter(F.col("start_date").isNotNull())
    undated = questions.filter(F.col("start_date").isNull())
    in_period = period_totals(
        days, dated, scope, "reading_date", ["wh", "n", "rows"], {"min_wh": "min", "max_wh": "max"}
    )
    heads = customers.select(_scopes(_group_columns(customers))).groupBy(*scope).agg(
        F.count(F.lit(1)).alias("customers")
    )
    answered = dated.join(in_period, [*scope, "start_date", "end_date"], "left").unionByName(
        undated.join(_merge(days, scope), scope, "left")
    )
    op = F.col("operation")
    if counts is None:
        answered = answered.withColumn("median_wh", F.when(op == "median", F.raise_error(F.lit("no answer for the operation median without value counts"))).cast("double"))
    else:
        keys = {"_from": "start_date", "_to": "end_date"}
        text = {k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in keys.items()}
        medians = _medians(questions, customers, counts)
        answered = answered.withColumns(text).join(medians, [*scope, *keys], "left").drop(*keys)
    kwh = F.lit(1000.0)
    mean = rounded_ratio(F.col("wh"), F.col("n") * 1000, fv.ANSWER_DECIMALS)
    value = (
        F.when(op == "sum", F.coalesce(F.col("wh"), F.lit(0)).cast("double") / kwh)
        .when(op == "mean", mean.cast("double") / F.lit(10.0**fv.ANSWER_DECIMALS))
        .when(op == "median", F.col("median_wh") / kwh)
        .when(op == "min", F.col("min_wh").cast("double") / kwh)
        .when(op == "max", F.col("max_wh").cast("double") / kwh)
        .when(op == "count", F.coalesce(F.col("n"), F.lit(0)).cast("double"))
        .when(op == "count_readings", F.coalesce(F.col("rows"), F.lit(0)).cast("double"))
        .when(op == "count_customers", F.coalesce(F.col("customers"), F.lit(0)).cast("double"))
        .otherwise(F.raise_error(F.concat(F.lit("no answer for the operation "), op)))
    )
    return answered.join(heads, scope, "left").select(
        "query", "category", "group_key", value.alias("expected_value")
    )


def _ungrouped(questions: DataFrame, customers: DataFrame) -> DataFrame:
    """Grouped questions once for each value of their column, which becomes their scope."""
    if "group_by" not in questions.columns:
        return questions.withColumn("group_key", F.lit(None).cast("string"))
    groups = customers.select(_scopes(_group_columns(customers))).filter("scope != 'all' and scope_key is not null").distinct()
    groups = groups.select(F.col("scope").alias("group_by"), F.col("scope_key").alias("group_key"))
    whole = questions.filter("group_by is null").drop("group_by").withColumn("group_key", F.lit(None).cast("string"))
    parts = questions.filter("group_by is not null").join(groups, "group_by")
    parts = parts.withColumns({"scope": F.col("group_by"), "scope_key": F.col("group_key")}).drop("group_by")
    return whole.unionByName(parts)


def ground_truth(
    questions: DataFrame,
    customers: DataFrame,
    tariffs: DataFrame,
    profiles: DataFrame,
    force_zero_minimum: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The answer table: query, category, expected_value, tolerance, tolerance_type, and group_key if
    the questions have `group_by`: an answer for each group.

    Each tool answers all its questions as one batch; questions without an answer are left out, an
    operation that no tool here has fails the job.
    All of them start from `daily_profiles` of the readings: with those in a table, the readings
    are read once. Medians start from `value_counts` of them.
    """

    grouped = "group_by" in questions.columns
    questions = _ungrouped(questions, customers)
    no_group = F.lit(None).cast("string").alias("group_key")

    def requests(tool: str) -> DataFrame:
        return questions.filter(F.col("tool") == tool).select(
            F.col("query").alias("request_id"), "customer_id", "start_date", "end_date"
        )

    def answers(result: DataFrame, category: str, value: str) -> DataFrame:
        return result.select(
            F.col("request_id").alias("query"),
            F.lit(category).alias("category"),
            no_group,
            F.col(value).alias("expected_value"),
        )

    bills = bill_from_profiles(requests("tariff_calculator"), customers, tariffs, profiles)
    factors = load_factor_from_profiles(requests("calculate_load_factor"), profiles)
    scoped = questions.filter(F.col("tool").isin("pandas_aggregator", "sql_executor"))
    plots = questions.filter(F.col("tool") == "plot_generator")
    found = (
        answers(bills, "billing", "total_cost")
        .unionByName(answers(factors, "load_factor", "load_factor"))
        .unionByName(_scope_answers(scoped, customers, profiles, counts))
        .unionByName(plots.select("query", "category", no_group, F.lit(1.0).alias("expected_value")))
    )
    answered = found.filter(F.col("expected_value").isNotNull())
    return with_tolerance(answered, force_zero_minimum).select(*_ENTRY, *(["group_key"] if grouped else []))


def category_counts(workload: DataFrame) -> DataFrame:
    return workload.groupBy("category").agg(F.count(F.lit(1)).alias("questions"))
