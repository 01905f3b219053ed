"""Meter tables, episodes and tool results read out of the generic test tables.

The test tables are an order-entry schema with an event log; these views give them the shapes the
operators work on. Nothing is sampled or cut.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.functions.once import computed_once
from wattquill.functions.ranking import bucketed_row_number
from wattquill.sources import constants
from wattquill.sources.tables import exact_kwh

STEPS_PER_EPISODE = 12
# wide enough that a user with billions of episodes does not run into the ids of the next user
EPISODE_STRIDE = 10**10
REQUEST_DAYS = 14
UNKNOWN_ID_OFFSET = 1_000_000
ODD_REQUESTS = 10**9
ODD_PERIODS = (
    ("0001-01-01", "9999-12-31"),
    ("2024-01-20", "2024-01-10"),
    (None, "2024-01-31"),
    ("2024-01-01", None),
    (None, None),
    ("1990-01-01", "1990-12-31"),
)
_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
    "customer": "c_custkey BIGINT, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_shipdate TIMESTAMP_NTZ",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    household = F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.when(household, "residential").otherwise("commercial").alias("segment"),
        F.when(F.col("c_custkey") % 5 == 0, "standard").otherwise("smart").alias("meter_type"),
    )


def tariffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constants.tariffs(spark)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: some 150 meters per thousandth of scale, in January 2024."""
    return exact_kwh(
        table(spark, sf_dir, "events").select(
            F.col("event_id").alias("reading_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").alias("timestamp"),
            F.col("value").alias("consumption_kwh"),
        )
    )


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as readings, 1995-2001: a larger table, and the meter is found by a join."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    hour = F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
    return exact_kwh(
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("reading_id"),
            F.col("o_custkey").alias("customer_id"),
            (F.col("l_shipdate") + hour).alias("timestamp"),
            F.col("l_quantity").alias("consumption_kwh"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fortnight for every customer and for some that do not exist; for a few customers also all
    years, a reversed period, and one without a first or a last day."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    unknown = known.filter(F.col("customer_id") < 10).select(
        (F.col("customer_id") + UNKNOWN_ID_OFFSET).alias("customer_id")
    )
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("customer_id") % 7).cast("int"))
    plain = known.union(unknown).select(
        F.col("customer_id").alias("request_id"),
        "customer_id",
        first.alias("start_date"),
        F.date_add(first, REQUEST_DAYS - 1).alias("end_date"),
    )
    odd = F.inline(
        F.array(
            *[
                F.struct(
                    (F.col("customer_id") + ODD_REQUESTS * (k + 1)).alias("request_id"),
                    "customer_id",
                    F.lit(start).cast("date").alias("start_date"),
                    F.lit(end).cast("date").alias("end_date"),
                )
                for k, (start, end) in enumerate(ODD_PERIODS)
            ]
        )
    )
    return plain.union(known.union(unknown).filter(F.col("customer_id") % 100 < 4).select(odd))


def _click_call(event_id: Column, limit: Column, user: Column) -> Column:
    """Tool and arguments of a click: arguments of every JSON type, right and wrong."""

    def sql(argument: Column | str) -> Column:
        value = F.lit(argument) if isinstance(argument, str) else argument
        return F.concat(F.lit('sql_executor\nAction Input: {"query": "SELECT 1", "row_limit": '), value, F.lit("}"))

    kind = event_id % 16
    quoted = F.concat(F.lit('"'), limit, F.lit('"'))
    return (
        F.when(kind == 0, sql("7.9"))
        .when(kind == 1, sql("true"))
        .when(kind == 2, sql("null"))
        .when(kind == 3, sql("[1]"))
        .when(kind == 4, sql('"many"'))
        .when(kind == 5, sql(limit))
        .when(kind == 6, "sql_executor\nAction Input: [1, 2]")
        .when(
            kind == 7,
            F.concat(
                F.lit('tariff_calculator\nAction Input: {"customer_id": '),
                user,
                F.lit(', "start_date": "2024-01-01", "end_date": "2024-01-31", "note": 1}'),
            ),
        )
        .when(kind == 8, 'tariff_calculator\nAction Input: {"customer_id": "one", "start_date": "2024-01-01"}')
        .when(kind == 9, sql("false"))
        .otherwise(sql(quoted))
    )


def _step_text() -> Column:
    """What the agent says at an event; each branch is one case of the parser or the tool check."""
    event_type, event_id = F.col("event_type"), F.col("event_id")
    user, cents = F.col("user_id").cast("string"), F.col("value").cast("decimal(12,2)").cast("string")
    lines = F.concat_ws
    endless = (F.col("user_id") % 10 == 0) & event_type.isin("purchase", "error", "signup")
    limit = (event_id % 50).cast("string")
    return (
        F.when(endless, "Thought: keep thinking")
        .when((event_type == "view") & (event_id % 7 == 0), "Thought: \n ")
        .when(event_type == "view", F.concat(F.lit("Thought: look up customer "), user))
        .when(
            event_type == "click",
            F.concat(F.lit("Thought: run a query\nAction: "), _click_call(event_id, limit, user)),
        )
        .when(event_type == "purchase", F.format_string("Answer: The total cost is %s GBP.", cents))
        .when(
            (event_type == "error") & (event_id % 2 == 0),
            lines(
                "\n",
                F.lit("Thought: bill"),
                F.lit("Action: tariff_calculator"),
                F.format_string(
                    'Action Input: {"customer_id": "%s", "start_date": "2024-01-01",}', user
                ),
                F.lit("Observation:"),
            ),
        )
        .when(event_type == "error", F.concat(F.lit("no marker here "), cents))
        .when(event_id % 3 == 0, "Thought: plot\nAction: plot_generator")
        .when(
            event_id % 3 == 1,
            'Thought: try\nAction: nonexistent_tool\nAction Input: {"a": 1, "b": "x"}',
        )
        .otherwise("Action: sql_executor\nAction Input: {bad json")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as agent turns: each user's events in time order, cut into episodes of twelve steps.

    (episode_id, step, event_id, value, response, prompt_tokens, completion_tokens)
    """
    units = {"_day": "day", "_minute": "minute", "_second": "second"}
    events = table(spark, sf_dir, "events").withColumns(
        {name: F.date_trunc(unit, "ts") for name, unit in units.items()}
    )
    numbered = bucketed_row_number(events, ["user_id"], list(units), ["ts", "event_id"], "rn")
    index = F.col("rn") - 1
    spoken = computed_once(
        numbered, ["rn", "user_id", "event_id", "event_type", "value"], response=_step_text()
    )
    return spoken.select(
        (F.col("user_id") * F.lit(EPISODE_STRIDE) + F.floor(index / STEPS_PER_EPISODE)).alias("episode_id"),
        (index % STEPS_PER_EPISODE + 1).cast("int").alias("step"),
        "event_id",
        "value",
        ((F.col("event_type") == "purchase") & (F.col("user_id") % 10 != 0)).alias("is_answer"),
        "response",
        (F.col("event_id") % 500 + 100).alias("prompt_tokens"),
        F.length("response").cast("bigint").alias("completion_tokens"),
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real prose as turns: (conv_id, turn, response)."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("response")
    )


def expectations(turn_rows: DataFrame) -> DataFrame:
    """What each episode should have answered, a few percent off the logged answer.

    An existing plot in the plot category; otherwise exact in every fourth episode, zero in every
    eleventh, else within 5 %; unknown without an answer.
    """
    answered = F.when(F.col("is_answer") & (F.col("step") <= 10), F.col("step"))
    episode = F.col("episode_id")
    cents = F.col("value").cast("decimal(12,2)")
    factor = 1 + (episode % 5 - 2) * F.lit("0.03").cast("decimal(3,2)")
    exact, plot = episode % 4 == 0, episode % 5 == 4
    category = F.element_at(
        F.lit(["aggregation", "billing", "load_factor", "count", "plot"]), (episode % 5 + 1).cast("int")
    )
    return (
        turn_rows.groupBy("episode_id")
        .agg(F.min_by(cents, answered).alias("value"))
        .select(
            "episode_id",
            category.alias("category"),
            F.when(episode % 11 == 0, 0.0)
            .otherwise((F.col("value") * factor).cast("double"))
            .alias("expected_value"),
            F.when(exact | plot, 0.0).otherwise(0.05).alias("tolerance"),
            F.when(plot, "plot_exists").when(exact, "exact").otherwise("relative").alias("tolerance_type"),
        )
    )


def plot_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as plot calls whose results name files: some exist in `sf_dir`, some do not, some lie
    outside of it."""
    n = F.col("event_id") % 5
    name = (
        F.when(n == 0, "/events.parquet")
        .when(n == 1, "/customer.parquet")
        .when(n == 2, "/plot_not_written.parquet")
        .when(n == 3, "2/events.parquet")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("episode_id"),
        F.when(F.col("event_type") == "error", "sql_executor").otherwise("plot_generator").alias("tool"),
        (F.col("event_type") != "view").alias("success"),
        F.concat(F.lit(sf_dir.rstrip("/")), name).alias("result"),
    )
