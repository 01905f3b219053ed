"""Registered transcript, tool-call and episode queries over the test tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.functions import text as tx
from wattquill.functions.once import computed_once
from wattquill.operators import episodes as ep
from wattquill.operators import toolcalls as tc
from wattquill.operators import transcripts as tr
from wattquill.sources import artifacts, testdata
from wattquill.sources.constants import tool_parameters
from wattquill.sources.tables import materialize

Query = Callable[[SparkSession, str], DataFrame]


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return tr.parse_turns(testdata.turns(spark, d))


def _count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def parse_turns(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("episode_id", "step", *tr.PARSED_COLUMNS)


def _prose(spark: SparkSession, d: str) -> DataFrame:
    return tr.parse_turns(testdata.conversation_turns(spark, d))


def turn_type_counts(spark: SparkSession, d: str) -> DataFrame:
    agents = _parsed(spark, d).select(F.lit("agent").alias("source"), "type")
    prose = _prose(spark, d).select(F.lit("prose").alias("source"), "type")
    return agents.unionByName(prose).groupBy("source", "type").agg(_count())


def parse_error_kinds(spark: SparkSession, d: str) -> DataFrame:
    agents = _parsed(spark, d).select(F.lit("agent").alias("source"), "error_kind")
    prose = _prose(spark, d).select(F.lit("prose").alias("source"), "error_kind")
    errors = agents.unionByName(prose).filter(F.col("error_kind").isNotNull())
    return errors.groupBy("source", "error_kind").agg(_count())


def json_repair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Action inputs that are JSON as written, and after the repair, per action."""
    clean = tr.drop_observation_suffix(F.col("response"))
    tails = computed_once(
        testdata.turns(spark, d),
        [],
        action=tx.tail_after(clean, "Action:"),
        raw=tx.tail_after(clean, "Action Input:"),
    )
    inputs = computed_once(
        tails.filter(F.col("raw").isNotNull()),
        [],
        action=tx.strip(tx.until_stop(F.col("action"))),
        raw=tx.strip(tx.until_stop(F.col("raw"))),
    )

    def valid(text: Column) -> Column:
        return F.coalesce(tx.is_json(text), F.lit(False)).cast("bigint")

    return inputs.groupBy("action").agg(
        _count("inputs"),
        F.sum(valid(F.col("raw"))).alias("valid_raw"),
        F.sum(valid(tx.repair_json(F.col("raw")))).alias("valid_repaired"),
    )


# --- tool calls -------------------------------------------------------------------------------


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return tr.action_calls(_parsed(spark, d))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return tc.check_calls(_calls(spark, d))


def tool_param_specs(spark: SparkSession, d: str) -> DataFrame:
    """Every parameter with the number of calls that give it."""
    keys = F.map_keys(F.from_json(F.col("action_input"), "map<string,string>"))
    given = _calls(spark, d).select("tool", F.explode(keys).alias("param")).groupBy("tool", "param")
    return tool_parameters(spark).join(given.agg(_count("given")), ["tool", "param"], "left").select(
        "tool", "param", "position", "type", "required", "default_value",
        F.coalesce("given", F.lit(0)).alias("given"),
    )


def calls_unknown_tool(spark: SparkSession, d: str) -> DataFrame:
    return tc.unknown_tool_calls(_calls(spark, d)).select("episode_id", "step", "tool")


def calls_missing_param(spark: SparkSession, d: str) -> DataFrame:
    missing = _checked(spark, d).filter(F.col("status") == "missing_parameter")
    return missing.select("episode_id", "step", "tool", "problem_param")


def calls_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Converted row limits and customer ids of the calls without a problem."""
    ok = _checked(spark, d).filter(F.col("status") == "ok")
    return ok.select(
        "episode_id",
        "step",
        "tool",
        F.try_element_at("arguments", F.lit("row_limit")).cast("int").alias("row_limit"),
        F.try_element_at("arguments", F.lit("customer_id")).cast("bigint").alias("customer_id"),
    )


def calls_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    """The same calls with every third row limit left out, so that the default applies."""
    cut = F.regexp_replace("action_input", r', "row_limit": "[^"]*"', "")
    calls = _calls(spark, d).withColumn(
        "action_input", F.when(F.col("step") % 3 == 0, cut).otherwise(F.col("action_input"))
    )
    checked = tc.check_calls(calls).filter(F.col("status") == "ok")
    limit = F.try_element_at("arguments", F.lit("row_limit")).cast("int")
    return checked.groupBy("tool", limit.alias("row_limit")).agg(_count("calls"))


def calls_extra_args(spark: SparkSession, d: str) -> DataFrame:
    """Calls by number of arguments; an unknown tool declares none, so it has no extra ones."""
    return _checked(spark, d).groupBy("tool", "status", "extra_arguments").agg(_count("calls"))


def call_success_by_tool(spark: SparkSession, d: str) -> DataFrame:
    records = tc.call_records(_checked(spark, d))
    return records.groupBy("tool", "status", "success", "error").agg(_count("calls"))


# --- episodes ---------------------------------------------------------------------------------


def _parsed_table(spark: SparkSession, d: str) -> DataFrame:
    """Parsed turns as a table: the texts are parsed once for all that is derived from them."""
    return materialize(_parsed(spark, d).drop("response", "thought", "action_input"), "parsed")


def _plot_episodes(spark: SparkSession, d: str, parsed: DataFrame) -> DataFrame:
    """Episodes with a plot call at one of their events that an existing file confirms."""
    files = artifacts.list_artifacts(spark, d)
    confirmed = artifacts.verified_plot_calls(testdata.plot_calls(spark, d), files, d)
    events = confirmed.select(F.col("episode_id").alias("event_id"))
    return parsed.join(events, "event_id", "left_semi").select("episode_id")


def _rewards_of(spark: SparkSession, d: str, parsed: DataFrame) -> DataFrame:
    plots = _plot_episodes(spark, d, parsed)
    return ep.episode_rewards(ep.episode_outcomes(parsed, texts=False), testdata.expectations(parsed), plots)


def _rewards(spark: SparkSession, d: str) -> DataFrame:
    return _rewards_of(spark, d, _parsed_table(spark, d))


def episode_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ep.episode_outcomes(_parsed(spark, d))


def episode_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = ep.episode_tool_calls(_parsed(spark, d))
    return calls.withColumn("tools", F.array_join("tools", ","))


def answer_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The last number of every turn that has one."""
    numbers = testdata.turns(spark, d).select(
        "event_id", tx.last_number(F.col("response")).alias("number")
    )
    return numbers.filter(F.col("number").isNotNull())


def plot_artifacts_verified(spark: SparkSession, d: str) -> DataFrame:
    """Plot calls confirmed by a file; here the table files themselves stand in for plots."""
    files = artifacts.list_artifacts(spark, d)
    calls = artifacts.verified_plot_calls(testdata.plot_calls(spark, d), files, d)
    name = F.substring_index("result", "/", -1)
    return calls.groupBy(name.alias("file")).agg(_count("calls"))


def episode_rewards(spark: SparkSession, d: str) -> DataFrame:
    return _rewards(spark, d)


def reward_distribution(spark: SparkSession, d: str) -> DataFrame:
    return ep.reward_distribution(_rewards(spark, d))


def episode_token_usage(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed_table(spark, d)
    return ep.token_usage(parsed, ep.episode_outcomes(parsed, texts=False))


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ep.run_metrics(_rewards(spark, d))


def epoch_batches(spark: SparkSession, d: str) -> DataFrame:
    episodes = testdata.turns(spark, d).select("episode_id").distinct()
    return ep.epoch_batches(episodes, "episode_id")


def batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    rewards = materialize(_rewards(spark, d), "rewards")
    return ep.batch_metrics(ep.epoch_batches(rewards, "episode_id"), rewards)


def step_rewards(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed_table(spark, d)
    return ep.step_rewards(parsed, ep.episode_outcomes(parsed, texts=False), _rewards_of(spark, d, parsed))


def accuracy_by_category(spark: SparkSession, d: str) -> DataFrame:
    return ep.accuracy_by_category(_rewards(spark, d))


def queries() -> dict[str, Query]:
    named = [
        parse_turns,
        turn_type_counts,
        parse_error_kinds,
        json_repair_counts,
        tool_param_specs,
        calls_unknown_tool,
        calls_missing_param,
        calls_coercion,
        calls_with_defaults,
        calls_extra_args,
        call_success_by_tool,
        episode_outcomes,
        episode_tool_calls,
        answer_numbers,
        plot_artifacts_verified,
        episode_rewards,
        reward_distribution,
        episode_token_usage,
        run_metrics,
        epoch_batches,
        batch_metrics,
        step_rewards,
        accuracy_by_category,
    ]
    return {query.__name__: query for query in named}
