"""Outcomes, scores and roll-ups of agent episodes.

The key of a table of turns is (episode_id, step). Only the first ten steps of an episode count, and
per-episode state has a fixed size (a minimum and a bit per step), so an episode that was logged with
any number of steps or copies costs one small partial aggregate per task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattquill import fixed_values as fv
from wattquill.functions.hashing import digest
from wattquill.functions.once import computed_once
from wattquill.functions.ranking import bucketed_row_number
from wattquill.functions.text import last_number


# where step, kind and hash of a turn lie in its packed number
_STEP_BIT, _KIND_BIT = 58, 57


def _terminal() -> Column:
    return F.col("type").isin("answer", "error") & F.col("step").between(1, fv.MAX_STEPS)


def _terminal_rank() -> Column:
    """A terminal turn as one number: step, kind (answers first) and bits of a hash of its text.

    The least number of an episode is its end. Copies of a turn have the same number, and of different
    texts at one step the one with the lower hash counts, in whatever order they come.
    """
    left = F.call_function("shiftleft", F.col("step").cast("bigint"), F.lit(_STEP_BIT))
    kind = F.call_function("shiftleft", (F.col("type") == "error").cast("bigint"), F.lit(_KIND_BIT))
    text = F.xxhash64("answer", "error").bitwiseAND(F.lit((1 << _KIND_BIT) - 1))
    return left.bitwiseOR(kind).bitwiseOR(text)


def _step_of(rank: Column) -> Column:
    return F.call_function("shiftright", rank, F.lit(_STEP_BIT)).cast("int")


def episode_outcomes(parsed: DataFrame, texts: bool = True) -> DataFrame:
    """One row per episode: it ends with the first answer (success) or error (failure), at most
    ten steps in; thoughts and tool calls continue it.

    `tool_calls` counts the calls before that end. The state of an episode is three numbers, in a hash
    aggregate. Texts of `answer` and `error` are fetched afterwards, for the turn each episode ends
    with; `texts=False` leaves these two columns and their join out.
    """
    staged = parsed.select("episode_id", F.col("step").cast("int").alias("step"), "type", "answer", "error")
    rank = F.when(_terminal(), _terminal_rank())
    is_call = (F.col("type") == "action") & F.col("step").between(1, fv.MAX_STEPS)
    bit = F.call_function("shiftleft", F.lit(1), F.col("step"))
    number = F.when(F.col("type") == "answer", last_number(F.col("answer")))
    packed = computed_once(staged, ["episode_id"], rank=rank, call=F.when(is_call, bit), number=number)
    grouped = packed.groupBy("episode_id").agg(
        F.min("rank").alias("_rank"),
        F.coalesce(F.bit_or("call"), F.lit(0)).alias("_calls"),
        F.min_by("number", "rank").alias("answer_number"),
    )
    end = _step_of(F.col("_rank"))
    is_error = F.call_function("shiftright", F.col("_rank"), F.lit(_KIND_BIT)) % 2 == 1
    success = F.coalesce(~is_error, F.lit(False))
    before_end = F.call_function("shiftleft", F.lit(1), F.coalesce(end, F.lit(fv.MAX_STEPS + 1))) - F.lit(1)
    status = F.when(end.isNull(), "max_iterations").otherwise(F.when(success, "success").otherwise("failure"))
    columns = [
        status.alias("status"),
        success.alias("success"),
        F.coalesce(end, F.lit(fv.MAX_STEPS)).alias("iterations"),
        F.bit_count(F.col("_calls").bitwiseAND(before_end)).cast("int").alias("tool_calls"),
    ]
    value = F.when(success, F.col("answer_number")).alias("answer_number")
    if not texts:
        return grouped.select("episode_id", *columns, value)
    # copies of a turn fall together in the first step of this aggregate, before anything is sent
    ends = staged.filter(_terminal()).select("episode_id", _terminal_rank().alias("_rank"), "answer", F.col("error").alias("_error"))
    found = grouped.join(ends.distinct(), ["episode_id", "_rank"], "left")
    error = F.when(end.isNull(), F.lit(f"no answer within {fv.MAX_STEPS} steps")).when(
        ~success, F.concat(F.lit("unreadable turn: "), F.col("_error"))
    )
    return found.select(
        "episode_id", *columns, F.when(success, F.col("answer")).alias("answer"), value, error.alias("error")
    )


def trajectory(parsed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The turns that took part in their episode: steps 1 to `iterations`."""
    ends = outcomes.select("episode_id", "iterations")
    return (
        parsed.filter(F.col("step").between(1, fv.MAX_STEPS))
        .join(ends, "episode_id")
        .filter(F.col("step") <= F.col("iterations"))
        .drop("iterations")
    )


def episode_tool_calls(parsed: DataFrame) -> DataFrame:
    """Number and ordered list of the tools called before the end of each episode.

    The ends are numbers in a hash aggregate; calls lose their copies before they meet their episode,
    and the list has one entry per step, so ten at most.
    """
    step = F.col("step").cast("int")
    in_time = F.col("step").between(1, fv.MAX_STEPS)
    ends = parsed.groupBy("episode_id").agg(F.min(F.when(_terminal(), step)).alias("_end"))
    calls = parsed.filter((F.col("type") == "action") & in_time & F.col("action").isNotNull())
    # of different tools at one step the last by name counts
    calls = calls.select("episode_id", step.alias("step"), "action").distinct()
    kept = ends.join(calls, "episode_id", "left").groupBy("episode_id", "_end").agg(
        F.collect_list(F.when(F.col("step") < F.coalesce("_end", F.lit(fv.MAX_STEPS + 1)), F.struct("step", "action"))).alias("_calls")
    )
    at_step = F.transform(
        F.sequence(F.lit(1), F.lit(fv.MAX_STEPS)),
        lambda at: F.array_max(F.transform(F.filter("_calls", lambda c: c["step"] == at), lambda c: c["action"])),
    )
    tools = F.array_compact(at_step)
    return kept.select("episode_id", F.size(tools).alias("tool_calls"), tools.alias("tools"))


def _accuracy(plot_verified: Column) -> Column:
    """The part of the reward for the right value."""
    kind = F.coalesce(F.col("tolerance_type"), F.lit(fv.DEFAULT_TOLERANCE_TYPE))
    tolerance = F.coalesce(F.col("tolerance"), F.lit(fv.DEFAULT_TOLERANCE))
    expected, number = F.col("expected_value"), F.col("answer_number")
    off_by = F.abs(number - expected)
    close = (
        F.when(kind == "plot_exists", plot_verified)
        .when(kind == "exact", off_by <= fv.EXACT_EPSILON)
        .when(expected == 0, F.abs(number) <= tolerance)
        .otherwise(off_by <= tolerance * F.abs(expected))
    )
    return F.when(F.coalesce(close, F.lit(False)), fv.REWARD_ACCURATE).otherwise(0.0)


def episode_rewards(
    outcomes: DataFrame, expectations: DataFrame, plot_episodes: DataFrame | None = None
) -> DataFrame:
    """The score of every episode with an expectation (episode_id, category, expected_value,
    tolerance, tolerance_type).

    No tool call ends the scoring at -5, a failed episode at 2 - 3; an accurate answer adds 5.
    `plot_episodes` lists the episodes with a confirmed plot file.
    """
    numeric = outcomes.select("episode_id", "success", "tool_calls", "answer_number")
    joined = numeric.join(expectations, "episode_id")
    verified = F.lit(False)
    if plot_episodes is not None:
        confirmed = plot_episodes.select("episode_id").distinct().withColumn("_plot", F.lit(True))
        joined = joined.join(confirmed, "episode_id", "left")
        verified = F.coalesce(F.col("_plot"), F.lit(False))
    used = F.col("tool_calls") > 0
    parts = joined.select(
        "episode_id",
        "category",
        "success",
        F.when(used, fv.REWARD_TOOL_USED).otherwise(fv.REWARD_NO_TOOL).alias("tool_part"),
        F.when(used & F.col("success"), fv.REWARD_SUCCESS)
        .when(used, fv.REWARD_FAILURE)
        .otherwise(0.0)
        .alias("success_part"),
        F.when(used & F.col("success"), _accuracy(verified)).otherwise(0.0).alias("accuracy_part"),
    )
    total = F.col("tool_part") + F.col("success_part") + F.col("accuracy_part")
    return parts.withColumn("reward", total)


def reward_distribution(rewards: DataFrame) -> DataFrame:
    return rewards.groupBy("reward").agg(F.count(F.lit(1)).alias("episodes"))


def _metrics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("episodes"),
        F.coalesce(F.avg("reward"), F.lit(0.0)).alias("mean_reward"),
        F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)).alias("success_rate"),
    ]


def run_metrics(rewards: DataFrame) -> DataFrame:
    """Episodes, mean reward and success rate; zeros for no episodes."""
    return rewards.agg(*_metrics())


def accuracy_by_category(rewards: DataFrame) -> DataFrame:
    accurate = F.avg((F.col("accuracy_part") > 0).cast("int")).alias("accuracy")
    return rewards.groupBy("category").agg(*_metrics(), accurate)


def epoch_batches(
    workload: DataFrame,
    key: str,
    epochs: int = fv.EPOCHS,
    batch_size: int = fv.BATCH_SIZE,
    seed: int = fv.DEFAULT_SEED,
    bucket_digits: int = 3,
) -> DataFrame:
    """(epoch, key, position, batch): the workload in a new order each epoch, cut into batches.

    The order is that of a hash of (key, epoch). Its first `bucket_digits` hex digits cut an epoch
    into even buckets, as many digits again cut those: 16 million buckets with three.
    `key` is unique in the workload.
    """
    shuffled = (
        workload.select(key)
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .withColumn("_order", digest(F.col(key), F.col("epoch"), seed))
        .withColumn("_bucket", F.substring("_order", 1, bucket_digits))
        .withColumn("_part", F.substring("_order", bucket_digits + 1, bucket_digits))
    )
    numbered = bucketed_row_number(
        shuffled, ["epoch"], ["_bucket", "_part"], ["_order", key], "position"
    )
    batch = F.floor((F.col("position") - 1) / batch_size)
    return numbered.select("epoch", key, "position", batch.alias("batch"))


def batch_metrics(batches: DataFrame, rewards: DataFrame) -> DataFrame:
    """Metrics per epoch and batch; `batches` is keyed by episode_id."""
    return batches.join(rewards, "episode_id").groupBy("epoch", "batch").agg(*_metrics())


def step_rewards(parsed: DataFrame, outcomes: DataFrame, rewards: DataFrame) -> DataFrame:
    """The final reward of an episode on each of its steps."""
    steps = trajectory(parsed, outcomes).select("episode_id", "step")
    return steps.join(rewards.select("episode_id", "reward"), "episode_id")


def token_usage(
    parsed: DataFrame,
    outcomes: DataFrame,
    columns: Sequence[str] = ("prompt_tokens", "completion_tokens"),
) -> DataFrame:
    """Token sums per episode over its steps, from logged per-turn counts."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]
    used = trajectory(parsed, outcomes).groupBy("episode_id").agg(*sums)
    total = F.lit(0)
    for column in columns:
        total = total + F.col(column)
    return used.withColumn("total_tokens", total)
