"""Parsing of agent turns: one projection over a table of turns, no shuffle and no Python worker."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattquill import fixed_values as fv
from wattquill.functions import text as tx
from wattquill.functions.once import computed_once

PARSED_COLUMNS = ["type", "thought", "action", "action_input", "answer", "error_kind", "error"]


def drop_observation_suffix(response: Column) -> Column:
    """Without the stop text a local model leaves at the end of a turn."""
    cleaned = F
    for suffix in fv.OBSERVATION_SUFFIXES:
        kept = F.char_length(response) - len(suffix)
        cleaned = cleaned.when(
            F.endswith(response, F.lit(suffix)), F.substr(response, F.lit(1), kept)
        )
    return cleaned.otherwise(response)


def parse_turns(turns: DataFrame, response: str = "response") -> DataFrame:
    """Add type, thought, action, action_input, answer, error_kind and error to every turn.

    `type` is answer, action, thought_only or error; a NULL response is an error without markers.
    An answer anywhere in the turn wins. `action_input` is the repaired JSON text. The steps are
    separate projections so that each expression is evaluated once.
    """
    tails = turns.withColumn(
        "_clean", drop_observation_suffix(F.coalesce(F.col(response), F.lit("")))
    ).select(
        "*",
        tx.tail_after(F.col("_clean"), fv.ANSWER).alias("_answer"),
        tx.tail_after(F.col("_clean"), fv.THOUGHT).alias("_thought"),
        tx.tail_after(F.col("_clean"), fv.ACTION).alias("_action"),
        tx.tail_after(F.col("_clean"), fv.ACTION_INPUT).alias("_input"),
    )
    is_answer = F.col("_answer").isNotNull()
    sections = tails.select(
        *turns.columns,
        tx.strip(tx.until_stop(F.col("_answer"))).alias("answer"),
        F.when(~is_answer, tx.strip(tx.until_stop(F.col("_thought")))).alias("thought"),
        F.when(~is_answer, tx.strip(tx.until_stop(F.col("_action")))).alias("action"),
        F.when(
            ~is_answer & F.col("_action").isNotNull(),
            tx.repair_json(tx.until_stop(F.col("_input"))),
        ).alias("_json"),
    )
    judged = sections.withColumn("_valid", F.coalesce(tx.is_json(F.col("_json")), F.lit(False)))
    acts = F.col("action").isNotNull()
    kind = (
        F.when(F.col("answer").isNotNull(), None)
        .when(acts & F.col("_json").isNull(), "missing_action_input")
        .when(acts & ~F.col("_valid"), "invalid_json")
        .when(~acts & (F.coalesce(F.col("thought"), F.lit("")) == ""), "no_markers")
    )
    typed = judged.withColumn("error_kind", kind.cast("string"))
    turn_type = (
        F.when(F.col("answer").isNotNull(), "answer")
        .when(F.col("error_kind").isNotNull(), "error")
        .when(acts, "action")
        .otherwise("thought_only")
    )
    message = F
    for name, text in fv.ERROR_TEXTS.items():
        message = message.when(F.col("error_kind") == name, text)
    return computed_once(
        typed,
        turns.columns,
        type=turn_type,
        thought=F.col("thought"),
        action=F.col("action"),
        action_input=F.when(F.col("error_kind").isNull(), F.col("_json")),
        answer=F.col("answer"),
        error_kind=F.col("error_kind"),
        error=message,
    )


def action_calls(parsed: DataFrame) -> DataFrame:
    """The turns that call a tool: (episode_id, step, tool, action_input)."""
    return parsed.filter(F.col("type") == "action").select(
        "episode_id", "step", F.col("action").alias("tool"), "action_input"
    )
