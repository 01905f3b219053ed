"""Mixing sources to target weights: iterative proportional fitting, with DataFrame functions only.

Documents are summed up to cells of source, language and topic; from then on only cells are worked
on. Each sweep scales the tokens of the cells so that the total of each source meets its target, then
each language, then each topic. The factor that a cell ends with, divided by the largest, is the
share of its documents to keep: the sample has the wanted margins in expectation and is the largest
one that has them without repeating a document. A document is kept if a hash of its id, spread over
0 to 1, is below that share.

Targets are weights per value of a column; without any, a value with a total of t tokens weighs
t ** `TEMPER`, which lifts small ones. Targets of values that don't occur are unused; values without a
target weigh nothing and are left out.

Tokens are stretches between spaces and line feeds; the topic, where no column says it, is the form
of the text: fragment, numbers, lines or prose.

Defined cases: null is a value of its own in each column; a null text is an empty one, with no
tokens; a null id is hashed as an empty text; repeated rows share their fate. With no tokens at all
every document is kept.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattquill.llm.common import set_aside, stored, table

TEMPER = 0.9
SWEEPS = 10
MARGINS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(
        F.length(text) - F.length(F.translate(text, " \n", "")) + 1
    ).cast("bigint")


def text_form(text: Column, tokens: Column) -> Column:
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    return (
        F.when(tokens < 100, "fragment")
        .when(digits * 100 > F.length(text), "numbers")
        .when(lines * 60 > tokens, "lines")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """`docs` with mix_tokens and mix_topic."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("mix_tokens", token_count(text))
    return docs.withColumn("mix_topic", text_form(text, F.col("mix_tokens")))


def weighted(cells: DataFrame, margin: str, targets: Mapping[str, float] | None) -> DataFrame:
    """The target of each cell's value in one column."""
    if targets is None:
        total = F.sum("tokens").over(Window.partitionBy(margin))
        return cells.withColumn(f"{margin}_target", F.pow(total.cast("double"), F.lit(TEMPER)))
    named = F.coalesce(
        *[F.when(F.col(margin) == value, F.lit(float(weight))) for value, weight in targets.items()],
        F.lit(0.0),
    )
    return cells.withColumn(f"{margin}_target", named)


def shares(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """source, lang, topic and the share of their documents to keep; docs from `described`."""
    cells = docs.groupBy("source", "lang", F.col("mix_topic").alias("topic")).agg(
        F.sum("mix_tokens").alias("tokens")
    )
    # few rows from here on: the sweeps start from a table, not from the texts
    cells = stored(cells, "cells")
    for margin in MARGINS:
        cells = weighted(cells, margin, (targets or {}).get(margin))
    cells = cells.withColumn("factor", F.lit(1.0))
    for sweep in range(sweeps):
        if sweep and sweep % SWEEPS == 0:
            cells = stored(cells, "factors")
        for margin in MARGINS:
            total = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(margin))
            cells = cells.withColumn(
                "factor",
                F.col("factor") * F.when(total > 0, F.col(f"{margin}_target") / total).otherwise(1.0),
            )
    fitted = stored(cells.select(*MARGINS, "tokens", "factor"), "factors")
    largest = fitted.filter("tokens > 0").agg(F.max("factor")).first()[0]
    share = F.round(F.least(F.lit(1.0), F.col("factor") / F.lit(largest or 1.0)), 9)
    return fitted.select(*MARGINS, F.when(F.lit(bool(largest)), share).otherwise(1.0).alias("share"))


def chance(doc_id: Column) -> Column:
    """The id's place in 0 to 1."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def sampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The documents kept, with mix_tokens, mix_topic and mix_share."""
    docs = described(docs.drop("mix_share"))
    cells = shares(docs, targets).select(
        *[F.col(m).alias(f"_cell_{m}") for m in MARGINS], F.col("share").alias("mix_share")
    )
    own = {"source": "source", "lang": "lang", "topic": "mix_topic"}
    same = reduce(lambda a, b: a & b, [F.col(own[m]).eqNullSafe(F.col(f"_cell_{m}")) for m in MARGINS])
    # the cells are a small table on disk: Spark broadcasts it if its size allows, and joins on the
    # three columns otherwise
    return (
        docs.join(cells, same)
        .drop(*[f"_cell_{m}" for m in MARGINS])
        .filter(chance(F.col("doc_id")) < F.col("mix_share"))
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return sampled(docs).select(
        "doc_id",
        "source",
        "lang",
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("tokens"),
        F.col("mix_share").alias("share"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the sample."""
    rows, back = set_aside(docs, ["doc_id", "text", "source", "lang"])
    return back(sampled(rows))


def op6_sql() -> str:
    """The same in SQL, the temper and the number of sweeps spelled out."""
    steps = [
        """t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, CASE WHEN text = '' THEN 0
  ELSE length(text) - length(translate(text, ' ' || chr(10), '')) + 1 END AS tokens FROM t),
d AS (SELECT doc_id, source, lang, tokens, CASE WHEN tokens < 100 THEN 'fragment'
  WHEN (length(text) - length(translate(text, '0123456789', ''))) * 100 > length(text) THEN 'numbers'
  WHEN (length(text) - length(translate(text, chr(10), ''))) * 60 > tokens THEN 'lines'
  ELSE 'prose' END AS topic FROM n),
c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
s0 AS (SELECT *, pow(sum(tokens) OVER (PARTITION BY source), 0.9) AS source_target,
  pow(sum(tokens) OVER (PARTITION BY lang), 0.9) AS lang_target,
  pow(sum(tokens) OVER (PARTITION BY topic), 0.9) AS topic_target, 1.0::DOUBLE AS factor FROM c)"""
    ]
    last = "s0"
    for k in range(1, 11):
        for margin in ("source", "lang", "topic"):
            name = f"s{k}_{margin}"
            steps.append(
                f"{name} AS (SELECT * EXCLUDE (factor), factor * CASE WHEN sum(tokens * factor) OVER w > 0 "
                f"THEN {margin}_target / sum(tokens * factor) OVER w ELSE 1 END AS factor "
                f"FROM {last} WINDOW w AS (PARTITION BY {margin}))"
            )
            last = name
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
f AS (SELECT source, lang, topic,
  round(least(1.0, factor / (SELECT max(factor) FROM {last} WHERE tokens > 0)), 9) AS share FROM {last})
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens::BIGINT AS tokens, f.share
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang
  AND d.topic = f.topic
WHERE ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < f.share"""
    )
