"""Registered queries of the text operators."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from wattquill.llm import (
    collocations,
    crosstokens,
    fingerprint,
    jaccard,
    layout,
    mixing,
    packing,
    passages,
    pii,
    quotes,
    records,
    toxicity,
    voronoi,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_pii": pii.op2_pii,
        "op3_fingerprint": fingerprint.op3_fingerprint,
        "op4_layout": layout.op4_layout,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_mixing": mixing.op6_mixing,
        "op7_quotes": quotes.op7_quotes,
        "op8_packing": packing.op8_packing,
        "op9_voronoi": voronoi.op9_voronoi,
        "op10_passages": passages.op10_passages,
        "op11_crosstokens": crosstokens.op11_crosstokens,
        "op12_collocations": collocations.op12_collocations,
        "op13_records": records.op13_records,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": mixing.op6_sql(),
        "op9_voronoi": voronoi.OP9_SQL,
        "op12_collocations": collocations.OP12_SQL,
    }
