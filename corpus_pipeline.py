"""From raw documents to packed training sequences, a stage at a time."""

from pyspark.sql import DataFrame, SparkSession

from wattquill.llm import jaccard, mixing, packing, pii, toxicity
from wattquill.llm.common import stored, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

# token ids, models and 64-bit hashes have no SQL: tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each reads what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
