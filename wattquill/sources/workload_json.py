"""The question workload as JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.schemas import WORKLOAD


def read_workload(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Questions with `expected_value` as DOUBLE; a boolean answer counts as 1 or 0.

    `multi_line` reads one JSON array per file; without it each line holds one question, which
    splits over tasks. A missing path is an error.
    """
    raw = spark.read.schema(WORKLOAD).option("multiLine", multi_line).json(path)
    text = F.col("expected_value")
    flag = F.when(text == "true", 1.0).when(text == "false", 0.0)
    return raw.withColumn("expected_value", F.coalesce(text.try_cast("double"), flag))


def write_workload(workload: DataFrame, path: str) -> None:
    """One JSON object a line."""
    workload.select(*WORKLOAD.fieldNames()).write.mode("overwrite").json(path)
