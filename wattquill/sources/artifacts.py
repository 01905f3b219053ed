"""Plot files on disk, and which logged calls they confirm."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _plain_path(path: Column) -> Column:
    """Without scheme and authority: `file:///a/b` and `/a/b` are the same file."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def list_artifacts(spark: SparkSession, directory: str) -> DataFrame:
    """(path, length) of every file below the directory; contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return listing.select(_plain_path(F.col("path")).alias("path"), "length")


def verified_plot_calls(calls: DataFrame, artifacts: DataFrame, directory: str) -> DataFrame:
    """Successful plot calls whose `result` names an existing, non-empty file below the directory."""
    prefix = directory.rstrip("/") + "/"
    plots = calls.filter((F.col("tool") == "plot_generator") & F.col("success")).filter(
        F.startswith(_plain_path(F.col("result")), _plain_path(F.lit(prefix)))
    )
    files = artifacts.filter(F.col("length") > 0).select(F.col("path").alias("_path"))
    return plots.join(files, _plain_path(F.col("result")) == F.col("_path"), "left_semi")
