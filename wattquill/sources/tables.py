"""Meter tables as Parquet: explicit schemas on read, a pruning-friendly layout on write."""

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.schemas import METER_TABLES
from wattquill.session import shared_dir

logger = logging.getLogger(__name__)

READING_KWH = "decimal(15,3)"
MANIFEST = "current"


def exact_kwh(readings: DataFrame) -> DataFrame:
    """Readings carry three decimals, so they are kept as DECIMAL.

    NaN, infinities and values of 10^12 kWh or more have no such form: they become NULL, which the
    results count as `null_reading_count`. They neither end the job nor enter a sum.
    """
    return readings.withColumn("consumption_kwh", F.col("consumption_kwh").try_cast(READING_KWH))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of `customers`, `tariffs`, `readings` below `root`."""
    if name not in METER_TABLES:
        raise ValueError(f"unknown table {name!r}, expected one of {', '.join(METER_TABLES)}")
    version = current_version(spark, root)
    root = f"{root}/{version}" if version else root
    if name != "readings":
        return spark.read.schema(METER_TABLES[name]).parquet(f"{root}/{name}")
    # our own files hold the exact type, and filters on it reach the scan; others may hold doubles
    df = spark.read.parquet(f"{root}/{name}")
    exact = df.schema["consumption_kwh"].dataType.simpleString() == READING_KWH
    return df if exact else exact_kwh(df)


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def _exists(spark: SparkSession, path: str) -> bool:
    """Asks for the path itself, whatever lies below it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _file_context(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()), target


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder below `root` that the last finished write made current; None before any."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")
    system = files.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(files):
        return None
    stream = system.open(files)
    try:
        return stream.readLine()
    finally:
        stream.close()


def _make_current(spark: SparkSession, root: str, version: str) -> None:
    """Readers see the old version or the new one: the manifest is replaced by one rename."""
    context, target = _file_context(spark, f"{root}/{MANIFEST}")
    _, written = _file_context(spark, f"{root}/{MANIFEST}-{version}")
    system = written.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(written, True)
    stream.writeBytes(f"{version}\n")
    stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(written, target, options)


def write_tables(
    customers: DataFrame,
    tariffs: DataFrame,
    readings: DataFrame,
    root: str,
    overwrite: bool = False,
) -> bool:
    """Write the three tables below `root`; False (and nothing written) if there are tables already.

    All or nothing: the tables go into a new version folder, and only when all three are there does
    one rename make it the one that `read_table` follows. A write that fails leaves the tables as they
    were. The version before stays for readers that have begun with it; older ones are removed.

    Readings go into one folder per day. The range shuffle on (day, customer, time) gives files of
    even size however large one day or one customer is, each with a narrow customer range: day folders
    stand for the index by time, min/max statistics for the one by customer. A Bloom filter of the
    customers in each row group stands for the third, customer and time together: a look-up over many
    days opens the footers of these days, but reads only the row groups that hold the customer.
    """
    spark = readings.sparkSession
    before = current_version(spark, root)
    there = before or any(_exists(spark, f"{root}/{name}") for name in METER_TABLES)
    if not overwrite and there:
        logger.warning("tables exist below %s, use overwrite=True to replace them", root)
        return False
    version = f"version-{uuid.uuid4().hex}"
    order = ["reading_date", "customer_id", "timestamp"]
    customers.write.parquet(f"{root}/{version}/customers")
    tariffs.write.parquet(f"{root}/{version}/tariffs")
    (
        exact_kwh(readings)
        .withColumn("reading_date", F.to_date("timestamp"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy("reading_date")
        .option("parquet.bloom.filter.enabled#customer_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(f"{root}/{version}/readings")
    )
    _make_current(spark, root, version)
    _remove_versions(spark, root, {version, before})
    return True


def _remove_versions(spark: SparkSession, root: str, kept: set[str | None]) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(target):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in kept:
            system.delete(status.getPath(), True)


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from the written table.

    For results that several branches of a query read: each computes it once, plans stay small, and
    a lost executor costs a re-read instead of a recomputation.
    """
    path = temporary_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: its name and row count."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    stats = counts[0]
    for count in counts[1:]:
        stats = stats.unionByName(count)
    return stats
