"""The five tools for one question at a time, on top of the batch operators.

Each call is a request table of one row. Results are small dictionaries; whatever is large stays a
DataFrame. For many questions use the operators directly: one job answers all of them.
"""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.fixed_values import DEFAULT_ROW_LIMIT
from wattquill.operators.aggregate import aggregate
from wattquill.operators.billing import bill
from wattquill.operators.loadfactor import load_factor
from wattquill.operators.plotdata import plot_data, plot_title
from wattquill.operators.sqlguard import guarded_sql, preview
from wattquill.sources.tables import read_table, register_views

GROUP_LIMIT = 10_000
_PROBLEMS = {
    "customer_not_found": "there is no customer {id}",
    "no_tariff": "segment '{segment}' has no tariff",
    "no_readings": "customer {id} has no readings in the period",
}


class MeterTools:
    """The tools over one set of meter tables, which SQL text sees as views."""

    def __init__(self, customers: DataFrame, tariffs: DataFrame, readings: DataFrame) -> None:
        self.spark = readings.sparkSession
        self.customers, self.tariffs, self.readings = customers, tariffs, readings
        register_views({"customers": customers, "tariffs": tariffs, "readings": readings})

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "MeterTools":
        """Over the tables written below `root`."""
        return cls(*[read_table(spark, root, name) for name in ("customers", "tariffs", "readings")])

    def sql_executor(self, query: str, row_limit: int = DEFAULT_ROW_LIMIT) -> dict:
        """`columns`, `rows` and `row_count` of at most `row_limit` rows of a SELECT."""
        return preview(guarded_sql(self.spark, query, row_limit), row_limit)

    def pandas_aggregator(
        self,
        query: str,
        operation: str,
        column: str,
        group_by: str | None = None,
        group_limit: int = GROUP_LIMIT,
    ) -> dict:
        """One aggregate over all rows of a SELECT, whole or by group.

        Of groups the first `group_limit` in their order are handed out, and `truncated` says whether
        there are more; `aggregate` has them all, as a DataFrame.
        """
        rows = guarded_sql(self.spark, query, row_limit=None)
        result = aggregate(rows, operation, column, group_by)
        answer = {"operation": operation, "column": column}
        if group_by:
            rows = result.orderBy(group_by).limit(group_limit + 1).collect()
            groups = {r[group_by]: r["result"] for r in rows[:group_limit]}
            return answer | {"group_by": group_by, "results": groups, "truncated": len(rows) > group_limit}
        return answer | {"result": result.first()["result"]}

    def tariff_calculator(self, customer_id: int, start_date: str, end_date: str) -> dict:
        """The bill of one customer; ValueError if there is no customer, tariff or reading."""
        own = self.readings.filter(F.col("customer_id") == customer_id)
        requests = self._request(customer_id, start_date, end_date)
        return self._one(bill(requests, self.customers, self.tariffs, own))

    def calculate_load_factor(self, customer_id: int, start_date: str, end_date: str) -> dict:
        """The load factor of one customer; ValueError if there are no readings."""
        own = self.readings.filter(F.col("customer_id") == customer_id)
        return self._one(load_factor(self._request(customer_id, start_date, end_date), own))

    def plot_series(
        self, query: str, plot_type: str, x_column: str, y_column: str, title: str = ""
    ) -> DataFrame:
        """The series of a plot over all rows of a SELECT, with its title (by default y vs x) in each
        row; drawing it is up to the caller."""
        rows = guarded_sql(self.spark, query, row_limit=None)
        named = plot_title(x_column, y_column, title)
        return plot_data(rows, plot_type, x_column, y_column).withColumn("title", F.lit(named))

    def _request(self, customer_id: int, start_date: str, end_date: str) -> DataFrame:
        first, last = date.fromisoformat(start_date), date.fromisoformat(end_date)
        return self.spark.range(1).select(
            F.col("id").alias("request_id"),
            F.lit(customer_id).cast("bigint").alias("customer_id"),
            F.lit(first).alias("start_date"),
            F.lit(last).alias("end_date"),
        )

    @staticmethod
    def _one(answers: DataFrame) -> dict:
        row = answers.first().asDict()
        status = row.pop("status")
        if status != "ok":
            text = _PROBLEMS[status].format(id=row["customer_id"], segment=row.get("segment"))
            raise ValueError(text)
        del row["request_id"]
        return row | {name: row[name].isoformat() for name in ("start_date", "end_date")}
