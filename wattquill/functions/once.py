"""Projections whose columns are evaluated exactly once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`df.select(*keep, **columns)` that later filters and projections do not reach into.

    A filter on a column of a plain projection is rewritten in terms of its inputs, and a long
    chain of text expressions is then copied for every use. A one-row generator keeps the columns
    as values: they cost one evaluation, whatever reads them.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
