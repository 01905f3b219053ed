"""Small fixed tables as literal rows, so that the optimizer knows their size."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wattquill import fixed_values as fv
from wattquill.schemas import TARIFFS


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, dict):
        fields = ", ".join(f"{_literal(name)}, {_literal(field)}" for name, field in value.items())
        return f"named_struct({fields})"
    if isinstance(value, list):
        return "array(" + ", ".join(_literal(item) for item in value) + ")"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def literal_rows(spark: SparkSession, ddl: Sequence[tuple[str, str]], rows: Sequence[tuple]) -> DataFrame:
    """`rows` as a DataFrame with the (name, type) columns of `ddl`."""
    names = ", ".join(name for name, _ in ddl)
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in ddl)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def tariffs(spark: SparkSession) -> DataFrame:
    """The two tariffs."""
    ddl = [(f.name, f.dataType.simpleString()) for f in TARIFFS.fields]
    return literal_rows(spark, ddl, fv.TARIFFS)


def tool_parameters(spark: SparkSession) -> DataFrame:
    """One row per tool parameter, in declaration order."""
    rows = [(*spec[:2], position, *spec[2:]) for position, spec in enumerate(fv.TOOL_PARAMETERS)]
    ddl = [
        ("tool", "string"),
        ("param", "string"),
        ("position", "int"),
        ("type", "string"),
        ("required", "boolean"),
        ("default_value", "string"),
    ]
    return literal_rows(spark, ddl, rows)


def tool_specs(spark: SparkSession) -> DataFrame:
    """One row per tool with its parameters, in declaration order, as one array."""
    fields = ("param", "type", "required", "default_value")
    specs: dict[str, list] = {}
    for tool, *values in fv.TOOL_PARAMETERS:
        specs.setdefault(tool, []).append(dict(zip(fields, values, strict=True)))
    kind = "array<struct<param:string,type:string,required:boolean,default_value:string>>"
    return literal_rows(spark, [("tool", "string"), ("specs", kind)], list(specs.items()))
