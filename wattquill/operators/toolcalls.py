"""Validation of logged tool calls against the parameter list of the five tools.

The parameters of a tool travel as one array, so a call is checked within its own row: five fixed
rows are broadcast, nothing is exploded, grouped or shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattquill import fixed_values as fv
from wattquill.functions.once import computed_once
from wattquill.functions.text import strip
from wattquill.sources.constants import tool_specs

_INTEGER_TEXT = r"^\s*[+-]?\d+(_\d+)*\s*$"
_FLOAT_TEXT = r"(?i)^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*\.?(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def _coerced(kind: Column, json_type: Column, text: Column) -> Column:
    """The argument as text of its declared type; NULL where it cannot be converted."""
    is_text = json_type == "STRING"
    is_bool = json_type == "BOOLEAN"
    is_number = ~is_text & ~is_bool & ~json_type.rlike("^(ARRAY|OBJECT)")
    digits = F.replace(strip(text), F.lit("_"), F.lit(""))
    as_int = (
        F.when(is_text, F.when(text.rlike(_INTEGER_TEXT), _plain_integer(digits)))
        .when(is_bool, F.when(text == "true", "1").otherwise("0"))
        .when(is_number, _truncated(text))
    )
    as_float = (
        F.when(is_text, F.when(text.rlike(_FLOAT_TEXT), digits.try_cast("double")))
        .when(is_bool, F.when(text == "true", 1.0).otherwise(0.0))
        .when(is_number, text.try_cast("double"))
    )
    as_bool = (
        F.when(is_text, F.lower(text).isin(*fv.TRUE_WORDS))
        .when(is_bool, text == "true")
        .when(is_number, text.try_cast("double") != 0)
        .otherwise(~text.isin("[]", "{}"))
    )
    return (
        F.when(kind == "str", F.when(is_bool, F.initcap(text)).otherwise(text))
        .when(kind == "int", as_int)
        .when(kind == "float", as_float.cast("string"))
        .when(kind == "bool", as_bool.cast("string"))
    )


def _plain_integer(digits: Column) -> Column:
    """Signed digits of any length without a plus sign and leading zeros."""
    plain = F.regexp_replace(digits, r"^([+-]?)0+(?=\d)", "$1")
    return F.when(plain.isin("-0", "+0"), "0").otherwise(F.ltrim(plain, F.lit("+")))


def _digits_of_double(value: Column) -> Column:
    """All digits of a double below 10^38 in size, as DECIMAL: its fraction times a power of two.

    A cast would take the shortest text that reads back as the same double, and fill up with zeros.
    """
    # 54 bits stay, so that the logarithm may be off by one
    power = F.greatest(F.floor(F.log2(F.abs(value))) - 54, F.lit(0)).cast("int")
    fraction = (value / F.pow(F.lit(2.0), power)).cast("bigint").cast("decimal(18,0)")
    half = F.least(power, F.lit(36))

    def two_to(exponent: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), exponent).cast("decimal(12,0)")

    return fraction * two_to(half) * two_to(power - half)


def _truncated(number: Column) -> Column:
    """A JSON number without its fraction, towards zero: integers of any length, and doubles below
    10^38 with all digits of their exact value (larger ones keep their exponent). Infinities have no
    integer."""
    value = number.try_cast("double")
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return (
        F.when(number.rlike(r"^-?\d+$"), _plain_integer(number))
        .when(F.abs(value) < 1e15, whole.cast("bigint").cast("string"))
        .when(F.abs(value) < 1e38, _digits_of_double(value).cast("string"))
        .when(F.abs(value) < float("inf"), number)
    )


def check_calls(calls: DataFrame) -> DataFrame:
    """Add the check of every call (tool, action_input as JSON text) to its row.

    - `status`: ok, unknown_tool, arguments_not_object, missing_parameter or bad_type. Parameters
      are looked at in declaration order and the first problem counts.
    - `problem_param`: the parameter at fault.
    - `arguments`: parameter to converted value, defaults filled in; a given null stays null.
    - `extra_arguments`: how many arguments the tool does not declare (they are ignored).
    """
    specs = F.broadcast(tool_specs(calls.sparkSession).withColumnRenamed("tool", "_tool"))
    is_object = F.startswith(F.col("action_input"), F.lit("{"))
    strict = {"allowSingleQuotes": "false"}
    values = F.when(is_object, F.from_json(F.col("action_input"), "map<string,variant>", strict))
    # numbers as they are written: a variant doesn't keep the difference of 1 and 1.0
    written = F.from_json(F.col("action_input"), "map<string,string>", strict)

    def argument(key: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        as_written = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        text = F.when(as_written, F.try_element_at(written, key)).otherwise(F.try_variant_get(v, "$", "string"))
        return F.struct(kind.alias("json_type"), text.alias("text"))

    args = F.transform_values(values, argument)
    opened = computed_once(calls, calls.columns, _name=strip(F.col("tool")), _args=args).join(
        specs, F.col("_name") == F.col("_tool"), "left"
    )

    def matched(spec: Column) -> Column:
        return F.struct(
            *[spec[field].alias(field) for field in ("param", "type", "required", "default_value")],
            F.map_contains_key("_args", spec["param"]).alias("given"),
            F.try_element_at("_args", spec["param"]).alias("arg"),
        )

    def judged(pair: Column) -> Column:
        given, json_type, text = pair["given"], pair["arg"]["json_type"], pair["arg"]["text"]
        is_null = json_type == "VOID"
        value = F.when(given & ~is_null, _coerced(pair["type"], json_type, text))
        problem = F.when(pair["required"] & ~given, "missing_parameter").when(
            given & ~is_null & value.isNull(), "bad_type"
        )
        return F.struct(
            pair["param"].alias("param"),
            (given | ~pair["required"]).alias("bound"),
            F.when(given, value).otherwise(pair["default_value"]).alias("value"),
            problem.alias("problem"),
        )

    checked = computed_once(
        opened, [*calls.columns, "_tool", "_args", "specs"], _judged=F.transform(F.transform("specs", matched), judged)
    )
    first = F.get(F.filter("_judged", lambda j: j["problem"].isNotNull()), F.lit(0))
    status = (
        F.when(F.col("_tool").isNull(), "unknown_tool")
        .when(F.col("_args").isNull(), "arguments_not_object")
        .otherwise(F.coalesce(F.col("_first.problem"), F.lit("ok")))
    )
    bound = F.transform(
        F.filter("_judged", lambda j: j["bound"]), lambda j: F.struct(j["param"], j["value"])
    )
    known = F.transform("specs", lambda s: s["param"])
    is_known = F.col("_tool").isNotNull() & F.col("_args").isNotNull()
    return checked.withColumn("_first", first).select(
        *calls.columns,
        status.alias("status"),
        F.col("_first.param").alias("problem_param"),
        F.when(is_known & F.col("_first").isNull(), F.map_from_entries(bound)).alias("arguments"),
        F.when(is_known, F.size(F.array_except(F.map_keys("_args"), known))).alias("extra_arguments"),
    )


def unknown_tool_calls(calls: DataFrame) -> DataFrame:
    """Calls of a tool that does not exist."""
    names = F.broadcast(tool_specs(calls.sparkSession).select(F.col("tool").alias("_tool")))
    return calls.join(names, strip(F.col("tool")) == F.col("_tool"), "left_anti")


def call_records(checked: DataFrame) -> DataFrame:
    """Outcome records: tool, arguments, success and, for a failed call, the error."""
    tools = ", ".join(dict.fromkeys(spec[0] for spec in fv.TOOL_PARAMETERS))
    name, param = F.col("tool"), F.col("problem_param")
    error = (
        F.when(
            F.col("status") == "unknown_tool",
            F.format_string(f"no tool is called '%s', there are {tools}", name),
        )
        .when(
            F.col("status") == "missing_parameter",
            F.format_string("parameter '%s' of tool '%s' is not given", param, name),
        )
        .when(F.col("status") == "bad_type", F.format_string("the value of '%s' has the wrong type", param))
        .when(F.col("status") == "arguments_not_object", F.lit("the arguments are no object"))
    )
    keys = [c for c in checked.columns if c in ("episode_id", "step")]
    return checked.select(
        *keys, "tool", "arguments", "status", (F.col("status") == "ok").alias("success"), error.alias("error")
    )
