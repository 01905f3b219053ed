"""Text helpers for transcripts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattquill import fixed_values as fv


def strip(text: Column) -> Column:
    """Drop all Unicode white space at both ends (plain `trim` would drop blanks only)."""
    return F.btrim(text, F.lit(fv.WHITE_SPACE))


def tail_after(text: Column, marker: str) -> Column:
    """Everything after the first occurrence of the marker; NULL where it does not occur."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substr(text, at + len(marker)))


def until_stop(tail: Column) -> Column:
    """Cut at the first marker of the stop list, in list order, that occurs anywhere in the text."""
    section = F
    for marker in fv.STOP_MARKERS:
        section = section.when(F.contains(tail, F.lit(marker)), F.substring_index(tail, marker, 1))
    return section.otherwise(tail)


def repair_json(text: Column) -> Column:
    """One line, and no comma before a closing brace or bracket."""
    flat = F.translate(strip(text), "\n\r\t", "   ")
    return F.regexp_replace(F.regexp_replace(flat, r",(?U)\s*\}", "}"), r",(?U)\s*\]", "]")


def is_json(text: Column) -> Column:
    """A single complete JSON value: embedding it in an object and in a list must both parse.

    Either test alone lets trailing text through. NaN, Infinity and repeated keys are let in, and no
    size is too large: the text is only read through, no value is built from it.
    """
    rules = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}
    in_object = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x string, _bad string", rules)
    in_list = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", rules)
    return in_object["_bad"].isNull() & in_list.isNotNull()


def last_number(text: Column) -> Column:
    """The last number in the text, thousands commas ignored; a sign belongs to decimals only."""
    hits = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(fv.NUMBER_PATTERN), 0)
    return F.try_element_at(hits, F.lit(-1)).try_cast("double")
