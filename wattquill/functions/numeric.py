"""Exact arithmetic: energy is summed as whole watt-hours, ratios are rounded from integers.

Sums of BIGINT do not depend on partition order, stay in primitive longs inside generated code,
and fail (rather than wrap) on overflow under ANSI mode.
"""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

THOUSANDTH = Decimal("0.001")


def watt_hours(kwh: Column) -> Column:
    """DECIMAL(15,3) kWh as BIGINT Wh."""
    return (kwh * F.lit(1000)).cast("bigint")


def kwh_decimal(wh: Column) -> Column:
    """BIGINT Wh as DECIMAL(23,3) kWh."""
    return wh.cast("decimal(20,0)") * F.lit(THOUSANDTH)


def money(amount: Column) -> Column:
    """Round a DECIMAL half up to two places and hand it out as DOUBLE."""
    return F.round(amount, 2).cast("double")


def rounded_ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """`numerator / denominator` of two integers, rounded half away from zero, in units of 10^-places.

    Integer arithmetic, so ties never depend on a binary fraction. NULL where the denominator is 0.
    The result is a BIGINT: it fits for any ratio below 10^(18 - places), and no mean or load factor
    of DECIMAL(15,3) readings comes near that.
    """
    num = numerator.cast("decimal(20,0)")
    den = F.when(denominator != 0, denominator).cast("decimal(20,0)")
    doubled = F.abs(num) * F.lit(Decimal(2 * 10**places)) + F.abs(den)
    units = F.call_function("div", doubled, F.abs(den) * F.lit(Decimal(2)))
    negative = (numerator < 0) != (denominator < 0)
    return F.when(negative, -units).otherwise(units)


def skip_nan(column: Column) -> Column:
    """NaN counts as missing, like NULL."""
    return F.nanvl(column, F.lit(None).cast("double"))
