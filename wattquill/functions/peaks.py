"""Peak windows packed in text such as `06:00-09:00,18:00-22:00`; minutes are not significant."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS = range(24)


def _hour_of(clock: Column) -> Column:
    return F.split_part(clock, F.lit(":"), F.lit(1)).cast("int")


def peak_windows(peak_hours: Column) -> Column:
    """ARRAY<STRUCT<start_hour INT, end_hour INT>>."""
    return F.transform(
        F.split(peak_hours, ","),
        lambda w: F.struct(
            _hour_of(F.split_part(w, F.lit("-"), F.lit(1))).alias("start_hour"),
            _hour_of(F.split_part(w, F.lit("-"), F.lit(2))).alias("end_hour"),
        ),
    )


def is_peak(hour: Column, windows: Column) -> Column:
    """In any window, start included and end not; a window over midnight matches no hour."""
    return F.exists(windows, lambda w: (hour >= w["start_hour"]) & (hour < w["end_hour"]))


def _bit(hour: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), hour)


def peak_mask(windows: Column) -> Column:
    """The peak hours of a tariff as 24 bits, worked out once per tariff row."""
    hours = F.filter(F.sequence(F.lit(0), F.lit(len(HOURS) - 1)), lambda h: is_peak(h, windows))
    mask = F.aggregate(hours, F.lit(0), lambda bits, hour: bits.bitwiseOR(_bit(hour)))
    return F.when(windows.isNotNull(), mask)


def masked_sum(by_hour: Column, mask: Column) -> Column:
    """Sum of the entries of a 24-entry array whose bit is set."""
    kept = F.filter(by_hour, lambda wh, hour: mask.bitwiseAND(_bit(hour)) != 0)
    return F.when(
        mask.isNotNull(), F.aggregate(kept, F.lit(0).cast("bigint"), lambda total, wh: total + wh)
    )


def in_mask(hour: Column, mask: Column) -> Column:
    return mask.bitwiseAND(_bit(hour)) != 0
