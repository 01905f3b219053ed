"""Table schemas. Timestamps are naive local times, so TIMESTAMP_NTZ throughout."""

from pyspark.sql import types as T

_LONG, _INT, _TEXT, _DOUBLE = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
_TIME = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CUSTOMERS = _struct(customer_id=_LONG, segment=_TEXT, meter_type=_TEXT, join_date=_TIME)
TARIFFS = _struct(
    tariff_id=_LONG,
    segment=_TEXT,
    peak_rate_per_kwh=_DOUBLE,
    off_peak_rate_per_kwh=_DOUBLE,
    standing_charge=_DOUBLE,
    peak_hours=_TEXT,
)
READINGS = _struct(reading_id=_LONG, customer_id=_LONG, timestamp=_TIME, consumption_kwh=_DOUBLE)
METER_TABLES = {"customers": CUSTOMERS, "tariffs": TARIFFS, "readings": READINGS}

# `expected_value` is a number or a boolean in the file, so it is read as text and cast later
WORKLOAD = _struct(
    query=_TEXT, category=_TEXT, expected_value=_TEXT, tolerance=_DOUBLE, tolerance_type=_TEXT
)
TURNS = _struct(episode_id=_LONG, step=_INT, response=_TEXT)
