from datetime import datetime

from pyspark.sql import functions as F

from wattquill.operators.plotdata import daily_consumption
from wattquill.operators.toolcalls import check_calls
from wattquill.operators.transcripts import action_calls, parse_turns
from wattquill.sources.tables import exact_kwh
from wattquill.streaming import streams

CALL = 'Action: sql_executor\nAction Input: {"query": "SELECT 1"}'


def test_calls_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = [(i % 7, i, CALL if i % 3 else "Thought: hm") for i in range(60)]
    turns = spark.createDataFrame(rows, "episode_id bigint, step int, response string")
    turns.repartition(3).write.json(str(tmp_path / "in"))
    stream = streams.checked_calls(streams.read_turns(spark, str(tmp_path / "in"), 1))
    streams.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("episode_id", "step", "status")
    expected = check_calls(action_calls(parse_turns(turns))).select("episode_id", "step", "status")
    assert sorted(got.collect()) == sorted(expected.collect()) and got.count() == 40


def test_daily_consumption_of_closed_days(spark, tmp_path):
    rows = [
        (d * 100 + i, i % 3, datetime(2024, 1, 1 + d, (i * 5) % 24, 7), i / 8) for d in range(6) for i in range(20)
    ]
    readings = spark.createDataFrame(
        rows, "reading_id bigint, customer_id bigint, timestamp timestamp_ntz, consumption_kwh double"
    )
    for day in range(6):
        part = readings.filter(F.dayofmonth("timestamp") == day + 1).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.daily_consumption(streams.read_readings(spark, str(tmp_path / "in"), 1))
    streams.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {tuple(r) for r in daily_consumption(exact_kwh(readings)).collect()}
    assert got <= expected
    assert {r for r in expected if r[1].day <= 4} <= got
