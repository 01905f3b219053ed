import duckdb
import pytest
from pyspark.sql import functions as F

from wattquill.llm import mixing


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_as_sql(spark, folder):
    got = mixing.op6_mixing(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = con.execute(mixing.op6_sql())
    names = [c[0] for c in result.description]
    assert names == got.columns
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_margins_meet_their_targets(frame, prose):
    rows = []
    for i in range(3000):
        rows.append((i, prose(i % 50, 20 + i % 7 * 20), ("en", "de", "fr")[i % 5 % 3], ("a", "b")[i % 3 == 0]))
    docs = mixing.described(frame(rows, "doc_id long, text string, lang string, source string"))
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.2, "de": 0.3, "fr": 0.5}}
    cells = mixing.shares(docs, targets, sweeps=40)
    joined = docs.withColumn("topic", F.col("mix_topic")).join(cells, ["source", "lang", "topic"])
    for margin, wanted in targets.items():
        got = {r[0]: r.s for r in joined.groupBy(margin).agg(F.sum(F.col("mix_tokens") * F.col("share")).alias("s")).collect()}
        for value, share in wanted.items():
            assert got[value] / sum(got.values()) == pytest.approx(share, abs=1e-6)
    assert cells.agg(F.max("share")).first()[0] == 1.0
    kept = mixing.sampled(docs.drop("mix_tokens", "mix_topic"), targets)
    real = {r[0]: r.s for r in kept.groupBy("lang").agg(F.sum("mix_tokens").alias("s")).collect()}
    assert real["fr"] / sum(real.values()) == pytest.approx(0.5, abs=0.06)


def test_nulls_and_empty_tables(frame, docs):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(1, None, None, None), (2, "", "en", None), (None, "a b", None, "s"), (3, "a b c", "en", "s"), (3, "a b c", "en", "s")]
    df = frame(rows, schema).withColumn("mix_share", F.lit("x"))
    kept = mixing.stage(df.sparkSession, df, "")
    assert kept.columns == df.columns and {r.mix_share for r in kept.collect()} <= {"x"}
    none = frame([(1, None, "en", "s"), (2, "", "de", "t")], schema)
    assert mixing.sampled(none).count() == 2
    assert mixing.sampled(docs([])).count() == 0


def test_plan_has_no_python(spark, small):
    plan = mixing.op6_mixing(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
