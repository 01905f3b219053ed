import pytest

from wattquill.operators.sqlguard import dedup_names, guarded_sql, preview


@pytest.fixture(autouse=True)
def views(spark):
    rows = [(i, "residential" if i % 2 else "commercial", i * 10) for i in range(250)]
    spark.createDataFrame(rows, "customer_id bigint, segment string, credit_limit int").createOrReplaceTempView(
        "customers"
    )
    spark.sql("SELECT 1 AS id, DATE '2024-01-01' AS updated_at, 'Drop' AS note").createOrReplaceTempView("notes")


@pytest.mark.parametrize(
    "statement",
    [
        "DELETE FROM customers",
        "INSERT INTO customers VALUES (1, 'x', 2)",
        "UPDATE customers SET segment = 'x'",
        "DROP TABLE customers",
        "CREATE TABLE t AS SELECT 1",
        "ALTER TABLE customers ADD COLUMN x INT",
        "TRUNCATE TABLE customers",
        "SET spark.sql.ansi.enabled = false",
        "CACHE TABLE customers",
        "ADD JAR '/tmp/x.jar'",
        "SELECT 1; DROP TABLE customers",
        "SELECT 1) t; DROP TABLE customers; SELECT * FROM (SELECT 1",
        "EXPLAIN SELECT 1",
        "SELECT reflect('java.lang.Math', 'abs', -1)",
        "SELECT `reflect`('java.lang.Math', 'abs', -1)",
        "SELECT java_method ('java.lang.Math', 'abs', -1)",
        "SELECT try_reflect('java.lang.Math', 'abs', -1)",
        r"SELECT r'\', reflect('java.lang.Math', 'abs', -1), 'x'",
        "SELECT 1 AS `a'`, reflect('java.lang.Math', 'abs', -1) AS `b'`",
        "SELECT IDENTIFIER('ref' || 'lect')('java.lang.Math', 'abs', -1)",
        "SELECT /* ' */ reflect('java.lang.Math', 'abs', -1) /* ' */",
        "SELECT /* /* */ ' */ java_method('java.lang.Math','abs',-7) AS x /* ' */",
        "SELECT /* /* */ ' */ reflect('java.lang.Math','abs',-7) AS x /* ' */",
        "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.Math', 'abs', -1))",
        "SELECT (SELECT max(r) FROM (SELECT reflect('java.lang.Math', 'abs', -1) AS r))",
        "SELECT transform(array(1), x -> reflect('java.lang.Math', 'abs', x))",
        "SELECT * FROM customers ORDER BY reflect('java.lang.Math', 'abs', -1)",
        "WITH c AS (SELECT reflect('java.lang.Math', 'abs', -1) AS r) SELECT * FROM c",
    ],
)
def test_anything_but_a_select_is_refused(spark, statement):
    with pytest.raises(ValueError, match="only"):
        guarded_sql(spark, statement)


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT * FROM parquet.`{}/events.parquet`",
        "SELECT (SELECT count(*) FROM parquet.`{}/events.parquet`)",
        "SELECT * FROM customers WHERE EXISTS (SELECT 1 FROM parquet.`{}/events.parquet`)",
        "WITH f AS (SELECT * FROM parquet.`{}/events.parquet`) SELECT count(*) FROM f",
    ],
)
def test_reading_files_by_path_is_refused(spark, small, statement):
    with pytest.raises(ValueError, match="only registered views"):
        guarded_sql(spark, statement.format(small))


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT * FROM {}",
        "SELECT (SELECT count(*) FROM {})",
        "SELECT * FROM customers c JOIN {} f ON true",
        "SELECT * FROM customers WHERE customer_id IN (SELECT 1 FROM {})",
        "WITH f AS (SELECT * FROM {}) SELECT count(*) FROM f",
        "WITH f AS (WITH g AS (SELECT * FROM {}) SELECT * FROM g) SELECT * FROM f",
        "SELECT * FROM customers, LATERAL (SELECT * FROM {})",
        "SELECT * FROM customers UNION ALL SELECT * FROM {}",
    ],
)
def test_refusal_does_not_tell_what_exists(spark, tmp_path, statement):
    """The same error for a file that is there, one that is not and one that can't be read; no job."""
    (tmp_path / "there.parquet").write_text("not parquet at all")
    tracker = spark.sparkContext.statusTracker()
    seen = set()
    for name in ("there", "missing"):
        relation = f"parquet.`{tmp_path}/{name}.parquet`"
        spark.sparkContext.setJobGroup(f"guard {name}", "")
        with pytest.raises(ValueError, match="only registered views") as refused:
            guarded_sql(spark, statement.format(relation))
        seen.add(str(refused.value).replace(name, "x"))
        assert not tracker.getJobIdsForGroup(f"guard {name}")
    assert len(seen) == 1
    for name in ("no_such_table", "default.no_such_table", "IDENTIFIER('parquet.`/tmp/x`')"):
        with pytest.raises(ValueError, match="only registered views"):
            guarded_sql(spark, statement.format(name))


def test_views_and_expressions_in_any_spelling_are_read(spark):
    assert guarded_sql(spark, "SELECT * FROM `CUSTOMERS` LIMIT 3").count() == 3
    nested = "WITH A AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM B WHERE x IN (SELECT x FROM a)"
    assert guarded_sql(spark, nested).count() == 1
    lateral = "SELECT * FROM notes n, LATERAL (SELECT count(*) AS n FROM customers c WHERE c.customer_id > n.id)"
    assert guarded_sql(spark, lateral).count() == 1


def test_queries_without_a_view_are_allowed(spark):
    assert guarded_sql(spark, "SELECT sum(id) AS s FROM range(5)").first().s == 10
    assert guarded_sql(spark, "SELECT * FROM VALUES (1), (2) AS t(x)").count() == 2
    assert guarded_sql(spark, "SELECT reflected FROM (SELECT 'reflect(x)' AS reflected) -- reflect(").count() == 1


def test_harmless_words_are_allowed(spark):
    df = guarded_sql(spark, "SELECT updated_at, note FROM notes WHERE note = 'Drop' AND 'reflect(' <> ''")
    assert df.count() == 1


def test_unknown_column_is_a_runtime_error(spark):
    with pytest.raises(RuntimeError, match="query failed"):
        guarded_sql(spark, "SELECT nope FROM customers")


def test_row_limits(spark):
    everything = "SELECT * FROM customers"
    assert guarded_sql(spark, everything).count() == 100
    assert guarded_sql(spark, everything + " ; \n", row_limit=7).count() == 7
    assert guarded_sql(spark, everything, row_limit=None).count() == 250
    assert guarded_sql(spark, everything + " LIMIT 5", row_limit=10).count() == 5
    assert guarded_sql(spark, everything + " LIMIT 200", row_limit=10).count() == 10
    assert guarded_sql(spark, everything + " LIMIT 200", row_limit=10, strict=False).count() == 200
    inner = "SELECT credit_limit FROM (SELECT * FROM customers LIMIT 200) -- LIMIT 3"
    assert guarded_sql(spark, inner, row_limit=10, strict=False).count() == 10


@pytest.mark.parametrize(
    ("statement", "rows"),
    [
        ("SELECT * FROM customers LIMIT 30", 30),
        ("SELECT * FROM customers ORDER BY 1 LIMIT 30 OFFSET 2", 30),
        ("WITH c AS (SELECT * FROM customers) SELECT * FROM c LIMIT 30", 30),
        ("SELECT credit_limit FROM customers", 10),
        ("SELECT * FROM (SELECT * FROM customers LIMIT 30)", 10),
        ("SELECT customer_id, 'limit 5' FROM customers /* LIMIT 30 */", 10),
        ("SELECT * FROM customers /* /* */ LIMIT 30 */", 10),
        ("SELECT * FROM customers LIMIT ALL", 10),
    ],
)
def test_own_limit_detection(spark, statement, rows):
    assert guarded_sql(spark, statement, row_limit=10, strict=False).count() == rows


def test_order_is_kept_and_envelope(spark):
    df = guarded_sql(spark, "SELECT customer_id FROM customers ORDER BY customer_id DESC LIMIT 3")
    assert preview(df) == {"columns": ["customer_id"], "rows": [[249], [248], [247]], "row_count": 3}


def test_duplicate_names(spark):
    df = guarded_sql(spark, "SELECT * FROM customers a JOIN customers b ON a.customer_id = b.customer_id")
    assert df.columns[3:] == ["customer_id_1", "segment_1", "credit_limit_1"]
    assert dedup_names(["a", "a_1", "a", "A"]) == ["a", "a_1", "a_2", "A_3"]
    assert df.filter("customer_id = 3").select("segment_1").first()[0] == "residential"
