"""The read-only SQL gate."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from waybill.plans.sql_view import AUTO_ANALYSIS, RefusedQuery, check, query


@pytest.fixture
def facts(spark):
    return spark.range(3).select(
        F.col("id").alias("order_id"), F.lit("2018-01-01").alias("created_at"),
        F.lit("card").alias("payment_type"), F.lit(2.5).alias("gross_revenue"), F.lit(True).alias("on_time"),
        F.lit("SP").alias("customer_state"), F.timestamp_seconds(F.lit(1514764800)).alias("order_purchase_timestamp"),
    )


@pytest.mark.parametrize("sql", [
    "SELECT created_at FROM facts",
    "  select count(*) from facts ;  ",
    "SELECT 'drop; --' AS t FROM facts",
    "SELECT f.order_id FROM facts f JOIN (SELECT max(order_id) AS m FROM facts) g ON f.order_id = g.m",
    "SELECT order_id FROM facts UNION ALL SELECT order_id FROM facts",
    "SELECT order_id FROM `facts` `default`",
    "SELECT spark_catalog.order_id FROM FACTS AS spark_catalog",
    "SELECT * FROM (TABLE facts)",
    "SELECT * FROM (WITH x AS (SELECT order_id FROM facts), y AS (SELECT * FROM x) SELECT * FROM y JOIN x USING (order_id))",
    "SELECT f.order_id, l.n FROM facts f, LATERAL (SELECT count(*) AS n FROM facts g WHERE g.order_id <= f.order_id) l",
    "SELECT order_id, e FROM facts LATERAL VIEW explode(array(1, 2)) t AS e",
    "SELECT * FROM IDENTIFIER('fa' || 'cts')",
    "SELECT id, v.a FROM range(3), (VALUES (1), (2)) AS v(a)",
    "SELECT from_json('{\"a\": 1}', 'a INT').a AS a, get_json_object('{}', '$.b') AS b, md5('x') AS c",
    "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY order_id) AS m, approx_count_distinct(order_id) AS d FROM facts",
    "SELECT order_id, sum(gross_revenue) OVER (PARTITION BY payment_type ORDER BY order_id) AS s FROM facts",
    "SELECT order_id AS reflect FROM facts WHERE EXISTS (SELECT 1 FROM facts g WHERE g.order_id = facts.order_id)",
    "SELECT transform(array(order_id), x -> x + 1) AS t, aggregate(array(1, 2), 0, (a, b) -> a + b) AS u FROM facts",
])
def test_accepted(facts, sql):
    assert query(sql, facts=facts).count() > 0


@pytest.mark.parametrize("sql", [
    "", "WITH x AS (SELECT 1) SELECT * FROM x", "DROP TABLE facts", "SELECT 1; DROP TABLE facts",
    "SELECT * FROM facts; SELECT 1", "insert into facts select 1", "SELECT 1 /* */ ; delete from facts",
])
def test_refused_by_its_words(sql):
    with pytest.raises(RefusedQuery):
        check(sql)


@pytest.mark.parametrize("call", [
    "reflect('java.lang.System', 'getProperty', 'user.name')", "java_method('java.lang.System', 'getProperty', 'user.name')",
    "try_reflect('java.lang.System', 'getProperty', 'user.name')", "input_file_name()", "upper(input_file_name())",
    "(SELECT max(java_method('java.lang.System', 'getProperty', 'user.name')) FROM facts)",
])
def test_functions_that_reach_outside_are_refused(facts, call):
    for sql in (f"SELECT {call} AS x FROM facts", f"SELECT 1 AS a FROM facts ORDER BY {call}", f"SELECT 1 AS a FROM facts WHERE {call} <> ''"):
        with pytest.raises((RefusedQuery, AnalysisException)):
            query(sql, facts=facts)


def test_functions_of_the_session_are_refused(spark, facts):
    spark.udf.register("leak", lambda x: x, "long")
    with pytest.raises((RefusedQuery, AnalysisException)):
        query("SELECT leak(order_id) AS x FROM facts", facts=facts)


def test_a_stored_table_or_view_named_like_a_view(spark, facts):
    spark.range(1).write.mode("overwrite").saveAsTable("facts")
    spark.sql("CREATE OR REPLACE VIEW stored_view AS SELECT * FROM range(2)")
    try:
        assert query("SELECT * FROM facts", facts=facts).count() == 3
        for sql in ("SELECT * FROM default.facts", "SELECT * FROM spark_catalog.default.facts", "SELECT * FROM stored_view",
                    "SELECT (SELECT max(id) FROM default.facts) AS m", "SELECT * FROM facts WHERE order_id IN (SELECT id FROM stored_view)",
                    "SELECT * FROM (WITH facts AS (SELECT * FROM default.facts) SELECT * FROM facts)",
                    "SELECT * FROM facts f, LATERAL (SELECT * FROM default.facts g WHERE g.id = f.order_id) l"):
            with pytest.raises(RefusedQuery):
                query(sql, facts=facts)
    finally:
        spark.sql("DROP VIEW stored_view")
        spark.sql("DROP TABLE facts")


def test_other_data_is_out_of_reach(spark, facts):
    spark.range(1).createOrReplaceTempView("secret")
    spark.range(1).write.mode("overwrite").saveAsTable("waybill_secret")
    try:
        for sql in (
            "SELECT * FROM secret", "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
            "SELECT * FROM waybill_secret", "SELECT * FROM facts, default.waybill_secret",
            "SELECT * FROM `spark_catalog`.default.waybill_secret", "SELECT * FROM facts, waybill_secret",
            "SELECT * FROM (waybill_secret)", "SELECT * FROM (TABLE waybill_secret)",
            """SELECT "'" AS a FROM waybill_secret WHERE "'" = "'" """,
            "SELECT /* ' */ 1 FROM waybill_secret /* ' */",
            "SELECT 1 AS `a'` FROM waybill_secret ORDER BY `a'`",
            r"SELECT r'\' AS a FROM waybill_secret WHERE r'\' = 'x'",
            "SELECT * FROM /* x */ waybill_secret", "SELECT * FROM facts WHERE 1 IN (SELECT id FROM `waybill_secret`)",
            "SELECT * FROM IDENTIFIER('waybill' || '_secret')",
        ):
            with pytest.raises((RefusedQuery, AnalysisException)):
                query(sql, facts=facts).collect()
    finally:
        spark.sql("DROP TABLE waybill_secret")
    assert not any(t.name.startswith("facts_") for t in spark.catalog.listTables("global_temp"))


def test_strftime_is_understood(facts):
    row = query("SELECT strftime(order_purchase_timestamp, '%Y-%m-%d %H') AS t FROM facts", facts=facts).first()
    assert row.t == "2018-01-01 00"


def test_cached_facts_stay_cached(facts):
    facts.cache().count()
    assert query("SELECT count(*) AS n FROM facts", facts=facts).first().n == 3
    assert facts.is_cached and facts.storageLevel.useMemory
    facts.unpersist()


def test_auto_analysis_runs(facts):
    for sql in AUTO_ANALYSIS.values():
        query(sql, facts=facts).collect()


def test_strftime_knows_its_letters_and_refuses_others(spark):
    facts = spark.sql("SELECT TIMESTAMP '2018-03-05 14:07:09.123456' AS ts")
    fmt = "%d.%m.%y %H:%M:%S %b %B %a %A %j %p %I year %Y %% %u %w %F %T it's"
    got = query(f"SELECT strftime(ts, \"{fmt}\") AS t FROM facts", facts=facts).first().t
    moment = datetime(2018, 3, 5, 14, 7, 9)
    assert got == moment.strftime(fmt.replace("%u", "1").replace("%w", "1"))
    with pytest.raises(Exception, match="%Q"):
        query("SELECT strftime(ts, '%Q') AS t FROM facts", facts=facts).collect()
