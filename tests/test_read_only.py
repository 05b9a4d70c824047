import time

import pytest
from loomgraph.sources import store


@pytest.fixture(scope="module")
def sql(spark):
    rows = spark.createDataFrame([(i, f"n{i % 7}", [i, i + 1]) for i in range(300)], "id long, name string, xs array<long>")
    spark.range(3).createOrReplaceTempView("another")
    return store.ReadOnlySql(spark, {"things": rows, "Others": rows.limit(5)}, deadline=60)


@pytest.mark.parametrize(
    "q",
    [
        "select count(*) from things",
        "with a as (select id from things where name in (select name from others)) select a.id from a join things t on a.id = t.id where exists (select 1 from others o where o.id = a.id)",
        "select name, collect_list(id), max(struct(id, name)), row_number() over (order by name) from things group by name",
        "select x, transform(xs, y -> y + 1) from things lateral view explode(xs) as x",
        "select * from range(3) union all select 7 union all select * from values (1), (2) as v(a)",
        "select (select max(id) from things), try_divide(1, 0), nvl(null, 2), date_add(current_date(), 1), like('a', 'b')",
        "select 'drop table things; delete' as text -- insert",
        "with recursive w(n) as (select 1 union all select n + 1 from w where n < 5) select sum(n) from w",
    ],
)
def test_reading_statements_run(sql, q):
    sql.run(q)


@pytest.mark.parametrize(
    ("q", "why"),
    [
        ("select java_method('java.lang.System', 'getProperty', 'user.home')", "CallMethodViaReflection"),
        ("select reflect('java.util.UUID', 'randomUUID')", "CallMethodViaReflection"),
        ("select try_reflect('java.lang.System', 'getProperty', 'user.home')", "CallMethodViaReflection"),
        ("select id from things where id = (select length(java_method('java.util.UUID', 'randomUUID')) from others limit 1)", "CallMethodViaReflection"),
        ("select id from things order by java_method('java.util.UUID', 'randomUUID')", "CallMethodViaReflection"),
        ("with a as (select reflect('java.util.UUID', 'randomUUID') u) select u from a", "CallMethodViaReflection"),
        ("select input_file_name() from things", "InputFileName"),
        ("select * from another", "named tables"),
        ("select id from things where id in (select id from another)", "named tables"),
        ("drop view things", "reading"),
        ("create table t as select 1", "reading"),
        ("insert into things select * from things", "reading"),
        ("set spark.sql.shuffle.partitions = 1", "reading"),
        ("cache table things", "reading"),
        ("add jar '/tmp/x.jar'", "reading"),
    ],
)
def test_others_are_refused(sql, q, why):
    with pytest.raises(ValueError, match=why):
        sql.run(q)


def test_paths_are_no_tables(sql, data):
    for q in (f"select * from parquet.`{data}/region.parquet`", f"select 1 where 1 in (select r_regionkey from parquet.`{data}/region.parquet`)", "select * from text.`/etc/passwd`"):
        with pytest.raises(ValueError, match="named tables"):
            sql.run(q)


def test_functions_of_users_are_refused(spark, sql):
    spark.udf.register("mine", lambda x: x, "long")
    with pytest.raises(ValueError, match="PythonUDF"):
        sql.run("select mine(id) from things")


def test_rows_are_capped(sql):
    rows, more = sql.run("select id from things order by id")
    assert more and [r.id for r in rows.collect()] == list(range(100))
    rows, more = sql.run("select id from things where id < 4", most=4)
    assert not more and rows.count() == 4


def test_slow_queries_are_stopped(spark, sql):
    quick = store.ReadOnlySql(spark, {"things": spark.range(10)}, deadline=2)
    began = time.monotonic()
    with pytest.raises(TimeoutError, match="2 seconds"):
        quick.run("select count(*) from range(1000000000000) where sqrt(id) < 0 or id % 7 = 8")
    assert time.monotonic() - began < 30
    assert quick.run("select count(*) n from things")[0].first().n == 10
