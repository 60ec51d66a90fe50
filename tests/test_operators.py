import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkferry.operators import coerce, merge, paging, validate


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_keeps_updates_and_adds(spark):
    dst = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 9)], "k int, t string, x int")
    src = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, t string")
    assert rows(merge.upsert(dst, src, ["k"])) == rows(spark.createDataFrame([(1, "a", 1), (2, "B", 2), (3, "C", None), (None, "N", 9)], dst.schema))


def test_upsert_without_key_appends_and_with_keys_only_ignores(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert merge.upsert(a, a, []).count() == 4
    assert rows(merge.upsert(a, spark.createDataFrame([(1, 2), (3, 3)], "a int, b int"), ["a", "b"])) == [(1, 1), (1, 2), (3, 3)]


def test_upsert_refuses_unknown_columns(spark):
    a = spark.createDataFrame([(1, 1)], "a int, b int")
    with pytest.raises(ValueError):
        merge.upsert(a, a.withColumn("c", F.lit(1)), ["a"])
    with pytest.raises(ValueError):
        merge.upsert(a, a, ["z"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 9), st.integers(0, 3)), st.dictionaries(st.integers(0, 9), st.integers(0, 3)))
def test_upsert_twice_is_upsert_once(spark, a, b):
    dst, src = (spark.createDataFrame(list(x.items()), "k int, v int") for x in (a, b))
    once = merge.upsert(dst, src, ["k"])
    assert rows(once) == rows(merge.upsert(once, src, ["k"])) == rows(spark.createDataFrame(list((a | b).items()), "k int, v int"))


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (None, 1, "n"), (None, 0, "m")], "k int, v int, t string")
    assert rows(merge.latest(df, ["k"], [F.col("v")])) == rows(spark.createDataFrame([(1, 2, "y"), (None, 1, "n")], df.schema))


@pytest.mark.parametrize("n,size", [(0, 10), (7, 10), (30, 10), (25, 10)])
def test_pages_are_the_table(spark, n, size):
    df = spark.createDataFrame([(i % 5, i // 5, i) for i in range(n)], "b int, a int, v int")
    got = list(paging.pages(df, ["b", "a"], size))
    assert len(got) == -(-n // size)
    assert [r.v for p in got for r in sorted(p.collect(), key=lambda r: (r.a, r.b))] == list(range(n))
    counted = paging.numbered(df, ["b", "a"], size, 3)
    assert sorted((r.page_id, r.v) for r in counted.collect()) == [(i // size, i) for i in range(n)]


def test_keyset_needs_a_value_for_each_column():
    with pytest.raises(ValueError):
        paging.after(["a", "b"], [1])
    with pytest.raises(ValueError):
        paging.page_order([])


def test_keyset_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    plan = spark.read.parquet(path).where(paging.after(["id"], [50]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,50)" in plan


def test_coerce_booleans(spark):
    df = spark.createDataFrame([(1, 1.0000001, " YES ", True), (5, 0.9, "maybe", False), (0, 1.0, "off", None)], "i int, f double, t string, b boolean")
    got = coerce.coerce(df, dict.fromkeys("iftb", "boolean"), "postgres").collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (False, False, None, False), (False, True, False, None)]
    assert [r.t for r in coerce.unfit(df, {"t": "bool"}, "postgres").collect()] == ["maybe"]
    assert [r.b for r in coerce.coerce(df, {"b": "tinyint(1)"}, "mysql").collect()] == [1, 0, None]
    assert coerce.coerce(df, {"i": "boolean"}, "sqlite").schema["i"].dataType.typeName() == "integer"


def test_constraints(spark):
    child = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id int, p int")
    parent = spark.createDataFrame([(10,), (11,)], "id int")
    assert [r.id for r in validate.orphans(child, ["p"], parent, ["id"]).collect()] == [2]
    assert [tuple(r) for r in validate.nulls(child, ["id", "p"]).collect()] == [("p", 1)]
    twice = spark.createDataFrame([(1, None), (1, None), (2, 2), (2, 2)], "a int, b int")
    assert validate.duplicates(twice, ["a", "b"]).count() == 2
    assert validate.duplicates(twice, ["a", "b"], nulls_match=False).count() == 1
    assert [r.id for r in validate.violations(child, "p < 50").collect()] == [2]


def test_upsert_by_the_newest_row(spark):
    dst = spark.createDataFrame([(1, 0, "old"), (2, 0, "old")], "k int, at int, v string")
    src = spark.createDataFrame([(1, 2, "new"), (1, 1, "middle"), (3, 1, "x")], "k int, at int, v string")
    out = merge.upsert(dst, src, ["k"], [F.col("at")])
    assert sorted(map(tuple, out.collect())) == [(1, 2, "new"), (2, 0, "old"), (3, 1, "x")]
