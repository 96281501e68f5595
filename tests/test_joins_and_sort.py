"""Joins and sorting."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weftline.operators.joins import join
from weftline.operators.sorting import is_sorted, sort


def players(spark):
    return spark.createDataFrame([(1, "ann"), (2, "bob"), (None, "nil"), (5, "eve")], "id long, name string")


def scores(spark):
    return spark.createDataFrame([(1, 10), (1, 20), (None, 30), (9, 40)], "id long, score long")


def test_inner_and_nulls(spark, rows):
    assert rows(join(players(spark), scores(spark), ["id"])) == [(None, "nil", 30), (1, "ann", 10), (1, "ann", 20)]


def test_many_to_many(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "id long, a string")
    assert rows(join(a, scores(spark), ["id"])) == [(1, "x", 10), (1, "x", 20), (1, "y", 10), (1, "y", 20)]


def test_left_right_outer(spark, rows):
    assert rows(join(players(spark), scores(spark), ["id"], "left")) == [(None, "nil", 30), (1, "ann", 10), (1, "ann", 20), (2, "bob", None), (5, "eve", None)]
    assert rows(join(players(spark), scores(spark), ["id"], "right")) == [(None, "nil", 30), (1, "ann", 10), (1, "ann", 20), (9, None, 40)]
    assert rows(join(players(spark), scores(spark), ["id"], "outer")) == [(None, "nil", 30), (1, "ann", 10), (1, "ann", 20), (2, "bob", None), (5, "eve", None), (9, None, 40)]


def test_cross(spark, rows):
    a, b = spark.createDataFrame([("p",), ("q",)], "a string"), spark.createDataFrame([(1,), (2,)], "b long")
    assert rows(join(a, b, [])) == [("p", 1), ("p", 2), ("q", 1), ("q", 2)]
    with pytest.raises(ValueError):
        join(a, b, [], "left")


def test_dealt_join_spreads_one_key_over_tasks(spark, rows):
    """Few keys with many rows on both sides give more tasks than keys, and the same rows."""
    a = spark.range(40).selectExpr("if(id % 8 = 0, null, id % 2) as k", "id as x", "'left' as c")
    b = spark.range(300).selectExpr("if(id % 9 = 0, null, id % 3) as k", "id as y", "'right' as c")
    got = join(a, b, ["k"], deal=16)
    assert rows(got) == rows(join(a, b, ["k"]))
    tasks = got.filter("k = 1").groupBy(F.spark_partition_id().alias("p")).count()
    assert tasks.count() > 6
    with pytest.raises(ValueError):
        join(a, b, ["k"], "left", deal=16)


def test_inner_suffixes_has_more_tasks_than_input_files(spark):
    from weftline import catalog

    got = catalog.QUERIES["inner_suffixes"](spark, "/root/testdata/sf0.01").select("nation", F.spark_partition_id().alias("p")).distinct().groupBy("nation").count()
    assert got.agg(F.min("count")).first()[0] > 4


def test_suffixes_also_without_a_match(spark, rows):
    a = spark.createDataFrame([(1, 5), (2, 6)], "id long, v long")
    b = spark.createDataFrame([(1, 7), (3, 8)], "id long, v long")
    got = join(a, b, ["id"], suffixes=("_a", "_b"))
    assert got.columns == ["id", "v_a", "v_b"] and rows(got) == [(1, 5, 7)]
    assert rows(join(a, b, ["id"], "left")) == [(1, 5, 7), (2, 6, None)]
    assert rows(join(a, b, ["id"], "right")) == [(1, 5, 7), (3, None, 8)]


def test_outer_takes_the_right_value_where_it_matches(spark, rows):
    a = spark.createDataFrame([(1, 5), (2, 6), (4, 9)], "id long, v long")
    b = spark.createDataFrame([(1, 7), (3, 8), (4, None)], "id long, v long")
    got = join(a, b, ["id"], "outer")
    assert got.columns == ["id", "v"] and rows(got) == [(1, 7), (2, 6), (3, 8), (4, None)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_empty_sides(spark, how):
    a, b = players(spark), scores(spark)
    assert join(a.filter("false"), b, ["id"], how).count() == (4 if how in ("right", "outer") else 0)
    assert join(a, b.filter("false"), ["id"], how).count() == (4 if how in ("left", "outer") else 0)


def test_column_names_with_dots(spark, rows):
    a = spark.createDataFrame([(1, 2)], "id long, `x.y` long")
    assert join(a, scores(spark), ["id"]).columns == ["id", "x.y", "score"]


def test_errors(spark):
    with pytest.raises(AnalysisException):
        join(players(spark), scores(spark), ["nothing"])
    with pytest.raises(ValueError):
        join(players(spark), scores(spark), ["id"], "semi")


def test_unique_keys_at_volume(spark):
    a = spark.range(100_500).select(F.col("id").alias("key"), F.col("id").alias("value"))
    plan = join(a, a, ["key"])
    assert plan.count() == 100_500


def test_nullable_keys_are_still_an_equi_join(spark):
    plan = join(players(spark).repartition(2), scores(spark).repartition(2), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_sort(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("Z", 3), ("é", 4)], "k string, v long")
    assert [r["k"] for r in df.transform(sort(["k"])).collect()] == ["Z", "a", "b", "é"]
    assert is_sorted(df.transform(sort(["v"])), ["v"]) and not is_sorted(df, ["k"])
    with pytest.raises(ValueError):
        sort([])
