"""Ready-made pipelines, pipelines over named sources, streaming and time functions."""

import math
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline import catalog
from weftline.functions import geo
from weftline.functions.time import hours_between, parse_time, weekday
from weftline.operators import aggregates, transforms
from weftline.plans import roads, texts
from weftline.plans.pipeline import Pipeline
from weftline.sources import io
from weftline.streaming.text import word_count as stream_count

DOCS = [(1, "Night, night: the MOON"), (2, "moon? sun sun"), (3, "... !!!"), (4, "the sun")]


def docs(spark, values=DOCS):
    return spark.createDataFrame(values, "doc_id long, text string")


def test_word_count_is_in_order(spark):
    got = [tuple(r) for r in texts.word_count(docs(spark)).collect()]
    assert got == [("moon", 2), ("night", 2), ("the", 2), ("sun", 3)]


def test_tf_idf(spark):
    got = [tuple(r) for r in texts.inverted_index(docs(spark)).collect()]
    r = lambda x: round(x, 9)
    # the third document has no words, yet counts as one of four
    assert got == [
        (2, "moon", r(math.log(2) / 3)),
        (1, "moon", r(math.log(2) / 4)),
        (1, "night", r(0.5 * math.log(4))),
        (2, "sun", r(2 / 3 * math.log(2))),
        (4, "sun", r(0.5 * math.log(2))),
        (4, "the", r(0.5 * math.log(2))),
        (1, "the", r(0.25 * math.log(2))),
    ]


def test_tf_idf_of_a_word_in_all_documents_is_zero_and_top_is_cut(spark):
    got = texts.inverted_index(spark.createDataFrame([(f"d{i}", "same") for i in range(5)], "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["tf_idf"]) for r in got] == [("d0", 0.0), ("d1", 0.0), ("d2", 0.0)]


def test_pmi_filters_before_it_counts(spark):
    values = [(1, "hello hello hello world world tiny tiny"), (2, "hello hello hello hello world"), (3, "short text")]
    got = [tuple(r) for r in texts.pmi(docs(spark, values)).collect()]
    r = lambda x: round(math.log(x), 9)
    # (1, hello) 3, (1, world) 2, (2, hello) 4; of 9 words hello has 7 and world 2
    assert got == [(1, "world", r((2 / 5) / (2 / 9))), (1, "hello", r((3 / 5) / (7 / 9))), (2, "hello", r(1 / (7 / 9)))]


def test_same_pipeline_many_inputs(spark, rows):
    source = Pipeline.source("docs")
    words = source.then(transforms.lower_case("text"), transforms.split("text"))
    counts = words.then(aggregates.count_by(["text"], "n"))
    longest = counts.then(aggregates.top_n([], "n", 1, ["text"]))
    for k in (1, 2):
        df = docs(spark, [(i, f"A b{'  a' * k}") for i in range(k)])
        assert rows(counts.run(docs=df)) == [("a", k * (k + 1)), ("b", k)]
        assert rows(longest.run(docs=df)) == [("a", k * (k + 1))]
    with pytest.raises(KeyError):
        counts.run(other=docs(spark))


def test_join_and_sort_of_pipelines(spark):
    a, b = Pipeline.source("a"), Pipeline.source("b")
    both = a.join(b, ["doc_id"]).sort(["doc_id"])
    got = both.run(a=docs(spark), b=docs(spark).select("doc_id", F.length("text").alias("n"))).collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3, 4] and both.sources == {"a", "b"}


def test_times(spark):
    good = {"20171020T112237.427000": "2017-10-20 11:22:37.427", "20171020T112237.4": "2017-10-20 11:22:37.4", "20240229T000000.000001": "2024-02-29 00:00:00.000001"}
    bad = ["", "garbage", "20171020T112237", "20171020T112237.1234567", "20230229T000000.0", None]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "t string").select("t", parse_time(F.col("t")).cast("timestamp_ntz").alias("v"))
    got = {r["t"]: r["v"] for r in df.collect()}
    assert all(got[k] == datetime.fromisoformat(v) for k, v in good.items()) and all(got[x] is None for x in bad)


def test_weekday_and_hours(spark):
    df = spark.sql("select timestamp'2017-10-20 11:00:00' a, timestamp'2017-10-20 12:30:00' b, cast(null as timestamp) c")
    row = df.select(weekday(F.col("a")), hours_between(F.col("a"), F.col("b")), hours_between(F.col("b"), F.col("a")), hours_between(F.col("a"), F.col("c"))).first()
    assert tuple(row) == ("Fri", 1.5, 0.0, 0.0)


def test_haversine_and_ratio(spark):
    one = spark.range(1)
    quarter = geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0))
    row = one.select(quarter, geo.guarded_ratio(F.lit(1.0), F.lit(0)), geo.guarded_ratio(F.lit(1.0), F.lit(4))).first()
    assert math.isclose(row[0], geo.EARTH_RADIUS_KM * math.pi / 2, rel_tol=1e-12) and row[1] == 0.0 and row[2] == 0.25


TIMES = "edge_id long, enter_time string, leave_time string"


def trips(spark, values):
    return spark.createDataFrame(values, TIMES)


def test_road_speed_by_distance(spark):
    times = trips(spark, [(1, "20240105T100000.0", "20240105T110000.0"), (1, "20240105T103000.0", "20240105T123000.0"), (1, "20240106T235959.999999", "20240107T005959.999999")])
    edges = spark.createDataFrame([(1, [0.0, 0.0], [0.0, 1.0])], "edge_id long, start array<double>, end array<double>")
    got = {(r[0], r[1]): r[2] for r in roads.road_speed(times, edges).collect()}
    km = geo.EARTH_RADIUS_KM * math.pi / 180
    assert got.keys() == {("Fri", 10), ("Sat", 23)}
    assert math.isclose(got["Fri", 10], (km + km / 2) / 2, rel_tol=1e-9) and math.isclose(got["Sat", 23], km, rel_tol=1e-9)


@pytest.mark.parametrize(("length", "km"), [("1000", 1.0), ("120", 0.12), ("100", 100.0), ("x", None)])
def test_road_speed_by_given_length(spark, length, km):
    times = trips(spark, [(7, "20240105T100000.0", "20240105T110000.0")])
    edges = spark.createDataFrame([(7, [0.0, 0.0], [0.0, 0.0], length)], "edge_id long, start array<double>, end array<double>, length string")
    got = [r["speed"] for r in roads.road_speed(times, edges).collect()]
    assert got == ([] if km is None else [km])


def test_road_speed_leaves_out_bad_rows_and_renames(spark):
    times = trips(spark, [(1, "", "20240105T110000.0"), (1, "20240105T110000.0", "20240105T100000.0"), (2, "20240105T100000.0", "20240105T110000.0")])
    edges = spark.createDataFrame([(1, [0.0, 0.0], [0.0, 1.0])], "edge_id long, start array<double>, end array<double>")
    assert roads.road_speed(times, edges).count() == 0
    names = roads.Names(speed="v", weekday="w", hour="h")
    good = trips(spark, [(1, "20240105T100000.0", "20240105T110000.0")])
    assert roads.road_speed(good, edges, names).columns == ["w", "h", "v"]


def test_streaming_word_count(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Sun, moon\nsun\n")
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "text")
    q = stream_count(stream).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counted")) == [("moon", 1), ("sun", 2)]


@pytest.mark.parametrize("plan", [texts.inverted_index, texts.pmi])
def test_texts_are_cut_into_words_once(spark, tmp_path, plan):
    docs(spark).write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = plan(spark.read.parquet(str(tmp_path / "docs")))
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert final.count("Generate explode") == 1 and "ReusedExchange" in final


def shuffled_for(df):
    """Keys of the shuffles that operators asked for."""
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*?), \d+\), ENSURE_REQUIREMENTS", df._jdf.queryExecution().executedPlan().toString())]


@pytest.mark.parametrize("plan", [texts.inverted_index, texts.pmi])
def test_words_of_documents_are_counted_without_a_shuffle(spark, plan):
    out = plan(docs(spark))
    assert "_doc, _word" not in shuffled_for(out)


def test_pmi_adds_up_rows_of_one_document(spark):
    parts = [(1, "hello hello"), (None, "world"), (1, "hello world"), (2, "hello hello hello hello world"), (None, "world"), (1, "world")]
    whole = [(1, "hello hello hello world world"), (None, "world world"), (2, "hello hello hello hello world")]
    assert texts.pmi(docs(spark, parts)).collect() == texts.pmi(docs(spark, whole)).collect() != []


def test_tf_idf_adds_up_rows_of_one_document(spark):
    got = [tuple(r) for r in texts.inverted_index(docs(spark, [(1, "sun"), (1, "sun moon"), (2, None), (3, "moon")])).collect()]
    # four rows count as documents, the two of one id as one document of each of its words
    assert got == [(3, "moon", round(math.log(2), 9)), (1, "moon", round(math.log(2) / 3, 9)), (1, "sun", round(2 / 3 * math.log(4), 9))]


def test_tasks_of_dealt_rows_grow_with_the_table(spark, tmp_path):
    spark.range(200_000).selectExpr("id % 1000 as k", "id as x").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    n, twice = io.parts(table, 0.05), io.parts(table, 0.025)
    assert n > spark.sparkContext.defaultParallelism and abs(twice - 2 * n) <= 1
    out = io.deal(table, ["k"], 0.05).groupBy("k", "x").count()
    assert out.rdd.getNumPartitions() == n  # neither shuffled again nor merged
    assert io.parts(docs(spark)) == int(spark.conf.get("spark.sql.shuffle.partitions"))  # size unknown


@pytest.mark.parametrize("query", ["pipeline_document_frequency", "distinct_words_per_document"])
def test_words_are_made_distinct_without_a_shuffle(spark, query):
    keys = shuffled_for(catalog.QUERIES[query](spark, "/root/testdata/sf0.001"))
    assert not [k for k in keys if "doc_id" in k]
