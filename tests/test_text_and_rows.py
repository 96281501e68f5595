"""Row operators and text functions."""

import math
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import transforms as t

EVERY_SPACE = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def frame(spark, values, schema="id long, text string"):
    return spark.createDataFrame(values, schema)


def test_identity(spark, rows):
    assert rows(frame(spark, [(1, "a"), (2, None)]).transform(t.identity())) == [(1, "a"), (2, None)]


def test_strip_punctuation_is_ascii_only(spark, rows):
    got = frame(spark, [(1, "Hi, you! «ok» — [x]~"), (2, None), (3, "")]).transform(t.strip_punctuation("text"))
    assert rows(got) == [(1, "Hi you «ok» — x"), (2, None), (3, "")]


def test_lower_case_is_unicode(spark, rows):
    values = ["ÀÉ", "ẞ", "İ", "ΑΣ", "МИР"]
    got = frame(spark, list(enumerate(values))).transform(t.lower_case("text"))
    assert rows(got) == [(i, v.lower()) for i, v in enumerate(values)]


def test_split_at_every_kind_of_white_space(spark, rows):
    assert len(EVERY_SPACE) == 29
    got = frame(spark, [(ord(c), f"{c}a{c}{c}b{c}") for c in EVERY_SPACE]).transform(t.split("text"))
    assert rows(got) == sorted((ord(c), x) for c in EVERY_SPACE for x in "ab")


def test_split_without_words_gives_no_row(spark, rows):
    assert rows(frame(spark, [(1, ""), (2, " \t\n"), (3, "x")]).transform(t.split("text"))) == [(3, "x")]


@pytest.mark.parametrize("separator", [";", ".", "|", "ab", "\\", "^", "$1", "\t", " "])
def test_split_at_a_literal(spark, separator):
    texts = ["", separator, f"x{separator}y", f"{separator}x{separator}{separator}", "plain"]
    got = frame(spark, list(enumerate(texts))).transform(t.split("text", separator)).collect()
    for i, value in enumerate(texts):
        assert [r["text"] for r in got if r["id"] == i] == value.split(separator)


def test_split_into_characters(spark, rows):
    assert rows(frame(spark, [(1, "añ"), (2, "")]).transform(t.split("text", ""))) == [(1, "a"), (1, "ñ"), (2, "")]


def test_split_passes_nulls_numbers_and_missing_columns(spark, rows):
    df = frame(spark, [(1, None), (2, "a b")])
    assert rows(df.transform(t.split("text"))) == [(1, None), (2, "a"), (2, "b")]
    assert rows(df.transform(t.split("id"))) == rows(df)
    assert rows(df.transform(t.split("other"))) == rows(df)


def test_split_of_a_long_text(spark):
    df = frame(spark, [(1, "word " * 100_500)])
    assert df.transform(t.split("text")).count() == 100_500


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from([*EVERY_SPACE, *"aBç.!"]), max_size=12), min_size=1, max_size=30))
def test_words_equal_pythons(spark, texts):
    import string

    got = frame(spark, list(enumerate(texts))).select("id", text.words(F.col("text")).alias("w")).collect()
    table = str.maketrans("", "", string.punctuation)
    assert {r["id"]: r["w"] for r in got} == {i: x.translate(table).lower().split() for i, x in enumerate(texts)}


def test_product(spark, rows):
    df = spark.createDataFrame([(1, 2, 0.5), (2, 3, 4.0)], "id long, speed long, time double")
    assert rows(df.transform(t.product(["speed", "time"], "distance")), "id", "distance") == [(1, 1.0), (2, 12.0)]
    assert rows(df.transform(t.product([])), "product") == [(1,), (1,)]


def test_keep(spark, rows):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1)], "id long, f long, g long")
    assert rows(df.transform(t.keep("f ^ g")), "id") == [(2,), (3,)]
    assert rows(df.transform(t.keep(F.col("f") > F.col("g"))), "id") == [(3,)]
    assert rows(df.transform(t.keep(lambda r: r["f"] and r["g"])), "id") == [(4,)]


def test_project_keeps_the_order_and_fails_early(spark):
    df = spark.createDataFrame([(1, "x", 5)], "id long, junk string, value long")
    assert df.transform(t.project(["value", "id"])).columns == ["value", "id"]
    with pytest.raises(AnalysisException):
        df.transform(t.project(["nothing"]))


def test_compute_adds_and_overwrites(spark, rows):
    df = frame(spark, [(1, "abc"), (2, "𝄞")])
    assert rows(df.transform(t.compute("n", F.length("text"))), "n") == [(1,), (3,)]
    assert rows(df.transform(t.compute("id", "id * 10")), "id") == [(10,), (20,)]
    assert rows(df.transform(t.compute("root", lambda r: math.sqrt(r["id"]), "double")), "root") == [(1.0,), (math.sqrt(2),)]
    with pytest.raises(ValueError):
        df.transform(t.compute("root", lambda r: 1))
