"""Sources, sinks, command lines and arbitrary Python."""

import json

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.operators import udf
from weftline.sources import io


def test_rows_in_memory(spark, rows):
    assert rows(io.rows(spark, [{"a": 1, "b": "x"}, {"a": 2}], "a long, b string")) == [(1, "x"), (2, None)]


def test_text_lines(spark, rows, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("1;hello\n2;wörld\n", encoding="utf-8")
    assert rows(io.text_lines(spark, str(path))) == [("1;hello",), ("2;wörld",)]
    parts = F.split("value", ";")
    assert rows(io.text_lines(spark, str(path), columns={"id": parts[0].cast("int"), "w": parts[1]})) == [(1, "hello"), (2, "wörld")]
    parse = lambda line: dict(zip(("id", "w"), (int(line.split(";")[0]), line.split(";")[1]), strict=True))
    assert rows(io.text_lines(spark, str(path), parse, "id long, w string")) == [(1, "hello"), (2, "wörld")]
    with pytest.raises(ValueError):
        io.text_lines(spark, str(path), parse)


def test_json_lines(spark, rows, tmp_path, capsys):
    path = tmp_path / "t.jsonl"
    path.write_text('{"a": 1, "t": "ñ"}\n\n  \n{"a": 2}\n', encoding="utf-8")
    df = io.json_lines(spark, str(path), "a long, t string")
    assert rows(df) == [(1, "ñ"), (2, None)] and rows(io.json_lines(spark, str(path))) == rows(df)
    for nulls, last in ((False, {"a": 2}), (True, {"a": 2, "t": None})):
        out = tmp_path / f"out{nulls}"
        io.write_json_lines(df.orderBy("a"), str(out), single_file=True, nulls=nulls)
        (file,) = out.glob("part-*.json")
        assert [json.loads(x) for x in file.read_text(encoding="utf-8").splitlines()] == [{"a": 1, "t": "ñ"}, last]
    io.write_json_lines(df.orderBy("a"), "-")
    assert capsys.readouterr().out == '{"a": 1, "t": "ñ"}\n{"a": 2}\n'
    path.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.json_lines(spark, str(path), "a long").collect()


def test_parquet(spark, rows, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert rows(io.parquet(spark, str(tmp_path / "p"))) == [(0,), (1,), (2,)]


def test_command_lines(spark, tmp_path, capsys):
    docs = tmp_path / "docs.jsonl"
    docs.write_text('{"doc_id": "a", "text": "sunny sunny Moons"}\n{"doc_id": "b", "text": "moons, moons"}\n')

    def run(*args):
        cli.main([str(x) for x in args], spark)
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert run("word-count", "--input", docs) == [{"text": "sunny", "count": 2}, {"text": "moons", "count": 3}]
    assert [r["doc_id"] for r in run("inverted-index", "--input", docs)] == ["a", "b", "a"]
    assert [(r["doc_id"], r["text"]) for r in run("pmi", "--input", docs)] == [("a", "sunny"), ("b", "moons")]
    times, edges = tmp_path / "times.jsonl", tmp_path / "edges.jsonl"
    times.write_text('{"edge_id": 1, "enter_time": "20240105T100000.0", "leave_time": "20240105T110000.0"}\n')
    edges.write_text('{"edge_id": 1, "start": [0, 0], "end": [0, 1], "length": 5000}\n')
    assert run("road-speed", "--travel-times", times, "--edges", edges) == [{"weekday": "Fri", "hour": 10, "speed": 5.0}]
    cli.main(["word-count", "--input", str(docs), "--output", str(tmp_path / "out")], spark)
    lines = [x for file in sorted((tmp_path / "out").glob("part-*")) for x in file.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"text": "sunny", "count": 2}, {"text": "moons", "count": 3}]
    field = tmp_path / "field.txt"
    field.write_text("2 2 1 1 1")
    cli.main(["voronoi", "--input", str(field)], spark)
    assert capsys.readouterr().out.startswith("4 0.00000000 0.00000000 2.0")
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_map_rows(spark, rows):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string")
    got = df.transform(udf.map_rows(lambda r: [{"id": r["id"], "w": w} for w in (r["t"] or "").split()], "id long, w string"))
    assert rows(got) == [(1, "a"), (1, "b")]


def test_reduce_groups_in_order_with_early_stop(spark, rows):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 9)], "k long, v long")

    def first_two(keys, group):
        assert keys == ("k",)
        for _, row in zip(range(2), group):
            yield row

    assert rows(df.transform(udf.reduce_groups(first_two, ["k"], "k long, v long", ["v"]))) == [(1, 1), (1, 2), (2, 9)]


def test_join_groups(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, b string")

    def both(keys, left, right):
        left, right = list(left), list(right)
        yield {"k": (left or right)[0]["k"], "n": 10 * len(left) + len(right)}

    assert rows(udf.join_groups(a, b, both, ["k"], "k long, n long")) == [(1, 10), (2, 11), (3, 1)]


def test_spread_deals_small_scans_only(spark, rows, tmp_path):
    spark.range(20).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(20).repartition(9).write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "many"))
    one = io.spread(io.parquet(spark, str(tmp_path / "one")))
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows(one) == [(i,) for i in range(20)]
    many = io.parquet(spark, str(tmp_path / "many"))
    if many.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        assert io.spread(many) is many
