"""Rows, text lines, JSON lines, Parquet and point lists in; JSON lines and Parquet out."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rows(spark: SparkSession, data: Iterable[dict], schema: str) -> DataFrame:
    """A table of rows in memory; missing columns are null."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(r.get(n) for n in kind.names) for r in data], kind)


def text_lines(spark: SparkSession, path: str, parser: Callable[[str], dict] | None = None, schema: str | None = None, columns: dict[str, Column] | None = None) -> DataFrame:
    """A row for each line of text files, as `value` without its line end.

    columns computes the row's columns from `value`. A Python parser of a line
    needs the schema of its rows; it is the slow way.
    """
    lines = spark.read.text(path)
    if columns is not None:
        return lines.select(*[c.alias(n) for n, c in columns.items()])
    if parser is None:
        return lines
    if schema is None:
        raise ValueError("a Python parser needs the schema of its rows")
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = [parser(x) for x in frame["value"]]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in parsed], dtype=object) for n in names})

    return lines.mapInPandas(run, schema)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A row for each line that isn't blank; a malformed line is an error. Without a schema one is inferred, by a pass of its own."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan dealt over the cluster if it has fewer partitions than cores, as with a file of one row group.

    For scans alone: what lies below is planned here. A scan with more
    partitions, as any large table has, stays as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def parts(df: DataFrame, mb: float = 8) -> int:
    """How many partitions give each so many MB of df's size as Catalyst estimates it without running anything, one for each core at least.

    The estimate of a scan is the size of its files. Where there is none, as
    with rows from memory, it is the number of shuffle partitions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1e15:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(df.sparkSession.sparkContext.defaultParallelism, min(20_000, math.ceil(size / (mb * 1e6))))


def deal(df: DataFrame, keys: Sequence[str], mb: float = 8) -> DataFrame:
    """The rows dealt by keys over partitions of a bounded size, which adaptive execution doesn't merge.

    What is grouped by these and further keys later needs no shuffle: texts are
    shuffled once instead of their words, and the groups that a task holds at
    once don't grow with the table.
    """
    return df.repartition(parts(df, mb), *keys)


def write_json_lines(df: DataFrame, path: str, single_file: bool = False, nulls: bool = False) -> None:
    """JSON lines into a folder, or for "-" to standard output in the order of the rows.

    nulls writes missing values as null, else they are left out. Sorted rows are
    in order if the files are read in the order of their names; single_file puts
    all into one file, by one task, and is for small results only.
    """
    if path == "-":
        for row in df.toLocalIterator():
            values = row.asDict(recursive=True)
            print(json.dumps(values if nulls else {k: v for k, v in values.items() if v is not None}, ensure_ascii=False, default=str), file=sys.stdout)
        return
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", str(not nulls).lower()).json(path)


def field_and_points(spark: SparkSession, path: str) -> tuple[float, float, DataFrame]:
    """Width, height and points (id, x, y) of a text: width, height and number of points, then x and y of each, at any white space.

    An empty text is an error.
    """
    numbers = spark.read.text(path, wholetext=True).select(F.array_remove(F.split("value", r"\s+"), "").alias("v"))
    head = numbers.select(F.get("v", F.lit(0)), F.get("v", F.lit(1)), F.get("v", F.lit(2))).first()
    if head is None or head[2] is None:
        raise ValueError("the text must begin with width, height and the number of points")
    n = int(head[2])
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.explode(F.array().cast("array<int>"))
    points = numbers.select("v", at.alias("id")).select("id", F.element_at("v", 2 * F.col("id") + 4).cast("double").alias("x"), F.element_at("v", 2 * F.col("id") + 5).cast("double").alias("y"))
    return float(head[0]), float(head[1]), points


def format_cells(cells: DataFrame) -> DataFrame:
    """id and line: the number of vertices and their coordinates with eight decimals."""
    numbers = F.flatten(F.transform("cell", lambda p: F.array(p["x"], p["y"])))
    return cells.select("id", F.array_join(F.concat(F.array(F.size("cell").cast("string")), F.transform(numbers, lambda v: F.format_string("%.8f", v))), " ").alias("line"))
