"""Keyed aggregations. Each returns a function DataFrame -> DataFrame; no keys mean one group.

No aggregation gives a row for empty input, not even one without keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialise
from .transforms import Transform, unused

Keys = Sequence[str]


def count_by(keys: Keys, column: str = "count") -> Transform:
    """Rows of each group; a key of the same name as the count is replaced by it."""

    def run(df: DataFrame) -> DataFrame:
        n = unused(df, "_n")
        out = df.groupBy(*keys).agg(F.count("*").alias(n)).filter(F.col(n) > 0)
        return out.select(*[k for k in keys if k != column], F.col(n).alias(column))

    return run


def sum_by(keys: Keys, column: str) -> Transform:
    """Sum of a column under its own name; nulls are ignored."""

    def run(df: DataFrame) -> DataFrame:
        n = unused(df, "_n")
        return df.groupBy(*keys).agg(F.sum(column).alias(column), F.count("*").alias(n)).filter(F.col(n) > 0).drop(n)

    return run


def average_by(keys: Keys, column: str, result: str | None = None) -> Transform:
    """Mean of the values that are numbers or spell one; a group without any gives no row."""

    def run(df: DataFrame) -> DataFrame:
        if column not in df.columns:
            return df.select(*keys).limit(0).withColumn(result or column, F.lit(None).cast("double"))
        value = F.col(column)
        if isinstance(df.schema[column].dataType, T.BooleanType):
            value = value.cast("int")
        mean = unused(df, "_avg")
        out = df.groupBy(*keys).agg(F.avg(value.try_cast("double")).alias(mean))
        return out.filter(F.col(mean).isNotNull()).select(*keys, F.col(mean).alias(result or column))

    return run


def first_by(keys: Keys, order_by: Sequence[str | Column]) -> Transform:
    """The first row of each group in the given order."""
    return lambda df: _ranked(df, keys, order_by, 1)


def top_n(keys: Keys, column: str, n: int, ties: Sequence[str | Column] = ()) -> Transform:
    """The n rows of each group with the largest values; ties are decided by further columns, ascending."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return lambda df: _ranked(df, keys, [F.col(column).desc(), *ties], n)


def _ranked(df: DataFrame, keys: Keys, order: Sequence[str | Column], n: int) -> DataFrame:
    if not keys:
        return df.orderBy(*order).limit(n)
    rank = unused(df, "_rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n).drop(rank)


def term_frequency(keys: Keys, words: str, result: str = "tf", carry: Sequence[str] = (), order_by: Sequence[str] = ()) -> Transform:
    """Each distinct word of a group with its share of the group's rows.

    carry names columns that are taken over from the group's first row in the
    order of order_by; without it other columns are dropped.
    """

    def run(df: DataFrame) -> DataFrame:
        counts = df.groupBy(*keys, words).agg(F.count("*").alias("_n"))
        if keys:  # a window over words that are counted already
            out = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
        else:
            out = counts.crossJoin(counts.agg(F.sum("_n").alias("_all")))
        out = out.select(*keys, words, (F.col("_n") / F.col("_all")).alias(result))
        if carry:
            if not order_by:
                raise ValueError("columns of a first row need an order")
            first = df.groupBy(*keys).agg(F.min_by(F.struct(*carry), F.struct(*order_by)).alias("_first"))
            from .joins import join

            out = join(out, first, keys).select(*keys, words, result, "_first.*") if keys else out.crossJoin(first).select(words, result, "_first.*")
        return out

    return run


def reduce_runs(keys: Keys, order_by: Sequence[str], aggregates: Sequence[Column], ranges: int | None = None) -> Transform:
    """One row for each maximal run of rows, in the given order, with equal keys (null equals null), and its number from 1.

    Rows are dealt into ranges of the whole order, so no window spans the table
    and a value that many rows share is split by the further columns: run starts
    are found inside ranges, and a table of one row per range tells how the
    ranges join up. The dealt rows are written into the shared folder, as both
    steps must see the same ranges. Null comes first. There are as many ranges
    as shuffle partitions by default.
    """
    if not order_by:
        raise ValueError("runs need an order")

    def run(df: DataFrame) -> DataFrame:
        n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part, key, start, base, number = (unused(df, x) for x in ("_part", "_key", "_start", "_base", "_number"))
        ascending = [F.col(c).asc_nulls_first() for c in order_by]
        dealt = df.repartitionByRange(n, *ascending)
        rows = materialise(dealt.withColumn(part, F.spark_partition_id()), "runs").withColumn(key, F.struct(*keys))
        inside = Window.partitionBy(part).orderBy(*ascending)
        new = F.when(F.row_number().over(inside) == 1, None).otherwise((~F.lag(key).over(inside).eqNullSafe(F.col(key))).cast("long"))
        rows = rows.withColumn(start, F.coalesce(new, F.lit(0).cast("long")))
        order = F.struct(*order_by)
        ends = rows.groupBy(part).agg(F.min_by(key, order).alias("head"), F.max_by(key, order).alias("tail"), F.sum(start).alias("n"))
        whole = Window.orderBy(part)  # one row for each range
        ends = ends.withColumn("new", F.when(F.lag("tail").over(whole).eqNullSafe(F.col("head")) & (F.row_number().over(whole) > 1), 0).otherwise(1))
        ends = ends.select(part, (F.sum(F.col("n") + F.col("new")).over(whole.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias(base))
        rows = rows.join(ends, part)
        rows = rows.withColumn(number, F.col(base) + F.sum(start).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.groupBy(number, *keys).agg(*aggregates).withColumnRenamed(number, "run")

    return run
