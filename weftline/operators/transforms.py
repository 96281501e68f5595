"""Row operators. Each returns a function DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text

Transform = Callable[[DataFrame], DataFrame]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, like this one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identity() -> Transform:
    return lambda df: df.select("*")


def strip_punctuation(column: str) -> Transform:
    """Delete ASCII punctuation in place."""
    return lambda df: df.withColumn(column, text.strip_punctuation(F.col(column)))


def lower_case(column: str) -> Transform:
    return lambda df: df.withColumn(column, F.lower(column))


def split(column: str, separator: str | None = None) -> Transform:
    """A row for each part of the column's text, the other columns repeated.

    A null, or a column that holds no text or does not exist, passes its rows
    through unchanged; a text without parts gives no row.
    """

    def run(df: DataFrame) -> DataFrame:
        if column not in df.columns or not isinstance(df.schema[column].dataType, T.StringType):
            return df
        parts = F.when(F.col(column).isNull(), F.array(F.lit(None).cast("string"))).otherwise(text.split(F.col(column), separator))
        return df.select(*[F.explode(parts).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])

    return run


def product(columns: Sequence[str], result: str = "product") -> Transform:
    """The product of columns; 1 for none."""
    return lambda df: df.withColumn(result, reduce(mul, [F.col(c) for c in columns]) if columns else F.lit(1).cast("long"))


def keep(condition: Column | str | Callable[[dict], object]) -> Transform:
    """Rows for which the condition holds; numbers count as true unless they are 0.

    A Python function of the row as a dict is the slow way: it goes through a
    user-defined function.
    """

    def run(df: DataFrame) -> DataFrame:
        if isinstance(condition, Column):
            test = condition
        elif isinstance(condition, str):
            test = F.expr(condition)
        else:
            test = F.udf(lambda row: bool(condition(row.asDict())), "boolean")(F.struct("*"))
        return df.filter(test.cast("boolean"))

    return run


def project(columns: Sequence[str]) -> Transform:
    """Only these columns, in this order; a missing one is an error at once."""
    return lambda df: df.select(*columns)


def compute(column: str, value: Column | str | Callable[[dict], object], returns: str | None = None) -> Transform:
    """Add or overwrite a column by an expression, or by a Python function of the row (the slow way), whose type `returns` then names."""

    def run(df: DataFrame) -> DataFrame:
        if isinstance(value, Column):
            new = value
        elif isinstance(value, str):
            new = F.expr(value)
        else:
            if returns is None:
                raise ValueError("a Python function needs the type that it returns")
            new = F.udf(lambda row: value(row.asDict()), returns)(F.struct("*"))
        return df.withColumn(column, new)

    return run
