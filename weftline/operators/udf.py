"""Arbitrary Python over rows, groups and pairs of groups, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from .transforms import Transform

Row = dict


def _plain(frame: pd.DataFrame) -> list[Row]:
    frame = frame.astype(object)
    return frame.where(frame.notna(), None).to_dict("records")


def _frame(rows: Iterable[Row], names: Sequence[str]) -> pd.DataFrame:
    rows = list(rows)
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names}, columns=list(names))


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names


def map_rows(function: Callable[[Row], Iterable[Row]], schema: str) -> Transform:
    """Any number of rows for each row."""
    names = _names(schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _frame((out for row in _plain(frame) for out in function(row)), names)

    return lambda df: df.mapInPandas(run, schema)


def reduce_groups(function: Callable[[tuple[str, ...], Iterator[Row]], Iterable[Row]], keys: Sequence[str], schema: str, order_by: Sequence[str] = ()) -> Transform:
    """Any number of rows for each group; the function gets the names of the keys and the group's rows, in order if one is given.

    A whole group is in one task's memory: prefer the built-in aggregations.
    """
    names = _names(schema)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if order_by:
            frame = frame.sort_values(list(order_by), kind="stable")
        return _frame(function(tuple(keys), iter(_plain(frame))), names)

    return lambda df: df.groupBy(*keys).applyInPandas(run, schema)


def join_groups(left: DataFrame, right: DataFrame, function: Callable[[tuple[str, ...], Iterator[Row], Iterator[Row]], Iterable[Row]], keys: Sequence[str], schema: str) -> DataFrame:
    """Any number of rows for each key of either side; the function gets the rows of both sides."""
    names = _names(schema)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _frame(function(tuple(keys), iter(_plain(a)), iter(_plain(b))), names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
