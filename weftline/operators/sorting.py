"""Sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from .transforms import Transform


def sort(keys: Sequence[str], ties: Sequence[str | Column] = ()) -> Transform:
    """Ascending by keys, strings by code point; ties add columns that make the order complete."""
    if not keys:
        raise ValueError("sorting needs keys")
    return lambda df: df.orderBy(*keys, *ties)


def is_sorted(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the rows come in ascending order of keys, as they are collected; for tests on small tables."""
    rows = [tuple(r[k] for k in keys) for r in df.collect()]
    return all(a <= b for a, b in zip(rows, rows[1:], strict=False))
