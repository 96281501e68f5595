"""Pipelines over named sources: described once, run on any inputs any number of times."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from weftline.operators import joins, sorting
from weftline.operators.transforms import Transform


@dataclass(frozen=True)
class Pipeline:
    """An immutable description; every method gives a new one, so a common beginning can be continued in several ways."""

    sources: frozenset[str]
    build: Callable[[dict[str, DataFrame]], DataFrame]

    @staticmethod
    def source(name: str) -> Pipeline:
        return Pipeline(frozenset([name]), lambda given: given[name])

    def then(self, *steps: Transform) -> Pipeline:
        """Apply operators one after the other."""

        def build(given: dict[str, DataFrame]) -> DataFrame:
            df = self.build(given)
            for step in steps:
                df = df.transform(step)
            return df

        return Pipeline(self.sources, build)

    def sort(self, keys: Sequence[str], ties: Sequence[str] = ()) -> Pipeline:
        return self.then(sorting.sort(keys, ties))

    def join(self, other: Pipeline, keys: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_1", "_2")) -> Pipeline:
        return Pipeline(self.sources | other.sources, lambda given: joins.join(self.build(given), other.build(given), keys, how, suffixes))

    def run(self, **given: DataFrame) -> DataFrame:
        """The result as a lazy DataFrame; missing sources are an error at once."""
        if missing := self.sources - given.keys():
            raise KeyError(f"missing sources: {', '.join(sorted(missing))}")
        return self.build(given)
