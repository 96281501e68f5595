"""Voronoi cells of points in a rectangle, by clipping with the bisectors to other points.

A point's bisectors come nearest point first; once the next point is more than
twice as far away as the cell's farthest corner, no further bisector can cut it.
Distinct points lie in a k-d tree that is shared with the tasks, so a cell costs
about its neighbourhood, not the table, also where points are dense. The number
of points is checked against a bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-9
#: Distinct points that are shared with every task at most: 24 bytes each.
SHARED_POINTS = 5_000_000

Polygon = list[tuple[float, float]]


def clip(cell: Polygon, a: float, b: float, c: float) -> Polygon:
    """The part of a convex polygon where a*x + b*y + c <= EPS."""
    out: Polygon = []
    values = [a * x + b * y + c for x, y in cell]
    for k, (p, v) in enumerate(zip(cell, values, strict=True)):
        q, w = cell[k - 1], values[k - 1]
        if (v <= EPS) != (w <= EPS):
            t = w / (w - v)
            out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
        if v <= EPS:
            out.append(p)
    return out


def bisector(p: tuple[float, float], q: tuple[float, float]) -> tuple[float, float, float]:
    """Coefficients that are not positive at points nearer to p than to q."""
    return 2 * (q[0] - p[0]), 2 * (q[1] - p[1]), p[0] ** 2 + p[1] ** 2 - q[0] ** 2 - q[1] ** 2


def tidy(cell: Polygon) -> Polygon:
    """The corners that turn, counter-clockwise from the lowest, then leftmost.

    A cell is convex, so they are the strict convex hull of its corners: a chain
    from left to right along the bottom and one back along the top.
    """

    def chain(corners: Polygon) -> Polygon:
        out: Polygon = []
        for p in corners:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= EPS:
                out.pop()
            out.append(p)
        return out[:-1]

    corners = sorted(set(cell))
    hull = chain(corners) + chain(corners[::-1]) if len(corners) > 1 else corners
    if not hull:
        return hull
    lowest = min(y for _, y in hull) + EPS
    start = hull.index(min(p for p in hull if p[1] <= lowest))
    return hull[start:] + hull[:start]


def fold(cell: Polygon, p: tuple[float, float], others: Iterable[tuple[float, float]]) -> Polygon:
    """Clip by the bisectors to other points, which come nearest first; equal points share their cell."""
    reach = None
    for q in others:
        if not cell:
            break
        if reach is None:
            reach = max(((x - p[0]) ** 2 + (y - p[1]) ** 2 for x, y in cell), default=0.0)
        if (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 > 4 * reach * (1 + 1e-9) + EPS:
            break
        after = clip(cell, *bisector(p, q))
        if after != cell:
            cell, reach = after, None
    return cell


class Tree:
    """A k-d tree without pointers: a range of points is cut at its middle, by x and y in turn, down to LEAF points."""

    LEAF = 16

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order, ranges = np.arange(len(x)), [(0, len(x), 0)]
        self.cut = np.zeros(len(x))  # where the range with this middle is cut
        while ranges:
            lo, hi, axis = ranges.pop()
            if hi - lo > self.LEAF:
                mid = (lo + hi) // 2
                part, along = order[lo:hi], y if axis else x
                order[lo:hi] = part[np.argpartition(along[part], mid - lo)]
                self.cut[mid] = along[order[mid]]
                ranges += [(lo, mid, 1 - axis), (mid, hi, 1 - axis)]
        self.x, self.y = x[order], y[order]

    def around(self, px: float, py: float) -> Iterator[tuple[float, float]]:
        """All points, nearest to (px, py) first."""
        # an entry is a point, or a range with the offsets from the place to its half of the plane in x and y
        heap: list[tuple] = [(0.0, 1, 0, len(self.x), 0, 0.0, 0.0)]
        while heap:
            _, is_range, lo, hi, axis, dx, dy = heappop(heap)
            if not is_range:
                yield float(self.x[lo]), float(self.y[lo])
            elif hi - lo <= self.LEAF:
                for k in range(lo, hi):
                    heappush(heap, ((self.x[k] - px) ** 2 + (self.y[k] - py) ** 2, 0, k, k, 0, 0.0, 0.0))
            else:
                mid = (lo + hi) // 2
                gap = float(self.cut[mid] - (py if axis else px))
                for first, last, beyond in ((lo, mid, min(0.0, gap)), (mid, hi, max(0.0, gap))):
                    # the half that the place is in keeps its offset
                    x, y = (dx, beyond or dy) if axis else (beyond or dx, dy)
                    heappush(heap, (x * x + y * y, 1, first, last, 1 - axis, x, y))


_CELL = "array<struct<x:double,y:double>>"


def cells(points: DataFrame, width: float, height: float, shared: int = SHARED_POINTS) -> DataFrame:
    """id and cell (corners) of each point (id, x, y) in the rectangle from the origin to (width, height).

    Points with a null coordinate have no cell and cut none; points outside the
    rectangle have the part of their cell inside, perhaps none. Rows are told
    apart by id.
    """
    points = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null")
    kind = points.schema["id"].dataType.simpleString()
    field = [(0.0, 0.0), (width, 0.0), (width, height), (0.0, height)]
    schema = f"id {kind}, cell {_CELL}"
    distinct = points.select("x", "y").distinct()
    if distinct.limit(shared + 1).count() > shared:
        raise ValueError(f"more than {shared} points: cut the field into tiles that overlap")
    table = distinct.toPandas()
    tree = Tree(table["x"].to_numpy(), table["y"].to_numpy())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [tidy(fold(field, (x, y), tree.around(x, y))) for x, y in zip(frame["x"], frame["y"], strict=True)]
            yield pd.DataFrame({"id": frame["id"], "cell": [[{"x": a, "y": b} for a, b in c] for c in made]})

    return points.mapInPandas(run, schema)


def area(cell: F.Column) -> F.Column:
    """Signed area of a cell."""
    n = F.size(cell)
    turn = F.transform(cell, lambda p, i: p["x"] * F.element_at(cell, ((i + 1) % n + 1).cast("int"))["y"] - p["y"] * F.element_at(cell, ((i + 1) % n + 1).cast("int"))["x"])
    return F.aggregate(turn, F.lit(0.0), lambda a, v: a + v) / 2
