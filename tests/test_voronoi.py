"""Voronoi cells: known cells and invariants of random ones."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.plans import voronoi as v
from weftline.sources import io

FIELD = [(0.0, 0.0), (10.0, 0.0), (10.0, 6.0), (0.0, 6.0)]


def area(cell):
    return sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(cell, cell[1:] + cell[:1], strict=True)) / 2


def all_pairs(points):
    return [v.tidy(v.fold(FIELD, p, sorted((q for k, q in enumerate(points) if k != i), key=lambda q: math.dist(p, q)))) for i, p in enumerate(points)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40))
def test_cells_tile_the_field(seed, n):
    rng = random.Random(seed)
    points = [(rng.uniform(0, 10), rng.uniform(0, 6)) for _ in range(n)]
    cells = all_pairs(points)
    assert math.isclose(sum(map(area, cells)), 60, rel_tol=1e-9)
    for p, cell in zip(points, cells, strict=True):
        assert area(cell) >= 0 and cell[0] == min(cell, key=lambda c: (round(c[1], 8), round(c[0], 8)))
        for q in points:
            a, b, c = v.bisector(p, q)
            assert all(a * x + b * y + c <= 1e-6 for x, y in cell)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 300), st.sampled_from([1e-9, 0.1, 10.0]))
def test_tree_gives_points_nearest_first_and_all(seed, n, spread):
    rng = random.Random(seed)
    points = [(3 + rng.uniform(-spread, spread), 3 + rng.choice([0.0, rng.uniform(-spread, spread)])) for _ in range(n)]
    tree = v.Tree(np.array([p[0] for p in points]), np.array([p[1] for p in points]))
    for p in [*points[:5], (0.0, 0.0), (3.0, 9.0)]:
        found = list(tree.around(*p))
        gaps = [(x - p[0]) ** 2 + (y - p[1]) ** 2 for x, y in found]
        assert sorted(found) == sorted(points) and gaps == sorted(gaps)


def test_a_dense_place_costs_its_neighbourhood():
    rng = random.Random(3)
    points = [(5 + rng.gauss(0, 1e-4), 3 + rng.gauss(0, 1e-4)) for _ in range(20_000)] + [(rng.uniform(0, 10), rng.uniform(0, 6)) for _ in range(50)]
    tree = v.Tree(np.array([p[0] for p in points]), np.array([p[1] for p in points]))
    seen = 0

    def counted(p):
        nonlocal seen
        for q in tree.around(*p):
            seen += 1
            yield q

    for p in points[:200]:
        v.fold(FIELD, p, counted(p))
    assert seen < 200 * 20_000 / 20  # the few at the rim of the dense place have large cells


def test_spark_equals_all_pairs(spark):
    rng = random.Random(9)
    points = [(rng.uniform(0, 10), rng.uniform(0, 6)) for _ in range(80)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    got = {r["id"]: [(c["x"], c["y"]) for c in r["cell"]] for r in v.cells(df, 10.0, 6.0).collect()}
    for i, cell in enumerate(all_pairs(points)):
        assert len(got[i]) == len(cell) and all(math.dist(a, b) < 1e-7 for a, b in zip(got[i], cell, strict=True))
    total = v.cells(df, 10.0, 6.0).select(v.area(F.col("cell")).alias("a")).agg(F.sum("a")).first()[0]
    assert math.isclose(total, 60, rel_tol=1e-9)


def test_few_equal_outside_and_missing_points(spark):
    cells = lambda values: {r["id"]: [(c["x"], c["y"]) for c in r["cell"]] for r in v.cells(spark.createDataFrame(values, "id long, x double, y double"), 10.0, 6.0).collect()}
    assert cells([(1, 2.0, 2.0)]) == {1: FIELD}
    assert cells([(1, 2.0, 3.0), (2, 8.0, 3.0)]) == {1: [(0, 0), (5, 0), (5, 6), (0, 6)], 2: [(5, 0), (10, 0), (10, 6), (5, 6)]}
    assert cells([(1, 2.0, 2.0), (2, 2.0, 2.0)]) == {1: FIELD, 2: FIELD}
    assert cells([(1, 5.0, 3.0), (2, 50.0, 3.0), (3, None, 1.0)]) == {1: FIELD, 2: []}
    assert cells([]) == {}
    with pytest.raises(ValueError):
        v.cells(spark.range(3).selectExpr("id", "double(id) x", "0D y"), 1.0, 1.0, shared=2)


def test_tidy_drops_repeated_and_collinear_corners():
    assert v.tidy([(0, 2), (0, 0), (0, 0), (1, 0), (2, 0), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert v.tidy([(0, 2), (2, 2), (2, 0), (0, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    got = v.tidy([(1, 5e-10), (3, 0), (3, 2), (3, 2 + 1e-10), (1, 2)])
    assert len(got) == 4 and all(math.dist(p, q) < 1e-9 for p, q in zip(got, [(1, 5e-10), (3, 0), (3, 2), (1, 2)], strict=True))
    assert v.tidy([]) == [] and v.tidy([(1, 1), (1, 1)]) == [(1, 1)] and len(v.tidy([(0, 0), (1, 1), (2, 2)])) == 2


def test_text_in_and_out(spark, tmp_path):
    path = tmp_path / "field.txt"
    path.write_text("10 6 2\n2 3\n8\t3")
    width, height, points = io.field_and_points(spark, str(path))
    assert (width, height) == (10.0, 6.0)
    lines = [r["line"] for r in io.format_cells(v.cells(points, width, height)).orderBy("id").collect()]
    assert lines[0] == "4 0.00000000 0.00000000 5.00000000 0.00000000 5.00000000 6.00000000 0.00000000 6.00000000"
    path.write_text("")
    with pytest.raises(ValueError):
        io.field_and_points(spark, str(path))
