"""Tiled labels and holes against the untiled forms, and distances against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfield.operators import raster as rs, tiles as tl


def flood(on):
    """First cell of each set cell's component, cell by cell."""
    label = {}
    for start in zip(*np.nonzero(on)):
        if start in label:
            continue
        todo = [start]
        while todo:
            r, c = todo.pop()
            if (r, c) in label or not (0 <= r < on.shape[0] and 0 <= c < on.shape[1]) or not on[r, c]:
                continue
            label[r, c] = start
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return {(int(a), int(b)): (int(x), int(y)) for (a, b), (x, y) in label.items()}


def rasters():
    rng = np.random.default_rng(5)
    snake = np.zeros((23, 31), bool)
    snake[::2] = True
    snake[1::4, -1] = True
    snake[3::4, 0] = True  # one component that crosses every border many times
    ring = np.zeros((23, 31), bool)
    ring[1:-1, 1:-1] = True
    ring[2:-2, 2:-2] = False
    ring[8, 8] = True
    return {1: rng.random((23, 31)) < 0.55, 2: snake, 3: np.zeros((23, 31), bool), 4: ring, 5: rng.random((23, 31)) < 0.8}


def table(spark, maps):
    rows = [(k, int(r), int(c)) for k, on in maps.items() for r, c in zip(*np.nonzero(on))]
    return spark.createDataFrame(rows, "k int, row int, col int")


@pytest.mark.parametrize("side", [1, 5, 64])
def test_components(spark, side):
    maps = rasters() if side > 1 else {1: rasters()[1][:6, :7], 2: rasters()[2][:6, :7]}
    got = tl.components(table(spark, maps), ["k"], side).collect()
    assert len(got) == sum(on.sum() for on in maps.values())
    want = {(k, *cell): first for k, on in maps.items() for cell, first in flood(on).items()}
    assert {(r.k, r.row, r.col): (r.label_row, r.label_col) for r in got} == want


def test_holes(spark):
    maps = rasters()
    sizes = spark.createDataFrame([(k, 23, 31) for k in maps], "k int, rows int, columns int")
    got = {(r.k, r.row, r.col) for r in tl.fill_holes(table(spark, maps), sizes, ["k"], 8).collect()}
    want = set()
    for k, on in maps.items():
        free = flood(~on)
        outside = {first for (r, c), first in free.items() if r in (0, 22) or c in (0, 30)}
        want |= {(k, int(r), int(c)) for r, c in zip(*np.nonzero(on))} | {(k, *cell) for cell, first in free.items() if first not in outside}
    assert got == want


def test_no_cells(spark):
    none = spark.createDataFrame([], "k int, row int, col int")
    assert tl.components(none, ["k"]).count() == 0
    assert rs.dilate(none, ["k"], 3.0).count() == 0


@pytest.mark.parametrize("radius", [0.0, 1.0, 2.3, 5.0, 17.5])
def test_distance_against_all_pairs(spark, radius):
    rng = np.random.default_rng(int(radius * 10))
    cells = [(int(k), int(r), int(c)) for k in range(3) for r, c in rng.integers(-20, 20, (int(rng.integers(1, 40)), 2))]
    got = {tuple(r) for r in rs.dilate(spark.createDataFrame([*cells, cells[0]], "k int, row int, col int"), ["k"], radius).collect()}
    want = set()
    reach = int(radius) + 1
    for k, r, c in cells:
        want |= {(k, r + y, c + x) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1) if x * x + y * y <= radius * radius}
    assert got == want


def test_distance_rows_do_not_grow_with_the_radius(spark):
    """A filled square: a place is one row whether the disk is small or large."""
    square = spark.range(60 * 60).select(F.lit(1).alias("k"), F.expr("CAST(id DIV 60 AS INT) AS row"), F.expr("CAST(id % 60 AS INT) AS col"))
    for radius in (3.0, 25.0):
        assert rs.column_distances(square, ["k"], F.lit(radius)).count() == 60 * (60 + 2 * int(radius))


def test_bare_masks(spark):
    boxes = [(1, 2.5, 3.0, 4.0, 8.0), (2, -9.0, 1.0, 5.0, 5.0), (3, 95.2, 40.0, 50.0, 20.5), (4, 5.0, 5.0, 0.0, 3.0)]
    df = spark.createDataFrame(boxes, "k int, x double, y double, w double, h double").withColumns({"page_width": F.lit(100), "page_height": F.lit(50)})
    got = {(r.k, r.part): (r.left, r.top, r.right, r.bottom) for r in rs.bare_masks(df, ["k"]).collect()}
    assert got == {(1, "erase"): (2, 3, 7, 11), (1, "seed"): (3, 5, 6, 9), (3, "erase"): (95, 40, 100, 50)}
    assert rs.span_cells(rs.bare_masks(df.where("k = 1"), ["k"]), ["k", "part"]).count() == 5 * 8 + 3 * 4
