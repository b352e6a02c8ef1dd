import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagica.operators import hulls
from pelagica.plans.habitat import habitat_classes
from pelagica.sources.tables import grid_cells

SCHEMA = "g string, lon double, lat double"


def corners(spark, points, **options):
    rows = hulls.convex_hull(spark.createDataFrame(points, SCHEMA), "g", **options)
    out = {}
    for r in rows.orderBy("g", "ordinal").collect():
        out.setdefault(r["g"], []).append((r["x"], r["y"]))
    return out


def test_degenerate_groups(spark):
    points = [("one", 1.0, 1.0)] * 3
    points += [("two", 0.0, 0.0), ("two", 1.0, 2.0)]
    points += [("line", float(i), float(i)) for i in range(5)]
    points += [("square", x, y) for x in (0.0, 0.5, 1.0) for y in (0.0, 0.5, 1.0)]
    points += [("gap", None, 1.0), ("gap", 2.0, 2.0)]
    got = corners(spark, points)
    assert got["one"] == [(1.0, 1.0)]
    assert got["two"] == [(0.0, 0.0), (1.0, 2.0)]
    assert got["line"] == [(0.0, 0.0), (4.0, 4.0)]
    assert got["square"] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert got["gap"] == [(2.0, 2.0)]


def test_random_hulls(spark):
    rng = random.Random(4)
    points = [
        (f"g{k}", round(rng.gauss(0, 1), 3), round(rng.gauss(0, 1), 3))
        for k in range(20)
        for _ in range(rng.choice([5, 60, 400]))
    ]
    got = corners(spark, points, fan=3)
    for k in range(20):
        mine = np.array([(x, y) for g, x, y in points if g == f"g{k}"])
        ring = np.array(got[f"g{k}"])
        assert {tuple(p) for p in ring} <= {tuple(p) for p in mine}
        for a, b in zip(ring, np.roll(ring, -1, axis=0)):
            side = (b[0] - a[0]) * (mine[:, 1] - a[1]) - (b[1] - a[1]) * (mine[:, 0] - a[0])
            assert side.min() >= -1e-9
            # No corner is missing and none is on an edge: only the two ends touch it.
            assert (np.abs(side) < 1e-12).sum() >= 2


@pytest.mark.parametrize("width", [1e-5, 1e-7, 1e-12])
def test_small_hulls_keep_their_corners(spark, width):
    square = [(-125.0 + x * width, 40.0 + y * width) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5))]
    got = corners(spark, [("s", *p) for p in square], fan=3)["s"]
    assert sorted(got) == sorted(set(square[:4]))


def test_the_split_of_rows_does_not_matter():
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e-8, 1e-13):
        points = np.round(rng.normal(size=(400, 2)), 1) * scale + [-125.3, 40.7]
        whole = hulls.hull_points(points)
        parts = np.vstack([hulls.hull_points(points[i::7]) for i in range(7)])
        assert np.array_equal(whole, hulls.hull_points(parts))


def test_all_points_on_a_circle_stay(spark):
    angles = np.linspace(0, 2 * np.pi, 500, endpoint=False)
    points = [("c", float(np.cos(a)), float(np.sin(a))) for a in angles]
    assert len(corners(spark, points, fan=5)["c"]) == 500


@pytest.mark.parametrize("tile", [0.3, 1.0, 10.0])
def test_clip_counts_the_edge(spark, tile):
    triangle = spark.createDataFrame([("t", 0.0, 0.0), ("t", 4.0, 0.0), ("t", 0.0, 4.0)], SCHEMA)
    cells = spark.createDataFrame(
        [(float(x), float(y), x % 2) for x in range(-1, 6) for y in range(-1, 6)],
        "x double, y double, layer int",
    )
    inside = hulls.clip_cells(cells, hulls.convex_hull(triangle, "g"), "g", tile)
    got = {(r["x"], r["y"]) for r in inside.collect()}
    assert got == {(x, y) for x in range(5) for y in range(5) if x + y <= 4}


@pytest.mark.parametrize("tile,levels", [(0.5, 0), (0.25, 3), (0.25, 8), (40.0, 2)])
def test_cover_changes_only_the_spread(spark, tile, levels):
    rng = random.Random(12)
    points = [(g, rng.gauss(m, 2), rng.gauss(-m, 1)) for g, m in (("a", 0), ("b", 3)) for _ in range(60)]
    points += [("one", 1.0, 1.0), ("two", 0.0, 0.0), ("two", 2.0, 1.0)]
    found = hulls.convex_hull(spark.createDataFrame(points, SCHEMA), "g")
    rings = {}
    for r in found.orderBy("g", "ordinal").collect():
        rings.setdefault(r["g"], []).append((r["x"], r["y"]))
    data = [(x / 4, y / 4, (x + y) % 3 or None) for x in range(-24, 40) for y in range(-24, 24)]
    cells = spark.createDataFrame(data, "x double, y double, layer int")

    def inside(g, x, y):
        ring = rings[g]
        (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*ring))
        left = all((bx - ax) * (y - ay) >= (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))
        return left and x0 <= x <= x1 and y0 <= y <= y1

    want = sorted((g, x, y) for g in rings for x, y, _ in data if inside(g, x, y))
    got = hulls.clip_cells(cells, found, "g", tile, levels)
    assert sorted((r["g"], r["x"], r["y"]) for r in got.collect()) == want
    assert {g for g, _, _ in want} == {"a", "b", "one", "two"}
    counts = {}
    layer = {(x, y): k for x, y, k in data}
    for g, x, y in want:
        if layer[x, y]:
            counts[g, layer[x, y]] = counts.get((g, layer[x, y]), 0) + 1
    lookup = spark.createDataFrame([(1, "s", "m")], "tid int, tid_short string, measurement string")
    rows = hulls.class_counts_inside(cells, found, lookup, "g", tile, levels).collect()
    assert {(r["g"], r["layer"]): r["n"] for r in rows} == counts
    assert hulls.clip_cells(cells, found.limit(0), "g", tile, levels).isEmpty()


def test_cover_grows_with_the_border(spark):
    """A circle a hundred times a tile wide: cells of the cover stay near the border's length, with a small share of the edges each."""
    angles = np.linspace(0, 2 * np.pi, 720, endpoint=False)
    sizes = {}
    for radius in (32.0, 64.0):
        points = [("c", float(radius * np.cos(a)), float(radius * np.sin(a))) for a in angles]
        cover = hulls.hull_cover(hulls.convex_hull(spark.createDataFrame(points, SCHEMA), "g"), "g").collect()
        sizes[radius] = len(cover)
        border = [r for r in cover if r["edges"]]
        assert {r["level"] for r in border} == {0}
        assert sum(len(r["edges"]) for r in border) < 720 / 12 * len(border)
        area = sum(4 ** r["level"] for r in cover if not r["edges"])
        assert area < np.pi * radius**2 < area + len(border)
    assert sizes[64.0] < 2.5 * sizes[32.0] < 1500


def test_hulls_across_the_180th_meridian(spark):
    points = [("across", x, y) for x in (179.0, 180.0, -179.0, -178.0) for y in (0.0, 2.0)]
    points += [("east", x, y) for x in (-10.0, 10.0) for y in (0.0, 2.0)] + [("wide", x, y) for x in (-100.0, 0.0, 100.0) for y in (0.0, 2.0)]
    points += [("no", None, 1.0), (None, 5.0, 1.0)]
    placed = hulls.unwrap_longitudes(spark.createDataFrame(points, SCHEMA), "g")
    got = {}
    for r in placed.collect():
        got.setdefault(r["g"], set()).add(r["lon"])
    assert got == {"across": {179.0, 180.0, 181.0, 182.0}, "east": {-10.0, 10.0}, "wide": {-100.0, 0.0, 100.0}, "no": {None}, None: {5.0}}
    found = hulls.convex_hull(placed.filter("g = 'across'"), "g")
    cells = spark.createDataFrame([(x, 1.0, 1) for x in (-180.0, -179.5, -177.5, 0.0, 178.5, 179.5)], "x double, y double, layer int")
    assert {r["x"] for r in hulls.clip_cells(cells, found, "g", turn=360.0).collect()} == {-180.0, -179.5, 179.5}


def test_habitat_and_grid(spark):
    grid = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, None)], "row_no int, col_no int, layer int")
    cells = grid_cells(grid, 10.0, 50.0, 1.0, 1.0)
    assert {(r["x"], r["y"]) for r in cells.collect()} == {(10.5, 49.5), (11.5, 49.5), (10.5, 48.5)}
    points = spark.createDataFrame([("s", x, y) for x in (10.0, 12.0) for y in (48.0, 50.0)], SCHEMA)
    lookup = spark.createDataFrame([(1, "sonar", "direct")], "tid int, tid_short string, measurement string")
    counts = habitat_classes(points, cells, lookup, "g", "lon", "lat")
    got = {(r["layer"], r["tid_short"]): r["n"] for r in counts.collect()}
    assert got == {(1, "sonar"): 1, (2, None): 1}
