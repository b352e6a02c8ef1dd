"""Minimum convex polygons and raster cells inside them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

# What rounding can add to a cross product, as a share of its two products.
ROUNDING = 3.4e-16
# Corners a task keeps in memory before it passes them on.
MAX_KEPT = 200_000


def _turn(a: tuple, b: tuple, c: tuple) -> float:
    """Positive when ``c`` lies to the left of the line from ``a`` to ``b``; the sign is exact.

    Only a value within its own rounding error is worked out again in fractions.
    """
    one, two = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    if abs(one - two) > ROUNDING * (abs(one) + abs(two)):
        return one - two
    (ax, ay), (bx, by), (cx, cy) = ([Fraction(v) for v in p] for p in (a, b, c))
    exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (exact > 0) - (exact < 0)


def hull_points(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of ``(n, 2)`` points, counter-clockwise.

    Starts at the lowest x (then lowest y); collinear points are left out.
    """
    points = _outer(np.unique(points, axis=0))
    if len(points) < 3:
        return points

    def chain(ordered: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for p in ordered:
            while len(kept) > 1 and _turn(kept[-2], kept[-1], p) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    ordered = [tuple(p) for p in points.tolist()]
    return np.array(chain(ordered) + chain(ordered[::-1]))


def _outer(points: np.ndarray) -> np.ndarray:
    """Leave out points certainly inside the polygon of the extremes in 16 directions."""
    if len(points) < 4:
        return points
    angles = np.arange(16) * (np.pi / 8)
    reach = points @ np.vstack([np.cos(angles), np.sin(angles)])
    ring = points[reach.argmax(axis=0)]
    inner = np.ones(len(points), dtype=bool)
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        if not np.array_equal(a, b):
            one = (b[0] - a[0]) * (points[:, 1] - a[1])
            two = (b[1] - a[1]) * (points[:, 0] - a[0])
            inner &= one - two > ROUNDING * (np.abs(one) + np.abs(two))
    return points[~inner]


def ring_area(points: np.ndarray) -> float:
    """Area of a closed ring, zero for fewer than three corners."""
    # from the first corner, so that a small ring far from the origin keeps its digits
    x, y = points[:, 0] - points[0, 0], points[:, 1] - points[0, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2.0)


def _reduce_by(key: str):
    """Per-task reduction: of each group only the corners of what was seen."""

    def as_frame(seen: dict[object, np.ndarray]) -> pd.DataFrame:
        points = np.vstack(list(seen.values()))
        groups = np.repeat(np.array(list(seen), dtype=object), [len(p) for p in seen.values()])
        return pd.DataFrame({key: groups, "x": points[:, 0], "y": points[:, 1]})

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[object, np.ndarray] = {}
        for batch in batches:
            points = batch[["x", "y"]].to_numpy()
            for group, rows in batch.groupby(key, sort=False).indices.items():
                part = points[rows]
                if group in seen:
                    part = np.vstack([seen[group], part])
                seen[group] = hull_points(part)
            if sum(map(len, seen.values())) > MAX_KEPT:
                yield as_frame(seen)
                seen = {}
        if seen:
            yield as_frame(seen)

    return reduce_batches


def _finish(key: str):
    """Final corners of groups that arrive one after another."""

    def as_frame(done: list[tuple[object, np.ndarray]]) -> pd.DataFrame:
        rings = [hull_points(points) for _, points in done]
        sizes = [len(ring) for ring in rings]
        points = np.vstack(rings)
        return pd.DataFrame(
            {
                key: np.repeat(np.array([group for group, _ in done], dtype=object), sizes),
                "ordinal": np.concatenate([np.arange(1, n + 1) for n in sizes]),
                "x": points[:, 0],
                "y": points[:, 1],
                "area": np.repeat([ring_area(ring) for ring in rings], sizes),
            }
        )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: tuple[object, np.ndarray] | None = None
        for batch in batches:
            points = batch[["x", "y"]].to_numpy()
            done = []
            for group, rows in batch.groupby(key, sort=False).indices.items():
                part = points[rows]
                if waiting is not None and waiting[0] == group:
                    part = np.vstack([waiting[1], part])
                elif waiting is not None:
                    done.append(waiting)
                waiting = (group, part)
            if done:
                yield as_frame(done)
        if waiting is not None:
            yield as_frame([waiting])

    return finish


def convex_hull(
    points: DataFrame, key: str, x: str = "lon", y: str = "lat", fan: int = 64
) -> DataFrame:
    """Corners of each group's convex hull with their ordinal and the hull's area.

    Points shrink in three steps: to the corners of what one task reads, to the
    corners of one of ``fan`` parts of a group, and to the corners of the
    group.  The hull of hulls is the hull, so no point that matters is lost and
    no task receives a whole group.
    """
    key_type = points.schema[key].dataType.simpleString()
    placed = points.select(
        key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    ).dropna()
    shape = f"{key} {key_type}, x double, y double"
    by_task = placed.mapInPandas(_reduce_by(key), shape)
    part = F.pmod(F.hash("x", "y"), F.lit(fan))
    by_part = by_task.repartition(key, part).mapInPandas(_reduce_by(key), shape)
    corners = f"{key} {key_type}, ordinal long, x double, y double, area double"
    grouped = by_part.repartition(key).sortWithinPartitions(key)
    return grouped.mapInPandas(_finish(key), corners)


def hull_polygons(corners: DataFrame, key: str) -> DataFrame:
    """One row per hull: its corners as an array, and its bounding box."""
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("ordinal", "x", "y"))),
        lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")),
    )
    return corners.groupBy(key).agg(
        ordered.alias("ring"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
    )


def _edges(ring: str) -> Column:
    """Consecutive corners of a closed ring as ``(ax, ay, bx, by)``."""
    here = F.col(ring)
    turned = F.concat(F.slice(here, 2, F.size(here)), F.slice(here, 1, 1))
    return F.zip_with(
        here,
        turned,
        lambda a, b: F.struct(
            a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")
        ),
    )


def _inside(px: Column, py: Column, edges: Column) -> Column:
    """Whether a point lies in a counter-clockwise ring; the edge, up to rounding, is inside."""

    def left(e: Column) -> Column:
        one = (e["bx"] - e["ax"]) * (py - e["ay"])
        two = (e["by"] - e["ay"]) * (px - e["ax"])
        return one - two >= -ROUNDING * (F.abs(one) + F.abs(two))

    return F.forall(edges, left)


def _tile(value: Column, tile_deg: Column | float) -> Column:
    return F.floor(value / (tile_deg if isinstance(tile_deg, Column) else F.lit(tile_deg)))


def unwrap_longitudes(points: DataFrame, key: str, x: str = "lon", turn: float = 360.0) -> DataFrame:
    """Put the points of each group on one stretch of longitude, also across the 180th meridian.

    A group starts after the widest empty gap, in 360ths of ``turn``, on the circle; points before that start are moved
    one turn east, so that ``x`` may reach beyond half a turn.  Groups that don't cross stay as they are.  A group is known
    by at most 360 numbers.  Longitudes lie within half a turn of 0; rows without one, or without a key, are kept as they are.
    """
    here = F.col(x).cast("double")
    placed = points.withColumn(x, F.when(here >= turn / 2, here - turn).otherwise(here))
    step = F.floor(F.col(x) / F.lit(turn / 360))
    seen = placed.filter(F.col(x).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_set(step)).alias("_steps"))
    steps = F.col("_steps")
    following = F.concat(F.slice(steps, 2, F.size(steps)), F.array(F.element_at(steps, 1) + 360))
    gaps = F.zip_with(steps, following, lambda a, b: F.struct((b - a).alias("gap"), F.when(b >= 180, b - 360).otherwise(b).alias("start")))
    starts = seen.select("_key", F.array_max(gaps)["start"].alias("_start"))
    moved = placed.join(starts, F.col(key) == F.col("_key"), "left")
    return moved.withColumn(x, F.when(step < F.col("_start"), F.col(x) + turn).otherwise(F.col(x))).drop("_key", "_start")


def _crossing(level: Column, tx: Column, ty: Column, edges: Column, tile_deg: float) -> Column:
    """The edges whose line crosses a cell; NULL if the cell lies beyond one of them.

    Every point of a cell is left of the edges that are left out.  The cell is taken a little too wide, and an edge
    counts as crossing within rounding, so no point is decided here that its own test would decide otherwise.
    """
    side = F.lit(tile_deg) * F.pow(F.lit(2.0), level)
    west, south = (tx - 1e-9) * side, (ty - 1e-9) * side
    east, north = (tx + 1 + 1e-9) * side, (ty + 1 + 1e-9) * side

    def products(e: Column) -> tuple[Column, ...]:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        return dx * (south - e["ay"]), dx * (north - e["ay"]), dy * (west - e["ax"]), dy * (east - e["ax"])

    def rounding(one: Column, two: Column, three: Column, four: Column) -> Column:
        return 4 * ROUNDING * (F.greatest(F.abs(one), F.abs(two)) + F.greatest(F.abs(three), F.abs(four)))

    def beyond(e: Column) -> Column:
        south_, north_, west_, east_ = products(e)
        return F.greatest(south_, north_) - F.least(west_, east_) < -rounding(south_, north_, west_, east_)

    def crosses(e: Column) -> Column:
        south_, north_, west_, east_ = products(e)
        return F.least(south_, north_) - F.greatest(west_, east_) < rounding(south_, north_, west_, east_)

    return F.when(~F.exists(edges, beyond), F.filter(edges, crosses))


def hull_cover(corners: DataFrame, key: str, tile_deg: float = 1.0, levels: int = 8) -> DataFrame:
    """Cells of a quadtree that cover each hull: ``key, level, tx, ty, edges``.

    A cell of level ``l`` is ``tile_deg * 2**l`` wide.  A hull starts with the few cells of the level that suits its extent
    (``levels`` at most); a cell that an edge crosses is cut into four down to level 0, a cell wholly inside is left whole,
    one wholly outside is dropped.  So the number of cells grows with the border, and ``edges``, empty for cells inside, holds only
    those a point of the cell must still be compared with.  All steps are narrow.  Hulls of one or two corners cover their
    point or line.
    """
    box = F.array(
        *[
            F.struct(*[c.cast("double").alias(n) for c, n in zip(ends, ("ax", "ay", "bx", "by"))])
            for x, y, dx, dy in (("x_min", "y_max", 0, -1), ("x_max", "y_min", 0, 1), ("x_min", "y_min", 1, 0), ("x_max", "y_max", -1, 0))
            for ends in [(F.col(x), F.col(y), F.col(x) + dx, F.col(y) + dy)]
        ]
    )
    hulls = hull_polygons(corners, key).withColumn("edges", F.concat(_edges("ring"), box))
    tiles = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")) / F.lit(tile_deg)
    fitting = F.when(tiles > 1, F.least(F.lit(levels), F.ceil(F.log2(tiles)))).otherwise(0).cast("int")
    hulls = hulls.withColumn("level", fitting)

    def span(low: str, high: str) -> Column:
        first, last = (_tile(F.col(c), F.lit(tile_deg) * F.pow(F.lit(2.0), F.col("level"))) for c in (low, high))
        return F.explode(F.sequence(first, last))

    def settled(cells: DataFrame, fresh: Column) -> DataFrame:
        left = F.when(fresh, _crossing(F.col("level"), F.col("tx"), F.col("ty"), F.col("edges"), tile_deg)).otherwise(F.col("edges"))
        return cells.select(key, "level", "tx", "ty", left.alias("edges")).filter(F.col("edges").isNotNull())

    cells = hulls.withColumn("tx", span("x_min", "x_max")).withColumn("ty", span("y_min", "y_max"))
    cells = settled(cells, F.lit(True))

    def cell(level: Column, tx: Column, ty: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), tx.cast("long").alias("tx"), ty.cast("long").alias("ty"))

    level, tx, ty = F.col("level"), F.col("tx"), F.col("ty")
    quarters = F.array(*[cell(level - 1, 2 * tx + dx, 2 * ty + dy) for dx in (0, 1) for dy in (0, 1)])
    for depth in range(levels, 0, -1):
        cut = (level == depth) & (F.size("edges") > 0)
        parts = F.explode(F.when(cut, quarters).otherwise(F.array(cell(level, tx, ty))))
        cells = cells.select(key, "edges", cut.alias("_cut"), parts.alias("_c")).select(key, "edges", "_cut", "_c.*")
        cells = settled(cells, F.col("_cut"))
    return cells


def _kept_cover(corners: DataFrame, key: str, tile_deg: float, levels: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Cells inside hulls, border cells, and the levels of the former; written once, since each is read for itself."""
    cover = checkpointed(hull_cover(corners, key, tile_deg, levels))
    inside = cover.filter(F.size("edges") == 0).drop("edges")
    used = sorted(r["level"] for r in inside.select("level").distinct().collect())  # at most one row a level
    border = cover.filter(F.size("edges") > 0).drop("level")
    return inside, border, used


def _placed(cells: DataFrame, tile_deg: float, turn: float | None) -> DataFrame:
    """Cells with the tile of their centre, one turn further east as well if hulls may reach beyond half a turn."""
    here = F.col("x")
    places = F.array(here, here + turn) if turn else F.array(here)
    placed = cells.withColumn("_x", F.explode(places))
    return placed.withColumns({"tx": _tile(F.col("_x"), tile_deg), "ty": _tile(F.col("y"), tile_deg)})


def _with_parents(placed: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Rows once for each level, with the cell of that level they lie in."""
    parents = F.array(
        *[
            F.struct(F.lit(k).alias("level"), F.shiftright("tx", k).alias("tx"), F.shiftright("ty", k).alias("ty"))
            for k in levels
        ]
    )
    return placed.withColumn("_p", F.explode(parents)).drop("tx", "ty").select("*", "_p.*").drop("_p")


def clip_cells(
    cells: DataFrame, corners: DataFrame, key: str, tile_deg: float = 1.0, levels: int = 8, turn: float | None = None
) -> DataFrame:
    """Raster cells whose centre lies inside a hull, once per hull.

    Hulls are covered by cells of a quadtree (``hull_cover``), which makes the join an equality on level and tile.  Cells wholly
    inside a hull need no further test; those at its border compare their centres with the few edges that cross them.
    The tile's width and the levels change only the spread.  ``turn`` is to be given for hulls of ``unwrap_longitudes``.
    """
    inside, border, used = _kept_cover(corners, key, tile_deg, levels)
    placed = _placed(cells, tile_deg, turn)
    met = placed.join(border, ["tx", "ty"]).filter(_inside(F.col("_x"), F.col("y"), F.col("edges"))).select(key, *cells.columns)
    if not used:
        return met
    return met.union(_with_parents(placed, used).join(inside, ["level", "tx", "ty"]).select(key, *cells.columns))


def with_class_names(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """Attach the class names; unknown classes keep NULLs."""
    return cells.join(
        lookup.select(F.col("tid").alias("layer"), "tid_short", "measurement"), "layer", "left"
    )


def class_counts_inside(
    cells: DataFrame, corners: DataFrame, lookup: DataFrame, key: str, tile_deg: float = 1.0, levels: int = 8, turn: float | None = None
) -> DataFrame:
    """Cells per hull and class, cells without a class left out.

    Cells are counted by tile and class once, and those counts by the larger cells of the cover; cells wholly inside a hull add
    these counts, and only the tiles at a hull's border look at their cells again.
    """
    inside, border, used = _kept_cover(corners, key, tile_deg, levels)
    placed = _placed(cells.filter(F.col("layer").isNotNull()), tile_deg, turn)
    cut = placed.join(border, ["tx", "ty"]).filter(_inside(F.col("_x"), F.col("y"), F.col("edges")))
    total = cut.groupBy(key, "layer").agg(F.count("*").alias("n"))
    if used:
        counts = placed.groupBy("tx", "ty", "layer").agg(F.count("*").alias("n"))
        counts = _with_parents(counts, used).groupBy("level", "tx", "ty", "layer").agg(F.sum("n").alias("n"))
        total = total.unionByName(counts.join(inside, ["level", "tx", "ty"]).select(key, "layer", "n"))
    total = total.groupBy(key, "layer").agg(F.sum("n").alias("n"))
    return with_class_names(total, lookup).select(key, "layer", "tid_short", "measurement", "n")


def class_counts(
    cells: DataFrame, keys: Sequence[str], by: Sequence[str] = ("layer", "tid_short", "measurement")
) -> DataFrame:
    """Cells per group and class, cells without a class left out."""
    return (
        cells.filter(F.col("layer").isNotNull())
        .groupBy(*keys, *by)
        .agg(F.count("*").alias("n"))
    )
