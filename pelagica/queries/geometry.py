"""Queries on hulls, rasters and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clean, deployments, hulls, summary
from ..plans import habitat
from ..sources import tables
from .registry import Tables, query

PROJECTS = ("P1", "P3")
# A fifth of a degree in units of 1e-7 degrees.
TILE = 2_000_000.0
# A whole turn, and one that takes the middle of the fixes to the 180th meridian, in the same units.
TURN = 3_600_000_000
TO_180 = -555_000_000


def _raw_dives(t: Tables) -> DataFrame:
    """Dive positions as the combined table stores them: day-first text times."""
    return t.dive_positions.select(
        "foid",
        "tag",
        F.date_format("datetime", "d/M/yyyy HH:mm:ss").alias("time"),
        "gps_lat_post",
        "gps_lon_post",
    )


@query(
    "dives_region_filter",
    """
SELECT foid, tag, date_trunc('second', datetime) AS datetime, gps_lat_post, gps_lon_post,
  CAST(year(datetime) AS int) AS year, CAST(month(datetime) AS int) AS month, 'SPEC' AS species
FROM {dive_positions}
WHERE tag IN (SELECT tag_id FROM {deployments} WHERE project_id IN ('P1', 'P3'))
  AND year(datetime) = 2024 AND month(datetime) IN (1, 2) AND gps_lat_post <> 0
  AND gps_lon_post < -124.5e0""",
)
def dives_region_filter(t: Tables) -> DataFrame:
    dives = tables.parse_dives(_raw_dives(t))
    return tables.select_dives(
        dives, t.deployments, PROJECTS, "SPEC", 2024, (1, 2), -124.5
    ).drop("time")


def hull_ctes(points: str, out: str) -> str:
    """CTEs with the counter-clockwise hull edges of ``points(g, x, y)``, whole numbers.

    An edge leaves every point on its left or on itself; with whole numbers that is decided without rounding.
    """
    cross = "((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))"
    along = "((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y))"
    length = "((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"
    return f"""
{out} AS (SELECT a.g, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM {points} a
  JOIN {points} b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM {points} c WHERE c.g = a.g AND ({cross} < 0
    OR ({cross} = 0 AND ({along} < 0 OR {along} > {length})))))"""


# The view's positions are whole thousandths of a degree.  Hulls are taken of whole numbers, so that points on a line
# are on it in both engines, and rests of animals 1e-7 degrees wide (thousandths of a ten-thousandth) are among them.
HULLS = (
    """
fixes AS (SELECT r.*, CAST(round(r.lon * 1000) AS bigint) * 10000 AS xi, CAST(round(r.lat * 1000) AS bigint) * 10000 AS yi
  FROM {tag_records} r WHERE lat <> 0 AND lon <> 0 AND lon < 180),
known AS (SELECT d.project_id, d.project_id || '_' || d.bird_id AS uni_id, xi AS x, yi AS y
  FROM fixes r JOIN {deployments} d ON r.tag_id = d.tag_id AND r.datetime > d.dep_start
    AND (d.dep_end IS NULL OR r.datetime < d.dep_end)),
resting AS (SELECT 'rest_' || CAST(s_suppkey AS string) AS g, CAST(s_suppkey AS bigint) * 100 + dx AS x,
    CAST(s_nationkey AS bigint) * 100 + dy AS y
  FROM {supplier} CROSS JOIN (SELECT 0 AS dx, 0 AS dy UNION ALL SELECT 1, 0 UNION ALL SELECT 1, 1 UNION ALL SELECT 0, 1) c),
bird_points AS (SELECT DISTINCT uni_id AS g, x, y FROM known UNION ALL SELECT g, x, y FROM resting),"""
    + hull_ctes("bird_points", "bird_edges")
    + """,
project_points AS (SELECT DISTINCT k.project_id AS g, e.ax AS x, e.ay AS y
  FROM bird_edges e JOIN (SELECT DISTINCT project_id, uni_id FROM known) k ON k.uni_id = e.g
  UNION SELECT project_id, x, y FROM known WHERE uni_id NOT IN (SELECT g FROM bird_edges)),"""
    + hull_ctes("project_points", "project_edges")
    + """,
edges AS (SELECT * FROM bird_edges UNION ALL SELECT * FROM project_edges)"""
)


def _whole(value: Column, steps: int) -> Column:
    """Degrees on a grid of ``1 / steps`` as whole numbers of 1e-7 degrees."""
    return F.rint(value * steps) * (10_000_000 // steps)


def _known_fixes(t: Tables) -> DataFrame:
    fixes = clean.usable_fixes(t.tag_records)
    fixes = fixes.withColumns({c: _whole(F.col(c), 1000) for c in ("lat", "lon")})
    return deployments.assign_deployment(fixes, t.deployments, ("project_id", "bird_id"))


def _resting(t: Tables) -> DataFrame:
    """Animals that stay within a square of 1e-7 degrees."""
    corner = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]))
    named = t.supplier.select(F.concat(F.lit("rest_"), F.col("s_suppkey").cast("string")).alias("uni_id"), "s_suppkey", "s_nationkey", corner.alias("c"))
    return named.select("uni_id", (F.col("s_nationkey") * 100 + F.col("c.y")).cast("double").alias("lat"), (F.col("s_suppkey") * 100 + F.col("c.x")).cast("double").alias("lon"))


@query(
    "convex_hull",
    "WITH "
    + HULLS
    + """,
turned AS (SELECT *, CASE WHEN atan2(b_y - ay, bx - ax) <= 1e-12 - pi() / 2
  THEN atan2(b_y - ay, bx - ax) + 2 * pi() ELSE atan2(b_y - ay, bx - ax) END AS turn FROM edges)
SELECT g AS home, row_number() OVER (PARTITION BY g ORDER BY turn) AS ordinal, ax / 1e7 AS x, ay / 1e7 AS y,
  CAST(abs(sum(CAST(ax AS hugeint) * b_y - CAST(bx AS hugeint) * ay) OVER (PARTITION BY g)) AS double) / 2e0 AS area
FROM turned""",
)
def convex_hull(t: Tables) -> DataFrame:
    """Hull of every animal and of every project; the area in squares of 1e-7 degrees."""
    known = _known_fixes(t).select("uni_id", "project_id", "lat", "lon")
    corners = habitat.home_ranges(known.unionByName(_resting(t), allowMissingColumns=True)).filter("home IS NOT NULL")
    return corners.withColumns({c: F.col(c) / 1e7 for c in ("x", "y")})


@query(
    "raster_cells",
    """
SELECT -125e0 + (CAST(p_partkey % 50 AS double) + 0.5e0) * 0.02e0 AS x,
  60e0 - (floor(CAST(p_partkey AS double) / 50e0) + 0.5e0) * 0.025e0 AS y, p_size AS layer
FROM {part}""",
)
def raster_cells(t: Tables) -> DataFrame:
    grid = t.part.select(
        F.floor(F.col("p_partkey") / 50).alias("row_no"),
        (F.col("p_partkey") % 50).alias("col_no"),
        F.col("p_size").alias("layer"),
    )
    return tables.grid_cells(grid, -125.0, 60.0, 0.02, 0.025)


CLIPPED = (
    HULLS
    + """,
whole_cells AS (SELECT *, CAST(round(x * 10000) AS bigint) * 1000 AS xi, CAST(round(y * 10000) AS bigint) * 1000 AS yi
  FROM {raster_cells}),
clipped AS (SELECT h.g AS home, c.x, c.y, c.layer FROM whole_cells c
  JOIN (SELECT DISTINCT g FROM project_edges) h ON NOT EXISTS (
    SELECT 1 FROM project_edges e WHERE e.g = h.g
      AND (e.bx - e.ax) * (c.yi - e.ay) - (e.b_y - e.ay) * (c.xi - e.ax) < 0))"""
)


def _project_hulls(t: Tables) -> DataFrame:
    return hulls.convex_hull(_known_fixes(t).withColumnRenamed("project_id", "home"), "home")


def _whole_cells(t: Tables) -> DataFrame:
    cells = t.raster_cells.withColumnsRenamed({"x": "lon", "y": "lat"})
    return cells.withColumns({"x": _whole(F.col("lon"), 10_000), "y": _whole(F.col("lat"), 10_000)})


@query("raster_clip_hull", "WITH " + CLIPPED + "\nSELECT * FROM clipped")
def raster_clip_hull(t: Tables) -> DataFrame:
    clipped = hulls.clip_cells(_whole_cells(t), _project_hulls(t), "home", TILE)
    return clipped.drop("x", "y").withColumnsRenamed({"lon": "x", "lat": "y"})


def _turned(value: Column) -> Column:
    """Longitudes of whole 1e-7 degrees moved west to the 180th meridian, within half a turn of 0."""
    return F.pmod(value + TO_180 + TURN // 2, F.lit(float(TURN))) - TURN // 2


@query(
    "raster_clip_across_180",
    "WITH "
    + CLIPPED
    + f"""
SELECT home, ((CAST(round(x * 10000) AS bigint) * 1000 + {TO_180} + {3 * TURN // 2}) % {TURN} - {TURN // 2}) / 1e7 AS x, y, layer
FROM clipped""",
)
def raster_clip_across_180(t: Tables) -> DataFrame:
    """The clip on the other side of the world: hulls that lie on both sides of the 180th meridian hold the same cells."""
    fixes = _known_fixes(t).withColumnRenamed("project_id", "home").withColumn("lon", _turned(F.col("lon")))
    corners = hulls.convex_hull(hulls.unwrap_longitudes(fixes, "home", "lon", TURN), "home")
    cells = _whole_cells(t).withColumn("x", _turned(F.col("x")))
    clipped = hulls.clip_cells(cells, corners, "home", TILE, turn=TURN)
    return clipped.select("home", (F.col("x") / 1e7).alias("x"), F.col("lat").alias("y"), "layer")


@query(
    "raster_lookup_join",
    """
SELECT c.x, c.y, c.layer, l.tid_short, l.measurement
FROM {raster_cells} c LEFT JOIN {raster_lookup} l ON l.tid = c.layer""",
)
def raster_lookup_join(t: Tables) -> DataFrame:
    return hulls.with_class_names(t.raster_cells, t.raster_lookup)


@query(
    "raster_class_counts",
    "WITH "
    + CLIPPED
    + """
SELECT c.home, c.layer, l.tid_short, l.measurement, count(*) AS n
FROM clipped c LEFT JOIN {raster_lookup} l ON l.tid = c.layer
WHERE c.layer IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def raster_class_counts(t: Tables) -> DataFrame:
    return hulls.class_counts_inside(_whole_cells(t), _project_hulls(t), t.raster_lookup, "home", TILE)


@query(
    "legacy_extent",
    """
SELECT split_part(bird_id, '_', 1) AS species, min(lat_degree) AS min_lat,
  max(lat_degree) AS max_lat, min(long_degree) AS min_lon, max(long_degree) AS max_lon,
  max(abs(cal_depth)) AS max_depth
FROM {legacy_track} GROUP BY 1""",
)
def legacy_extent(t: Tables) -> DataFrame:
    return summary.legacy_extent(tables.legacy_species(t.legacy_track))
