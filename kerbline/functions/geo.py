"""Geometry as column expressions, and the grid join that spatial operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import once

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def utm(lat: Column, lon: Column, central: float = 75.0) -> tuple[Column, Column]:
    """(easting, northing) in metres of the transverse Mercator zone around ``central`` degrees, by Snyder's series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    nu = F.lit(a) / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2)
    w = F.cos(phi) * (F.radians(lon) - math.radians(central))
    arc = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    x = 500000 + k0 * nu * (w + (1 - t + c) * F.pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(w, 5) / 120)
    y = k0 * (arc + nu * F.tan(phi) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(w, 6) / 720))
    return x, y


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance of a point from a straight piece; a piece of no length is a point."""
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt(F.pow(px - (x1 + along * dx), 2) + F.pow(py - (y1 + along * dy), 2))


def polyline_distance(px: Column, py: Column, points: Column) -> Column:
    """Least distance of a point from an array of structs (lon, lat); null for fewer than two points."""
    piece = lambda i: segment_distance(px, py, points[i - 1]["lon"], points[i - 1]["lat"], points[i]["lon"], points[i]["lat"])
    return F.when(F.size(points) > 1, F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), piece)))


def pieces_distance(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Planar distance of two straight pieces: 0 where they cross, else the least of an end from the other piece."""
    side = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    crossed = (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
    ends = [(ax, ay, cx, cy, dx, dy), (bx, by, cx, cy, dx, dy), (cx, cy, ax, ay, bx, by), (dx, dy, ax, ay, bx, by)]
    return F.when(crossed, 0.0).otherwise(F.least(*[segment_distance(*e) for e in ends]))


def wkt_points(text: Column) -> Column:
    """Array of (lon, lat) of a WKT line, or of a multi-line's first line; null for text that is neither."""
    body = F.regexp_extract(text, r"(?i)^\s*(?:MULTI)?LINESTRING\s*\(+([^()]*)\)", 1)
    parts = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    points = F.transform(parts, lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("lon"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("lat")))
    return F.when((body != "") & ~F.exists(points, lambda p: p["lon"].isNull() | p["lat"].isNull()), points)


def line_centroid(points: Column) -> tuple[Column, Column]:
    """(lon, lat) of the length-weighted middle of a line's pieces; a line of no length is its first point."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.struct(
        F.sqrt(F.pow(points[i]["lon"] - points[i - 1]["lon"], 2) + F.pow(points[i]["lat"] - points[i - 1]["lat"], 2)).alias("w"),
        ((points[i]["lon"] + points[i - 1]["lon"]) / 2).alias("lon"), ((points[i]["lat"] + points[i - 1]["lat"]) / 2).alias("lat")))
    total = F.aggregate(pieces, F.lit(0.0), lambda s, p: s + p["w"])
    mean = lambda axis: F.coalesce(F.try_divide(F.aggregate(pieces, F.lit(0.0), lambda s, p: s + p["w"] * p[axis]), total), points[0][axis])
    return mean("lon"), mean("lat")


def ring_area(points: Column) -> Column:
    """Area of a closed ring of (x, y) structs; null unless it is finite and over zero."""
    twice = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + points[i - 1]["x"] * points[i]["y"] - points[i]["x"] * points[i - 1]["y"])
    area = F.abs(twice) / 2
    return F.when((F.size(points) > 3) & (area > 0) & ~F.isnan(area), area)


def inside_ring(points: Column) -> Column:
    """A struct of lon and lat: a point inside a closed ring: the middle of its widest stretch on a level line between the two vertices around half its height."""

    def level(lats: Column) -> Column:
        return once((F.array_min(lats) + F.array_max(lats)) / 2, lambda half: (F.coalesce(F.array_min(F.filter(lats, lambda y: y > half)), half) + F.array_max(F.filter(lats, lambda y: y <= half))) / 2)

    def crossed(points: Column, at: Column) -> Column:
        edges = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.struct(points[i - 1].alias("a"), points[i].alias("b")))
        met = F.filter(edges, lambda e: (e["a"]["lat"] > at) != (e["b"]["lat"] > at))
        return F.array_sort(F.transform(met, lambda e: e["a"]["lon"] + (at - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) * (e["b"]["lon"] - e["a"]["lon"])))

    def middle(xs: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.struct((F.get(xs, i * 2) - F.get(xs, i * 2 + 1)).alias("narrow"), ((F.get(xs, i * 2) + F.get(xs, i * 2 + 1)) / 2).alias("lon")))
        return F.array_min(pairs)["lon"]

    def place(points: Column, at: Column) -> Column:
        found = lambda xs: F.struct(F.when(F.size(xs) > 1, middle(xs)).otherwise(points[0]["lon"]).alias("lon"), F.when(F.size(xs) > 1, at).otherwise(points[0]["lat"]).alias("lat"))
        return once(crossed(points, at), found)

    at = lambda p: once(F.transform(p, lambda q: q["lat"]), level)
    return once(points, lambda p: once(at(p), lambda y: place(p, y)))


def on_line(points: Column) -> Column:
    """A struct of lon and lat: the line's inner vertex next to its centroid, of a straight line's first end."""

    def nearest(points: Column, middle: Column) -> Column:
        inner = F.when(F.size(points) > 2, F.slice(points, 2, F.greatest(F.size(points) - 2, F.lit(1)))).otherwise(F.slice(points, 1, 1))
        far = F.transform(inner, lambda p: F.struct((F.pow(p["lon"] - middle["lon"], 2) + F.pow(p["lat"] - middle["lat"], 2)).alias("d"), p["lon"].alias("lon"), p["lat"].alias("lat")))
        return F.array_min(far).dropFields("d")

    centre = lambda p: F.struct(*[c.alias(n) for c, n in zip(line_centroid(p), ("lon", "lat"), strict=True)])
    return once(points, lambda p: once(centre(p), lambda m: nearest(p, m)))


def cells(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size).alias("cell_x"), F.floor(y / size).alias("cell_y")


def level(x1: str, y1: str, x2: str, y2: str, unit: float) -> Column:
    """The level of a grid whose cells are as large as the box: ``unit`` at level 0, twice that at each next."""
    size = F.greatest(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1))
    return F.greatest(F.lit(0), F.ceil(F.log2(size / unit))).cast("int")


def levels(rows: DataFrame) -> list[int]:
    """The levels that there are: a few, as each doubles the size."""
    return sorted(r.level for r in rows.select("level").distinct().collect())


def in_levels(rows: DataFrame, x1: str, y1: str, x2: str, y2: str, unit: float) -> DataFrame:
    """``rows`` in each cell of their ``level`` that their box touches: four at most where the cells are as large as it; cell_x, cell_y."""
    size = F.lit(unit) * F.pow(F.lit(2.0), F.col("level"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return rows.withColumn("cell_x", cells(x1, x2)).withColumn("cell_y", cells(y1, y2))


def grid_join(left: DataFrame, right: DataFrame, xy_left: tuple[str, str], xy_right: tuple[str, str], radius: float, extra: list[str] | None = None) -> DataFrame:
    """Pairs of rows within ``radius`` (inclusive, planar) with their ``distance``: an equi-join on grid cells of that size.

    ``right`` goes to its own and the eight cells around, so each pair meets exactly once; ``extra`` names more
    equality columns. Columns must differ but for ``extra``.
    """
    (lx, ly), (rx, ry) = xy_left, xy_right
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = right.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    spread = spread.withColumn("_cx", F.floor(F.col(rx) / radius) + F.col("_dx")).withColumn("_cy", F.floor(F.col(ry) / radius) + F.col("_dy")).drop("_dx", "_dy")
    placed = left.withColumn("_cx", F.floor(F.col(lx) / radius)).withColumn("_cy", F.floor(F.col(ly) / radius))
    pairs = placed.join(spread, ["_cx", "_cy", *(extra or [])]).drop("_cx", "_cy")
    distance = F.sqrt(F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= radius)
