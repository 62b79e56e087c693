"""Nearest, radius, map-matching, interval and ripple joins: packed trees, grid cells or hour buckets first, then exact tests."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, tree
from ..functions import refdata as R
from ..functions.shared import spread_join, staged


def _finite(*columns: str) -> Column:
    """Whether the columns are numbers: no nulls, and NaN counts as over infinity."""
    return reduce(and_, [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in columns])


def _unmatched(queries: DataFrame, right: DataFrame, columns: list[str], distance: str) -> DataFrame:
    """No rows, with the columns of an answer."""
    return queries.limit(0).join(right.limit(0).select(*columns), F.lit(True)).withColumn(distance, F.lit(None).cast("double"))


def ring_nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, keep: list[str], group: str | None = None) -> DataFrame:
    """``left``'s key with the nearest right row (planar x, y columns lx, ly and rx, ry; ties by ``right_key``), per ``group`` of the right side where given.

    The right side is a packed tree for each group, without those in one place with a lesser one. Rows without coordinates have no answer.
    """
    groups = [group] if group else []
    right = right.where(_finite("rx", "ry"))
    places = right.groupBy(*groups, "rx", "ry").agg(F.min(F.struct(right_key, *keep)).alias("r")).select(*groups, "rx", "ry", "r.*")
    asked = left.select(key, "lx", "ly").where(_finite("lx", "ly"))
    if group:
        asked = asked.join(right.select(group).distinct())  # each kind is asked for
    packed = tree.pack(places, ["rx", "ry"], ["rx", "ry"], groups, ["rx", "ry", right_key, *keep])
    if packed is None:
        return _unmatched(asked.select(key), right, [*groups, right_key, *keep], "distance").select(key, *groups, "distance", right_key, *keep)
    distance = lambda k: F.sqrt(F.pow(F.col("lx") - k["rx"], 2) + F.pow(F.col("ly") - k["ry"], 2))
    best = lambda d, k: F.struct(d.alias("distance"), *[k[c].alias(c) for c in (right_key, *keep)])
    return tree.nearest(packed, asked, ["lx", "ly"], distance, best).select(key, *groups, "best.*")


def haversine_nearest(left: DataFrame, right: DataFrame, key: str, keep: list[str], first: list[str], group: str | None = None) -> DataFrame:
    """Nearest row of ``right`` by great-circle distance, among those of the same ``group`` where one is given; ties by ``first``. Columns lat, lon and rlat, rlon.

    The right side is a packed tree of points in space, where the straight distance rises with that on the globe; so poles and the date line need no care.
    Rows without coordinates have none. The groups that ``right`` lacks have none either.
    """
    by = [group] if group else []
    right, left = right.where(_finite("rlat", "rlon")), left.where(_finite("lat", "lon")).select(key, *by, "lat", "lon")
    more = [c for c in keep if c not in first]
    places = right.groupBy(*by, "rlat", "rlon").agg(F.min(F.struct(*first, *more)).alias("r")).select(*by, "rlat", "rlon", "r.*", *_space("rlat", "rlon", "r"))
    packed = tree.pack(places, ["_rx", "_ry", "_rz"], ["_rx", "_ry", "_rz"], by, ["rlat", "rlon", *first, *more])
    if packed is None:
        return _unmatched(left.select(key, *by), right, keep, "distance_km").select(key, *by, "distance_km", *keep)
    distance = lambda k: F.round(geo.haversine_km(F.col("lat"), F.col("lon"), k["rlat"], k["rlon"]), 9)
    best = lambda d, k: F.struct(d.alias("distance_km"), *[k[c].alias(c) for c in (*first, *more)])
    asked = left.select("*", *_space("lat", "lon", "q"))
    found = tree.nearest(packed, asked, ["_qx", "_qy", "_qz"], distance, best, slack=(1e-9, 1e-11))
    return found.select(key, *by, "best.distance_km", *[f"best.{c}" for c in keep])


def _space(lat: str, lon: str, name: str) -> list[Column]:
    """A place on the globe as a point of the unit sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return [(F.cos(la) * F.cos(lo)).alias(f"_{name}x"), (F.cos(la) * F.sin(lo)).alias(f"_{name}y"), F.sin(la).alias(f"_{name}z")]


def radius_counts(points: DataFrame, pois: DataFrame, key: str) -> DataFrame:
    """poi_count_200m, poi_count_500m (inclusive) and poi_gravity_score within 500 m, for points lx, ly and pois rx, ry in metres with poi_type."""
    near = geo.grid_join(points, pois, ("lx", "ly"), ("rx", "ry"), 500.0)
    pull = R.lookup(F.col("poi_type"), R.POI_GRAVITY, 1.0) / F.pow(F.greatest(F.lit(10.0), F.col("distance")), 1.5)
    sums = near.groupBy(key).agg(F.count_if(F.col("distance") <= 200).alias("poi_count_200m"), F.count("*").alias("poi_count_500m"), (1000 * F.sum(pull)).alias("poi_gravity_score"))
    return points.select(key).join(sums, key, "left").fillna(0)


def match_roads(points: DataFrame, roads: DataFrame, reach: float = 0.002, penalties: dict[str, float] | None = None) -> DataFrame:
    """Each point's road: of those whose envelope meets the point's box, the one of least distance plus class penalty; where none does, the plain nearest.

    points: id, lon, lat. roads: segment_id, osm_highway, points (lon, lat). Without penalties (an empty dict) it is the nearest
    road everywhere. The box is asked of a grid with levels: an envelope is in the level whose cells are as large as it, so in four cells at most, and a
    point asks one cell of each level that there is. The nearest is asked of a packed tree of envelopes. Points without finite coordinates have no road.
    Each place is asked once, however many points it has.
    """
    points = points.select("id", "lon", "lat").where(_finite("lon", "lat"))
    places = staged(points.groupBy("lon", "lat").agg(F.count("*").alias("n")))
    found = _match_places(places.select(F.struct("lon", "lat").alias("id"), "lon", "lat"), roads, reach, penalties)
    return spread_join(points, found.select("id.lon", "id.lat", *[c for c in found.columns if c != "id"]), ["lon", "lat"], places, F.xxhash64("id")).drop("lon", "lat")


def _match_places(points: DataFrame, roads: DataFrame, reach: float, penalties: dict[str, float] | None) -> DataFrame:
    lons, lats = F.transform("points", lambda p: p["lon"]), F.transform("points", lambda p: p["lat"])
    roads = roads.where(F.size("points") > 1).select("segment_id", "osm_highway", "points", F.array_min(lons).alias("x1"), F.array_max(lons).alias("x2"), F.array_min(lats).alias("y1"), F.array_max(lats).alias("y2"))
    roads = roads.where(_finite("x1", "x2", "y1", "y2"))
    if penalties == {}:
        return _nearest_road(points, roads).select("id", "best.*")
    tried = staged(_best_in_box(points, roads, reach, R.SNAP_PENALTY if penalties is None else penalties))
    found, rest = tried.where("m is not null").select("id", "m.*"), tried.where("m is null").select("id", "lon", "lat")
    return found if rest.isEmpty() else found.unionByName(_nearest_road(rest, roads).select("id", "best.*"))


def _nearest_road(points: DataFrame, roads: DataFrame) -> DataFrame:
    """``points`` (id, lon, lat) with ``best``: segment_id, osm_highway and distance_deg of the nearest road; ties by segment_id."""
    packed = tree.pack(roads, ["x1", "y1"], ["x2", "y2"], keep=["segment_id", "osm_highway", "points"])
    if packed is None:
        return points.limit(0).withColumn("best", F.struct(F.lit("").alias("segment_id"), F.lit("").alias("osm_highway"), F.lit(0.0).alias("distance_deg")))
    distance = lambda k: F.round(geo.polyline_distance(F.col("lon"), F.col("lat"), k["points"]), 12)
    best = lambda d, k: F.struct(d.alias("_d"), k["segment_id"].alias("segment_id"), k["osm_highway"].alias("osm_highway"), d.alias("distance_deg"))
    return tree.nearest(packed, points, ["lon", "lat"], distance, best).withColumn("best", F.col("best").dropFields("_d"))


def _best_in_box(points: DataFrame, roads: DataFrame, reach: float, penalties: dict[str, float]) -> DataFrame:
    """id, lon, lat and the road ``m`` of least distance and penalty whose envelope meets the point's box, or null."""
    box = roads.withColumns({"x1": F.col("x1") - reach, "x2": F.col("x2") + reach, "y1": F.col("y1") - reach, "y2": F.col("y2") + reach})
    placed = geo.in_levels(box.withColumn("level", geo.level("x1", "y1", "x2", "y2", 4 * reach)), "x1", "y1", "x2", "y2", 4 * reach)
    at = points.withColumn("level", F.explode(F.array(*map(F.lit, geo.levels(placed))).cast("array<int>")))
    at = geo.in_levels(at, "lon", "lat", "lon", "lat", 4 * reach)
    met = at.join(placed, ["level", "cell_x", "cell_y"]).where("lon between x1 and x2 and lat between y1 and y2")
    d = F.round(geo.polyline_distance(F.col("lon"), F.col("lat"), F.col("points")), 12)
    met = met.withColumn("distance_deg", d).withColumn("cost", F.round(F.col("distance_deg") + R.lookup(F.col("osm_highway"), penalties, 0.0), 12))
    best = F.min_by(F.struct("segment_id", "osm_highway", "distance_deg"), F.struct("cost", "segment_id"))
    return points.join(met.groupBy("id").agg(best.alias("m")), "id", "left")


def attach_geometry(events: DataFrame, matched: DataFrame, roads: DataFrame) -> DataFrame:
    """``events`` with their road (matched: id, segment_id) and its points; events without a road keep null."""
    return events.join(matched.select("id", "segment_id"), "id", "left").join(roads.select("segment_id", "points"), "segment_id", "left")


def active_events(asked: DataFrame, calendar: DataFrame) -> DataFrame:
    """For each asked row (segment_id, target_hour, lat, lon): events under way, and the nearest one's distance, decayed impact, venue and label.

    calendar: event_key, venue, label, elat, elon, start_ts, end_ts. An event goes to each hour it touches, and each hour's events are a packed tree; only
    asked hours are looked at. Rows of hours without an event keep none: count 0, distance 10**6 m, impact 0.
    """
    last = F.date_trunc("hour", F.col("end_ts") - F.expr("interval 1 microsecond"))
    busy = calendar.where("end_ts > start_ts").withColumn("target_hour", F.explode(F.sequence(F.date_trunc("hour", "start_ts").cast("timestamp_ntz"), last.cast("timestamp_ntz"), F.expr("interval 1 hour"))))
    busy = staged(busy.join(asked.select("target_hour").distinct(), "target_hour", "left_semi"))
    counts = busy.groupBy("target_hour").agg(F.count("*").alias("active_event_count"))
    near = haversine_nearest(asked, busy.withColumnsRenamed({"elat": "rlat", "elon": "rlon"}), "segment_id", ["venue", "label"], ["event_key"], "target_hour")
    rows = asked.select("segment_id", "target_hour").join(near.hint("merge"), ["segment_id", "target_hour"], "left").join(counts, "target_hour", "left")
    d = F.coalesce(F.round(F.col("distance_km") * 1000, 6), F.lit(1e6))
    return rows.select("segment_id", "target_hour", F.coalesce("active_event_count", F.lit(0)).alias("active_event_count"), d.alias("nearest_event_distance_m"), F.when(F.col("distance_km").isNotNull(), event_decay(d)).otherwise(0.0).alias("event_impact"), "venue", "label")


def event_decay(metres: Column) -> Column:
    return F.coalesce(F.exp(-metres / 1000), F.lit(0.0))


def near_lines(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Pairs of lines (id, other) with different ids and a distance of ``reach`` at most, once each. a, b: id, points (lon, lat).

    Lines are cut into straight pieces. A piece's box is in the level of the grid whose cells are as large as it; pieces of equal levels meet there, and a smaller one is also
    put into the larger levels, four cells at most in each. A pair of pieces counts in the cell that has the lower left corner of what their boxes share.
    """
    unit = 4 * reach
    left, right = [_pieces(x, grown).withColumn("level", geo.level("x1", "y1", "x2", "y2", unit)) for x, grown in ((a, reach), (b, 0.0))]
    left, right = (x.select(*[F.col(c).alias(f"{side}_{c}") if c != "level" else F.col(c) for c in x.columns]) for x, side in ((left, "a"), (right, "b")))
    pairs = None
    for own, other, also in ((left, right, True), (right, left, False)):
        i, j = own.columns[0][0], other.columns[0][0]
        levels = F.array(*map(F.lit, geo.levels(own))).cast("array<int>")
        above = F.filter(levels, lambda n: n >= F.col("level") if also else n > F.col("level"))  # noqa: B023
        placed = geo.in_levels(own, *[f"{i}_{c}" for c in ("x1", "y1", "x2", "y2")], unit)
        probes = geo.in_levels(other.withColumn("level", F.explode(above)), *[f"{j}_{c}" for c in ("x1", "y1", "x2", "y2")], unit)
        met = placed.join(probes, ["level", "cell_x", "cell_y"]).where("a_id != b_id and a_x1 <= b_x2 and b_x1 <= a_x2 and a_y1 <= b_y2 and b_y1 <= a_y2")
        size = F.lit(unit) * F.pow(F.lit(2.0), F.col("level"))
        met = met.where((F.floor(F.greatest("a_x1", "b_x1") / size) == F.col("cell_x")) & (F.floor(F.greatest("a_y1", "b_y1") / size) == F.col("cell_y")))
        met = met.select("a_id", "b_id", "a_piece", "b_piece")
        pairs = met if pairs is None else pairs.unionByName(met)
    ends = [F.col(f"{side}_piece.{c}") for side in "ab" for c in ("px", "py", "qx", "qy")]
    near = pairs.withColumn("d", geo.pieces_distance(*ends)).where(F.col("d") <= reach)
    return near.groupBy(F.col("a_id").alias("id"), F.col("b_id").alias("other")).agg(F.min("d").alias("distance"))


def _pieces(lines: DataFrame, grown: float) -> DataFrame:
    """id, piece (its ends) and its box, grown on all sides, for each straight piece of ``lines``."""
    p = F.col("points")
    piece = lambda i: F.struct(p[i - 1]["lon"].alias("px"), p[i - 1]["lat"].alias("py"), p[i]["lon"].alias("qx"), p[i]["lat"].alias("qy"))
    rows = lines.where(F.size("points") > 1).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("points") - 1), piece)).alias("piece"))
    c = {n: F.col(f"piece.{n}") for n in ("px", "py", "qx", "qy")}
    return rows.withColumns({"x1": F.least(c["px"], c["qx"]) - grown, "y1": F.least(c["py"], c["qy"]) - grown, "x2": F.greatest(c["px"], c["qx"]) + grown, "y2": F.greatest(c["py"], c["qy"]) + grown})


def ripples(rows: DataFrame, lines: DataFrame, least: float = 70.0, reach_m: float = 40.0, degree_m: float = 111000.0) -> DataFrame:
    """Spill-over from rows with eps of ``least`` to the roads that come within ``reach_m`` of theirs in the same hour.

    rows: segment_id, target_hour, eps and what else goes along. lines: segment_id, points (lon, lat); each road is in it once. The decay follows the distance of the lines' centroids.
    Which roads are near is found once for each road, not for each hour. Roads without a line neither spill nor are reached.
    """
    sources = rows.where(F.col("eps") >= least).select(F.col("segment_id").alias("source_bottleneck"), "target_hour", F.col("eps").alias("source_eps"))
    known = lines.where(F.size("points") > 1).select(F.col("segment_id").alias("id"), "points")
    pairs = near_lines(known.join(sources.select(F.col("source_bottleneck").alias("id")).distinct(), "id", "left_semi"), known, reach_m / degree_m)
    lon, lat = geo.line_centroid(F.col("points"))
    middle = known.select("id", lon.alias("lon"), lat.alias("lat"))
    pairs = pairs.join(middle, "id").join(middle.select(F.col("id").alias("other"), F.col("lon").alias("olon"), F.col("lat").alias("olat")), "other")
    metres = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) * 1000
    pairs = pairs.select(F.col("id").alias("source_bottleneck"), F.col("other").alias("segment_id"), metres.alias("distance_m"))
    met = sources.join(pairs, "source_bottleneck").join(rows.drop("eps"), ["segment_id", "target_hour"])
    met = met.withColumn("decay", ripple_decay(F.col("distance_m")))
    return met.withColumn("eps_spillover", F.bround(F.round(F.col("source_eps") * F.col("decay"), 9), 2)).drop("source_eps")


def ripple_decay(metres: Column) -> Column:
    return F.greatest(F.lit(0.65), 0.97 - 0.32 * metres / 40)
