"""Queries of the spatial, tag, context, metric and publication operators with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import ranks
from ..functions import refdata as R
from ..functions.shared import dealt, running_sum, staged
from ..operators import clean, context, metrics, spatial, tags
from . import core, fixtures
from .core import register, rounded
from .fixtures import view
from .sql import case

HAV = "2 * {r} * asin(least(1.0::DOUBLE, sqrt(sin(radians({b} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({b})) * sin(radians({d} - {c}) / 2) ** 2)))"


def hav(a: str, c: str, b: str, d: str, r: str = "6371.0088::DOUBLE") -> str:
    return HAV.format(a=a, b=b, c=c, d=d, r=r)


def _utm_sql(lat: str, lon: str) -> tuple[str, str]:
    """The projection in one SELECT-less pair of DuckDB expressions."""
    e2 = "0.0066943799901413165::DOUBLE"
    ep2 = "0.006739496742276434::DOUBLE"
    nu = f"(6378137.0::DOUBLE / sqrt(1 - {e2} * sin(radians({lat})) ** 2))"
    t, c, w = f"(tan(radians({lat})) ** 2)", f"({ep2} * cos(radians({lat})) ** 2)", f"(cos(radians({lat})) * (radians({lon}) - radians(75.0::DOUBLE)))"
    arc = f"(6378137.0::DOUBLE * ((1 - {e2}/4 - 3*{e2}**2/64 - 5*{e2}**3/256) * radians({lat}) - (3*{e2}/8 + 3*{e2}**2/32 + 45*{e2}**3/1024) * sin(2*radians({lat})) + (15*{e2}**2/256 + 45*{e2}**3/1024) * sin(4*radians({lat})) - (35*{e2}**3/3072) * sin(6*radians({lat}))))"
    x = f"(500000 + 0.9996::DOUBLE * {nu} * ({w} + (1 - {t} + {c}) * {w}**3 / 6 + (5 - 18*{t} + {t}**2 + 72*{c} - 58*{ep2}) * {w}**5 / 120))"
    y = f"(0.9996::DOUBLE * ({arc} + {nu} * tan(radians({lat})) * ({w}**2 / 2 + (5 - {t} + 9*{c} + 4*{c}**2) * {w}**4 / 24 + (61 - 58*{t} + {t}**2 + 600*{c} - 330*{ep2}) * {w}**6 / 720)))"
    return x, y


_SX, _SY = _utm_sql("lat_center", "lon_center")
_PX, _PY = _utm_sql("lat", "lon")
_SM = f"sm AS (SELECT segment_id, {_SX} AS x, {_SY} AS y FROM seg)"
_PM = f"pm AS (SELECT poi_id, {case('lower(trim(poi_type))', R.POI_TYPE, 'none')} AS kind, {_PX} AS x, {_PY} AS y FROM pois)"
_LM = f"lm AS (SELECT parking_id, {_PX} AS x, {_PY} AS y, capacity_tag, area_m2 FROM parking)"


def segments_m(spark: SparkSession, sf_dir: str, dimension: DataFrame | None = None) -> DataFrame:
    x, y = geo.utm(F.col("lat_center"), F.col("lon_center"))
    return (dimension or core.dimension(spark, sf_dir)).select("segment_id", x.alias("lx"), y.alias("ly"))


def pois_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.utm(F.col("lat"), F.col("lon"))
    return view(spark, sf_dir, "pois").select("poi_id", tags.poi_type_of_synonym(F.col("poi_type")).alias("poi_type"), x.alias("rx"), y.alias("ry")).where("poi_type is not null")


def lots_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.utm(F.col("lat"), F.col("lon"))
    spaces, source = tags.capacity_estimate(tags.capacity(F.col("capacity_tag")), F.col("area_m2"))
    rows = dealt(view(spark, sf_dir, "parking"), "parking_id").select("parking_id", x.alias("rx"), y.alias("ry"), spaces.alias("estimated_capacity"), source.alias("capacity_source"))
    return staged(rows)  # or each filter works the places out anew, in the one or two tasks that read so small a file


# --- tags and lookups -------------------------------------------------------------------------------
@register("B12_highway_class", f"SELECT segment_id, osm_highway, {case('lower(osm_highway)', {h: c for c, hs in R.HIGHWAY_CLASS.items() for h in hs}, 'residential')} AS road_class FROM roads")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "roads").select("segment_id", "osm_highway", clean.road_class_of_highway(F.col("osm_highway")).alias("road_class"))


@register("A2_road_table", "SELECT segment_id, osm_highway FROM roads WHERE osm_highway NOT IN ({})".format(", ".join(f"'{h}'" for h in R.EXCLUDED_HIGHWAYS)))
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import elements

    r = view(spark, sf_dir, "roads")
    number = F.regexp_extract("segment_id", r"(\d+)$", 1).cast("long")
    none = F.lit(None)
    nodes = r.select(F.explode(F.array(F.struct((number * 2).alias("id"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), F.struct((number * 2 + 1).alias("id"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))).alias("n")).select(F.lit("node").alias("type"), "n.*", none.cast("array<long>").alias("nodes"), none.cast("map<string,string>").alias("tags"))
    ways = r.select(F.lit("way").alias("type"), number.alias("id"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.array(number * 2, number * 2 + 1).alias("nodes"), F.create_map(F.lit("highway"), F.col("osm_highway")).alias("tags"))
    return elements.roads(nodes.unionByName(ways)).select("segment_id", "osm_highway")


@register("B25_relevance", "SELECT segment_id, target_hour, CASE WHEN count_total <= 2 THEN 0 WHEN count_total <= 10 THEN 1 WHEN count_total <= 30 THEN 2 ELSE 3 END AS relevance FROM hours")
def b25(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("count_total")
    return core.hours(spark, sf_dir).select("segment_id", "target_hour", F.when(n <= 2, 0).when(n <= 10, 1).when(n <= 30, 2).otherwise(3).alias("relevance"))


@register("B26_haversine", f"SELECT segment_id, round({hav('lat_center', 'lon_center', '12.9716::DOUBLE', '77.5946::DOUBLE')}, 6) AS km FROM seg")
def b26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(core.dimension(spark, sf_dir).select("segment_id", geo.haversine_km(F.col("lat_center"), F.col("lon_center"), F.lit(12.9716), F.lit(77.5946)).alias("km")))


@register("B27_utm", f"SELECT * FROM (WITH {_SM} SELECT segment_id, round(x, 3) AS x, round(y, 3) AS y FROM sm)")
def b27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments_m(spark, sf_dir).select("segment_id", F.col("lx").alias("x"), F.col("ly").alias("y")), 3)


@register("B28_wkt_centroid", "SELECT segment_id, round((lon1 + lon2) / 2, 6) AS lon, round((lat1 + lat2) / 2, 6) AS lat FROM roads")
def b28(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("LINESTRING (%.12f %.12f, %.12f %.12f)", "lon1", "lat1", "lon2", "lat2")
    lon, lat = geo.line_centroid(F.col("p"))
    return rounded(view(spark, sf_dir, "roads").select("segment_id", geo.wkt_points(text).alias("p")).select("segment_id", lon.alias("lon"), lat.alias("lat")))


@register("B29_ring_area", "SELECT parking_id, round(area_m2 * 2, 6) AS area FROM parking WHERE area_m2 > 0")
def b29(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), (F.col("area_m2") * y).alias("y"))
    ring = F.array(at(0, 0), at(2, 0), at(2, 1), at(0, 1), at(0, 0))
    return rounded(view(spark, sf_dir, "parking").where("area_m2 > 0").select("parking_id", geo.ring_area(ring).alias("area")))


_CAP = "CASE WHEN capacity_tag IS NULL OR lower(trim(capacity_tag)) IN ('yes') THEN NULL WHEN contains(capacity_tag, '-') THEN greatest(CAST(split_part(capacity_tag, '-', 1) AS DOUBLE), CAST(split_part(capacity_tag, '-', 2) AS DOUBLE)) ELSE CAST(regexp_extract(capacity_tag, '[0-9.]+') AS DOUBLE) END"


@register("B30_capacity", f"SELECT parking_id, {_CAP} AS capacity FROM parking")
def b30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "parking").select("parking_id", tags.capacity(F.col("capacity_tag")).alias("capacity"))


_EST = f"(SELECT parking_id, round(coalesce({_CAP}, greatest(1.0::DOUBLE, area_m2 / 15), 8.0::DOUBLE), 6) AS estimated_capacity, CASE WHEN ({_CAP}) IS NOT NULL THEN 'tag' WHEN area_m2 > 0 THEN 'area' ELSE 'default' END AS capacity_source FROM (SELECT parking_id, capacity_tag, CASE WHEN area_m2 > 0 THEN area_m2 END AS area_m2 FROM parking))".replace("greatest(1.0::DOUBLE, area_m2 / 15)", "CASE WHEN area_m2 > 0 THEN greatest(1.0::DOUBLE, area_m2 / 15) END")


@register("B31_capacity_estimate", f"SELECT * FROM {_EST}")
def b31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lots_m(spark, sf_dir).select("parking_id", "estimated_capacity", "capacity_source"))


@register("B33_structures", "SELECT segment_id, location, CAST(CAST(regexp_extract(segment_id, '[0-9]+$') AS INT) % 3 <> 1 OR contains(upper(location), 'BRIDGE') AS INT) AS is_structure FROM (SELECT segment_id, 'Old ' || CASE WHEN osm_highway = 'primary' THEN 'Bridge' ELSE 'Street' END AS location FROM roads)")
def b33(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("segment_id", r"(\d+)$", 1).cast("int")
    text = F.when(n % 3 == 0, '{"Bridge": "yes"}').when(n % 3 == 1, "bridge=no; layer=0").otherwise("tunnel=no;layer=-1")
    r = view(spark, sf_dir, "roads").select("segment_id", F.concat(F.lit("Old "), F.when(F.col("osm_highway") == "primary", "Bridge").otherwise("Street")).alias("location"), tags.tag_map(text).alias("t"))
    return r.select("segment_id", "location", tags.is_structure(F.col("t"), F.col("location")).cast("int").alias("is_structure"))


@register("B37_poi_type_of_tags", f"SELECT poi_id, {case('poi_type', {'subway': 'metro', 'retail': 'commercial', 'School': 'school', 'clinic': 'hospital', 'pub': 'nightlife'}, 'office')} AS kind FROM pois")
def b37(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("poi_type")
    pairs = F.when(t == "subway", F.create_map(F.lit("railway"), F.lit("station"), F.lit("station"), F.lit("subway"))).when(t == "retail", F.create_map(F.lit("landuse"), t)).when(t == "unknown_kind", F.create_map(F.lit("office"), F.lit("yes"))).otherwise(F.create_map(F.lit("amenity"), t))
    return view(spark, sf_dir, "pois").select("poi_id", tags.poi_type_of_tags(pairs).alias("kind"))


@register("B38_poi_synonyms", f"SELECT * FROM (SELECT poi_id, {case('lower(trim(poi_type))', R.POI_TYPE, 'none')} AS kind FROM pois) WHERE kind <> 'none'")
def b38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pois_m(spark, sf_dir).select("poi_id", F.col("poi_type").alias("kind"))


@register("B39_poi_id", "SELECT poi_id, CASE s WHEN 0 THEN poi_id WHEN 1 THEN 'osm:node:' || poi_id ELSE printf('%s:%.7f:%.7f:%s', poi_type, lat, lon, substr(name, 1, 60)) END AS stable_id FROM (SELECT *, CAST(substr(poi_id, 5) AS INT) % 3 AS s FROM pois)")
def b39(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.substring("poi_id", 5, 12).cast("int") % 3, F.col
    made = tags.poi_id(F.when(s == 0, c("poi_id")), F.lit("node"), F.when(s == 1, c("poi_id")), c("poi_type"), c("lat"), c("lon"), c("name"))
    return view(spark, sf_dir, "pois").select("poi_id", made.alias("stable_id"))


@register("B40_road_key", "SELECT segment_id, 'rk_' || concat_ws('_', replace(lower(police_station), ' ', '_'), nullif(replace(lower(junction_name), ' ', '_'), 'unknown'), road_class) AS road_key FROM dim")
def b40(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return core.dimension(spark, sf_dir).select("segment_id", tags.road_key(c("police_station"), c("junction_name"), F.lit(" "), c("road_class"), F.lit(None)).alias("road_key"))


@register("B42_ripple_decay", "SELECT segment_id, round(greatest(0.65::DOUBLE, 0.97::DOUBLE - 0.32::DOUBLE * event_count / 40), 6) AS decay FROM seg")
def b42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(core.dimension(spark, sf_dir).select("segment_id", spatial.ripple_decay(F.col("event_count")).alias("decay")))


@register("B44_dominant_class", "SELECT segment_id, target_hour, c AS dominant_class, round(least(100.0::DOUBLE, w / road_width_m * 100), 6) AS blockage FROM (SELECT *, CASE c " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in R.CLASS_WIDTH.items()) + " END AS w FROM (SELECT *, CASE " + " ".join(f"WHEN count_{k} = g THEN '{k}'" for k in R.CLASSES) + " END AS c FROM (SELECT *, greatest(" + ", ".join(R.COUNTS) + ") AS g FROM to_score)))")
def b44(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.array_max(F.array(*[F.struct(F.col(f"count_{c}").alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c"), F.lit(R.CLASS_WIDTH[c]).alias("w")) for i, c in enumerate(R.CLASSES)]))
    rows = core.to_score(spark, sf_dir).withColumn("b", best)
    return rounded(rows.select("segment_id", "target_hour", F.col("b.c").alias("dominant_class"), F.least(F.lit(100.0), F.col("b.w") / F.col("road_width_m") * 100).alias("blockage")))


@register("B45_congestion_label", "SELECT segment_id, target_hour, CASE WHEN congestion > 1.2 THEN 'heavy' WHEN congestion > 1.05 THEN 'slow' ELSE 'free' END AS congestion_label FROM to_score")
def b45(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("congestion")
    return core.to_score(spark, sf_dir).select("segment_id", "target_hour", F.when(m > 1.2, "heavy").when(m > 1.05, "slow").otherwise("free").alias("congestion_label"))


@register("B43_congestion_multiplier", "SELECT segment_id, target_hour, round(CASE WHEN hour % 3 = 0 THEN (60.0::DOUBLE + count_total) / 60 WHEN hour % 3 = 1 THEN 40.0::DOUBLE / (20 + hour) ELSE 1.0::DOUBLE END, 6) AS multiplier FROM hours")
def b43(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import congestion_multiplier

    h, c = F.col("hour") % 3, F.col
    m = congestion_multiplier(F.when(h == 0, 60.0 + c("count_total")), F.when(h == 0, F.lit(60.0)), F.when(h == 1, (20 + c("hour")).cast("double")), F.when(h == 1, F.lit(40.0)))
    return rounded(core.hours(spark, sf_dir).select("segment_id", "target_hour", m.alias("multiplier")))


# --- spatial joins ----------------------------------------------------------------------------------
_LINES = "ln AS (SELECT segment_id AS road, osm_highway, lon1, lat1, lon2, lat2 FROM roads)"
_ALONG = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((e.longitude - lon1) * (lon2 - lon1) + (e.latitude - lat1) * (lat2 - lat1)) / ((lon2 - lon1) ** 2 + (lat2 - lat1) ** 2)))"
_DIST = f"round(sqrt((e.longitude - (lon1 + {_ALONG} * (lon2 - lon1))) ** 2 + (e.latitude - (lat1 + {_ALONG} * (lat2 - lat1))) ** 2), 12)"
_BOX = "e.longitude BETWEEN least(lon1, lon2) - 0.002::DOUBLE AND greatest(lon1, lon2) + 0.002::DOUBLE AND e.latitude BETWEEN least(lat1, lat2) - 0.002::DOUBLE AND greatest(lat1, lat2) + 0.002::DOUBLE"


def match_sql(cost: str | None, shown: str = "id, road AS segment_id, round(d, 9) AS distance_deg") -> str:
    """Over all pairs: the road of least distance plus ``cost`` among those of the point's box, and where it has none, or without a ``cost`` always, the plain nearest."""
    order = f"inside DESC, CASE WHEN inside THEN round(d + {cost}, 12) ELSE d END" if cost else "d"
    pairs = f"SELECT e.id, ln.*, {_DIST} AS d, {_BOX} AS inside FROM cleaned1 e, ln"
    return f"SELECT {shown} FROM (WITH {_LINES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}, road) AS n FROM ({pairs})) WHERE n = 1)"


def _match(spark: SparkSession, sf_dir: str, penalties: dict | None) -> DataFrame:
    e = clean.clean_events(view(spark, sf_dir, "violations")).select("id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    point = lambda i: F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"))
    r = view(spark, sf_dir, "roads").select("segment_id", "osm_highway", F.array(point(1), point(2)).alias("points"))
    return rounded(spatial.match_roads(e, r, penalties=penalties).select("id", "segment_id", "distance_deg"), 9)


@register("C1_map_matching", match_sql(case("osm_highway", R.SNAP_PENALTY, 0.0)))
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, None)


@register("C2_nearest_edge", match_sql(None))
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, {})


@register("C11_nearest_poi", f"SELECT * FROM (WITH {_SM}, {_PM} SELECT segment_id, kind AS poi_type, round(min(sqrt((sm.x - pm.x) ** 2 + (sm.y - pm.y) ** 2)), 3) AS distance FROM sm, pm WHERE kind <> 'none' GROUP BY 1, 2)")
def c11(spark: SparkSession, sf_dir: str, dimension: DataFrame | None = None) -> DataFrame:
    return rounded(spatial.ring_nearest(segments_m(spark, sf_dir, dimension), pois_m(spark, sf_dir), "segment_id", "poi_id", [], "poi_type").select("segment_id", "poi_type", "distance"), 3)


@register("C12_radius_counts", f"SELECT * FROM (WITH {_SM}, {_PM} SELECT segment_id, count(d) FILTER (d <= 200) AS poi_count_200m, count(d) AS poi_count_500m, round(coalesce(1000 * sum({case('kind', R.POI_GRAVITY, 1.0)} / greatest(10.0::DOUBLE, d) ** 1.5) FILTER (d IS NOT NULL), 0), 6) AS poi_gravity_score FROM (SELECT segment_id, kind, sqrt((sm.x - pm.x) ** 2 + (sm.y - pm.y) ** 2) AS d FROM sm LEFT JOIN pm ON kind <> 'none' AND sqrt((sm.x - pm.x) ** 2 + (sm.y - pm.y) ** 2) <= 500) GROUP BY 1)")
def c12(spark: SparkSession, sf_dir: str, dimension: DataFrame | None = None) -> DataFrame:
    return rounded(spatial.radius_counts(segments_m(spark, sf_dir, dimension), pois_m(spark, sf_dir), "segment_id"))


_NEAREST_LOT = f"(WITH {_SM}, {_LM} SELECT segment_id, parking_id, d AS distance FROM (SELECT segment_id, parking_id, round(sqrt((sm.x - lm.x) ** 2 + (sm.y - lm.y) ** 2), 6) AS d, row_number() OVER (PARTITION BY segment_id ORDER BY sqrt((sm.x - lm.x) ** 2 + (sm.y - lm.y) ** 2), parking_id) AS n FROM sm, lm) WHERE n = 1)"


def nearest_lots(spark: SparkSession, sf_dir: str, dimension: DataFrame | None = None) -> DataFrame:
    return spatial.ring_nearest(segments_m(spark, sf_dir, dimension), lots_m(spark, sf_dir), "segment_id", "parking_id", ["estimated_capacity"])


@register("C13_nearest_parking", f"SELECT segment_id, parking_id, round(distance, 3) AS distance, estimated_capacity FROM {_NEAREST_LOT} JOIN {_EST} USING (parking_id)")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nearest_lots(spark, sf_dir).select("segment_id", "parking_id", F.round("distance", 3).alias("distance"), "estimated_capacity"))


@register("D13_volume_scale", "SELECT round(greatest(1.0::DOUBLE, quantile_cont(event_count::DOUBLE, 0.95)), 6) AS scale FROM seg WHERE event_count > 0")
def d13(spark: SparkSession, sf_dir: str, dimension: DataFrame | None = None) -> DataFrame:
    rows = (dimension or core.dimension(spark, sf_dir)).where("event_count > 0")
    p = ranks.percentiles(rows, {"scale": F.col("event_count")}, 0.95)["scale"]
    return rounded(ranks.one_row(rows, {"scale": max(1.0, p or 0.0)}))


@register("B32_overflow_risk", f"SELECT segment_id, round(100 * (1 - exp(-(event_count / (SELECT greatest(1.0::DOUBLE, quantile_cont(event_count::DOUBLE, 0.95)) FROM seg) * (1 + greatest(0.0::DOUBLE, least(3.0::DOUBLE, distance / 500))) / greatest(0.35::DOUBLE, sqrt(greatest(estimated_capacity, 1) / 8))))), 4) AS overflow_risk FROM seg JOIN {_NEAREST_LOT} USING (segment_id) JOIN {_EST} USING (parking_id)")
def b32(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.dimension(spark, sf_dir).select("segment_id", "event_count").join(nearest_lots(spark, sf_dir), "segment_id").join(F.broadcast(d13(spark, sf_dir)))
    return rounded(rows.select("segment_id", tags.overflow_risk(F.col("event_count"), F.col("distance"), F.col("estimated_capacity"), F.col("scale")).alias("overflow_risk")), 4)


_NEAR_SEG = f"SELECT event_key, segment_id, round(d, 6) AS distance_km FROM (SELECT event_key, segment_id, d, row_number() OVER (PARTITION BY event_key ORDER BY d, segment_id) AS n FROM (SELECT event_key, segment_id, round({hav('latitude', 'longitude', 'lat_center', 'lon_center')}, 9) AS d FROM calendar, seg)) WHERE n = 1"


@register("C18_nearest_segment", _NEAR_SEG)
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = view(spark, sf_dir, "calendar").select("event_key", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    d = core.dimension(spark, sf_dir).select("segment_id", F.col("lat_center").alias("rlat"), F.col("lon_center").alias("rlon"))
    return rounded(spatial.haversine_nearest(q, d, "event_key", ["segment_id"], ["segment_id"]).select("event_key", "segment_id", "distance_km"))


@register("C19_nearest_station", f"SELECT segment_id, venue AS station, round_even(d * 1000, 0) AS metres, CAST(greatest(3, round_even(d / 15 * 60, 0)) AS INT) AS eta_min FROM (SELECT segment_id, venue, d, row_number() OVER (PARTITION BY segment_id ORDER BY d, venue) AS n FROM (SELECT segment_id, venue, round({hav('lat_center', 'lon_center', 'latitude', 'longitude')}, 9) AS d FROM seg, calendar)) WHERE n = 1")
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = core.dimension(spark, sf_dir).select("segment_id", F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon"))
    st = view(spark, sf_dir, "calendar").select(F.col("venue").alias("station"), F.col("latitude").alias("rlat"), F.col("longitude").alias("rlon"))
    n = spatial.haversine_nearest(s, st, "segment_id", ["station"], ["station"])
    km = F.col("distance_km")
    return n.select("segment_id", "station", F.bround(km * 1000, 0).alias("metres"), F.greatest(F.lit(3), F.bround(km / 15 * 60, 0).cast("int")).alias("eta_min"))


_CAL = "cal AS (SELECT *, TIMESTAMP '2024-01-01' + start_hour_offset * INTERVAL 1 HOUR AS start_ts, TIMESTAMP '2024-01-01' + end_hour_offset * INTERVAL 1 HOUR AS end_ts FROM calendar)"
_EV = f"SELECT * FROM (WITH {_CAL}, hh AS (SELECT DISTINCT target_hour FROM hours), p AS (SELECT segment_id, target_hour, event_key, venue, label, round({hav('lat_center', 'lon_center', 'latitude', 'longitude')} * 1000, 6) AS d FROM seg, hh, cal WHERE start_ts < target_hour + INTERVAL 1 HOUR AND end_ts > target_hour), r AS (SELECT *, count(*) OVER (PARTITION BY segment_id, target_hour) AS c, row_number() OVER (PARTITION BY segment_id, target_hour ORDER BY d, event_key) AS n FROM p) SELECT s.segment_id, hh.target_hour, coalesce(c, 0) AS active_event_count, round(coalesce(d, 1e6), 3) AS nearest_event_distance_m, round(coalesce(exp(-d / 1000), 0), 6) AS event_impact, venue FROM seg s CROSS JOIN hh LEFT JOIN r ON r.segment_id = s.segment_id AND r.target_hour = hh.target_hour AND n = 1)"


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    at = lambda c: base + F.make_dt_interval(F.lit(0), F.col(c))
    return view(spark, sf_dir, "calendar").select("event_key", "venue", "label", F.col("latitude").alias("elat"), F.col("longitude").alias("elon"), at("start_hour_offset").alias("start_ts"), at("end_hour_offset").alias("end_ts"))


@register("C9_active_events", _EV)
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = core.dimension(spark, sf_dir).select("segment_id", F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon"))
    hours = core.hours(spark, sf_dir).select("target_hour").distinct()  # each segment is asked for at each of them
    r = spatial.active_events(s.join(F.broadcast(hours)), calendar_events(spark, sf_dir))
    return r.select("segment_id", "target_hour", "active_event_count", F.round("nearest_event_distance_m", 3).alias("nearest_event_distance_m"), F.round("event_impact", 6).alias("event_impact"), "venue")


@register("C10_calendar_hubs", "SELECT event_key, venue, latitude, longitude FROM calendar")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import join_hubs

    c = view(spark, sf_dir, "calendar")
    return join_hubs(c.select("event_key", "venue"), c.select("venue", "latitude", "longitude")).select("event_key", "venue", "latitude", "longitude")


def _booked(spark: SparkSession, sf_dir: str, hubs: bool) -> DataFrame:
    """Hubs or events as text, as a file has them, some of them faulty."""
    name, key = ("supplier", "s_suppkey") if hubs else ("orders", "o_orderkey")
    rows = fixtures.table(spark, sf_dir, name)
    return rows.selectExpr(*(HUBS if hubs else BOOKINGS)(key))


def HUBS(k: str) -> list[str]:  # noqa: N802
    return [f"CASE WHEN {k} % 11 = 3 THEN '  ' WHEN {k} % 13 = 5 THEN 'Hub 1' ELSE concat(' Hub ', CAST({k} AS VARCHAR(12)), ' ') END AS venue", f"CASE WHEN {k} % 17 = 6 THEN 'north' ELSE CAST({k} % 80 AS VARCHAR(12)) END AS latitude", f"CASE WHEN {k} % 19 = 7 THEN NULL ELSE CAST({k} % 170 AS VARCHAR(12)) END AS longitude"]


def BOOKINGS(k: str) -> list[str]:  # noqa: N802
    day, hour = f"concat('2024-01-', CAST(10 + {k} % 20 AS VARCHAR(12)))", f"CAST(10 + {k} % 7 AS VARCHAR(12))"
    return [f"{k} AS event_id", f"CASE WHEN {k} % 23 = 4 THEN ' ' ELSE concat('Hub ', CAST({k} % 9 AS VARCHAR(12))) END AS venue", f"CASE WHEN {k} % 29 = 8 THEN 'soon' WHEN {k} % 5 = 0 THEN concat({day}, 'T', {hour}, ':00:00Z') ELSE concat({day}, ' ', {hour}, ':30:00') END AS start_ts",
            f"CASE WHEN {k} % 31 = 9 THEN '' WHEN {k} % 37 = 10 THEN '2024-01-01 00:00:00' ELSE concat({day}, ' 22:15:00') END AS end_ts", f"CASE WHEN {k} % 3 = 0 THEN NULL ELSE 'match' END AS label"]


_HUBS = f"hb AS (SELECT trim(venue) AS venue, TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(longitude AS DOUBLE) AS longitude, count(*) OVER (PARTITION BY trim(venue)) AS n FROM (SELECT {', '.join(HUBS('s_suppkey'))} FROM supplier)), hf AS (SELECT venue, latitude, longitude, list_filter([CASE WHEN venue = '' THEN 'blank venue' END, CASE WHEN n > 1 AND venue <> '' THEN 'repeated venue' END, CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'no number' END], lambda x: x IS NOT NULL) AS f FROM hb)"
_TIME = "CASE WHEN {c} LIKE '%Z' THEN TRY_CAST(left({c}, -1) AS TIMESTAMP) + INTERVAL 330 MINUTE ELSE TRY_CAST({c} AS TIMESTAMP) END"
_BOOKED = f"""{_HUBS}, bk AS (SELECT event_id, trim(venue) AS venue, coalesce(label, '') AS label, {_TIME.format(c='start_ts')} AS start_ts, {_TIME.format(c='end_ts')} AS end_ts FROM (SELECT {', '.join(BOOKINGS('o_orderkey'))} FROM orders)),
 bf AS (SELECT bk.*, h.latitude, h.longitude, list_filter([CASE WHEN bk.venue = '' THEN 'blank venue' END, CASE WHEN start_ts IS NULL THEN 'no start' END, CASE WHEN end_ts IS NULL THEN 'no end' END, CASE WHEN end_ts <= start_ts THEN 'end not after start' END, CASE WHEN bk.venue <> '' AND h.latitude IS NULL THEN 'no hub' END], lambda x: x IS NOT NULL) AS f FROM bk LEFT JOIN (SELECT * FROM hf WHERE len(f) = 0) h ON h.venue = bk.venue)"""


def loaded_hubs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return context.routed(context.checked_hubs(_booked(spark, sf_dir, True)))


def loaded_calendar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return context.routed(context.checked_calendar(_booked(spark, sf_dir, False), loaded_hubs(spark, sf_dir)[0]))


@register("A6_hubs", f"WITH {_HUBS} SELECT venue, latitude, longitude FROM hf WHERE len(f) = 0")
def a6_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_hubs(spark, sf_dir)[0]


@register("A6_hub_faults", f"WITH {_HUBS} SELECT venue, latitude, longitude, array_to_string(f, '; ') AS faults FROM hf WHERE len(f) > 0")
def a6_hub_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_hubs(spark, sf_dir)[1].withColumn("faults", F.array_join("faults", "; "))


@register("A6_calendar", f"WITH {_BOOKED} SELECT event_id, venue, label, start_ts, end_ts, latitude, longitude FROM bf WHERE len(f) = 0")
def a6_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_calendar(spark, sf_dir)[0]


@register("A6_calendar_faults", f"WITH {_BOOKED} SELECT event_id, venue, start_ts, end_ts, array_to_string(f, '; ') AS faults FROM bf WHERE len(f) > 0")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_calendar(spark, sf_dir)[1].select("event_id", "venue", "start_ts", "end_ts", F.array_join("faults", "; ").alias("faults"))


_RAIN = "wx AS (SELECT target_hour, CASE WHEN i % 7 = 0 THEN (i % 13) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS rainfall_mm FROM (SELECT target_hour, CAST(date_diff('hour', (SELECT start_hour FROM bounds), target_hour) AS INT) AS i FROM (SELECT unnest(generate_series(start_hour, end_hour, INTERVAL 1 HOUR)) AS target_hour FROM bounds)))"


@register("A7_weather_load", f"SELECT * FROM (WITH {_RAIN} SELECT target_hour, round(rainfall_mm, 6) AS rainfall_mm, CAST(rainfall_mm > 0 AS INT) AS is_raining FROM wx)")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import hourly_weather

    b = core.bounds(spark, sf_dir)
    i = "timestampdiff(HOUR, start_hour, t)"
    rain = b.selectExpr("sequence(start_hour, end_hour, interval 1 hour) AS ts", "start_hour").selectExpr("transform(ts, t -> cast(t as string)) AS time", f"transform(ts, t -> CASE WHEN {i} % 7 = 0 THEN cast({i} % 13 as double) / 10 END) AS rain", "cast(null as array<double>) AS precipitation")
    return rounded(hourly_weather(rain, b))


@register("C8_weather_join", f"SELECT * FROM (WITH {_RAIN} SELECT segment_id, h.target_hour, round(coalesce(rainfall_mm, 0), 6) AS rainfall_mm FROM hours h LEFT JOIN wx USING (target_hour))")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.hours(spark, sf_dir).select("segment_id", "target_hour")
    return context.join_weather(rows, a7(spark, sf_dir)).select("segment_id", "target_hour", "rainfall_mm")


_WET = "SELECT target_hour, count(*) / 10.0::DOUBLE AS mm FROM hours GROUP BY 1"


@register("A7_C8_strict", f"SELECT segment_id, h.target_hour, round(mm, 6) AS rainfall_mm, 1 AS is_raining FROM hours h JOIN ({_WET}) USING (target_hour)")
def weather_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload with a reading for each hour that is asked, loaded and joined in the modes that take a missing hour for an error."""
    rows = core.hours(spark, sf_dir).select("segment_id", "target_hour")
    read = rows.groupBy("target_hour").agg((F.count("*") / 10).alias("mm"))
    spans = rows.groupBy("target_hour").agg(F.first("target_hour").alias("start_hour"), F.first("target_hour").alias("end_hour")).drop("target_hour")
    payload = read.select(F.array(F.col("target_hour").cast("string")).alias("time"), F.array("mm").alias("rain"))
    return rounded(context.join_weather(rows, context.hourly_weather(payload, spans, missing="error"), missing="error").select("segment_id", "target_hour", "rainfall_mm", "is_raining"))


def _apart(p: tuple[str, str], a: tuple[str, str], b: tuple[str, str]) -> str:
    """Distance of a point from a straight piece in DuckDB."""
    (px, py), (ax, ay), (bx, by) = p, a, b
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2, 0), 0)))"
    return f"sqrt(({px} - ({ax} + {t} * ({bx} - {ax}))) ** 2 + ({py} - ({ay} + {t} * ({by} - {ay}))) ** 2)"


def _turn(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    return f"sign(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


_P, _Q, _R, _S = ("a.px", "a.py"), ("a.qx", "a.qy"), ("b.px", "b.py"), ("b.qx", "b.qy")
_CROSS = f"({_turn(_P, _Q, _R)} * {_turn(_P, _Q, _S)} < 0 AND {_turn(_R, _S, _P)} * {_turn(_R, _S, _Q)} < 0)"
_MID = {v: f"(({v}1 + {v}2) / 2 * l1 + ({v}2 + {v}3) / 2 * l2) / (l1 + l2)" for v in "xy"}
RIPPLES = f"""WITH pc AS (SELECT segment_id, x1 AS px, y1 AS py, x2 AS qx, y2 AS qy FROM lines UNION ALL SELECT segment_id, x2, y2, x3, y3 FROM lines),
 mid AS (SELECT segment_id, {_MID['x']} AS lon, {_MID['y']} AS lat FROM (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS l1, sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2) AS l2 FROM lines)),
 met AS (SELECT a.segment_id AS source, b.segment_id AS other, min(CASE WHEN {_CROSS} THEN 0.0::DOUBLE ELSE least({_apart(_P, _R, _S)}, {_apart(_Q, _R, _S)}, {_apart(_R, _P, _Q)}, {_apart(_S, _P, _Q)}) END) AS apart FROM pc a JOIN pc b ON a.segment_id <> b.segment_id GROUP BY 1, 2),
 pr AS (SELECT source, other, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 1000 AS d FROM met JOIN mid a ON a.segment_id = source JOIN mid b ON b.segment_id = other WHERE apart <= 40.0::DOUBLE / 111000)
 SELECT source AS source_bottleneck, b.segment_id, b.target_hour, round_even(round(a.eps * greatest(0.65::DOUBLE, 0.97::DOUBLE - 0.32::DOUBLE * d / 40), 9), 2) AS eps_spillover, round(d, 1) AS distance_m, round(greatest(0.65::DOUBLE, 0.97::DOUBLE - 0.32::DOUBLE * d / 40), 3) AS decay, b.road_class, b.police_station
 FROM scored a JOIN pr ON a.segment_id = source JOIN scored b ON b.segment_id = other AND b.target_hour = a.target_hour WHERE a.eps >= 70"""


def rippling(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scored rows, lines of the roads)."""
    known = core.lines(spark, sf_dir).select("segment_id", geo.wkt_points(F.col("geometry_wkt")).alias("points"))
    return core.scored(spark, sf_dir).select("segment_id", "target_hour", "eps", "road_class", "police_station"), known


def shown_ripples(rows: DataFrame) -> DataFrame:
    return rows.select("source_bottleneck", "segment_id", "target_hour", "eps_spillover", F.round("distance_m", 1).alias("distance_m"), F.round("decay", 3).alias("decay"), "road_class", "police_station")


@register("C16_ripples", f"SELECT * FROM ({RIPPLES})")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_ripples(spatial.ripples(*rippling(spark, sf_dir)))


# --- metrics ----------------------------------------------------------------------------------------
_TEST = "tst AS (SELECT h.*, coalesce(m, 0.0::DOUBLE) AS forecast FROM hours h LEFT JOIN (SELECT segment_id, hour, round(sum(count_total) / greatest(1.0::DOUBLE, (SELECT h FROM span) / 24), 9) AS m FROM train GROUP BY 1, 2) c USING (segment_id, hour) WHERE h.target_hour >= (SELECT cutoff FROM bounds))"


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out facts with the climatology of the training hours as their forecast."""
    from ..operators import facts

    means = facts.climatology(core.train(spark, sf_dir), ["segment_id", "hour"], max(1.0, core.span(spark, sf_dir)[1] / 24), "m")
    rows = core.hours(spark, sf_dir).join(F.broadcast(core.bounds(spark, sf_dir).select("cutoff")), F.col("target_hour") >= F.col("cutoff"))
    return rows.join(means, ["segment_id", "hour"], "left").withColumn("forecast", F.coalesce(F.round("m", 9), F.lit(0.0)))


@register("D16_regression_quality", f"SELECT * FROM (WITH {_TEST} SELECT round(avg(abs(forecast - count_total)), 6) AS mae, round(sqrt(avg((forecast - count_total) ** 2)), 6) AS rmse, round(sum(abs(forecast - count_total)) / greatest(1.0::DOUBLE, sum(count_total)), 6) AS wape FROM tst)")
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.regression_quality(tested(spark, sf_dir), "count_total", "forecast"))


_P = "1 - exp(-forecast)"
_AUC = f"b AS (SELECT is_hotspot AS y, round({_P}, 9) AS p FROM tst)"


@register("D17_binary_quality", f"SELECT * FROM (WITH {_TEST}, {_AUC}, st AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b GROUP BY 1), cu AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM st) SELECT (SELECT round(sum(CASE WHEN a.p > c.p THEN 1.0::DOUBLE WHEN a.p = c.p THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) FROM b a, b c WHERE a.y = 1 AND c.y = 0) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision, (SELECT round(avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))), 6) FROM b) AS log_loss, (SELECT round(avg((p - y) ** 2), 6) FROM b) AS brier FROM cu)")
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tested(spark, sf_dir).withColumn("p", F.round(1 - F.exp(-F.col("forecast")), 9))
    return rounded(metrics.binary_quality(rows, "is_hotspot", "p"))


@register("D18_capture", f"SELECT * FROM (WITH {_TEST}, rk AS (SELECT count_total, row_number() OVER (ORDER BY forecast DESC, segment_id, target_hour) AS r, count(*) OVER () AS n FROM tst) SELECT " + ", ".join(f"round(sum(count_total) FILTER (r <= greatest(1, CAST(floor(n * {s}::DOUBLE) AS BIGINT))) / sum(count_total)::DOUBLE, 6) AS capture_{round(s * 100)}" for s in (0.01, 0.05, 0.1)) + " FROM rk)")
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.capture(tested(spark, sf_dir), "count_total", "forecast", ["segment_id", "target_hour"]))


_K = ", ".join(f"sum(CASE WHEN r <= {k} THEN is_hotspot ELSE 0 END) / {k}.0::DOUBLE AS precision_{k}, coalesce(sum(CASE WHEN r <= {k} THEN count_total / log2(r + 1) ELSE 0 END) / nullif(sum(CASE WHEN i <= {k} THEN count_total / log2(i + 1) ELSE 0 END), 0), 0) AS ndcg_{k}, count(*) FILTER (r <= {k} AND count_total = 0) / {k}.0::DOUBLE AS fdr_{k}" for k in (10, 25, 50))


# the given tables have few roads an hour: the days are ranked
@register("D19_at_k", f"SELECT * FROM (WITH {_TEST}, dy AS (SELECT *, CAST(target_hour AS DATE) AS day FROM tst), rk AS (SELECT *, count(*) OVER (PARTITION BY day) AS n, row_number() OVER (PARTITION BY day ORDER BY forecast DESC, segment_id, target_hour) AS r, row_number() OVER (PARTITION BY day ORDER BY count_total DESC, segment_id, target_hour) AS i FROM dy), ph AS (SELECT day, {_K} FROM rk WHERE n >= 50 GROUP BY 1) SELECT " + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in (10, 25, 50) for m in ("precision", "ndcg", "fdr")) + " FROM ph)")
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tested(spark, sf_dir).withColumn("day", F.to_date("target_hour"))
    return rounded(metrics.at_k(rows, "day", "count_total", "is_hotspot", "forecast", ["segment_id", "target_hour"]))




@register("D20_baselines", "SELECT 'count_total' AS feature, CAST(quantile_cont(count_total::DOUBLE, 0.5) AS DOUBLE) AS baseline, round(stddev_pop(count_total), 6) AS sigma FROM hours UNION ALL SELECT 'hour', CAST(quantile_cont(hour::DOUBLE, 0.5) AS DOUBLE), round(stddev_pop(hour), 6) FROM hours")
def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = core.hours(spark, sf_dir), ["count_total", "hour"]
    middle = ranks.percentiles(rows, {n: F.col(n) for n in names}, 0.5)
    sigma = rows.agg(*[F.stddev_pop(n).alias(n) for n in names])
    return rounded(sigma.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(middle[n]).alias("baseline"), F.col(n).alias("sigma")) for n in names])).alias("f")).select("f.*"))


@register("D21_deviation", "SELECT segment_id, target_hour, round((count_total - (SELECT quantile_cont(count_total::DOUBLE, 0.5) FROM hours)) / (SELECT CASE WHEN stddev_pop(count_total) <= 1e-12 THEN 1 ELSE stddev_pop(count_total) END FROM hours), 6) AS deviation FROM hours")
def d21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.hours(spark, sf_dir)
    middle = ranks.percentiles(rows, {"m": F.col("count_total")}, 0.5)["m"]
    s = F.when(F.col("s") <= 1e-12, 1.0).otherwise(F.col("s"))
    wide = rows.join(F.broadcast(rows.agg(F.stddev_pop("count_total").alias("s"))))  # one row
    return rounded(wide.select("segment_id", "target_hour", ((F.col("count_total") - F.lit(middle)) / s).alias("deviation")))


@register("D22_area_summary", "SELECT police_station, count(DISTINCT segment_id) FILTER (eps >= 50) AS problem_roads, CAST(sum(count_total) AS BIGINT) AS vehicles, round(sum(economic_loss_inr), 2) AS economic_loss_inr FROM scored GROUP BY 1")
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = core.scored(spark, sf_dir).groupBy("police_station").agg(F.countDistinct(F.when(F.col("eps") >= 50, F.col("segment_id"))).alias("problem_roads"), F.sum("count_total").alias("vehicles"), F.sum("economic_loss_inr").alias("economic_loss_inr"))
    return rounded(g, 2)


# --- publication ------------------------------------------------------------------------------------
@register("F2_probe_set", "SELECT segment_id, target_hour, CASE WHEN n <= 15 THEN round(congestion, 6) ELSE 1.0::DOUBLE END AS multiplier FROM (SELECT *, row_number() OVER (ORDER BY count_total DESC, segment_id, target_hour) AS n FROM to_score)")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.to_score(spark, sf_dir).select("segment_id", "target_hour", "count_total", "congestion")
    probes = rows.orderBy(F.desc("count_total"), "segment_id", "target_hour").limit(15).select("segment_id", "target_hour", F.round("congestion", 6).alias("m"))
    return rows.join(F.broadcast(probes), ["segment_id", "target_hour"], "left").select("segment_id", "target_hour", F.coalesce("m", F.lit(1.0)).alias("multiplier"))


@register("F3_publication", "SELECT segment_id, target_hour, eps, CAST(n AS INT) AS n, CAST(n <= 15 AS INT) AS queued FROM (SELECT *, row_number() OVER (ORDER BY eps DESC, segment_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY eps DESC, target_hour) AS k FROM scored) WHERE k = 1) WHERE eps >= 50 OR n <= 40")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.scored(spark, sf_dir).groupBy("segment_id").agg(F.min_by(F.struct("target_hour", "eps"), F.struct(-F.col("eps"), "target_hour")).alias("b")).select("segment_id", "b.*")  # one row a road
    rows = rows.withColumns({"falling": -F.col("eps"), "one": F.lit(1).cast("long")})
    n = running_sum(staged(rows), ["falling", "segment_id"], "one", "ahead").withColumn("n", (F.col("ahead") + 1).cast("int")).drop("falling", "one", "ahead")
    return n.where("eps >= 50 or n <= 40").withColumn("queued", (F.col("n") <= 15).cast("int"))


_PAIR = "(SELECT a.segment_id, a.target_hour, a.eps AS old_eps, b.eps AS new_eps, a.priority_band AS old_band, b.priority_band AS new_band FROM scored a JOIN scored b ON a.segment_id = b.segment_id AND b.target_hour = a.target_hour + INTERVAL 1 HOUR WHERE a.priority_band <> b.priority_band)"


def band_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import band_changes as changes

    s = core.scored(spark, sf_dir).select("segment_id", "target_hour", "eps", "priority_band")
    return changes(s.withColumn("target_hour", F.expr("target_hour + interval 1 hour")), s, ["segment_id", "target_hour"]).withColumn("target_hour", F.expr("target_hour - interval 1 hour"))


@register("C21_band_changes", f"SELECT segment_id, target_hour, old_eps, new_eps, old_band, new_band, CASE WHEN new_eps > old_eps THEN 'escalated' ELSE 'deescalated' END AS direction FROM {_PAIR}")
def c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_changes(spark, sf_dir)


@register("F4_delta_lists", f"SELECT direction, segment_id, target_hour, CAST(total AS BIGINT) AS total FROM (SELECT *, count(*) OVER (PARTITION BY direction) AS total, row_number() OVER (PARTITION BY direction ORDER BY abs(new_eps - old_eps) DESC, segment_id, target_hour) AS n FROM (SELECT *, CASE WHEN new_eps > old_eps THEN 'escalated' ELSE 'deescalated' END AS direction FROM {_PAIR})) WHERE n <= 20")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals are counted apart: with the rank alone each task keeps its first 20 rows of a direction, and only those meet."""
    rows = staged(band_changes(spark, sf_dir).select("direction", "segment_id", "target_hour", F.abs(F.col("new_eps") - F.col("old_eps")).alias("by")))
    n = F.row_number().over(W.partitionBy("direction").orderBy(F.desc("by"), "segment_id", "target_hour"))
    total = rows.groupBy("direction").agg(F.count("*").alias("total"))  # two rows
    return rows.withColumn("n", n).where("n <= 20").join(F.broadcast(total), "direction").select("direction", "segment_id", "target_hour", "total")


@register("A11_geojson_points", "SELECT segment_id, count(*) AS features, round(max(eps), 6) AS eps FROM scored GROUP BY 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import geojson

    lines = geojson.features(core.scored(spark, sf_dir).withColumn("geometry_wkt", F.lit("")).withColumn("map_matching_mode", F.lit("grid_fallback")))
    parsed = lines.select(F.from_json("value", "properties struct<segment_id:string, eps:double>").alias("f"))
    return rounded(parsed.groupBy(F.col("f.properties.segment_id").alias("segment_id")).agg(F.count("*").alias("features"), F.max("f.properties.eps").alias("eps")))


_SHOWN = "properties struct<segment_id:string, target_hour:string, road_name:string, hotspot_probability:double, clearance_m:double, emergency_gridlock_flag:boolean, geometry_wkt:string>, geometry struct<type:string>"


@register("A11_geojson_lines", """SELECT segment_id, strftime(target_hour, '%Y-%m-%d %H:%M:%S') AS target_hour, CASE WHEN hour % 3 = 0 THEN 'LineString' ELSE 'Point' END AS kind, '' AS road_name, 0.0::DOUBLE AS hotspot_probability, round(clearance_after_predicted_load_m, 6) AS clearance_m, emergency_gridlock_flag::BOOLEAN AS gridlock, CASE WHEN hour % 3 = 0 THEN 'LINESTRING (77.5 12.9, 77.6 12.95)' ELSE '' END AS geometry_wkt FROM scored WHERE hour % 3 <> 1""")
def a11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import geojson

    turn = F.col("hour") % 3
    rows = core.scored(spark, sf_dir).withColumns({"geometry_wkt": F.when(turn == 0, "LINESTRING (77.5 12.9, 77.6 12.95)"), "map_matching_mode": F.when(turn == 2, "grid_fallback").otherwise("osm_overpass_nearest_road")})
    parsed = geojson.scored_features(rows).select(F.from_json("value", _SHOWN).alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("kind"))
    return parsed.select("segment_id", "target_hour", "kind", "road_name", "hotspot_probability", F.round("clearance_m", 6).alias("clearance_m"), F.col("emergency_gridlock_flag").alias("gridlock"), "geometry_wkt")


@register("A14_latest_state", "SELECT segment_id, max(target_hour) AS target_hour, arg_max(eps, target_hour) AS eps FROM scored GROUP BY 1")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows arrive in three batches, the middle one twice; each is added to the table of latest states."""
    from ..functions.shared import folder
    from ..streaming import live

    rows, out = core.scored(spark, sf_dir).select("segment_id", "target_hour", "eps"), folder(spark, "latest")
    add = live.upsert(out, "segment_id", "target_hour")
    for number, part in enumerate((1, 2, 0)):
        for _ in range(2 if number == 1 else 1):
            add(rows.where(F.hour("target_hour") % 3 == part), number)
    return live.newest(spark.read.schema(rows.schema).parquet(out).select(*rows.columns), "segment_id", "target_hour")


@register("C24_live_overrides", "SELECT d.segment_id, coalesce(l.eps, 0.0) AS eps FROM dim d LEFT JOIN (SELECT segment_id, arg_max(eps, target_hour) AS eps FROM scored WHERE hour >= 12 GROUP BY 1) l USING (segment_id)")
def c24(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = core.scored(spark, sf_dir).where("hour >= 12").groupBy("segment_id").agg(F.max_by("eps", "target_hour").alias("eps"))
    return core.dimension(spark, sf_dir).select("segment_id").join(live, "segment_id", "left").fillna(0.0, ["eps"])


