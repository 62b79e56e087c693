"""Queries of the remaining joins and loads with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context
from ..sources import elements
from . import core
from .core import rounded
from .fixtures import view
from .sql import oracle

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, oracle(sql)
        return f

    return keep


@register("A3_point_features", "SELECT name, poi_type, lat, lon FROM pois")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "pois").withColumn("n", F.substring("poi_id", 5, 12).cast("int") % 3)
    poi = F.struct("name", "poi_type", "lat", "lon")
    feature = F.struct(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("name", "poi_type").alias("properties"))
    text = F.when(F.col("n") == 0, F.to_json(F.struct(F.array(feature).alias("features")))).when(F.col("n") == 1, F.to_json(F.struct(F.array(poi).alias("pois")))).otherwise(F.to_json(F.array(poi)))
    return elements.point_features(p.select(text.alias("value")))


@register("A4_element_points", "SELECT 'osm:node:' || substr(poi_id, 5) AS poi_id, 'school' AS poi_type, lat, lon FROM pois WHERE CAST(substr(poi_id, 5) AS INT) % 4 <> 3")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.substring("poi_id", 5, 12).cast("int"), F.col
    own, centre = n % 4 == 0, F.struct(c("lat").alias("lat"), c("lon").alias("lon"))
    rows = view(spark, sf_dir, "pois").select(F.lit("node").alias("type"), n.alias("id"), F.when(own, c("lat")).alias("lat"), F.when(own, c("lon")).alias("lon"), F.when(n % 4 != 3, centre).alias("center"), F.create_map(F.lit("amenity"), F.lit("school")).alias("tags"))
    return elements.points(rows).select("poi_id", "poi_type", "lat", "lon")


@register("A5_parking_supply", """SELECT 'osm:way:' || n AS parking_id, CASE n % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'line' ELSE 'point' END AS kind, round(lat + CASE n % 3 WHEN 0 THEN 0.0005::DOUBLE WHEN 1 THEN 0.0002::DOUBLE ELSE 0.0::DOUBLE END, 9) AS lat,
 round(lon + CASE n % 3 WHEN 0 THEN 0.00075::DOUBLE WHEN 1 THEN 0.001::DOUBLE ELSE 0.0::DOUBLE END, 9) AS lon, capacity_tag, CASE WHEN capacity_tag IS NULL THEN 'parking' ELSE '' END AS amenity FROM (SELECT *, CAST(substr(parking_id, 5) AS INT) AS n FROM parking)""")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings, bent lines and centres; each element comes twice."""
    n, c = F.substring("parking_id", 5, 12).cast("int"), F.col
    at = lambda dx, dy: F.struct((c("lat") + dy).alias("lat"), (c("lon") + dx).alias("lon"))
    ring, line = F.array(at(0, 0), at(0.001, 0), at(0.001, 0.001), at(0, 0)), F.array(at(0, 0), at(0.001, 0.0002), at(0.003, 0))
    tag = F.when(c("capacity_tag").isNull(), F.create_map(F.lit("amenity"), F.lit("parking"))).otherwise(F.create_map(F.lit("capacity"), F.lit(" "), F.lit("capacity:car"), c("capacity_tag")))
    none = F.lit(None).cast("double")
    rows = view(spark, sf_dir, "parking").select(F.lit("way").alias("type"), n.alias("id"), none.alias("lat"), none.alias("lon"), F.when(n % 3 == 0, ring).when(n % 3 == 1, line).alias("geometry"), F.when(n % 3 == 2, at(0, 0)).alias("center"), tag.alias("tags"))
    return rounded(elements.parking(rows.unionByName(rows)).select("parking_id", "kind", "lat", "lon", "capacity_tag", "amenity"), 9)


@register("A8_weather_table", "SELECT target_hour, rainfall_mm, CAST(rainfall_mm > 0 AS INT) AS is_raining FROM (SELECT target_hour, CAST(arg_max(count_total, segment_id) AS DOUBLE) - 1 AS rainfall_mm FROM hours GROUP BY 1)")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.hours(spark, sf_dir).select(F.col("target_hour").cast("string").alias("time"), (F.col("count_total") - 1).cast("string").alias("precipitation"), "segment_id")
    return context.weather_table(rows, "segment_id")


@register("E3_keep_last", "SELECT target_hour, arg_max(count_total, segment_id) AS count_total FROM hours GROUP BY 1")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.hours(spark, sf_dir).groupBy("target_hour").agg(F.max_by("count_total", "segment_id").alias("count_total"))


@register("B34_rain_shelter", "SELECT segment_id, target_hour, CAST(hour % 2 AS INT) * CAST(count_total > 1 AS INT) AS rain_shelter FROM hours")
def b34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.hours(spark, sf_dir).select("segment_id", "target_hour", context.rain_shelter(F.col("hour") % 2, (F.col("count_total") > 1).cast("int")).alias("rain_shelter"))


@register("B35_live_weather", "SELECT segment_id, target_hour, 2.5::DOUBLE AS rainfall_mm, 1 AS is_raining, CAST(count_total > 1 AS INT) AS rain_shelter FROM hours")
def b35(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.hours(spark, sf_dir).select("segment_id", "target_hour", F.lit(0.0).alias("rainfall_mm"), F.lit(0).alias("is_raining"), F.lit(0).alias("rain_shelter"), (F.col("count_total") > 1).cast("int").alias("is_structure"))
    live = core.bounds(spark, sf_dir).select(F.lit(2.5).alias("rainfall_mm"), F.lit(1).alias("is_raining"))
    return context.live_weather(rows, live).drop("is_structure")


@register("C14_volume", "SELECT d.segment_id, coalesce(v, 0.0)::DOUBLE AS volume FROM dim d LEFT JOIN (SELECT segment_id, CAST(greatest(0, sum(count_total * hour - 20)) AS DOUBLE) AS v FROM hours WHERE hour < 12 GROUP BY 1) USING (segment_id)")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.attach_volume(core.dimension(spark, sf_dir).select("segment_id"), core.hours(spark, sf_dir).where("hour < 12").selectExpr("segment_id", "hour AS volume", "count_total", "count_total * hour - 20 AS event_count"))  # several columns that could be it, and sums below 0


@register("C20_structure_flags", "SELECT h.segment_id, h.target_hour, CASE WHEN d.police_station < 'PS_5' THEN CAST(d.event_count % 2 AS INT) ELSE CAST(h.hour = 8 AS INT) END AS is_structure FROM hours h JOIN dim d USING (segment_id)")
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = core.dimension(spark, sf_dir).where("police_station < 'PS_5'").select("segment_id", (F.col("event_count") % 2).cast("int").alias("is_structure"))
    rows = core.hours(spark, sf_dir).select("segment_id", "target_hour", "hour")
    return context.structure_flags(rows, d, (F.col("hour") == 8).cast("int")).drop("hour")
