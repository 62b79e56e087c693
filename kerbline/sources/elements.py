"""Map elements (nodes and ways) to roads and points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import refdata as R
from ..operators.clean import road_class_of_highway


def roads(elements: DataFrame) -> DataFrame:
    """segment_id, osm_way_id, osm_highway, road_class, road_width_m, road_name, points from rows (type, id, lat, lon, nodes, tags).

    Ways of other kinds than roads, and ways with fewer than two known nodes, go; a way and a node count once, with the least of their values.
    """
    nodes = elements.where("type = 'node' and lat is not null and lon is not null").groupBy(F.col("id").alias("node")).agg(F.min(F.struct("lat", "lon")).alias("p")).select("node", "p.*")
    ways = elements.where("type = 'way'").select("id", F.col("tags")["highway"].alias("osm_highway"), F.col("tags")["name"].alias("road_name"), "nodes").where(F.col("osm_highway").isNotNull() & ~F.col("osm_highway").isin(*R.EXCLUDED_HIGHWAYS))
    ways = ways.groupBy("id").agg(F.min(F.struct("osm_highway", "road_name", "nodes")).alias("w")).select("id", "w.*")
    steps = ways.select("id", F.posexplode("nodes").alias("pos", "node")).join(nodes, "node")
    lines = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).where(F.size("p") >= 2)  # a way's own nodes: at most 2000 by the map's rules
    out = ways.drop("nodes").join(lines, "id").withColumn("road_class", road_class_of_highway(F.col("osm_highway")))
    points = F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return out.select(F.concat(F.lit("osm_way_"), F.col("id").cast("string")).alias("segment_id"), F.col("id").alias("osm_way_id"), "osm_highway", "road_class", R.lookup(F.col("road_class"), R.ROAD_WIDTH, 6.0).alias("road_width_m"), F.coalesce("road_name", F.lit("")).alias("road_name"), points.alias("points"))


def points(elements: DataFrame) -> DataFrame:
    """poi_id, poi_type, name, lat, lon from rows (type, id, lat, lon, center, tags): the own place, else the centre; rows without a place or a known type go."""
    from ..operators.tags import poi_type_of_tags

    lat, lon = F.coalesce("lat", F.col("center.lat")), F.coalesce("lon", F.col("center.lon"))
    rows = elements.select(F.concat_ws(":", F.lit("osm"), "type", F.col("id").cast("string")).alias("poi_id"), poi_type_of_tags(F.col("tags")).alias("poi_type"), F.try_element_at("tags", F.lit("name")).alias("name"), lat.alias("lat"), lon.alias("lon"))
    return rows.where("poi_type is not null and lat is not null and lon is not null")


def point_features(text: DataFrame) -> DataFrame:
    """name, poi_type, lat, lon from JSON text in column value: a FeatureCollection, {"pois": [...]} or a bare list; only points with two coordinates. Unreadable text gives no row."""
    feature = "struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<name: string, poi_type: string>>"
    poi = "struct<name: string, poi_type: string, lat: double, lon: double>"
    f = text.select(F.explode(F.from_json("value", f"features array<{feature}>")["features"]).alias("f")).where("f.geometry.type = 'Point' and size(f.geometry.coordinates) >= 2")
    f = f.select("f.properties.name", "f.properties.poi_type", F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"))
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{poi}>"))
    p = text.select(F.explode(F.coalesce(bare, F.from_json("value", f"pois array<{poi}>")["pois"])).alias("p")).select("p.name", "p.poi_type", "p.lat", "p.lon")
    return f.unionByName(p).where("lat is not null and lon is not null")


def parking(elements: DataFrame) -> DataFrame:
    """parking_id, kind (polygon, line or point), lat, lon, capacity_tag, name, amenity, parking from rows (type, id, lat, lon, geometry, tags, and center where given).

    A closed ring of four points or more is a polygon and lies at a point inside it, two points or more are a line and lie at a vertex; else the own place or the
    centre counts. Points without both coordinates don't belong to a shape. An id counts once, with its least values; elements without any place go.
    """
    centre = {c: F.col(f"center.{c}") if "center" in elements.columns else F.lit(None).cast("double") for c in ("lat", "lon")}
    rows = elements.withColumn("_g", F.filter(F.coalesce("geometry", F.array().cast(elements.schema["geometry"].dataType)), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()))
    g, node = F.col("_g"), (F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    closed = (F.size(g) >= 4) & (F.get(g, F.lit(0)) == F.element_at(g, F.when(F.size(g) > 0, -1).otherwise(1)))
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    by_centre = centre["lat"].isNotNull() & centre["lon"].isNotNull()
    kind = F.when(node, "point").when(closed, "polygon").when(F.size(g) >= 2, "line").when(by_centre | own, "point")
    shape = F.when(F.col("kind") == "polygon", geo.inside_ring(g)).when(F.col("kind") == "line", geo.on_line(g))
    place = lambda c: F.when(node, F.col(c)).when(F.col("kind").isin("polygon", "line"), F.col(f"_p.{c}")).when(by_centre, centre[c]).otherwise(F.col(c)).alias(c)
    tag = F.coalesce(*[F.nullif(F.trim(F.try_element_at("tags", F.lit(k))), F.lit("")) for k in ("capacity", "capacity:car", "capacity:cars", "capacity:motorcar", "capacity:motor_vehicle")])
    texts = [F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit("")).alias(k) for k in ("name", "amenity", "parking")]
    rows = rows.withColumn("kind", kind).where("kind is not null").withColumn("_p", shape)
    rows = rows.select(F.concat_ws(":", F.lit("osm"), "type", F.col("id").cast("string")).alias("parking_id"), F.struct("kind", place("lat"), place("lon"), tag.alias("capacity_tag"), *texts).alias("r"))
    return rows.groupBy("parking_id").agg(F.min("r").alias("r")).select("parking_id", "r.*")


def write_cache(rows: DataFrame, path: str, kind: str, version: str) -> None:
    """A versioned Parquet cache, partitioned by ``kind``."""
    rows.withColumn("cache_version", F.lit(version)).write.mode("overwrite").partitionBy(kind).parquet(path)
