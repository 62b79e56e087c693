"""GeoJSON features, one to a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo

GEOMETRY = ("geometry_wkt", "lon_center", "lat_center", "map_matching_mode")


# A scored road's properties, their types and what stands for none, in their order.
SCORED = {
    "segment_id": ("string", None),
    "target_hour": ("string", None),
    "police_station": ("string", "Unknown"),
    "junction_name": ("string", "No Junction"),
    "road_class": ("string", "unknown"),
    "road_width_m": ("double", 6.0),
    "predicted_total": ("double", 0.0),
    "traffic_interruption_0_100": ("double", 0.0),
    "parking_risk_0_100": ("double", 0.0),
    "eps": ("double", 0.0),
    "priority_band": ("string", "Low"),
    "recommended_action": ("string", "Monitor"),
    "recommended_force_units": ("int", 0),
    "map_matching_mode": ("string", "grid_fallback"),
    "road_name": ("string", ""),
    "osm_highway": ("string", ""),
    "count_two_wheeler": ("double", 0.0),
    "count_car": ("double", 0.0),
    "count_auto": ("double", 0.0),
    "count_light_commercial": ("double", 0.0),
    "count_heavy": ("double", 0.0),
    "count_other": ("double", 0.0),
    "live_congestion_multiplier": ("double", 1.0),
    "clearance_m": ("double", 0.0),
    "emergency_gridlock_flag": ("boolean", False),
    "confidence_band": ("string", "Low"),
    "hotspot_probability": ("double", 0.0),
    "economic_loss_inr": ("double", 0.0),
    "geometry_wkt": ("string", ""),
}


def scored_features(rows: DataFrame) -> DataFrame:
    """``features`` with the properties ``SCORED``, whatever columns ``rows`` has or lacks."""
    if "clearance_after_predicted_load_m" in rows.columns:
        rows = rows.withColumn("clearance_m", F.col("clearance_after_predicted_load_m"))
    out = {}
    for name, (kind, none) in SCORED.items():
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        out[name] = (value if none is None else F.coalesce(value, F.lit(none))).alias(name)
    return features(rows.select(*out.values(), "lon_center", "lat_center"))


def features(rows: DataFrame) -> DataFrame:
    """``value``: a feature per row with all other columns as properties, null ones too. Road-matched rows without a geometry are skipped; grid rows are points."""
    line = geo.wkt_points(F.col("geometry_wkt"))
    rows = rows.withColumn("_line", line).where(F.col("_line").isNotNull() | (F.col("map_matching_mode") == "grid_fallback"))
    path = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform("_line", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")))
    spot = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon_center", "lat_center").alias("coordinates")))
    properties = F.to_json(F.struct(*[c for c in rows.columns if c not in ("_line", "lon_center", "lat_center")]), {"ignoreNullFields": "false"})
    shape = F.when(F.col("_line").isNotNull(), path).otherwise(spot)
    return rows.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def write(rows: DataFrame, path: str) -> None:
    """Gzipped: a feature's text repeats its names and, from hour to hour, its road's points. Spark's text reader takes it as it is."""
    features(rows).write.text(path, compression="gzip")
