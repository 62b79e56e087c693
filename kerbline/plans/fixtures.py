"""Adapter views: the input tables of the operators, made from the given tables by one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "violations": """
        SELECT event_id AS id, ts,
         12.9005e0 + CAST(user_id * 37 % 97 AS DOUBLE)/500 + CAST(event_id % 5 AS DOUBLE)/100000 AS latitude,
         77.5005e0 + CAST(user_id * 53 % 89 AS DOUBLE)/500 + CAST(event_id % 3 AS DOUBLE)/100000 AS longitude,
         CASE user_id % 4 WHEN 0 THEN 'Outer Ring Road' WHEN 1 THEN '5th Cross Street' WHEN 2 THEN 'Layout Block' ELSE '  MG   Road ' END AS location,
         CASE event_type WHEN 'click' THEN 'SCOOTER' WHEN 'view' THEN 'CAR' WHEN 'purchase' THEN ' passenger  auto' WHEN 'signup' THEN 'LGV' ELSE 'LORRY/GOODS VEHICLE' END AS vehicle_type,
         CASE event_id % 11 WHEN 0 THEN 'OTHERS' WHEN 1 THEN 'jeep' ELSE NULL END AS updated_vehicle_type,
         CASE event_id % 6 WHEN 0 THEN '["WRONG PARKING","DOUBLE PARKING"]' WHEN 1 THEN 'NO PARKING' WHEN 2 THEN '["PARKING ON FOOTPATH"]' WHEN 3 THEN '[broken PARKING' WHEN 4 THEN '["DEFECTIVE NUMBER PLATE"]' ELSE NULL END AS violation_type,
         concat('PS_', CAST(user_id % 12 AS VARCHAR(10))) AS police_station,
         CASE WHEN user_id % 3 = 0 THEN 'No Junction' WHEN user_id % 3 = 1 THEN concat('BTP', CAST(user_id % 20 AS VARCHAR(10)), ' - Circle') ELSE NULL END AS junction_name,
         CASE event_id % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN ' Duplicate ' WHEN 2 THEN 'created1' WHEN 3 THEN 'created1' WHEN 4 THEN NULL WHEN 5 THEN 'processing' ELSE 'approved' END AS validation_status
        FROM events
    """,
    "pois": """
        SELECT concat('poi_', CAST(s_suppkey AS VARCHAR(12))) AS poi_id,
         CASE s_suppkey % 6 WHEN 0 THEN 'subway' WHEN 1 THEN 'retail' WHEN 2 THEN 'School' WHEN 3 THEN 'clinic' WHEN 4 THEN 'pub' ELSE 'unknown_kind' END AS poi_type,
         s_name AS name, 12.9e0 + CAST(s_suppkey * 41 % 199 AS DOUBLE)/1000 AS lat, 77.5e0 + CAST(s_suppkey * 59 % 181 AS DOUBLE)/1000 AS lon
        FROM supplier
    """,
    "parking": """
        SELECT concat('lot_', CAST(p_partkey AS VARCHAR(12))) AS parking_id,
         12.9e0 + CAST(p_partkey * 43 % 1999 AS DOUBLE)/10000 AS lat, 77.5e0 + CAST(p_partkey * 61 % 1801 AS DOUBLE)/10000 AS lon,
         CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR(10)) WHEN 1 THEN 'yes' WHEN 2 THEN concat(CAST(p_size AS VARCHAR(10)), '-', CAST(p_size + 5 AS VARCHAR(10))) WHEN 3 THEN concat('~', CAST(p_size AS VARCHAR(10)), ' cars') ELSE NULL END AS capacity_tag,
         CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE NULL END AS area_m2
        FROM part
    """,
    "calendar": """
        SELECT concat('ev_', CAST(n_nationkey AS VARCHAR(5))) AS event_key, n_name AS venue, n_name AS label,
         12.9e0 + CAST(n_nationkey * 31 % 97 AS DOUBLE)/500 AS latitude, 77.5e0 + CAST(n_nationkey * 47 % 89 AS DOUBLE)/500 AS longitude,
         (n_nationkey * 29) % 696 AS start_hour_offset, (n_nationkey * 29) % 696 + 2 + n_nationkey % 9 AS end_hour_offset
        FROM nation
    """,
    "roads": """
        SELECT concat('osm_way_', CAST(c_custkey AS VARCHAR(12))) AS segment_id,
         CASE c_custkey % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk_link' WHEN 2 THEN 'primary' WHEN 3 THEN 'tertiary' WHEN 4 THEN 'residential' ELSE 'footway' END AS osm_highway,
         12.9e0 + CAST(c_custkey * 37 % 997 AS DOUBLE)/5000 AS lat1, 77.5e0 + CAST(c_custkey * 53 % 887 AS DOUBLE)/5000 AS lon1,
         12.9e0 + CAST(c_custkey * 37 % 997 AS DOUBLE)/5000 + 0.0015e0 AS lat2, 77.5e0 + CAST(c_custkey * 53 % 887 AS DOUBLE)/5000 + CAST(c_custkey % 7 - 3 AS DOUBLE)/2000 AS lon2
        FROM customer
    """,
}
#: A road for each segment: an arm of one of 60 junctions, with a bend.
LINES = """
    SELECT segment_id, cx + dx * near AS x1, cy + dy * near AS y1, cx + dx * (near + far) / 2 + 0.00003e0 AS x2, cy + dy * (near + far) / 2 - 0.00002e0 AS y2, cx + dx * far AS x3, cy + dy * far AS y3
    FROM (SELECT segment_id, 77.5e0 + CAST(floor(j / 8) AS DOUBLE) / 100 AS cx, 12.9e0 + CAST(j % 8 AS DOUBLE) / 100 AS cy, near, near + long AS far,
      CASE WHEN arm IN (0, 1, 7) THEN 1e0 WHEN arm IN (3, 4, 5) THEN -1e0 ELSE 0e0 END AS dx, CASE WHEN arm IN (1, 2, 3) THEN 1e0 WHEN arm IN (5, 6, 7) THEN -1e0 ELSE 0e0 END AS dy
     FROM (SELECT segment_id, (lat_bin * 7 + lon_bin * 3) % 60 AS j, (lat_bin * 5 + lon_bin * 11) % 8 AS arm, CAST((lat_bin + lon_bin) % 5 AS DOUBLE) / 10000 AS near, CAST((lat_bin * 3 + lon_bin) % 6 + 1 AS DOUBLE) / 10000 AS long FROM seg))
"""
SOURCE = {"violations": "events", "pois": "supplier", "parking": "part", "calendar": "nation", "roads": "customer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter view ``name`` over the tables of ``sf_dir``."""
    source = SOURCE[name]
    return spark.sql(VIEWS[name].replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))
