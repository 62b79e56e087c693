"""The violations table from delimited text: wanted columns only, unreadable rows dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id STRING, latitude DOUBLE, longitude DOUBLE, location STRING, vehicle_type STRING, updated_vehicle_type STRING, violation_type STRING, created_datetime STRING, police_station STRING, junction_name STRING, validation_status STRING"


def typed(raw: DataFrame) -> DataFrame:
    """``created_datetime`` (UTC text) as ``ts`` without zone; rows without a readable time or coordinates go."""
    return raw.withColumn("ts", F.expr("try_cast(created_datetime AS timestamp_ntz)")).where("ts is not null and latitude is not null and longitude is not null").drop("created_datetime")


def read(spark: SparkSession, path: str) -> DataFrame:
    return typed(spark.read.csv(path, schema=SCHEMA, header=True, mode="PERMISSIVE", multiLine=False, escape='"'))
