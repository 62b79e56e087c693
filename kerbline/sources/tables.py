"""Small delimited tables, top-k and sample sinks, and what a trained model leaves behind."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATIONS = "station STRING, latitude DOUBLE, longitude DOUBLE, matched_name STRING"


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations with a name and a place; other rows go."""
    return spark.read.csv(path, schema=STATIONS, header=True).where("station is not null and latitude is not null and longitude is not null")


def write_top(rows: DataFrame, path: str, order: list[Column], k: int) -> None:
    """The first ``k`` rows by ``order`` as delimited text with a header."""
    rows.orderBy(*order).limit(k).write.mode("overwrite").csv(path, header=True)


def save_model(effects: DataFrame, metrics: DataFrame, segments: DataFrame, config: dict, path: str) -> None:
    """A model's table, its metrics (one row), the segment dimension and the configuration, in one folder."""
    effects.write.mode("overwrite").parquet(f"{path}/effects")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    segments.write.mode("overwrite").parquet(f"{path}/segments")
    segments.sparkSession.range(1).select(F.lit(json.dumps(config)).alias("value")).write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """What ``save_model`` wrote."""
    return *(spark.read.parquet(f"{path}/{name}") for name in ("effects", "metrics", "segments")), json.loads(spark.read.text(f"{path}/config").first().value)
