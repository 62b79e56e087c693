"""Queries of the sinks, the feature merges, the explanation cuts and the live refreshes with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import refdata as R
from ..functions.shared import staged
from ..operators import clean, context, learning, scoring, spatial, tags
from ..sources import elements, geojson, tables
from ..streaming import live as streams
from . import core, live, more
from .core import rounded
from .fixtures import view
from .sql import case, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return keep


def streamed(rows: DataFrame) -> DataFrame:
    """``rows`` as a stream of one batch, through a table in the shared folder."""
    spark, path = rows.sparkSession, live.folder(rows.sparkSession)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100000).parquet(path)


# --- sources and sinks ------------------------------------------------------------------------------
@register("A9_stations", "SELECT venue AS station, latitude, longitude, label AS matched_name FROM calendar")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = live.folder(spark)
    view(spark, sf_dir, "calendar").select(F.col("venue").alias("station"), "latitude", "longitude", F.col("label").alias("matched_name")).write.csv(path, header=True)
    return tables.read_stations(spark, path)


@register("A10_top_csv", "SELECT segment_id, target_hour, eps, priority_band FROM scored ORDER BY eps DESC, segment_id, target_hour LIMIT 100")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = live.folder(spark)
    tables.write_top(core.scored(spark, sf_dir).select("segment_id", "target_hour", "eps", "priority_band"), path, [F.desc("eps"), F.col("segment_id"), F.col("target_hour")], 100)
    return spark.read.csv(path, header=True, schema="segment_id string, target_hour timestamp_ntz, eps double, priority_band string")


@register("A10_feature_sample", "SELECT segment_id, target_hour, count_total, round(lag_1h_total, 6) AS lag_1h_total FROM lagged ORDER BY segment_id, target_hour LIMIT 1000")
def a10_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = live.folder(spark)
    rows = rounded(core.lagged(spark, sf_dir).select("segment_id", "target_hour", "count_total", "lag_1h_total"))
    tables.write_top(rows, path, [F.col("segment_id"), F.col("target_hour")], 1000)
    return spark.read.csv(path, header=True, schema="segment_id string, target_hour timestamp_ntz, count_total long, lag_1h_total double")


@register("A12_ripple_sink")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = live.folder(spark)
    places = core.dimension(spark, sf_dir).select("segment_id", "lon_center", "lat_center", F.lit("osm_overpass_nearest_road").alias("map_matching_mode")).join(core.lines(spark, sf_dir), "segment_id")
    geojson.write(more.c16(spark, sf_dir).join(places, "segment_id"), path)
    kinds = "geometry struct<type: string, coordinates: array<array<double>>>, properties struct<source_bottleneck: string, segment_id: string, target_hour: timestamp_ntz, eps_spillover: double>"
    found = spark.read.text(path).select(F.from_json("value", kinds).alias("f"))
    return rounded(found.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates")[1][0].alias("bend_lon")))


ORACLES["A12_ripple_sink"] = f"SELECT source_bottleneck, segment_id, target_hour, eps_spillover, 'LineString' AS kind, round(x2, 6) AS bend_lon FROM ({core.ORACLES['C16_ripples']}) JOIN ({oracle('SELECT segment_id, x2 FROM lines')}) USING (segment_id)"


@register("A13_versioned_cache", f"SELECT poi_id, {case('lower(trim(poi_type))', R.POI_TYPE, 'none')} AS poi_type, name, lat, lon, 'v1' AS cache_version FROM pois WHERE {case('lower(trim(poi_type))', R.POI_TYPE, 'none')} <> 'none'")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = live.folder(spark)
    rows = view(spark, sf_dir, "pois").withColumn("poi_type", tags.poi_type_of_synonym(F.col("poi_type"))).where("poi_type is not null")
    elements.write_cache(rows, path, "poi_type", "v1")
    return spark.read.schema("poi_id string, name string, lat double, lon double, cache_version string, poi_type string").parquet(path)


# --- joins ------------------------------------------------------------------------------------------
@register("C3_attach_geometry", f"SELECT e.id, m.segment_id, round(r.lon1, 9) AS lon1, round(r.lat2, 9) AS lat2 FROM cleaned1 e LEFT JOIN ({more.match_sql(case('osm_highway', R.SNAP_PENALTY, 0.0))}) m ON m.id = e.id LEFT JOIN roads r ON r.segment_id = m.segment_id")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda i: F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"))
    roads = view(spark, sf_dir, "roads").select("segment_id", F.array(point(1), point(2)).alias("points"))
    events = clean.clean_events(view(spark, sf_dir, "violations")).select("id")
    rows = spatial.attach_geometry(events, more.c1(spark, sf_dir), roads)
    return rounded(rows.select("id", "segment_id", F.col("points")[0]["lon"].alias("lon1"), F.col("points")[1]["lat"].alias("lat2")), 9)


_METRES = {f"dist_to_{kind}_m": kind for kind in R.POI_GRAVITY}


@register("C23_feature_merges")
def c23(spark: SparkSession, sf_dir: str, dimension: DataFrame | None = None) -> DataFrame:
    dimension = dimension or staged(core.dimension(spark, sf_dir))
    d = dimension.select("segment_id", "police_station")
    near = more.c11(spark, sf_dir, dimension).groupBy("segment_id").agg(*[F.max(F.when(F.col("poi_type") == kind, F.col("distance"))).alias(c) for c, kind in _METRES.items()])
    known = d.where("police_station != 'PS_1'").select("segment_id")
    places = known.join(near, "segment_id", "left").join(more.c12(spark, sf_dir, dimension), "segment_id", "left")
    lots = dimension.where("police_station != 'PS_2'").select("segment_id", "event_count").join(more.nearest_lots(spark, sf_dir, dimension), "segment_id").join(F.broadcast(more.d13(spark, sf_dir, dimension)))
    risk = tags.overflow_risk(F.col("event_count"), F.col("distance"), F.col("estimated_capacity"), F.col("scale"))
    lots = lots.select("segment_id", F.round("distance", 3).alias("dist_to_legal_parking_m"), F.round("estimated_capacity", 6).alias("legal_parking_capacity"), F.round(risk, 4).alias("overflow_risk_index"))
    return context.merge_features(d, places, lots)


ORACLES["C23_feature_merges"] = f"""SELECT d.segment_id, d.police_station, {', '.join(f"coalesce(n.{c}, 5000.0::DOUBLE) AS {c}" for c in _METRES)},
 coalesce(s.poi_count_200m, 0) AS poi_count_200m, coalesce(s.poi_count_500m, 0) AS poi_count_500m, coalesce(s.poi_gravity_score, 0.0::DOUBLE) AS poi_gravity_score,
 coalesce(p.distance, 0.0::DOUBLE) AS dist_to_legal_parking_m, coalesce(p.estimated_capacity, 0.0::DOUBLE) AS legal_parking_capacity, CASE WHEN d.police_station <> 'PS_2' THEN coalesce(o.overflow_risk, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS overflow_risk_index
 FROM ({oracle('SELECT segment_id, police_station FROM dim')}) d LEFT JOIN ({core.ORACLES['C12_radius_counts']}) s ON s.segment_id = d.segment_id AND d.police_station <> 'PS_1'
 LEFT JOIN (SELECT segment_id, {', '.join(f"max(distance) FILTER (poi_type = '{kind}') AS {c}" for c, kind in _METRES.items())} FROM ({core.ORACLES['C11_nearest_poi']}) GROUP BY 1) n ON n.segment_id = d.segment_id AND d.police_station <> 'PS_1'
 LEFT JOIN ({core.ORACLES['C13_nearest_parking']}) p ON p.segment_id = d.segment_id AND d.police_station <> 'PS_2' LEFT JOIN ({core.ORACLES['B32_overflow_risk']}) o ON o.segment_id = d.segment_id"""


@register("E5_nearest_one", f"SELECT segment_id, venue, round(d, 6) AS distance_km FROM (SELECT segment_id, venue, d, row_number() OVER (PARTITION BY segment_id ORDER BY d, venue) AS n FROM (SELECT segment_id, venue, round({more.hav('lat_center', 'lon_center', 'latitude', 'longitude')}, 9) AS d FROM seg, calendar)) WHERE n = 1")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = core.dimension(spark, sf_dir).select("segment_id", F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon"))
    hubs = view(spark, sf_dir, "calendar").select("venue", F.col("latitude").alias("rlat"), F.col("longitude").alias("rlon"))
    return rounded(spatial.haversine_nearest(s, hubs, "segment_id", ["venue"], ["venue"]).select("segment_id", "venue", "distance_km"))


@register("B36_event_decay", f"SELECT segment_id, round(exp(-distance_km), 6) AS impact FROM ({ORACLES['E5_nearest_one']})")
def b36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(e5(spark, sf_dir).select("segment_id", spatial.event_decay(F.col("distance_km") * 1000).alias("impact")))


@register("E4_rank_within_hour", "SELECT segment_id, target_hour, CAST(row_number() OVER (PARTITION BY target_hour ORDER BY count_total DESC, segment_id) AS INT) AS place FROM hours")
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("target_hour").orderBy(F.desc("count_total"), "segment_id"))
    return core.hours(spark, sf_dir).select("segment_id", "target_hour", place.alias("place"))


# --- explanations -----------------------------------------------------------------------------------
_WEIGHTS = {c: (i % 5 - 2) / 4 or 0.5 for i, c in enumerate(R.COUNTS)} | {"count_total": 0.125, "severity_weighted_count": 0.25, "sample_weight": -0.5, "hour": 0.0625, "day_of_week": -0.125, "month": 0.5, "day_of_month": -0.0625, "day_of_year": 0.03125, "is_late": 0.25, "is_hotspot": -0.25}
_IMPACTS = ", ".join(f"round({w}::DOUBLE * (fr.{c} - m.m_{c}), 9) AS {c}" for c, w in _WEIGHTS.items())


@register("F5_explanation_cuts", f"""SELECT * FROM (WITH fr AS (SELECT *, month(target_hour) AS month, day(target_hour) AS day_of_month, dayofyear(target_hour) AS day_of_year, CAST(hour >= 12 AS INT) AS is_late FROM hours),
 m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in _WEIGHTS)} FROM fr),
 wide AS (SELECT fr.segment_id, fr.target_hour, {_IMPACTS} FROM fr, m),
 tall AS (SELECT * FROM (UNPIVOT wide ON {', '.join(_WEIGHTS)} INTO NAME feature VALUE impact) WHERE impact <> 0),
 rk AS (SELECT *, row_number() OVER up AS s, count(*) FILTER (impact > 0.05) OVER (up ROWS UNBOUNDED PRECEDING) AS u, row_number() OVER (PARTITION BY segment_id, target_hour ORDER BY abs(impact) DESC, feature) AS n FROM tall WINDOW up AS (PARTITION BY segment_id, target_hour, impact > 0 ORDER BY abs(impact) DESC, feature))
 SELECT segment_id, target_hour, feature, round(impact, 6) AS impact, CAST(s <= CASE WHEN impact > 0 THEN 5 ELSE 3 END AS INT) AS served, CAST(s <= CASE WHEN impact > 0 THEN 3 ELSE 1 END AS INT) AS told, CAST(n <= 15 AS INT) AS largest, CAST(impact > 0.05 AND u <= 3 AND s <= 5 AS INT) AS shown FROM rk)""")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = {"month": F.month("target_hour"), "day_of_month": F.day("target_hour"), "day_of_year": F.dayofyear("target_hour"), "is_late": (F.col("hour") >= 12).cast("int")}
    return rounded(learning.explanation_cuts(core.hours(spark, sf_dir).withColumns(day), _WEIGHTS, ["segment_id", "target_hour"]))


# --- live refreshes ---------------------------------------------------------------------------------
@register("J2_live_rescoring", "SELECT segment_id, target_hour, round(eps, 6) AS eps, priority_band FROM scored")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out, dims = core.to_score(spark, sf_dir), live.folder(spark), live.folder(spark)
    rows.select("segment_id", "target_hour", "congestion").write.parquet(dims)
    scales = scoring.calibrate(rows)
    score = lambda r: scoring.score(r, scales).select("segment_id", "target_hour", "eps", "priority_band")
    streams.run_batches(streamed(rows.drop("congestion")), streams.rescore(out, lambda: spark.read.parquet(dims), score), live.folder(spark))
    return rounded(spark.read.parquet(out).drop("batch"))


@register("J5_live_ripples")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.folder(spark)
    rows, known = more.rippling(spark, sf_dir)
    streams.run_batches(streamed(rows), streams.refresh_ripples(out, known), live.folder(spark))
    return more.shown_ripples(spark.read.parquet(out))


ORACLES["J5_live_ripples"] = core.ORACLES["C16_ripples"]


@register("J6_feedback_accuracy", "SELECT segment_id AS edge_id, round(avg(CAST(id % 7 IN (0, 1, 2) AS DOUBLE)), 6) AS accuracy, count(*) AS answers FROM cleaned GROUP BY 1")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Accurate", "yes", "TRUE", "no", "inaccurate", "", "0"))), (F.col("id") % 7 + 1).cast("int"))
    rows, out = core.events(spark, sf_dir).select(F.col("segment_id").alias("edge_id"), said.alias("actual_accuracy")), live.folder(spark)
    whole = lambda batch, number: batch.write.mode("overwrite").parquet(out)  # noqa: E731 - complete mode: each batch has all rows
    streams.run_batches(streams.feedback_accuracy(streamed(rows)), whole, live.folder(spark), "complete")
    return rounded(spark.read.parquet(out))
