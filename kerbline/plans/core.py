"""Queries of the cleaning, calendar, fact, history and scoring operators with their oracles."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions import refdata as R
from ..functions.shared import folder, kept, running_sum, staged
from ..operators import calendar, clean, facts, history, scoring
from .fixtures import LINES, view
from .sql import oracle

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals: sums have no order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.mark_bulk_entry(clean.clean_events(view(spark, sf_dir, "violations")))


def base(make):
    """``make``'s table, staged once for all queries of a session: they start from the same facts."""

    @wraps(make)
    def once(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kept(spark, make.__name__, f"{sf_dir}/events.parquet", lambda: make(spark, sf_dir))

    return once


@base
def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = facts.active_hours(clean.clean_events(view(spark, sf_dir, "violations")))
    return h.withColumns({"hour": F.hour("target_hour"), "day_of_week": F.weekday("target_hour")})


@base
def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.segment_dimension(clean.clean_events(view(spark, sf_dir, "violations")))  # marks of bulk entry have no part in it


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id and event_count of the active segments: each of their events is in the count of one hour."""
    return hours(spark, sf_dir).groupBy("segment_id").agg(F.sum("count_total").alias("event_count"))


@base
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id and geometry_wkt: a bent road for each segment, by the same text as DuckDB's."""
    rows = spark.sql(LINES.replace("FROM seg", "FROM {seg}"), seg=dimension(spark, sf_dir))
    place = lambda i: F.concat(F.col(f"x{i}").cast("string"), F.lit(" "), F.col(f"y{i}").cast("string"))
    return rows.select("segment_id", F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", place(1), place(2), place(3)), F.lit(")")).alias("geometry_wkt"))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hours(spark, sf_dir).agg(F.min("target_hour").alias("start_hour"), F.max("target_hour").alias("end_hour"))
    return b.withColumn("cutoff", F.expr("end_hour - interval 7 days"))


def span(spark: SparkSession, sf_dir: str) -> tuple[object, float]:
    """(cutoff, training hours): two numbers of one row."""
    b = bounds(spark, sf_dir).selectExpr("cutoff", "CAST(timestampdiff(HOUR, start_hour, cutoff) AS DOUBLE) AS h").first()
    return b.cutoff, max(1.0, b.h)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours(spark, sf_dir).join(F.broadcast(bounds(spark, sf_dir).select("cutoff")), F.col("target_hour") < F.col("cutoff")).drop("cutoff")


def to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dimension(spark, sf_dir).select("segment_id", "road_class", "road_width_m", "police_station", "lat_center", "lon_center")
    rows = hours(spark, sf_dir).join(d, "segment_id")
    return rows.withColumns({"priority": ((F.col("count_total") * 17 + F.col("hour") * 5) % 100).cast("double") / 100, "congestion": 0.9 + ((F.col("hour") * 7 + F.col("count_total")) % 10).cast("double") / 10})


@base
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_score(spark, sf_dir)
    return scoring.score(rows, scoring.calibrate(rows))


def _columns(name: str, make, sql_from: str, columns: list[str], doubles: tuple[str, ...] = (), casts: dict[str, str] | None = None) -> None:
    """Registers some columns of a table that Spark makes by ``make`` and DuckDB has as ``sql_from``."""
    casts = casts or {}
    shown = ", ".join(f"round({c}, 6) AS {c}" if c in doubles else f"CAST({c} AS {casts[c]}) AS {c}" if c in casts else c for c in columns)

    @register(name, f"SELECT {shown} FROM {sql_from}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(make(spark, sf_dir).select(*columns))


# --- cleaning -------------------------------------------------------------------------------------
def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_events(view(spark, sf_dir, "violations"), parking_only=False)


@register("A1_violation_scan", "SELECT id, ts, latitude, longitude FROM violations WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND ts IS NOT NULL")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import violations

    raw, path = view(spark, sf_dir, "violations").withColumn("created_datetime", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), folder(spark, "csv")
    raw.select(*[c.split()[0] for c in violations.SCHEMA.split(", ")]).write.csv(path, header=True, escape='"')
    return violations.read(spark, path).select(F.col("id").cast("long").alias("id"), "ts", "latitude", "longitude")


_columns("B1_status_filter", _every, "cleaned_all", ["id", "validation_status"])
_columns("B2_status_weight", lambda s, d: _every(s, d).withColumnRenamed("sample_weight", "w0"), "cleaned_all", ["id", "w0"], ("w0",))
_columns("B3_local_hour", _every, "cleaned_all", ["id", "event_time", "target_hour"])
_columns("B4_vehicle_class", _every, "cleaned_all", ["id", "vehicle_class"])
_columns("B5_violation_severity", _every, "cleaned_all", ["id", "violation_severity_weight"], ("violation_severity_weight",))
_columns("B6_severity_weight", lambda s, d: clean.clean_events(view(s, d, "violations")).withColumnRenamed("severity_weight", "s0"), "cleaned1", ["id", "vehicle_footprint_weight", "s0"], ("vehicle_footprint_weight", "s0"))
_columns("B7_parking_filter", lambda s, d: clean.clean_events(view(s, d, "violations")), "cleaned1", ["id"])
_columns("B8_grid", events, "cleaned", ["id", "lat_bin", "lon_bin", "segment_id"])
_columns("B9_text", _every, "cleaned_all", ["id", "police_station", "junction_name", "location"])
_columns("B10_junction_bucket", events, "cleaned", ["id", "junction_bucket"])
_columns("B11_road_class", events, "cleaned", ["id", "road_class"])
_columns("B13_road_width", events, "cleaned", ["id", "road_width_m"], ("road_width_m",))
_columns("D7_bulk_entry", events, "cleaned", ["id", "is_bulk_artifact_segment", "sample_weight", "severity_weight"], ("sample_weight", "severity_weight"))


# --- calendar -------------------------------------------------------------------------------------
def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.calendar(hours(spark, sf_dir).select("segment_id", "target_hour"))


_KEY = "segment_id, target_hour, "
_FLAG = "CAST({} AS INT) AS {}"


def _day_query(name: str, columns: dict[str, str], doubles: bool = False) -> None:
    shown = ", ".join(f"round({e}, 6) AS {c}" if doubles else f"CAST({e} AS INT) AS {c}" if c != "hour_bucket" else f"{e} AS {c}" for c, e in columns.items())

    @register(name, f"SELECT {_KEY}{shown} FROM hours")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(_days(spark, sf_dir).select("segment_id", "target_hour", *columns))


def _hours_in(hs) -> str:
    return f"hour IN ({', '.join(map(str, hs))})"


_day_query("B14_calendar", {"hour": "hour", "day_of_week": "day_of_week", "month": "month(target_hour)", "day_of_year": "dayofyear(target_hour)", "is_weekend": "day_of_week >= 5", "is_peak": _hours_in(R.PEAK)})
_day_query("B15_cycles", {f"{n}_{f}": f"{f}(2 * pi() * {v} / {p})" for n, v, p in (("hour", "hour", 24), ("dow", "day_of_week", 7), ("month", "month(target_hour)", 12)) for f in ("sin", "cos")} | {"day_of_year_norm": "dayofyear(target_hour) / 365.0::DOUBLE"}, True)
_day_query("B16_peaks", {"is_weekday_peak": f"day_of_week < 5 AND {_hours_in(R.PEAK)}", "is_weekend_peak": f"day_of_week >= 5 AND {_hours_in(R.WEEKEND_PEAK)}"})
_day_query("B17_hour_bucket", {"hour_bucket": "CASE hour " + " ".join(f"WHEN {h} THEN '{n}'" for h, n in R.HOUR_BUCKET.items()) + " END"})
_day_query("B18_holidays", {n: "strftime(target_hour, '%Y-%m-%d') IN ({})".format(", ".join(f"'{d}'" for d in days)) for n, days in (("is_holiday", R.HOLIDAYS), ("is_festival", R.FESTIVALS))})
_day_query("B19_month_edges", {"is_first_week_of_month": "day(target_hour) <= 7", "is_month_end": "day(last_day(target_hour)) - day(target_hour) <= 3"})
_day_query("B20_micro_windows", {f"is_{n}": _hours_in(hs) + (" AND day_of_week < 5" if wd else "") for n, (hs, wd) in R.WINDOWS.items()})


@register("B21_vulnerability", "SELECT segment_id, round(CASE road_class WHEN 'motorway' THEN 2.0 WHEN 'trunk' THEN 1.8 WHEN 'primary' THEN 1.5 WHEN 'secondary' THEN 1.2 WHEN 'tertiary' THEN 1.0 WHEN 'residential' THEN 0.8 WHEN 'living_street' THEN 0.7 WHEN 'unknown' THEN 0.9 ELSE 1.0 END::DOUBLE * CASE WHEN road_width_m < 7 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS vulnerability FROM dim")
def b21(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.lookup(F.col("road_class"), R.VULNERABILITY, 1.0) * F.when(F.col("road_width_m") < 7, 1.5).otherwise(1.0)
    return rounded(dimension(spark, sf_dir).select("segment_id", v.alias("vulnerability")))


@register("B22_sparse_segments", "SELECT segment_id, CASE WHEN event_count < 10 THEN 'SPARSE_ROAD' ELSE segment_id END AS model_segment_id FROM seg")
def b22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension(spark, sf_dir).select("segment_id", F.when(F.col("event_count") < 10, "SPARSE_ROAD").otherwise(F.col("segment_id")).alias("model_segment_id"))


_LEVELS = "lv AS (SELECT police_station, CAST(row_number() OVER (ORDER BY police_station) - 1 AS INT) AS code FROM (SELECT DISTINCT police_station FROM dim WHERE police_station < 'PS_6' UNION SELECT 'Unknown'))"


def levels(values: DataFrame, column: str) -> DataFrame:
    """Distinct sorted levels with Unknown, and their positions, counted over range partitions."""
    known = values.select(column).union(values.sparkSession.range(1).select(F.lit("Unknown"))).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_sum(staged(known), [column], "_one", "code").select(column, F.col("code").cast("int").alias("code"))


@register("D14_category_levels", f"SELECT police_station, code FROM ({'WITH ' + _LEVELS} SELECT * FROM lv)")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(dimension(spark, sf_dir).where("police_station < 'PS_6'"), "police_station")


@register("B23_category_codes", f"SELECT segment_id, code FROM ({'WITH ' + _LEVELS} SELECT d.segment_id, coalesce(lv.code, (SELECT code FROM lv WHERE police_station = 'Unknown')) AS code FROM dim d LEFT JOIN lv USING (police_station))")
def b23(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dimension(spark, sf_dir).select("segment_id", "police_station")
    lv = levels(d.where("police_station < 'PS_6'"), "police_station")
    unknown = lv.where("police_station = 'Unknown'").select(F.col("code").alias("u"))
    return d.join(lv, "police_station", "left").join(F.broadcast(unknown)).select("segment_id", F.coalesce("code", "u").alias("code"))


# --- facts ----------------------------------------------------------------------------------------
@register("D1_active_segments", "SELECT segment_id, event_count FROM active ORDER BY event_count DESC, segment_id LIMIT 50")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.active_segments(events(spark, sf_dir), most=50)


_columns("D2_class_counts", hours, "hours", ["segment_id", "target_hour", *R.COUNTS, "count_total"])
_columns("D3_severity_sum", hours, "hours", ["segment_id", "target_hour", "severity_weighted_count"], ("severity_weighted_count",))
_columns("D4_weight_sum", hours, "hours", ["segment_id", "target_hour", "sample_weight"], ("sample_weight",))
_columns("B24_hotspot", hours, "hours", ["segment_id", "target_hour", "is_hotspot"])
_DIM = ["lat_center", "lon_center", "severity_mean", "footprint_mean", "road_width_m"]
_columns("D5_segment_dimension", dimension, "dim", ["segment_id", "event_count", *_DIM, "lat_bin", "lon_bin", "police_station", "junction_name", "road_class"], tuple(_DIM))


@register("D5_segment_means", "SELECT segment_id, round(lat_mean, 9) AS lat_mean, round(lon_mean, 9) AS lon_mean FROM dim")
def d5_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dimension(spark, sf_dir).select("segment_id", "lat_mean", "lon_mean"), 9)


@register("D5_geometry_centres", """SELECT segment_id, CASE WHEN lat_bin % 3 = 0 THEN '' WHEN lat_bin % 7 = 1 THEN 'LINESTRING (broken' ELSE 'line' END AS geometry, round(CASE WHEN lat_bin % 3 = 0 THEN lat_center WHEN lat_bin % 7 = 1 THEN lat_mean ELSE ((y1 + y2) / 2 * l1 + (y2 + y3) / 2 * l2) / (l1 + l2) END, 9) AS lat_center,
 round(CASE WHEN lat_bin % 3 = 0 THEN lon_center WHEN lat_bin % 7 = 1 THEN lon_mean ELSE ((x1 + x2) / 2 * l1 + (x2 + x3) / 2 * l2) / (l1 + l2) END, 9) AS lon_center, junction_bucket
 FROM dim JOIN (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS l1, sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2) AS l2 FROM lines) USING (segment_id) JOIN mode_junction_bucket USING (segment_id)""")
def d5_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events carry their road's line, every seventh another's; some roads have none, some an unreadable one."""
    rows = events(spark, sf_dir).join(lines(spark, sf_dir), "segment_id")
    wkt = F.when(F.col("lat_bin") % 3 == 0, "").when(F.col("lat_bin") % 7 == 1, "LINESTRING (broken").when(F.row_number().over(W.partitionBy("segment_id").orderBy("id")) % 7 == 0, "LINESTRING (1 2, 3 4)").otherwise(F.col("geometry_wkt"))
    d = facts.segment_dimension(rows.withColumn("geometry_wkt", wkt), texts=facts.TEXTS)
    return rounded(d.select("segment_id", F.regexp_replace("geometry_wkt", r"LINESTRING \([0-9].*", "line").alias("geometry"), "lat_center", "lon_center", "junction_bucket"), 9)


@register("D6_approval_rate", "SELECT police_station, round(coalesce(count(*) FILTER (lower(trim(validation_status)) = 'approved')::DOUBLE / nullif(count(*) FILTER (lower(trim(validation_status)) IN ('approved', 'rejected')), 0), 0.5), 6) AS approval_rate FROM violations GROUP BY 1")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(facts.approval_rates(view(spark, sf_dir, "violations")))


@register("D8_segment_totals", "SELECT segment_id, CAST(sum(count_total) AS BIGINT) AS segment_total_events, round(sum(count_total) / (SELECT h FROM span), 6) AS segment_event_rate, round((rank() OVER (ORDER BY sum(count_total)) + (count(*) OVER (PARTITION BY sum(count_total)) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS segment_rank_pct FROM train GROUP BY 1")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(facts.segment_totals(train(spark, sf_dir), int(span(spark, sf_dir)[1])))


@register("E1_average_rank", "SELECT segment_id, round((rank() OVER (ORDER BY event_count) + (count(*) OVER (PARTITION BY event_count) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS rank_pct FROM seg")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(facts.average_rank(dimension(spark, sf_dir).select("segment_id", "event_count"), "event_count", "rank_pct").select("segment_id", "rank_pct"))


def _climate(name: str, keys: list[str], column: str, period: str, city: bool) -> None:
    scale = f"greatest(1.0::DOUBLE, (SELECT h FROM span) / {period})" + (" * (SELECT count(*) FROM active)" if city else "")

    @register(name, f"SELECT {', '.join(keys)}, round(sum(count_total) / ({scale}), 6) AS {column} FROM train GROUP BY {', '.join(keys)}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        periods = max(1.0, span(spark, sf_dir)[1] / float(period))
        if city:
            periods *= active(spark, sf_dir).count()
        return rounded(facts.climatology(train(spark, sf_dir), keys, periods, column))


_climate("D9_segment_hour_mean", ["segment_id", "hour"], "segment_hour_mean", "24", False)
_climate("D9_segment_dow_hour_mean", ["segment_id", "day_of_week", "hour"], "segment_dow_hour_mean", "168", False)
_climate("D9_city_hour_mean", ["hour"], "city_hour_mean", "24", True)
_climate("D9_city_dow_hour_mean", ["day_of_week", "hour"], "city_dow_hour_mean", "168", True)


@register("D10_lag_proxies", "SELECT segment_id, day_of_week, hour, round(avg(count_total), 6) AS hist_lag_dow_hour_mean FROM train GROUP BY 1, 2, 3")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(train(spark, sf_dir).groupBy("segment_id", "day_of_week", "hour").agg(F.avg("count_total").alias("hist_lag_dow_hour_mean")))


_columns("D15_bounds", bounds, "bounds", ["start_hour", "end_hour", "cutoff"])


@register("D23_quality_counts", "SELECT (SELECT count(*) FROM violations) - (SELECT count(*) FROM kept) AS excluded_rows, (SELECT count(*) FROM cleaned) AS cleaned_rows, (SELECT count(*) FROM bulk WHERE is_bulk_artifact_segment = 1) AS artifact_segments, (SELECT count(*) FROM cleaned WHERE is_bulk_artifact_segment = 1 AND hour(event_time) < 6) AS artifact_rows")
def d23(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "violations").agg(F.count_if(~clean.status_kept(F.col("validation_status"))).alias("excluded_rows"))
    flagged = F.col("is_bulk_artifact_segment") == 1
    kept = events(spark, sf_dir).agg(F.count("*").alias("cleaned_rows"), F.countDistinct(F.when(flagged, F.col("segment_id"))).alias("artifact_segments"), F.count_if(flagged & (F.hour("event_time") < 6)).alias("artifact_rows"))
    return raw.join(F.broadcast(kept))  # one row each


@register("D24_station_volume", "SELECT police_station, count(*) AS station_volume, round(count(*) / (SELECT h FROM span), 6) AS station_event_rate FROM cleaned WHERE target_hour < (SELECT cutoff FROM bounds) GROUP BY 1")
def d24(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff, h = span(spark, sf_dir)
    rows = events(spark, sf_dir).where(F.col("target_hour") < F.lit(cutoff).cast("timestamp_ntz"))
    return rounded(rows.groupBy("police_station").agg(F.count("*").alias("station_volume"), (F.count("*") / h).alias("station_event_rate")))


QUERIES["D25_station_rate"] = lambda s, d: d24(s, d).select("police_station", "station_event_rate")
ORACLES["D25_station_rate"] = "SELECT police_station, station_event_rate FROM (" + ORACLES["D24_station_volume"] + ")"


# --- generators -----------------------------------------------------------------------------------
@register("G2_hour_spine", "SELECT unnest(generate_series(start_hour, end_hour, INTERVAL 1 HOUR)) AS target_hour FROM bounds")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.hour_spine(bounds(spark, sf_dir), "start_hour", "end_hour")


_ZERO = """zk AS (SELECT a.segment_id, s.target_hour, round(-ln((CAST('0x' || substr(md5(concat_ws(':', '42', 'zero', a.segment_id, strftime(s.target_hour, '%Y%m%d%H'))), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / ln(1 + a.event_count), 9) AS k
  FROM active a, (SELECT unnest(generate_series(start_hour, end_hour, INTERVAL 1 HOUR)) AS target_hour FROM bounds) s WHERE NOT EXISTS (SELECT 1 FROM hours h WHERE h.segment_id = a.segment_id AND h.target_hour = s.target_hour)),
 zeros AS (SELECT segment_id, target_hour FROM zk ORDER BY k, segment_id, target_hour LIMIT (SELECT greatest(1, count(*) // 2) FROM hours))"""


@base
def zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir)
    b = bounds(spark, sf_dir).first()
    return facts.absent_pairs(active(spark, sf_dir), b.start_hour, b.end_hour, h, max(1, h.count() // 2))


@register("G3_negative_samples", f"SELECT * FROM (WITH {_ZERO} SELECT segment_id, target_hour FROM zeros)")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zeros(spark, sf_dir)


@register("G1_training_frame", f"SELECT * FROM (WITH {_ZERO} SELECT segment_id, target_hour, count_total, round(sample_weight * (1 + 2 * CAST(count_heavy > 0 AS INT) + CAST(count_light_commercial > 0 AS INT)), 6) AS sample_weight FROM hours UNION ALL SELECT segment_id, target_hour, 0, 0.3::DOUBLE FROM zeros)")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(facts.with_zeros(hours(spark, sf_dir).drop("hour", "day_of_week"), zeros(spark, sf_dir)).select("segment_id", "target_hour", "count_total", "sample_weight"))


@register("E2_keep_first", f"SELECT * FROM (WITH {_ZERO} SELECT segment_id, count(*) AS kept_rows FROM (SELECT segment_id, target_hour FROM hours UNION SELECT segment_id, target_hour FROM zeros) GROUP BY 1)")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir).drop("hour", "day_of_week")
    both = facts.with_zeros(h, h.select("segment_id", "target_hour").unionByName(zeros(spark, sf_dir)))
    return both.groupBy("segment_id").agg(F.count("*").alias("kept_rows"))


@register("G4_future_grid", "SELECT segment_id, (SELECT max(end_hour) FROM bounds) + (n * INTERVAL 1 HOUR) AS target_hour FROM active, generate_series(1, 24) AS g(n)")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    future = bounds(spark, sf_dir).selectExpr("end_hour + interval 1 hour AS a", "end_hour + interval 24 hours AS b")
    return active(spark, sf_dir).select("segment_id").join(facts.hour_spine(future, "a", "b"))


@register("G5_temporal_split", "SELECT segment_id, target_hour, CASE WHEN target_hour >= (SELECT cutoff FROM bounds) THEN 'test' WHEN target_hour >= (SELECT cutoff FROM bounds) - INTERVAL 14 DAY THEN 'calibration' ELSE 'train' END AS part FROM hours")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.broadcast(bounds(spark, sf_dir).select("cutoff"))
    part = F.when(F.col("target_hour") >= F.col("cutoff"), "test").when(F.col("target_hour") >= F.expr("cutoff - interval 14 days"), "calibration").otherwise("train")
    return hours(spark, sf_dir).join(cut).select("segment_id", "target_hour", part.alias("part"))


# --- history --------------------------------------------------------------------------------------
_LAG = [f"lag_{k}h_total" for k in history.LAGS]


def lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir)
    return history.lags_with_fallback(h, h)


@register("C6_true_lags", "SELECT segment_id, target_hour, " + ", ".join(f"true_{k} AS true_lag_{k}h_total" for k in history.LAGS) + " FROM lagged")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir)
    return history.true_lags(h.select("segment_id", "target_hour"), h)


_columns("C7_lags_with_fallback", lagged, "lagged", ["segment_id", "target_hour", *_LAG], tuple(_LAG))


@register("C7_class_lags", "SELECT h.segment_id, h.target_hour, " + ", ".join(f"coalesce(p.count_{c}, 0) AS lag_1h_{c}" for c in R.CLASSES) + " FROM hours h LEFT JOIN hours p ON p.segment_id = h.segment_id AND p.target_hour = h.target_hour - INTERVAL 1 HOUR")
def c7c(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir)
    return history.class_lags(h.select("segment_id", "target_hour"), h)


@register("B41_self_exciting", "SELECT segment_id, target_hour, round(lag_1h_total * exp(-0.5) + lag_2h_total * exp(-1.0) + lag_3h_total * exp(-1.5), 6) AS self_exciting FROM lagged")
def b41(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    decay = sum((F.col(f"lag_{k}h_total") * math.exp(-k / 2) for k in (1, 2, 3)), F.lit(0.0))
    return rounded(lagged(spark, sf_dir).select("segment_id", "target_hour", decay.alias("self_exciting")))


@register("C15_spillover", "SELECT a.segment_id, a.target_hour, round(coalesce((SELECT sum(b.lag_1h_total) FROM near n JOIN lagged b ON b.segment_id = n.neighbour WHERE n.segment_id = a.segment_id AND b.target_hour = a.target_hour), 0), 6) AS neighbour_spillover FROM lagged a")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = history.neighbours(dimension(spark, sf_dir))
    return rounded(history.spillover(lagged(spark, sf_dir).select("segment_id", "target_hour", "lag_1h_total"), near).drop("lag_1h_total"))


@register("C5_climatology_join", "SELECT h.segment_id, h.target_hour, round(coalesce(c.m, 0), 6) AS segment_hour_mean FROM hours h LEFT JOIN (SELECT segment_id, hour, sum(count_total) / greatest(1.0::DOUBLE, (SELECT h FROM span) / 24) AS m FROM train GROUP BY 1, 2) c ON c.segment_id = h.segment_id AND c.hour = h.hour")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = facts.climatology(train(spark, sf_dir), ["segment_id", "hour"], max(1.0, span(spark, sf_dir)[1] / 24), "segment_hour_mean")
    return rounded(hours(spark, sf_dir).join(means.hint("merge"), ["segment_id", "hour"], "left").fillna(0.0, ["segment_hour_mean"]).select("segment_id", "target_hour", "segment_hour_mean"))


@register("C4_dimension_join", "SELECT h.segment_id, h.target_hour, coalesce(d.road_class, 'unknown') AS road_class, coalesce(d.road_width_m, 6.0) AS road_width_m FROM hours h LEFT JOIN (SELECT * FROM dim WHERE police_station <> 'PS_1') d USING (segment_id)")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dimension(spark, sf_dir).where("police_station <> 'PS_1'").select("segment_id", "road_class", "road_width_m")
    return hours(spark, sf_dir).select("segment_id", "target_hour").join(d, "segment_id", "left").fillna({"road_class": "unknown", "road_width_m": 6.0})


@register("C17_anti_join", "SELECT segment_id, target_hour FROM hours h WHERE NOT EXISTS (SELECT 1 FROM hours p WHERE p.segment_id = h.segment_id AND p.target_hour = h.target_hour - INTERVAL 24 HOUR)")
def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir).select("segment_id", "target_hour")
    return h.join(h.select("segment_id", F.expr("target_hour + interval 24 hours").alias("target_hour")).hint("merge"), ["segment_id", "target_hour"], "left_anti")


# --- scoring --------------------------------------------------------------------------------------
@register("D11_calibration", "SELECT round(count_p95, 6) AS count_p95, round(interruption_p95, 6) AS interruption_p95 FROM scale")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.calibrate(to_score(spark, sf_dir)))


QUERIES["C22_counts_with_widths"] = lambda s, d: to_score(s, d).select("segment_id", "target_hour", "count_total", "road_width_m")
ORACLES["C22_counts_with_widths"] = oracle("SELECT segment_id, target_hour, count_total, road_width_m FROM to_score")


@register("D12_recalibration", "SELECT round(p, 6) AS predicted_p95, round(greatest(0.5::DOUBLE, 0.15::DOUBLE * p), 6) AS interruption_p95 FROM (SELECT quantile_cont(predicted_total, 0.95) AS p FROM s1)")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    p = ranks.one_row(rows, ranks.percentiles(rows, {"predicted_p95": F.col("predicted_total")}, 0.95))
    return rounded(p.withColumn("interruption_p95", F.greatest(F.lit(0.5), 0.15 * F.col("predicted_p95"))))


_SCORES = {
    "I1_totals": ["predicted_total", "expected_parked_width_m"], "I2_peak_multiplier": ["peak_multiplier"], "I3_interruption": ["interruption_raw", "clearance_after_predicted_load_m", "emergency_gridlock_flag"],
    "I4_saturating_scores": ["parking_risk_0_100", "traffic_interruption_0_100"], "I5_I7_components": ["hotspot_score", "severity_score", "vulnerability_score"], "I6_live_bonus": ["live_bonus"], "I8_eps_raw": ["eps_raw"],
    "I9_I10_eps": ["eps"], "I11_bands": ["priority_band"], "I12_confidence": ["confidence_band"], "I13_action": ["recommended_action"], "I14_force_units": ["recommended_force_units"], "I15_economic_loss": ["economic_loss_inr"],
}
_TEXT = ("emergency_gridlock_flag", "priority_band", "confidence_band", "recommended_action", "recommended_force_units")
for _name, _cols in _SCORES.items():
    _columns(_name, scored, "scored", ["segment_id", "target_hour", *_cols], tuple(c for c in _cols if c not in _TEXT))


@register("I16_resolution_impact", """SELECT segment_id, target_hour, round_even(round(greatest(0.0::DOUBLE, road_width_m - p), 9), 1) AS clearance_before, round_even(round(least(100.0::DOUBLE, p / greatest(road_width_m, 1) * 100), 9), 0) AS choke_percent, CAST(greatest(1, floor(road_width_m / 3)) - floor(greatest(0.0::DOUBLE, road_width_m - p) / 3) AS INT) AS lanes_restored,
 round_even(round(least(95.0::DOUBLE, least(100.0::DOUBLE, p / greatest(road_width_m, 1) * 100) * 1.3::DOUBLE + eps * 0.15::DOUBLE) / 100 * volume * 50, 9), 0) AS economic_savings_per_hr
 FROM (SELECT *, CASE WHEN expected_parked_width_m = 0 THEN greatest(0.0::DOUBLE, road_width_m - clearance_after_predicted_load_m) ELSE expected_parked_width_m END AS p FROM scored)""")
def i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring.resolution_impact(scored(spark, sf_dir))
    return r.select("segment_id", "target_hour", r.before.clearance_m.alias("clearance_before"), r.before.choke_percent.alias("choke_percent"), r.improvement.lanes_restored.alias("lanes_restored"), r.improvement.economic_savings_per_hr.alias("economic_savings_per_hr"))


_PRIORITY = """(SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.40::DOUBLE * least(100.0::DOUBLE, eps) + 0.25::DOUBLE * least(100.0::DOUBLE, volume / 5000 * 100 * (eps / 100)) + 0.20::DOUBLE * CASE WHEN clearance_after_predicted_load_m > 4 THEN 100 WHEN clearance_after_predicted_load_m > 2.5 THEN 70 WHEN clearance_after_predicted_load_m > 1.5 THEN 40 ELSE 15 END
 + 0.15::DOUBLE * CASE road_class WHEN 'primary' THEN 90 WHEN 'secondary' THEN 65 WHEN 'tertiary' THEN 40 WHEN 'residential' THEN 20 ELSE 30 END)) AS p FROM scored)"""


@register("I17_enforcement_priority", f"SELECT segment_id, target_hour, round_even(round(p, 9), 1) AS enforcement_priority, CASE WHEN p >= 75 THEN 'Immediate' WHEN p >= 50 THEN 'Within 30 min' ELSE 'Can Wait' END AS urgency FROM {_PRIORITY}")
def i17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.enforcement_priority(scored(spark, sf_dir)).select("segment_id", "target_hour", "enforcement_priority", "urgency")


@register("I18_live_patch", "SELECT segment_id, target_hour, round(e, 6) AS live_eps, CASE WHEN e >= 85 THEN 'Red Line' WHEN e >= 60 THEN 'Orange Line' WHEN e >= 40 THEN 'Watchlist' ELSE 'Low' END AS live_band FROM (SELECT *, CASE WHEN congestion > 1.05 THEN least(100.0::DOUBLE, eps + least(15.0::DOUBLE, 25 * (congestion - 1))) ELSE eps END AS e FROM scored)")
def i18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.live_patch(scored(spark, sf_dir)).select("segment_id", "target_hour", "live_eps", "live_band"))
