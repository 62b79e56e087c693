"""The whole forecast: every feature of a segment-hour in one frame, models fitted on it, and the scores of the next 24 hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refdata as R
from ..functions.shared import staged
from ..operators import calendar, context, facts, history, learning, scoring, spatial, tags
from . import core, last, more
from .fixtures import view

QUERIES: dict = {}
ORACLES: dict = {}

#: Columns of text: the mean relevance of their level is the feature, drawn to that of all rows by ``DRAWN`` rows of it.
TEXTS, DRAWN = ("model_segment_id", "police_station", "junction_bucket", "road_class", "hour_bucket"), 5
_KEY = ["segment_id", "target_hour"]
#: What the count models see: recurrence. The trees see the whole frame.
RECURRENCE = (*learning.FEATURES, "segment_dow_hour_mean", "city_hour_mean", "city_dow_hour_mean", "self_exciting", "neighbour_spillover")


def places(spark: SparkSession, sf_dir: str, hours: DataFrame, cutoff, train_hours: float) -> DataFrame:
    """What is known of a segment whatever the hour: its dimension, totals, places and parking around, whether it is a bridge or the like, and its station's work."""
    before = hours.where(F.col("target_hour") < F.lit(cutoff).cast("timestamp_ntz"))
    whole = staged(core.dimension(spark, sf_dir))
    d = whole.drop("lat_bin", "lon_bin", "lat_mean", "lon_mean").withColumn("model_segment_id", F.when(F.col("event_count") < 10, "SPARSE_ROAD").otherwise(F.col("segment_id")))
    marks = core.events(spark, sf_dir)
    kinds = marks.groupBy("segment_id").agg(F.max("is_bulk_artifact_segment").alias("is_bulk_artifact_segment"))
    for c in ("junction_bucket", "location"):
        kinds = kinds.join(facts.mode_of(marks, ["segment_id"], c), "segment_id")
    kinds = kinds.withColumn("is_structure", tags.is_structure(F.create_map().cast("map<string,string>"), F.col("location")).cast("int")).drop("location")
    d = d.join(kinds, "segment_id").join(facts.segment_totals(before, max(1, int(train_hours))), "segment_id", "left")
    d = d.join(last.c23(spark, sf_dir, whole).drop("police_station"), "segment_id", "left")
    d = d.join(core.d24(spark, sf_dir), "police_station", "left").join(facts.approval_rates(view(spark, sf_dir, "violations")), "police_station", "left")
    return staged(d.fillna(0.0))


def frame(spark: SparkSession, sf_dir: str, rows: DataFrame, hours: DataFrame, fixed: DataFrame, cutoff, train_hours: float) -> DataFrame:
    """``rows`` (with segment_id and target_hour) with all features; means and lags come from ``hours`` alone, and means from those before ``cutoff``.

    A row that is one of those hours has no part in its own segment's means: its count is taken out of them.
    """
    before = hours.where(F.col("target_hour") < F.lit(cutoff).cast("timestamp_ntz")).withColumns({"hour": F.hour("target_hour"), "day_of_week": F.weekday("target_hour")})
    out = calendar.calendar(rows)
    days, weeks, segments = max(1.0, train_hours / 24), max(1.0, train_hours / 168), fixed.count()
    for keys, periods, name in ((["segment_id", "hour"], days, "segment_hour_mean"), (["segment_id", "day_of_week", "hour"], weeks, "segment_dow_hour_mean"), (["hour"], days * segments, "city_hour_mean"), (["day_of_week", "hour"], weeks * segments, "city_dow_hour_mean")):
        means = facts.climatology(before, keys, periods, name)
        out = out.join(means.hint("merge") if "segment_id" in keys else F.broadcast(means), keys, "left").fillna(0.0, [name])  # a city's are 168 at most
        if "segment_id" in keys and "count_total" in rows.columns:
            own = F.when(F.col("target_hour") < F.lit(cutoff).cast("timestamp_ntz"), F.col("count_total") / periods).otherwise(0.0)
            out = out.withColumn(name, F.greatest(F.lit(0.0), F.col(name) - own))
    out = staged(history.class_lags(history.lags_with_fallback(out, hours), hours))
    decay = sum((F.col(f"lag_{k}h_total") * F.exp(F.lit(-k / 2)) for k in (1, 2, 3)), F.lit(0.0))
    out = out.withColumn("self_exciting", decay)
    theirs = history.spillover(out.select(*_KEY, "lag_1h_total"), history.neighbours(fixed)).drop("lag_1h_total")
    rain = more.a7(spark, sf_dir).select("target_hour", "rainfall_mm", "is_raining")
    out = out.join(theirs.hint("merge"), _KEY).join(rain, "target_hour", "left").join(fixed, "segment_id")
    asked = rows.select(*_KEY).join(fixed.select("segment_id", F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon")), "segment_id")
    near = spatial.active_events(asked, more.calendar_events(spark, sf_dir))
    out = out.join(near.select(*_KEY, "nearest_event_distance_m", "event_impact").hint("merge"), _KEY, "left")
    return staged(out.fillna(0.0).withColumn("rain_shelter", context.rain_shelter(F.col("is_raining"), F.col("is_structure"))))


def coded(train: DataFrame, *frames: DataFrame) -> list[DataFrame]:
    """``frames`` with code_{text} for each of ``TEXTS``: the mean relevance of the level in ``train``, without the row itself where it is one of its rows; new levels have that of all."""
    prior = train.agg(F.avg("relevance")).first()[0] or 0.0
    out = list(frames)
    for c in TEXTS:
        sums = train.groupBy(c).agg(F.sum("relevance").alias("_s"), F.count("*").alias("_n"))
        for i, f in enumerate(out):
            own, one = (F.col("relevance"), 1) if "relevance" in f.columns else (F.lit(0.0), 0)
            mean = (F.col("_s") - own + DRAWN * prior) / (F.col("_n") - one + DRAWN)
            out[i] = f.join(sums, c, "left").withColumn(f"code_{c}", F.coalesce(mean, F.lit(prior))).drop("_s", "_n")
    return out


def features(rows: DataFrame) -> list[str]:
    """The numeric columns of a frame that are known before the hour comes."""
    known = {*R.COUNTS, "count_total", "severity_weighted_count", "sample_weight", "is_hotspot", "relevance"}
    return [c for c, t in rows.dtypes if t in ("int", "bigint", "double") and c not in known]


def predict_next_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each active segment's next 24 hours: counts of every class, calibrated priority, and the score and band that follow.

    The counts are a chain of Poisson models on ``RECURRENCE`` with out-of-fold columns, the priority is that of boosted trees on relevance over
    the whole frame, calibrated on the last training days.
    """
    hours = staged(core.hours(spark, sf_dir).drop("hour", "day_of_week"))
    cutoff, train_hours = core.span(spark, sf_dir)
    fixed = places(spark, sf_dir, hours, cutoff, train_hours)
    n = F.col("count_total")
    relevance = F.when(n <= 2, 0).when(n <= 10, 1).when(n <= 30, 2).otherwise(3).cast("double")
    known = frame(spark, sf_dir, hours, hours, fixed, cutoff, train_hours).withColumn("relevance", relevance)
    future = frame(spark, sf_dir, core.g4(spark, sf_dir), hours, fixed, cutoff, train_hours)
    known, future = (staged(f) for f in coded(known, known, future))
    seen = tuple(c for c in features(known) if c in future.columns)
    ahead = learning.poisson_chain(known, future, list(R.COUNTS), RECURRENCE, folds=5)
    ahead = learning.rank_and_calibrate(known, ahead, features=seen)
    ahead = ahead.withColumns({c: F.col(f"pred_{c}") for c in R.COUNTS}).withColumn("congestion", F.lit(1.0))
    scales = scoring.calibrate(hours.join(fixed.select("segment_id", "road_width_m"), "segment_id"))
    return scoring.score(ahead, scales).select(*_KEY, *[f"pred_{c}" for c in R.COUNTS], "predicted_total", "priority", "eps", "priority_band", "recommended_action")


QUERIES["predict_next_24h"] = predict_next_24h
