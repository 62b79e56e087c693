"""Queries of the models that are tables, and DuckDB's own fits of them, round by round."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refdata as R
from ..functions.shared import folder, staged
from ..operators import additive, facts, history, metrics, scoring
from ..sources import tables
from . import core
from .core import base, rounded
from .sql import STEPS, oracle

QUERIES: dict = {}
ORACLES: dict = {}

FOLDS, LATE = 3, 5
LAGS = (1, 24, 168)
FEATURES = ["b_hour", "b_dow", *[f"b_lag{k}" for k in LAGS], "b_climate"]
_KEY = ["segment_id", "target_hour"]


@base
def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training frame with its absences: counts, bins of the features, relevance, fold, and whether a row is past the cutoff."""
    h = core.hours(spark, sf_dir)
    rows = facts.with_zeros(h.drop("hour", "day_of_week"), core.zeros(spark, sf_dir)).withColumns({"hour": F.hour("target_hour"), "day_of_week": F.weekday("target_hour")})
    means = facts.climatology(core.train(spark, sf_dir), ["segment_id", "hour"], max(1.0, core.span(spark, sf_dir)[1] / 24), "climate")
    means = means.groupBy("segment_id").agg(F.map_from_entries(F.collect_list(F.struct("hour", "climate"))).alias("climates"))  # 24 hours at most: joined by segment, as the lags' means are
    rows = history.lags_with_fallback(rows, h).join(means.hint("merge"), "segment_id", "left").withColumn("climate", F.coalesce(F.round(F.try_element_at("climates", "hour"), 9), F.lit(0.0))).drop("climates")
    binned = lambda c, width, most: F.least(F.lit(most), F.floor(F.round(c, 9) * width)).cast("int")
    n = F.col("count_total")
    rows = rows.withColumns({"b_hour": F.col("hour"), "b_dow": F.col("day_of_week"), "b_climate": binned("climate", 50, 39), **{f"b_lag{k}": binned(f"lag_{k}h_total", 2, 9) for k in LAGS}})
    rows = rows.withColumns({"fold": additive.fold(_KEY, FOLDS), "one": F.lit(1.0), "relevance": F.when(n <= 0, 0).when(n <= 1, 1).when(n <= 2, 2).otherwise(3)})
    cut = core.bounds(spark, sf_dir).select("cutoff")
    return rows.join(F.broadcast(cut)).withColumns({"test": F.col("target_hour") >= F.col("cutoff"), "late": F.col("target_hour") >= F.expr(f"cutoff - interval {LATE} days")}).select(*_KEY, *R.COUNTS, "count_total", "sample_weight", "is_hotspot", "climate", *FEATURES, "fold", "one", "relevance", "test", "late")


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = framed(spark, sf_dir)
    return rows.where("not test"), rows.where("test")


@base
def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours past the cutoff with the counts of all classes, forecast one after the other."""
    return additive.chain(*split(spark, sf_dir), list(R.COUNTS), FEATURES, folds=FOLDS)[0]


def h1_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecasts(spark, sf_dir).select(*_KEY, *[f"pred_{c}" for c in R.COUNTS]))


def h1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's and climatology's errors on the hours past the cutoff."""
    rows = forecasts(spark, sf_dir).withColumn("forecast", sum((F.col(f"pred_{c}") for c in R.COUNTS), F.lit(0.0)))
    named = lambda name, c: metrics.regression_quality(rows, "count_total", c).withColumn("forecast", F.lit(name))
    return rounded(named("chain", "forecast").unionByName(named("climatology", "climate")))


def prioritised(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with rank_score, of all training rows, and priority: its logistic calibration on the last training days, which its own ranker has not seen."""
    model = additive.fit(additive.cells(train, ["relevance"], "one", FEATURES, ["late"]), "relevance", "one", FEATURES, {0: ~F.col("late"), 1: F.lit(True)}, kind="scores")
    a, b = additive.platt(staged(train.where("late").select(model.forecast(0).alias("s"), "is_hotspot")), "s", "is_hotspot")
    rows = rows.withColumn("rank_score", model.forecast(1))
    return rows.withColumn("priority", 1 / (1 + F.exp(-(F.lit(a) * F.col("rank_score") + F.lit(b)))))


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prioritised(*split(spark, sf_dir))


@base
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours past the cutoff, scored by their forecast counts and their calibrated priority."""
    train, _ = split(spark, sf_dir)
    rows = forecasts(spark, sf_dir)
    d = core.dimension(spark, sf_dir).select("segment_id", "road_class", "road_width_m", "police_station", "lat_center", "lon_center")
    rows = prioritised(train, rows).join(d, "segment_id").withColumns({c: F.col(f"pred_{c}") for c in R.COUNTS})
    known = core.hours(spark, sf_dir).join(d.select("segment_id", "road_width_m"), "segment_id")
    return scoring.score(rows.withColumns({"hour": F.hour("target_hour"), "congestion": F.lit(1.0)}), scoring.calibrate(known))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dispatch queue."""
    rows = rounded(dispatch(spark, sf_dir).select(*_KEY, "eps", "priority_band", "predicted_total", "priority", "interruption_raw"))
    return rows.orderBy(F.desc("eps"), F.desc("predicted_total"), *_KEY).limit(25)


def h2_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(priorities(spark, sf_dir).select(*_KEY, "rank_score", "priority", "is_hotspot"))


def h3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the calibrated priority; scores are told apart to nine digits."""
    return rounded(metrics.binary_quality(priorities(spark, sf_dir).withColumn("priority", F.round("priority", 9)), "is_hotspot", "priority"))


def a15_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count model saved as a table with its error, segments and configuration, read again and joined to the rows."""
    train, test = split(spark, sf_dir)
    model = additive.fit(additive.cells(train, ["count_total"], "sample_weight", FEATURES, []), "count_total", "sample_weight", FEATURES, {0: F.lit(True)})
    path = folder(spark, "model")
    error = metrics.regression_quality(test.withColumn("forecast", model.forecast(0)), "count_total", "forecast")
    tables.save_model(model.table(spark), error, core.dimension(spark, sf_dir), {"features": FEATURES, "target": "count_total"}, path)
    effects, error, segments, config = tables.load_model(spark, path)
    rows = additive.joined(test, effects, 0, config["features"], _KEY).join(segments.select("segment_id", "road_class"), "segment_id")
    return rounded(rows.join(F.broadcast(error.select("mae"))).select(*_KEY, "road_class", "forecast", "mae"))


QUERIES |= {"H1_poisson_chain": h1_forecast, "H1_quality": h1_quality, "H2_H4_priority": h2_priority, "H3_calibration_quality": h3_quality, "A15_model_artifacts": a15_artifacts, "slice_top_segment_hours": top_k, "F1_top_k": top_k}


# --- DuckDB -----------------------------------------------------------------------------------------
def _lags() -> str:
    out = []
    for k in LAGS:
        past = f"(SELECT m FROM past_dow p WHERE p.segment_id = f.segment_id AND p.dow = f.dow AND p.hr = f.hr)" if k == 168 else f"(SELECT m FROM past_hour p WHERE p.segment_id = f.segment_id AND p.hr = (f.hr - {k} + 24) % 24)"
        if k == 24:
            past = "(SELECT m FROM past_hour p WHERE p.segment_id = f.segment_id AND p.hr = f.hr)"
        out.append(f"CAST(least(9, floor(round(coalesce(CAST((SELECT t.count_total FROM hours t WHERE t.segment_id = f.segment_id AND t.target_hour = f.target_hour - INTERVAL {k} HOUR) AS DOUBLE), {past}, 0.0::DOUBLE), 9) * 2)) AS INT) AS b_lag{k}")
    return ", ".join(out)


_COUNTS = ", ".join(R.COUNTS)
_FRAME = f"""{core._ZERO},
 f AS (SELECT *, CAST(hour(target_hour) AS INT) AS hr, CAST(isodow(target_hour) - 1 AS INT) AS dow FROM (SELECT segment_id, target_hour, {_COUNTS}, count_total, sample_weight * (1 + 2 * CAST(count_heavy > 0 AS INT) + CAST(count_light_commercial > 0 AS INT)) AS w, is_hotspot FROM hours UNION ALL SELECT segment_id, target_hour, {', '.join('0' for _ in R.COUNTS)}, 0, 0.3::DOUBLE, 0 FROM zeros)),
 cl AS (SELECT segment_id, hour AS hr, round(sum(count_total) / greatest(1.0::DOUBLE, (SELECT h FROM span) / 24), 9) AS climate FROM train GROUP BY 1, 2),
 g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY segment_id, f.target_hour) AS rid, f.* EXCLUDE (hr, dow), f.hr AS b_hour, f.dow AS b_dow, {_lags()}, coalesce(climate, 0.0::DOUBLE) AS climate, CAST(least(39, floor(coalesce(climate, 0.0::DOUBLE) * 50)) AS INT) AS b_climate,
  CAST(CAST('0x' || substr(md5(concat_ws(':', segment_id, strftime(f.target_hour, '%Y%m%d%H'))), 1, 8) AS BIGINT) % {FOLDS} AS INT) AS fold, 1.0::DOUBLE AS one, CASE WHEN count_total <= 0 THEN 0 WHEN count_total <= 1 THEN 1 WHEN count_total <= 2 THEN 2 ELSE 3 END AS relevance,
  f.target_hour >= (SELECT cutoff FROM bounds) AS test, f.target_hour >= (SELECT cutoff FROM bounds) - INTERVAL {LATE} DAY AS late FROM f LEFT JOIN cl USING (segment_id, hr))"""


def _fit(name: str, rows: str, truth: str, weight: str, features: list[str], models: dict[int, str], kind: str = "counts") -> list[str]:
    """Steps that end in ``name``_p: (rid, m, p) of all rows and models."""
    seen = " UNION ALL ".join(f"SELECT rid, {m} AS m, CAST({truth} AS DOUBLE) AS y, CASE WHEN NOT test AND ({c}) THEN {weight} ELSE 0.0::DOUBLE END AS w FROM {rows}" for m, c in models.items())
    steps = [
        f"{name}_x AS MATERIALIZED (SELECT rid, unnest([{', '.join(repr(f) for f in features)}]) AS f, unnest([{', '.join(features)}]) AS b FROM {rows})",
        f"{name}_u AS MATERIALIZED ({seen})",
        f"{name}_b AS MATERIALIZED (SELECT m, coalesce(sum(w * y), 0) / coalesce(nullif(sum(w), 0), 1) AS base FROM {name}_u GROUP BY m)",
    ]
    step = "ln((sum(w * y) + any_value(base)) / (sum(w * p) + any_value(base)))" if kind == "counts" else "(sum(w * y) - sum(w * p)) / (sum(w) + 1)"
    for r in range(additive.ROUNDS + 1):
        total = "0.0::DOUBLE" if not r else "coalesce(sum(e), 0)"
        made = f"any_value(base) * exp({total})" if kind == "counts" else f"any_value(base) + {total}"
        met = f"{name}_u JOIN {name}_b USING (m)" + (f" JOIN {name}_x USING (rid) LEFT JOIN {name}_e{r} USING (m, f, b)" if r else "")
        last = r == additive.ROUNDS
        steps.append(f"{name}_p{'' if last else r} AS MATERIALIZED (SELECT rid, m, any_value(y) AS y, any_value(w) AS w, any_value(base) AS base, {made} AS p FROM {met} GROUP BY rid, m)")
        if not last:
            before = f"coalesce(any_value(o.e), 0) + " if r else ""
            old = f" LEFT JOIN {name}_e{r} o USING (m, f, b)" if r else ""
            steps.append(f"{name}_e{r + 1} AS MATERIALIZED (SELECT m, f, b, {before}{additive.RATE}::DOUBLE * {step} AS e FROM {name}_p{r} JOIN {name}_x USING (rid){old} GROUP BY m, f, b HAVING sum(w) > 0)")
    return steps


def _chain() -> str:
    """Steps that end in q{n}: the rows with all forecasts."""
    steps, rows, features = [_FRAME], "g", list(FEATURES)
    for n, t in enumerate(R.COUNTS):
        models = {k: f"fold <> {k}" for k in range(FOLDS)} | {FOLDS: "true"}
        steps += _fit(f"t{n}", rows, t, "w", features, models)
        steps.append(f"q{n} AS MATERIALIZED (SELECT r.*, p AS pred_{t}, CAST(least(9, floor(round(p, 9) * 10)) AS INT) AS bin_{t} FROM {rows} r JOIN t{n}_p x ON x.rid = r.rid AND x.m = CASE WHEN test THEN {FOLDS} ELSE fold END)")
        rows, features = f"q{n}", [*features, f"bin_{t}"]
    return ",\n ".join(steps)


_LAST = f"q{len(R.COUNTS) - 1}"
_CHAINED = _chain()
ORACLES["H1_poisson_chain"] = oracle(f"SELECT * FROM (WITH {_CHAINED} SELECT segment_id, target_hour, {', '.join(f'round(pred_{c}, 6) AS pred_{c}' for c in R.COUNTS)} FROM {_LAST} WHERE test)")
_ERRORS = "SELECT '{n}' AS forecast, round(avg(abs({f} - count_total)), 6) AS mae, round(sqrt(avg(({f} - count_total) ** 2)), 6) AS rmse, round(sum(abs({f} - count_total)) / greatest(1.0::DOUBLE, sum(count_total)), 6) AS wape FROM {r} WHERE test"
ORACLES["H1_quality"] = oracle(f"SELECT * FROM (WITH {_CHAINED} {_ERRORS.format(n='chain', r=_LAST, f='(' + ' + '.join(f'pred_{c}' for c in R.COUNTS) + ')')} UNION ALL {_ERRORS.format(n='climatology', r=_LAST, f='climate')})")


def _ranked(rounds: int = 6) -> str:
    """Steps that end in pr: (rid, rank_score, priority) of the rows past the cutoff."""
    steps = [*_fit("k", "g", "relevance", "one", FEATURES, {0: "NOT late", 1: "true"}, "scores")]
    steps.append("hl AS MATERIALIZED (SELECT p AS x, CAST(is_hotspot AS DOUBLE) AS y FROM k_p JOIN g USING (rid) WHERE m = 0 AND late AND NOT test)")
    steps.append("n0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS a, ln(sum(y) / (count(*) - sum(y))) AS b FROM hl)")
    for r in range(rounds):
        steps.append(f"s{r} AS MATERIALIZED (SELECT any_value(a) AS a, any_value(b) AS b, sum((y - p) * x) - any_value(a) AS ga, sum(y - p) AS gb, sum(p * (1 - p) * x * x) + 1 AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) AS hbb FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS p FROM hl, n{r}))")
        steps.append(f"n{r + 1} AS MATERIALIZED (SELECT a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM s{r})")
    steps.append(f"pr AS MATERIALIZED (SELECT rid, p AS rank_score, 1 / (1 + exp(-(a * p + b))) AS priority FROM k_p, n{rounds} WHERE m = 1)")
    return steps


_RANKS = _ranked()
_RANKED = ",\n ".join([_FRAME, *_RANKS])
ORACLES["H2_H4_priority"] = oracle(f"SELECT * FROM (WITH {_RANKED} SELECT segment_id, target_hour, round(rank_score, 6) AS rank_score, round(priority, 6) AS priority, is_hotspot FROM g JOIN pr USING (rid) WHERE test)")
ORACLES["H3_calibration_quality"] = oracle(f"""SELECT * FROM (WITH {_RANKED}, b AS MATERIALIZED (SELECT is_hotspot AS y, round(priority, 9) AS p FROM g JOIN pr USING (rid) WHERE test),
 st AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b GROUP BY 1), cu AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM st)
 SELECT (SELECT round(sum(CASE WHEN a.p > c.p THEN 1.0::DOUBLE WHEN a.p = c.p THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) FROM b a, b c WHERE a.y = 1 AND c.y = 0) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision,
 (SELECT round(avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))), 6) FROM b) AS log_loss, (SELECT round(avg((p - y) ** 2), 6) FROM b) AS brier FROM cu)""")
_SAVED = ",\n ".join([_FRAME, *_fit("k", "g", "count_total", "w", FEATURES, {0: "true"})])
ORACLES["A15_model_artifacts"] = oracle(f"SELECT * FROM (WITH {_SAVED} SELECT g.segment_id, g.target_hour, d.road_class, round(p, 6) AS forecast, (SELECT round(avg(abs(p - count_total)), 6) FROM k_p JOIN g USING (rid) WHERE test) AS mae FROM g JOIN k_p USING (rid) JOIN dim d USING (segment_id) WHERE test)")

_SCORING = [f"z{n} AS ({re.sub(r'FROM s([1-5])', r'FROM z\1', STEPS[f's{n}']).replace('FROM to_score', 'FROM td')})" for n in range(1, 7)]
_QUEUE = ",\n ".join([
    _CHAINED, *_RANKS,
    f"td AS (SELECT q.segment_id, q.target_hour, {', '.join(f'q.pred_{c} AS {c}' for c in R.COUNTS)}, {' + '.join(f'q.pred_{c}' for c in R.COUNTS)} AS count_total, q.b_hour AS hour, d.road_class, d.road_width_m, pr.priority, 1.0::DOUBLE AS congestion FROM {_LAST} q JOIN pr USING (rid) JOIN dim d USING (segment_id) WHERE test)",
    *_SCORING,
])
ORACLES["slice_top_segment_hours"] = ORACLES["F1_top_k"] = oracle(f"SELECT * FROM (WITH {_QUEUE} SELECT segment_id, target_hour, eps, priority_band, round(predicted_total, 6) AS predicted_total, round(priority, 6) AS priority, round(interruption_raw, 6) AS interruption_raw FROM z6 ORDER BY eps DESC, round(predicted_total, 6) DESC, segment_id, target_hour LIMIT 25)")
