"""Count forecasts, hourly ranking, calibration and contributions on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import once, staged

FEATURES = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "lag_1h_total", "lag_24h_total", "lag_168h_total", "segment_hour_mean")


def poisson_chain(train: DataFrame, rows: DataFrame, targets: list[str], features: tuple[str, ...] = FEATURES, folds: int = 3, weight: str = "sample_weight") -> DataFrame:
    """``rows`` with pred_{target} for each target in turn; later targets also see the forecasts of earlier ones.

    Chain columns of the training rows are out-of-fold: a row's fold, by a hash of its key, has no part in the model
    that forecasts it. Forecasts are non-negative by the log link.
    """
    train = train.withColumn("_fold", F.pmod(F.xxhash64("segment_id", "target_hour"), F.lit(folds)))
    seen = list(features)
    for t in targets:
        glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=t, featuresCol="_x", weightCol=weight, predictionCol=f"pred_{t}", regParam=0.1, maxIter=15)
        stages = Pipeline(stages=[VectorAssembler(inputCols=seen, outputCol="_x"), glm])
        parts = [stages.fit(train.where(F.col("_fold") != k)).transform(train.where(F.col("_fold") == k)).drop("_x") for k in range(folds)]
        rows = stages.fit(train).transform(rows).drop("_x")
        train = parts[0]
        for p in parts[1:]:
            train = train.unionByName(p)
        train = staged(train)  # each target would repeat the plan ``folds`` times otherwise
        seen.append(f"pred_{t}")
    return rows


def rank_and_calibrate(train: DataFrame, rows: DataFrame, cutoff_days: int = 14, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``rows`` with rank_score of boosted trees on relevance 0..3, and priority: its Platt calibration.

    The calibration is fitted on the last ``cutoff_days`` days of ``train`` with a ranker fitted before them; where those
    have one class only, or there are none, priority is the plain sigmoid.
    """
    last = F.broadcast(train.agg(F.expr(f"max(target_hour) - interval {cutoff_days} days").alias("_cut")))
    split = train.join(last).withColumn("_late", F.col("target_hour") >= F.col("_cut")).drop("_cut")
    trees = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), GBTRegressor(labelCol="relevance", featuresCol="_x", predictionCol="rank_score", maxIter=10, maxDepth=4, seed=42)])
    early, late = split.where("not _late"), split.where("_late")
    classes = late.agg(F.min("is_hotspot").alias("a"), F.max("is_hotspot").alias("b"), F.count("*").alias("n")).first()
    scored = trees.fit(train).transform(rows).drop("_x")
    if not classes.n or classes.a == classes.b or early.isEmpty():
        return scored.withColumn("priority", 1 / (1 + F.exp(-F.col("rank_score"))))
    one = VectorAssembler(inputCols=["rank_score"], outputCol="_s")
    held = trees.fit(early).transform(late).drop("_x")
    platt = LogisticRegression(featuresCol="_s", labelCol="is_hotspot", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(one.transform(held))
    return platt.transform(one.transform(scored)).withColumn("priority", vector_to_array("_p")[1]).drop("_s", "_p", "_r", "_c")


def _listed(rows: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """``rows`` with _f: an array of (feature, impact) of each feature that moves the row's forecast."""
    names = list(coefficients)
    means = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
    impact = lambda c: F.round(coefficients[c] * (F.col(c) - F.col(f"_m_{c}")), 9).alias("impact")
    return rows.join(F.broadcast(means)).withColumn("_f", F.filter(F.array(*[F.struct(F.lit(c).alias("feature"), impact(c)) for c in names]), lambda f: f["impact"] != 0))


def impacts(rows: DataFrame, coefficients: dict[str, float], key: list[str]) -> DataFrame:
    """key, feature, impact: coefficient * (value - mean) of each feature that moves the row's forecast."""
    return _listed(rows, coefficients).select(*key, F.explode("_f").alias("f")).select(*key, "f.*")


def contributions(rows: DataFrame, coefficients: dict[str, float], key: list[str], positive: int = 5, negative: int = 3) -> DataFrame:
    """The strongest impacts of each row: ``positive`` upward and ``negative`` downward."""
    n = F.row_number().over(W.partitionBy(*key, F.col("impact") > 0).orderBy(F.desc(F.abs("impact")), "feature"))
    return impacts(rows, coefficients, key).withColumn("n", n).where(F.when(F.col("impact") > 0, F.col("n") <= positive).otherwise(F.col("n") <= negative))


def explanation_cuts(rows: DataFrame, coefficients: dict[str, float], key: list[str], served: tuple[int, int] = (5, 3), told: tuple[int, int] = (3, 1), largest: int = 15, shown: int = 3, least: float = 0.05) -> DataFrame:
    """``impacts`` of ``rows``, one row for each ``key``, with flags: served and told (so many upward and downward), largest (by size), shown (the first of those served that are over ``least``).

    A row's impacts are ranked within the row, so nothing is shuffled or sorted over all rows.
    """
    by_size = F.array_sort(F.transform("_f", lambda f: F.struct((-F.abs(f["impact"])).alias("falling"), f["feature"].alias("feature"), f["impact"].alias("impact"))))
    ranked = F.transform(by_size, lambda f, n: F.struct(f["feature"].alias("feature"), f["impact"].alias("impact"), n.alias("n")))
    of_sign = lambda fs, upward: F.transform(F.filter(fs, lambda f: (f["impact"] > 0) == F.lit(upward)), lambda f, s: F.struct(f["feature"].alias("feature"), f["impact"].alias("impact"), f["n"].alias("n"), s.alias("s")))
    both = once(ranked, lambda fs: F.concat(of_sign(fs, True), of_sign(fs, False)))
    tall = _listed(rows, coefficients).select(*key, F.explode(both).alias("f")).select(*key, "f.*")
    upward = F.col("impact") > 0
    within = lambda cut: F.when(upward, F.col("s") < cut[0]).otherwise(F.col("s") < cut[1])
    seen = upward & (F.col("impact") > least) & (F.col("s") < min(shown, served[0]))  # upward ones over the bar come first by size
    flags = {"served": within(served), "told": within(told), "largest": F.col("n") < largest, "shown": seen}
    return tall.select(*key, "feature", "impact", *[v.cast("int").alias(k) for k, v in flags.items()])


def ablations(rows: DataFrame, baselines: dict[str, float], key: list[str], predict) -> DataFrame:
    """Change of the forecast when one feature takes its baseline: one perturbed table and one ``predict`` (adds column forecast) for all."""
    c = F.col
    changed = rows.withColumn("_f", F.explode(F.array(F.lit(""), *map(F.lit, baselines))))
    changed = changed.withColumns({k: F.when(c("_f") == k, F.lit(v)).otherwise(c(k).cast("double")) for k, v in baselines.items()})
    scored = predict(changed)
    whole = scored.where("_f = ''").select(*key, c("forecast").alias("_whole"))
    return scored.where("_f != ''").join(whole, key).select(*key, c("_f").alias("feature"), (c("_whole") - c("forecast")).alias("impact"))
