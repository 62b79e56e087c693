"""Quality of forecasts and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import running_sum, staged


def regression_quality(rows: DataFrame, truth: str, forecast: str) -> DataFrame:
    """One row: mae, rmse, wape (denominator 1 at least)."""
    e = F.col(forecast) - F.col(truth)
    return rows.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.sum(F.abs(e)) / F.greatest(F.lit(1.0), F.sum(F.abs(truth).cast("double")))).alias("wape"))


def binary_quality(rows: DataFrame, label: str, score: str) -> DataFrame:
    """One row: roc_auc and average_precision over distinct scores, log_loss and brier; no rank of single rows is needed.

    Rows are first counted by distinct score, and running sums go over those.
    """
    y, p = F.col(label).cast("double"), F.col(score)
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    plain = rows.agg(F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"), F.avg(F.pow(p - y, 2)).alias("brier"))
    steps = rows.groupBy(p.alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    steps = running_sum(staged(steps.withColumn("falling", -F.col("s"))), ["falling"], ["pos", "neg"], ["tp", "fp"])
    steps = steps.withColumns({"tp": F.col("tp") + F.col("pos"), "fp": F.col("fp") + F.col("neg")})
    ranks = steps.agg((F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"), (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("average_precision"))
    return ranks.join(F.broadcast(plain))


def capture(rows: DataFrame, truth: str, score: str, keys: list[str], shares: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """One row: share of all ``truth`` in the top ``shares`` of rows by score, ties by ``keys``; rows are ranked once, over range partitions."""
    total = rows.agg(F.sum(truth).alias("t"), F.count("*").alias("n")).first()
    ranked = rows.select(*keys, truth, (-F.col(score)).alias("falling"), F.lit(1).cast("long").alias("one"))
    ranked = running_sum(staged(ranked), ["falling", *keys], "one", "ahead")
    return ranked.agg(*[(F.sum(F.when(F.col("ahead") < max(1, int(total.n * s)), F.col(truth))) / total.t).alias(f"capture_{round(s * 100)}") for s in shares])


def at_k(rows: DataFrame, hour: str, truth: str, label: str, score: str, keys: list[str], ks: tuple[int, ...] = (10, 25, 50), least: int = 50) -> DataFrame:
    """precision, ndcg (gain: the truth) and false-dispatch rate at each k, averaged over hours with ``least`` rows; ties by ``keys``."""
    by = W.partitionBy(hour)
    ranked = rows.withColumns({"n": F.count("*").over(by), "r": F.row_number().over(by.orderBy(F.desc(score), *keys)), "i": F.row_number().over(by.orderBy(F.desc(truth), *keys))}).where(F.col("n") >= least)
    aggs = []
    for k in ks:
        top = F.col("r") <= k
        gain = F.sum(F.when(top, F.col(truth) / F.log2(F.col("r") + 1)).otherwise(0.0))
        ideal = F.sum(F.when(F.col("i") <= k, F.col(truth) / F.log2(F.col("i") + 1)).otherwise(0.0))
        aggs += [(F.sum(F.when(top, F.col(label)).otherwise(0)) / k).alias(f"precision_{k}"), F.coalesce(F.try_divide(gain, ideal), F.lit(0.0)).alias(f"ndcg_{k}"), (F.count_if(top & (F.col(truth) == 0)) / k).alias(f"fdr_{k}")]
    per_hour = ranked.groupBy(hour).agg(*aggs)
    return per_hour.agg(*[F.avg(c).alias(c) for c in per_hour.columns if c != hour])
