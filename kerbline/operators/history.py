"""Lags by exact hours, their fallbacks, and neighbours' spillover.

What is joined here grows with the facts, but Spark takes an exploded or grouped table to be no larger than the packed files it is made from; so the
joins are asked to be sort-merge ones, or millions of rows could be broadcast through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import refdata as R

LAGS = (1, 2, 3, 24, 168)


def true_lags(rows: DataFrame, hours: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """``rows`` with true_lag_{k}h_total: the total exactly k hours before, null where there was no row.

    History is exploded to its later hours once and pivoted, so all lags cost one shuffle.
    """
    later = hours.select("segment_id", "target_hour", "count_total", F.explode(F.array(*map(F.lit, lags))).alias("k"))
    later = later.select("segment_id", F.expr("target_hour + make_dt_interval(0, k, 0, 0)").alias("target_hour"), "k", "count_total")
    wide = later.groupBy("segment_id", "target_hour").agg(*[F.max(F.when(F.col("k") == k, F.col("count_total"))).alias(f"true_lag_{k}h_total") for k in lags])
    return rows.join(wide.hint("merge"), ["segment_id", "target_hour"], "left")


def lags_with_fallback(rows: DataFrame, hours: DataFrame) -> DataFrame:
    """lag_{k}h_total: the true lag, else the segment's mean at that hour (for 168: of that weekday and hour), else 0."""
    t = F.col("target_hour")
    past = hours.groupBy("segment_id", F.hour(t).alias("hr"), F.weekday(t).alias("dow")).agg(F.sum("count_total").alias("s"), F.count("count_total").alias("n"))
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    by_hour = past.groupBy("segment_id", "hr").agg((F.sum("s") / F.sum("n")).alias("m"), entries("dow", F.col("s") / F.col("n")).alias("days"))
    means = by_hour.groupBy("segment_id").agg(entries("hr", "m").alias("means"), entries("hr", "days").alias("weeks"))  # 24 hours and 168 of the week at most
    at = lambda k: F.pmod(F.hour(t) - k, F.lit(24))
    fallback = {k: F.try_element_at("means", at(k)) for k in LAGS if k < 168} | {168: F.try_element_at(F.try_element_at("weeks", at(0)), F.weekday(t))}
    lags = [F.coalesce(F.col(f"true_lag_{k}h_total").cast("double"), fallback[k], F.lit(0.0)).alias(f"lag_{k}h_total") for k in LAGS]
    return true_lags(rows, hours).join(means.hint("merge"), "segment_id", "left").select(*rows.columns, *lags)


def class_lags(rows: DataFrame, hours: DataFrame) -> DataFrame:
    """lag_1h_{class}: the class's count one hour before, else 0."""
    before = hours.select("segment_id", F.expr("target_hour + interval 1 hour").alias("target_hour"), *[F.col(f"count_{c}").alias(f"lag_1h_{c}") for c in R.CLASSES])
    return rows.join(before.hint("merge"), ["segment_id", "target_hour"], "left").fillna(0, [f"lag_1h_{c}" for c in R.CLASSES])


def neighbours(segments: DataFrame, radius: float = 0.005) -> DataFrame:
    """(segment_id, neighbour) within ``radius`` degrees of each other; static, so it is computed once."""
    a = segments.select("segment_id", F.col("lon_center").alias("x1"), F.col("lat_center").alias("y1"))
    b = segments.select(F.col("segment_id").alias("neighbour"), F.col("lon_center").alias("x2"), F.col("lat_center").alias("y2"))
    return geo.grid_join(a, b, ("x1", "y1"), ("x2", "y2"), radius).where("segment_id != neighbour").select("segment_id", "neighbour")


def spillover(lagged: DataFrame, near: DataFrame) -> DataFrame:
    """Sum of the neighbours' lag_1h_total in each row's hour, 0 where there is none."""
    theirs = lagged.select(F.col("segment_id").alias("neighbour"), "target_hour", "lag_1h_total")
    sums = near.join(theirs.hint("merge"), "neighbour").groupBy("segment_id", "target_hour").agg(F.sum("lag_1h_total").alias("neighbour_spillover"))
    return lagged.join(sums.hint("merge"), ["segment_id", "target_hour"], "left").fillna(0.0, ["neighbour_spillover"])
