"""Impact score and what follows from it: column algebra over counts, road and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions import refdata as R

BATCH_BANDS = ((80, "Red Line"), (50, "Orange Line"), (35, "Watchlist"))
LIVE_BANDS = ((85, "Red Line"), (60, "Orange Line"), (40, "Watchlist"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low).cast("double"), F.least(F.lit(high).cast("double"), c))


def band(eps: Column, bands: tuple = BATCH_BANDS) -> Column:
    out = None
    for least, name in bands:
        out = F.when(eps >= least, name) if out is None else out.when(eps >= least, name)
    return out.otherwise("Low")


def _total(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for c in R.CLASSES:
        out = out + F.col(f"count_{c}") * weights[c]
    return out


def calibrate(hours: DataFrame) -> DataFrame:
    """One row: count_p95 (1 at least) and interruption_p95 (0.05 at least) of facts with road_width_m."""
    parked = _total({c: R.CLASS_WIDTH[c] * R.OCCUPANCY[c] for c in R.CLASSES})
    raw = F.pow(parked / F.coalesce(F.col("road_width_m"), F.lit(6.0)), 2)
    p = ranks.percentiles(hours, {"count_p95": F.col("count_total"), "interruption_p95": raw}, 0.95)
    return ranks.one_row(hours, {n: max(least, p[n] or 0.0) for n, least in (("count_p95", 1.0), ("interruption_p95", 0.05))})


def score(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Scores rows of (segment_id, target_hour, count_*, road_class, road_width_m, hour, priority, congestion).

    ``scales`` is ``calibrate``'s one row; ``priority`` is the calibrated priority in 0..1, ``congestion`` the live multiplier.
    """
    c, one = F.col, F.lit
    rows = rows.withColumns({f"count_{k}": F.greatest(one(0.0), c(f"count_{k}").cast("double")) for k in R.CLASSES}).join(F.broadcast(scales))  # one row
    width = F.greatest(one(3.0), F.coalesce(c("road_width_m"), one(6.0)))
    rows = rows.withColumns({
        "predicted_total": sum((c(k) for k in R.COUNTS), one(0.0)),
        "expected_parked_width_m": _total({k: R.CLASS_WIDTH[k] * R.OCCUPANCY[k] for k in R.CLASSES}),
        "peak_multiplier": F.when(c("hour").isin(*R.PEAK), 1.8).when((c("hour") >= 23) | (c("hour") <= 5), 0.3).otherwise(1.0),
        "_w": width, "_damp": R.lookup(c("hour"), R.DAMPENER, 1.0), "_m": F.greatest(one(0.1), c("congestion")),
        "_cs": F.greatest(one(1.0), c("count_p95")) / 2, "_is": F.greatest(one(0.01), c("interruption_p95")) / 2,
        "_vm": R.lookup(c("road_class"), R.VULNERABILITY, 0.9) + F.when(width < 7, 0.5).otherwise(0.0),
    })
    rows = rows.withColumns({
        "interruption_raw": F.pow(c("expected_parked_width_m") / c("_w"), 2) * c("peak_multiplier"),
        "clearance_after_predicted_load_m": c("_w") - c("expected_parked_width_m"),
        "parking_risk_0_100": 100 * (1 - F.exp(-c("predicted_total") / c("_cs"))),
        "live_bonus": clip((c("_m") - 1) * 25, 0, 15),
        "hotspot_score": c("priority") * 100 * c("_damp"),
        "severity_score": clip(_total({k: R.FOOTPRINT[k] * 1.2 for k in R.CLASSES}) / c("_cs") * 50 * c("_damp"), 0, 100),
        "vulnerability_score": clip((c("_vm") - 0.7) / 1.8 * 100 * c("_damp"), 0, 100),
    })
    clear = c("clearance_after_predicted_load_m")
    rows = rows.withColumns({
        "traffic_interruption_0_100": 100 * (1 - F.exp(-c("interruption_raw") / c("_is"))),
        "emergency_gridlock_flag": (clear < 1.5).cast("int"),
        "eps_raw": clip(0.55 * c("hotspot_score") + 0.35 * c("severity_score") + 0.10 * c("vulnerability_score") + c("live_bonus"), 0, 100),
    })
    boosted = F.when(clear < 0, F.greatest(c("eps_raw"), one(85.0))).when(clear < 1.5, c("eps_raw") + (1.5 - F.least(clear, one(1.5))) * 10).otherwise(c("eps_raw"))
    rows = rows.withColumn("_eps", F.bround(F.round(clip(boosted, 0, 100), 9), 2))
    rows = rows.withColumn("eps", F.when((c("priority") < 0.35) & (c("_eps") >= 80), 79.0).otherwise(c("_eps")))
    reach = F.greatest(c("priority"), c("parking_risk_0_100") / 100)
    rows = rows.withColumns({"priority_band": band(c("eps")), "confidence_band": F.when(c("priority") > 0.6, "High").when(c("priority") >= 0.35, "Medium").when(reach > 0.4, "Medium").otherwise("Low")})
    red, orange, sure = c("priority_band") == "Red Line", c("priority_band") == "Orange Line", c("confidence_band") == "High"
    speed, choke = R.lookup(c("road_class"), R.BASE_SPEED, 30).cast("double"), F.least(one(100.0), c("expected_parked_width_m") / c("_w") * 100)
    slowed = F.greatest(one(5.0), speed * (1 - F.least(one(95.0), choke * 1.3 + c("eps") * 0.15) / 100))
    rows = rows.withColumns({
        "recommended_action": F.when(red & sure, "Immediate dispatch").when(red, "Immediate dispatch or tow readiness").when(orange & sure, "Preventative dispatch")
        .when(orange, "Monitor (Low Confidence)").when((c("priority_band") == "Low") & (c("_m") >= 1.2), "Stand down: congestion likely not parking-led").otherwise("Monitor"),
        "recommended_force_units": F.when((c("eps") < 40) | (c("confidence_band") == "Low"), 0).otherwise(F.least(one(3), F.ceil(c("eps") / 35).cast("int"))),
        "economic_loss_inr": F.bround(F.round(R.lookup(c("road_class"), R.TRAFFIC_VOLUME, 500) * (0.5 / slowed - 0.5 / speed) * 233, 6), 0),
    })
    return rows.drop("_w", "_damp", "_m", "_cs", "_is", "_vm", "_eps", "count_p95", "interruption_p95")


def resolution_impact(rows: DataFrame) -> DataFrame:
    """Adds structs before, after, improvement: the road with and without what is parked on it."""
    c, one = F.col, F.lit
    width, kind = F.coalesce(c("road_width_m"), one(6.0)), F.lower(c("road_class"))
    parked = F.coalesce(c("expected_parked_width_m"), one(0.0))
    parked = F.when(parked == 0, F.greatest(one(0.0), width - F.coalesce(c("clearance_after_predicted_load_m"), width))).otherwise(parked)
    parked = F.when(parked == 0, width * F.coalesce(c("traffic_interruption_0_100"), one(0.0)) / 100 * 0.5).otherwise(parked)
    rows = rows.withColumns({"_clear": F.greatest(one(0.0), width - parked), "_choke": F.least(one(100.0), parked / F.greatest(width, one(1.0)) * 100), "_speed": R.lookup(kind, R.BASE_SPEED, 30).cast("double")})
    rows = rows.withColumn("_slow", F.least(one(95.0), c("_choke") * 1.3 + c("eps") * 0.15))
    rows = rows.withColumns({"_now": F.greatest(one(5.0), c("_speed") * (1 - c("_slow") / 100)), "_loss": c("_slow") / 100 * R.lookup(kind, R.TRAFFIC_VOLUME, 500) * 50})
    half_even = lambda x, n: F.bround(F.round(x, 9), n)
    lanes, all_lanes = F.floor(c("_clear") / 3).cast("int"), F.greatest(one(1), F.floor(width / 3).cast("int"))
    return rows.withColumns({
        "before": F.struct(half_even(c("_clear"), 1).alias("clearance_m"), lanes.alias("lanes_available"), half_even(c("_choke"), 0).alias("choke_percent"), half_even(c("_now"), 0).alias("speed_kmh"), half_even(c("_loss"), 0).alias("economic_loss_per_hr")),
        "after": F.struct(half_even(width, 1).alias("clearance_m"), all_lanes.alias("lanes_available"), half_even(c("_speed"), 0).alias("speed_kmh")),
        "improvement": F.struct(half_even(c("_speed") - c("_now"), 0).alias("speed_recovery_kmh"), (all_lanes - lanes).alias("lanes_restored"), half_even(c("_loss"), 0).alias("economic_savings_per_hr"), R.lookup(kind, R.CASCADE_COUNT, 2).alias("cascade_segments_helped")),
    }).drop("_clear", "_choke", "_speed", "_slow", "_now", "_loss")


def enforcement_priority(rows: DataFrame) -> DataFrame:
    """Adds enforcement_priority (0..100) and urgency, of severity, cost, access and cascade."""
    c, kind = F.col, F.lower(F.col("road_class"))
    clear = F.coalesce(c("clearance_after_predicted_load_m"), F.lit(6.0))
    money = F.least(F.lit(100.0), R.lookup(kind, R.TRAFFIC_VOLUME, 500) / 5000 * 100 * (c("eps") / 100))
    access = F.when(clear > 4, 100).when(clear > 2.5, 70).when(clear > 1.5, 40).otherwise(15)
    p = clip(0.40 * F.least(F.lit(100.0), c("eps")) + 0.25 * money + 0.20 * access + 0.15 * R.lookup(kind, R.CASCADE_SCORE, 30), 0, 100)
    return rows.withColumns({"enforcement_priority": F.bround(F.round(p, 9), 1), "urgency": F.when(p >= 75, "Immediate").when(p >= 50, "Within 30 min").otherwise("Can Wait")})


def live_patch(rows: DataFrame) -> DataFrame:
    """Raises eps by up to 15 where the live multiplier is over 1.05, and bands it anew by the live cut-offs."""
    m = F.col("congestion")
    eps = F.when(m > 1.05, F.least(F.lit(100.0), F.col("eps") + F.least(F.lit(15.0), 25 * (m - 1)))).otherwise(F.col("eps"))
    return rows.withColumn("live_eps", eps).withColumn("live_band", band(F.col("live_eps"), LIVE_BANDS))
