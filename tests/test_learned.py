"""Models that are tables: against plain loops, held-out quality, and their use in the dispatch queue."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline import registry
from kerbline.operators import additive
from kerbline.plans import forecast, learned

SF = "/root/testdata/sf0.001"


def table(spark, n: int = 300):
    r = random.Random(3)
    rows = [(i, r.randrange(4), r.randrange(6), r.choice([0.5, 1.0, 2.0]), r.randrange(3)) for i in range(n)]
    rows = [(i, a, b, w, f, min(9, int(r.expovariate(1) * (1 + a) * (0.5 + b / 3)))) for i, a, b, w, f in rows]
    return rows, spark.createDataFrame(rows, "id int, a int, b int, w double, fold int, y int")


def plain(rows, use, kind: str, rounds: int = additive.ROUNDS) -> tuple[float, dict]:
    rows = [x for x in rows if use(x)]
    base, effects = sum(x[3] * x[5] for x in rows) / sum(x[3] for x in rows), {}
    for _ in range(rounds):
        total = lambda x, e=dict(effects): e.get(("a", x[1]), 0) + e.get(("b", x[2]), 0)
        sums = {}
        for x in rows:
            p = base * math.exp(total(x)) if kind == "counts" else base + total(x)
            for key in (("a", x[1]), ("b", x[2])):
                s = sums.setdefault(key, [0.0, 0.0, 0.0])
                s[0], s[1], s[2] = s[0] + x[3] * x[5], s[1] + x[3] * p, s[2] + x[3]
        for key, (y, p, w) in sums.items():
            effects[key] = effects.get(key, 0.0) + additive.RATE * (math.log((y + base) / (p + base)) if kind == "counts" else (y - p) / (w + 1))
    return base, effects


@pytest.mark.parametrize("kind", ["counts", "scores"])
def test_fits_are_plain_loops(spark, kind):
    rows, df = table(spark)
    model = additive.fit(df, "y", "w", ["a", "b"], {0: F.col("fold") != 0, 7: F.lit(True)}, kind=kind)
    for m, use in ((0, lambda x: x[4] != 0), (7, lambda x: True)):
        base, effects = plain(rows, use, kind)
        assert model.base[m] == pytest.approx(base)
        assert {k[1:]: v for k, v in model.effects.items() if k[0] == m} == pytest.approx(effects)


@pytest.mark.parametrize("kind", ["counts", "scores"])
def test_a_saved_model_joined_is_the_model(spark, kind):
    _, df = table(spark)
    model = additive.fit(df, "y", "w", ["a", "b"], {0: F.lit(True)}, kind=kind)
    saved = model.table(spark)
    other = df.unionByName(spark.createDataFrame([(-1, 99, None, 1.0, 0, 0), (-2, -5, 2, 1.0, 0, 0)], df.schema))  # bins that no one has seen
    want = {r.id: r.p for r in other.select("id", model.forecast(0).alias("p")).collect()}
    assert {r.id: r.forecast for r in additive.joined(other, saved, 0, ["a", "b"], ["id"], kind).collect()} == pytest.approx(want)
    again = additive.loaded(saved, kind, ["a", "b"])
    assert {r.id: r.p for r in other.select("id", again.forecast(0).alias("p")).collect()} == pytest.approx(want)


def test_nothing_to_learn_from(spark):
    _, df = table(spark)
    model = additive.fit(df.limit(0), "y", "w", ["a", "b"], {0: F.lit(True)})
    assert [r[0] for r in df.limit(2).select(model.forecast(0)).collect()] == [0.0, 0.0]
    assert additive.platt(df.limit(0), "a", "y") == (1.0, 0.0)


def test_platt_finds_the_curve(spark):
    r = random.Random(5)
    rows = [(x := r.gauss(0, 1), int(r.random() < 1 / (1 + math.exp(-(2 * x - 1))))) for _ in range(4000)]
    a, b = additive.platt(spark.createDataFrame(rows, "x double, y int"), "x", "y")
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.2


def test_rows_never_train_their_own_forecast(spark):
    _, df = table(spark, 90)
    marked = df.withColumns({"y": F.when(F.col("id") == 5, 1000).otherwise(F.col("y"))})
    one = {r.id: r.pred_y for r in _own(spark, df)}
    two = {r.id: r.pred_y for r in _own(spark, marked)}
    assert one[5] == pytest.approx(two[5]) and one != two


def _own(spark, df):
    model = additive.fit(df, "y", "w", ["a", "b"], {k: F.col("fold") != k for k in range(3)})
    own = F.lit(0.0)
    for k in range(3):
        own = F.when(F.col("fold") == k, model.forecast(k)).otherwise(own)
    return df.select("id", own.alias("pred_y")).collect()


def test_a_chain_is_fitted_over_cells(spark, monkeypatch):
    """Fits see a row for each combination of bins and fold, and fit what they would over the rows."""
    rows, df = table(spark)
    seen, fit = [], additive.fit
    monkeypatch.setattr(additive, "fit", lambda train, *a, **k: seen.append(train.count()) or fit(train, *a, **k))
    out, models = additive.chain(df, df, ["y"], ["a", "b"], "w")
    assert seen == [len({(x[1], x[2], x[4]) for x in rows})] and seen[0] < len(rows)
    want = fit(df, "y", "w", ["a", "b"], {k: F.col("fold") != k for k in range(3)} | {3: F.lit(True)})
    assert models["y"].base == pytest.approx(want.base) and models["y"].effects == pytest.approx(want.effects)
    assert {r.id: r.pred_y for r in out.collect()} == pytest.approx({r.id: r.p for r in df.select("id", want.forecast(3).alias("p")).collect()})


def test_the_chain_beats_climatology(spark):
    got = {r.forecast: r.wape for r in registry.QUERIES["H1_quality"](spark, SF).collect()}
    assert got["chain"] < 0.9 * got["climatology"]


def test_priority_is_calibrated_and_ranks_the_queue(spark):
    rows = learned.priorities(spark, SF).select("priority", "is_hotspot").collect()
    assert all(0 < r.priority < 1 for r in rows)
    assert abs(sum(r.priority for r in rows) / len(rows) - sum(r.is_hotspot for r in rows) / len(rows)) < 0.12
    queue = registry.QUERIES["F1_top_k"](spark, SF).collect()
    assert len(queue) == 25 and [r.eps for r in queue] == sorted((r.eps for r in queue), reverse=True)
    assert {r.target_hour for r in queue} <= {r.target_hour for r in learned.framed(spark, SF).where("test").collect()}


def test_the_frame_has_what_is_known_of_an_hour(spark):
    """Every feature that the forecast is to see, but nothing of the hour's own count."""
    static = "lat_center lon_center road_width_m is_bulk_artifact_segment code_model_segment_id code_police_station code_junction_bucket code_road_class code_hour_bucket"
    time = "hour day_of_week month day_of_year is_weekend is_peak hour_sin hour_cos dow_sin dow_cos month_sin month_cos day_of_year_norm is_weekday_peak is_weekend_peak is_holiday is_festival is_first_week_of_month is_month_end"
    windows = "is_school_dropoff is_school_pickup is_lunch_market is_office_commute_am is_office_commute_pm is_shopping_evening is_nightlife_peak"
    past = "segment_total_events segment_event_rate segment_rank_pct segment_hour_mean segment_dow_hour_mean city_hour_mean city_dow_hour_mean self_exciting neighbour_spillover severity_mean footprint_mean"
    lags = "lag_1h_total lag_2h_total lag_3h_total lag_24h_total lag_168h_total lag_1h_two_wheeler lag_1h_car lag_1h_auto lag_1h_light_commercial lag_1h_heavy lag_1h_other"
    around = "rainfall_mm is_raining is_structure rain_shelter dist_to_legal_parking_m legal_parking_capacity overflow_risk_index poi_count_200m poi_count_500m poi_gravity_score station_volume approval_rate station_event_rate nearest_event_distance_m event_impact"
    places = " ".join(f"dist_to_{k}_m" for k in "metro commercial bus_stop school hospital market restaurant worship office mall airport railway_station hotel nightlife park stadium university".split())
    hours = learned.core.hours(spark, SF).drop("hour", "day_of_week")
    cutoff, span = learned.core.span(spark, SF)
    fixed = forecast.places(spark, SF, hours, cutoff, span)
    known = forecast.frame(spark, SF, hours, hours, fixed, cutoff, span).withColumn("relevance", F.col("count_total").cast("double"))
    known, later = forecast.coded(known, known, known.drop("relevance"))
    named = set(forecast.features(known))
    assert set(" ".join((static, time, windows, past, lags, around, places)).split()) <= named
    assert not named & {"count_total", "relevance", "is_hotspot", "sample_weight"}
    assert known.count() == later.count() == hours.count()
    # a level of one row tells nothing of that row
    one = spark.createDataFrame([("x", 3.0), ("y", 0.0), ("y", 1.0)], "t string, relevance double")
    got = {(r.t, r.relevance): r.code_t for r in _coded(one)}
    prior = 4 / 3
    assert got == pytest.approx({("x", 3.0): prior, ("y", 0.0): (1 + 5 * prior) / 6, ("y", 1.0): 5 * prior / 6})


def _coded(rows):
    before = forecast.TEXTS
    forecast.TEXTS = ("t",)
    try:
        return forecast.coded(rows, rows)[0].collect()
    finally:
        forecast.TEXTS = before
