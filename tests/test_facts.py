"""Order statistics, sampling, loads with faults, weather modes, shapes of parking, streams that are stopped and resumed."""

import math
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo, ranks, shared
from kerbline.operators import clean, context, facts, history, learning
from kerbline.sources import elements, geojson
from kerbline.streaming import live


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_percentiles_are_exact(spark, p):
    r = random.Random(1)
    values = [(r.choice([1.0, 2.0, 2.0, 7.0]), r.gauss(0, 1), None if i % 3 else float(i)) for i in range(1001)]
    got = ranks.percentiles(spark.createDataFrame(values, "a double, b double, c double"), {c: F.col(c) for c in "abc"}, p)
    for n, c in enumerate("abc"):
        assert got[c] == pytest.approx(np.percentile([v[n] for v in values if v[n] is not None], p * 100), abs=1e-12)


def test_percentiles_of_many_rows_read_a_part_of_them(spark):
    rows = spark.range(200000).select(((F.col("id") * 7919) % 200003).cast("double").alias("v"))
    assert ranks.percentiles(rows, {"v": F.col("v")}, 0.95)["v"] == pytest.approx(np.percentile([(i * 7919) % 200003 for i in range(200000)], 95))


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,), (None,)], "v double")
    assert ranks.percentiles(empty, {"v": F.col("v")}, 0.5) == {"v": None} == ranks.percentiles(empty.limit(0), {"v": F.col("v")}, 0.5)
    assert ranks.percentiles(spark.createDataFrame([(3.0,)], "v double"), {"v": F.col("v")}, 0.95) == {"v": 3.0}


@pytest.mark.parametrize("wanted", [1, 40, 400, 10**6])
def test_samples_are_the_least_keys(spark, wanted, monkeypatch):
    start = datetime(2024, 1, 1)
    hours = [start + timedelta(hours=h) for h in range(50)]
    weights = [(f"s{i:02}", 20 + i * i) for i in range(30)]
    held = [(s, hours[h]) for s, _ in weights for h in range(0, 50, 7)]
    pos = spark.createDataFrame([*held, held[0]], "segment_id string, target_hour timestamp").withColumn("target_hour", F.col("target_hour").cast("timestamp_ntz"))
    got = [(r.segment_id, r.target_hour) for r in facts.absent_pairs(spark.createDataFrame(weights, "segment_id string, event_count int"), hours[0], hours[-1], pos, wanted).collect()]
    import hashlib

    def key(s, h, n):
        u = (int(hashlib.md5(f"42:zero:{s}:{h:%Y%m%d%H}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        return round(-math.log(u) / math.log1p(n), 9), s, h

    every = sorted(key(s, h, n) for s, n in weights for h in hours if (s, h) not in held)
    assert sorted(got) == sorted(k[1:] for k in every[:wanted]) and len(got) == len(set(got))
    monkeypatch.setattr(facts, "_cut", lambda line, n: (0.5, 1e-9))  # bounds that miss are widened
    again = facts.absent_pairs(spark.createDataFrame(weights, "segment_id string, event_count int"), hours[0], hours[-1], pos, wanted)
    assert sorted(got) == sorted((r.segment_id, r.target_hour) for r in again.collect())


def test_running_sums_of_two_values(spark):
    rows = spark.range(300).select((F.col("id") * 31 % 97).alias("k"), F.col("id").alias("a"), (F.col("id") % 5).alias("b"))
    x = y = 0
    for r in sorted(shared.running_sum(rows, ["k", "a"], ["a", "b"], ["x", "y"]).collect(), key=lambda r: (r.k, r.a)):
        assert (r.x, r.y) == (x, y)
        x, y = x + r.a, y + r.b


def test_staged_once_until_the_source_changes(spark, tmp_path):
    path, made = f"file://{tmp_path}/t", []
    spark.range(3).write.parquet(path)

    def make():
        made.append(1)
        return spark.read.parquet(path)

    once = lambda: shared.kept(spark, "t", path, make).count()
    assert (once(), once(), len(made)) == (3, 3, 1)
    spark.range(5).write.mode("overwrite").parquet(path)
    assert (once(), once(), len(made)) == (5, 5, 2)
    shared.removed(shared.kept(spark, "t", path, make))
    assert (once(), len(made)) == (5, 3)


# --- loads
def test_calendar_with_faults(spark):
    hubs = spark.createDataFrame([(" A ", "12.5", " 77 "), ("B", "x", "1"), ("C", "1", "2"), ("C", "3", "4"), (None, "1", "1"), ("D", None, "1")], "venue string, latitude string, longitude string")
    known, bad = context.routed(context.checked_hubs(hubs))
    assert [tuple(r) for r in known.select("venue", "latitude", "longitude").collect()] == [("A", 12.5, 77.0)]
    assert sorted((r.venue, ", ".join(r.faults)) for r in bad.collect()) == [("", "blank venue"), ("B", "no number"), ("C", "repeated venue"), ("C", "repeated venue"), ("D", "no number")]
    rows = [(1, "A", "2024-01-01 10:00:00", "2024-01-01 12:00:00", None), (2, " ", "soon", "", "x"), (3, "A", "2024-01-01T10:00:00Z", "2024-01-01T16:30:00+05:30", "y"), (4, "Z", "2024-01-01", "2024-01-02", "z"), (5, "A", "2024-01-01T12:00:00+01:00", "2024-01-01T16:30:00+05:30", "")]
    c = spark.createDataFrame(rows, "event_id int, venue string, start_ts string, end_ts string, label string")
    good, bad = context.routed(context.checked_calendar(c, known))
    assert {r.event_id: (r.label, str(r.start_ts), r.latitude) for r in good.collect()} == {1: ("", "2024-01-01 10:00:00", 12.5), 3: ("y", "2024-01-01 15:30:00", 12.5)}
    assert {r.event_id: r.faults for r in bad.collect()} == {2: ["blank venue", "no start", "no end"], 4: ["no hub"], 5: ["end not after start"]}
    with pytest.raises(Exception, match="no hub"):
        context.routed(context.checked_calendar(c.where("event_id in (1, 4)"), known), mode="error")
    assert context.routed(context.checked_calendar(c.where("event_id = 1"), known), mode="error")[0].count() == 1


def test_missing_weather_is_zero_or_an_error(spark):
    b = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS start_hour, timestamp_ntz'2024-01-01 03:00:00' AS end_hour")
    p = spark.createDataFrame([(["2024-01-01T00:00", "2024-01-01T01:20", "2024-01-01T01:40", "2024-01-01T02:00"], [0.0, 1.0, 2.0, None], [9.0, 9.0, 9.0, 3.0])], "time array<string>, rain array<double>, precipitation array<double>")
    got = {r.target_hour.hour: (r.rainfall_mm, r.is_raining) for r in context.hourly_weather(p, b).collect()}
    assert got == {0: (0.0, 0), 1: (2.0, 1), 2: (3.0, 1), 3: (0.0, 0)}
    with pytest.raises(Exception, match="no rainfall for 2024-01-01 03:00:00"):
        context.hourly_weather(p, b, missing="error").collect()
    with pytest.raises(ValueError):
        context.hourly_weather(p.drop("rain", "precipitation"), b)
    rows = spark.sql("SELECT 1 AS x, timestamp_ntz'2024-01-01 02:00:00' AS target_hour UNION ALL SELECT 2, timestamp_ntz'2024-01-05 00:00:00'")
    weather = context.hourly_weather(p, b)
    assert {r.x: r.rainfall_mm for r in context.join_weather(rows, weather).collect()} == {1: 3.0, 2: 0.0}
    with pytest.raises(Exception, match="no rainfall for 2024-01-05 00:00:00"):
        context.join_weather(rows, weather, missing="error").collect()


def test_places_of_parking(spark):
    p = lambda *xy: [{"lon": float(x), "lat": float(y)} for x, y in xy]
    horseshoe = p((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (3, 2), (3, 10), (0, 10), (0, 0))
    rows = [("way", 1, None, None, horseshoe, None), ("way", 2, None, None, p((0, 0), (4, 1), (10, 0)), None), ("way", 3, None, None, p((1, 2), (3, 4)), {"lat": 9.0, "lon": 9.0}), ("way", 4, None, None, None, {"lat": 5.0, "lon": 6.0}), ("node", 5, 7.0, 8.0, p((0, 0), (1, 1)), None), ("way", 6, None, None, p((0, 0)), None), ("node", 7, 1.0, None, None, None)]
    df = spark.createDataFrame(rows, "type string, id long, lat double, lon double, geometry array<struct<lon double, lat double>>, center struct<lat double, lon double>").withColumn("tags", F.lit(None).cast("map<string,string>"))
    got = {r.parking_id: (r.kind, r.lon, r.lat) for r in elements.parking(df).collect()}
    assert got == {"osm:way:1": ("polygon", 1.5, 6.0), "osm:way:2": ("line", 4.0, 1.0), "osm:way:3": ("line", 1.0, 2.0), "osm:way:4": ("point", 6.0, 5.0), "osm:node:5": ("point", 8.0, 7.0)}


def test_a_long_ring_takes_time_in_proportion(spark):
    """A comb of 200 teeth: what is common to a ring's edges is worked out once, not for each edge."""
    teeth = [(float(i), 10.0 if i % 2 else 0.0) for i in range(1, 400)]
    ring = [{"lon": x, "lat": y} for x, y in [(0.0, -1.0), (0.0, 0.0), *teeth, (400.0, 0.0), (400.0, -1.0), (0.0, -1.0)]]
    df = spark.createDataFrame([("way", 1, None, None, ring), ("way", 2, None, None, ring[1:-1])], "type string, id long, lat double, lon double, geometry array<struct<lon double, lat double>>").withColumn("tags", F.lit(None).cast("map<string,string>"))
    begun = time.monotonic()
    got = {r.parking_id: (r.kind, r.lon, r.lat) for r in elements.parking(df).collect()}
    assert got["osm:way:1"] == ("polygon", 1.0, 5.0) and got["osm:way:2"][0] == "line" and time.monotonic() - begun < 20


def test_pieces_that_cross_touch_or_are_dots(spark):
    f = lambda *v: round(spark.range(1).select(geo.pieces_distance(*map(F.lit, map(float, v)))).first()[0], 9)
    assert [f(0, 0, 2, 2, 0, 2, 2, 0), f(0, 0, 1, 0, 1, 0, 1, 5), f(0, 0, 4, 0, 1, 0, 9, 0), f(0, 0, 1, 0, 3, 0, 9, 0), f(0, 0, 0, 0, 3, 4, 3, 4), f(0, 0, 4, 0, 2, 1, 2, 3)] == [0, 0, 0, 2, 5, 1]


# --- streams
def test_a_stopped_stream_goes_on_and_drops_what_is_late(spark):
    at = lambda d, h, m=0: datetime(2024, 1, d, h, m)
    schema = "id long, event_time timestamp, segment_id string, vehicle_class string"
    parts = [[(1, at(1, 0), "s", "car"), (2, at(1, 0, 59), "s", "two_wheeler"), (3, at(1, 5), "s", "car")], [(3, at(1, 5), "s", "car"), (4, at(1, 5, 30), "s", "car"), (5, at(1, 9), "t", "car")], [(6, at(1, 1), "s", "car"), (7, at(3, 0), "s", "car")]]
    out, dropped = live.resumed(spark, [spark.createDataFrame(p, schema) for p in parts], live.segment_hours, shared.folder(spark))
    got = {(r.segment_id, r.target_hour.hour): r.count_total for r in out.collect()}
    assert got == {("s", 0): 2, ("s", 5): 2, ("t", 9): 1} and dropped == 1


def test_lags_are_not_broadcast(spark):
    """Spark takes the exploded history for small, whatever it holds."""
    hours = shared.staged(spark.createDataFrame([("a", datetime(2024, 1, 1, h), h + 1) for h in range(3)], "segment_id string, target_hour timestamp_ntz, count_total long"))
    lagged = history.lags_with_fallback(hours, hours)
    near = spark.createDataFrame([("a", "a")], "segment_id string, neighbour string")
    plan = history.spillover(lagged.select("segment_id", "target_hour", "lag_1h_total"), near)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r.target_hour.hour, r.lag_1h_total, r.lag_2h_total, r.lag_168h_total) for r in lagged.collect()) == [(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 2.0), (2, 2.0, 1.0, 3.0)]


def test_a_batch_of_scores_asks_the_state_once():
    class Value:
        def __init__(self):
            self.held, self.calls = None, 0

        def exists(self):
            self.calls += 1
            return self.held is not None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    state = live.BandChanges()
    state.last = Value()
    tell = lambda *rows: [tuple(r) for f in state.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=["target_hour", "eps", "priority_band"])]), None) for r in f.itertuples(index=False)]
    assert tell((2, 60.0, "b"), (1, 10.0, "a"), (3, 61.0, "b"), (4, 5.0, "a")) == [("s", 2, 10.0, 60.0, "a", "b", "escalated"), ("s", 4, 61.0, 5.0, "b", "a", "deescalated")]
    assert tell((5, 90.0, "c")) == [("s", 5, 5.0, 90.0, "a", "c", "escalated")] and state.last.calls == 4


def test_band_changes_are_not_broadcast(spark):
    rows = shared.staged(spark.createDataFrame([("s", 1, 10.0, "a"), ("t", 1, 10.0, "a")], "segment_id string, target_hour long, eps double, priority_band string"))
    new = rows.withColumn("priority_band", F.when(F.col("segment_id") == "s", "b").otherwise("a"))
    got = context.band_changes(rows, new, ["segment_id", "target_hour"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [(r.segment_id, r.old_band, r.new_band) for r in got.collect()] == [("s", "a", "b")]


def test_explanations_are_ranked_within_their_row(spark):
    rows = spark.createDataFrame([("s", 4.0, 1.0, 2.0, 2.0), ("t", 0.0, 3.0, 2.0, 4.0)], "id string, a double, b double, c double, d double")
    got = learning.explanation_cuts(rows, {"a": 1.0, "b": 1.0, "c": 9.0, "d": -2.0}, ["id"], (1, 1), (1, 0), 2, 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    assert sorted(map(tuple, got.collect())) == [("s", "a", 2.0, 1, 1, 1, 1), ("s", "b", -1.0, 1, 0, 0, 0), ("s", "d", 2.0, 0, 0, 1, 0), ("t", "a", -2.0, 1, 0, 1, 0), ("t", "b", 1.0, 1, 1, 0, 1), ("t", "d", -2.0, 0, 0, 1, 0)]


def test_features_are_written_packed(spark):
    path = shared.folder(spark)
    geojson.write(spark.createDataFrame([("s", "LINESTRING (1 2, 3 4)", 1.0, 2.0, "x")] * 1000, "segment_id string, geometry_wkt string, lon_center double, lat_center double, map_matching_mode string").coalesce(1), path)
    text = spark.read.text(path)
    assert all(f.endswith(".gz") for f in text.inputFiles()) and text.count() == 1000 and text.distinct().count() == 1


def test_means_of_hours_are_not_broadcast(spark):
    """What is grouped by segment and hour grows with the facts, however small its packed files."""
    from kerbline.plans import core

    for query in ("C5_climatology_join", "C17_anti_join"):
        plan = core.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "segment_id" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_events_are_read_once_for_hours_and_dimension(spark):
    """Neither joins the events; bulk entry and activity follow from the hours, modes from the sums of equal texts."""
    from kerbline.plans import core

    sf, scans = "/root/testdata/sf0.001", lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")
    assert scans(core.hours.__wrapped__(spark, sf)) == 1
    whole = core.dimension.__wrapped__(spark, sf)
    assert not [f for f in whole.inputFiles() if f.endswith("events.parquet")]


def test_active_hours_are_those_of_marked_events(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("night", at(h % 6), "car", 1.5, 1.0) for h in range(12)] + [("night", at(9), "other", 8.5, 2.0)] * 10 + [("day", at(h), "auto", 0.3, 0.7) for h in range(22)] * 2 + [("rare", at(1), "car", 9.0, 9.0)] * 3
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, segment_id string, event_time timestamp_ntz, vehicle_class string, severity_weight double, sample_weight double").withColumn("target_hour", F.col("event_time"))
    marked = clean.mark_bulk_entry(e)
    want = facts.segment_hours(marked.join(facts.active_segments(marked).select("segment_id"), "segment_id", "left_semi"))
    shown = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    got = facts.active_hours(e)
    assert got.columns == want.columns and shown(got) == shown(want) and {r.segment_id for r in got.collect()} == {"night", "day"}


def test_means_of_lags_join_once_a_segment(spark):
    hours = shared.staged(spark.createDataFrame([("a", datetime(2024, 1, d, h), d + h) for d in (1, 2, 8) for h in (3, 4)], "segment_id string, target_hour timestamp_ntz, count_total long"))
    asked = spark.createDataFrame([("a", datetime(2024, 1, 15, 4)), ("b", datetime(2024, 1, 15, 4))], "segment_id string, target_hour timestamp_ntz")
    lagged = history.lags_with_fallback(asked, hours)
    assert lagged._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    got = {r.segment_id: (r.lag_1h_total, r.lag_2h_total, r.lag_24h_total, r.lag_168h_total) for r in lagged.collect()}
    assert got == {"a": (pytest.approx((4 + 5 + 11) / 3), 0.0, pytest.approx((5 + 6 + 12) / 3), 12.0), "b": (0.0, 0.0, 0.0, 0.0)}
    later = history.lags_with_fallback(asked.withColumn("target_hour", F.expr("target_hour + interval 7 days")), hours)
    assert {r.segment_id: r.lag_168h_total for r in later.collect()} == {"a": pytest.approx((5 + 12) / 2), "b": 0.0}
