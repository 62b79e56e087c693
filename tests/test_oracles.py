"""Registered queries against DuckDB's computation of them at the smallest scale, a sample of each family; and hand-made edge rows."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from kerbline import registry
from kerbline.functions import geo
from kerbline.functions import refdata as R
from kerbline.functions import shared
from kerbline.operators import clean, scoring, spatial, tags
from kerbline.plans import core, more
from kerbline.plans.sql import case, oracle

SF = "/root/testdata/sf0.001"
NAMES = ["B5_violation_severity", "D2_class_counts", "C7_lags_with_fallback", "C12_radius_counts", "C9_active_events", "I13_action", "D17_binary_quality", "G3_negative_samples", "F3_publication", "C1_map_matching", "A9_stations", "A10_top_csv", "C3_attach_geometry", "F5_explanation_cuts", "J2_live_rescoring", "J6_feedback_accuracy", "C16_ripples", "A6_calendar_faults", "A5_parking_supply", "D5_geometry_centres", "D19_at_k", "J1_late_rows", "H1_poisson_chain", "H3_calibration_quality", "A15_model_artifacts", "F1_top_k"]


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v if v is None or isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(registry.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == columns
    wanted = sorted((tuple(plain(r[at[c]]) for c in columns) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == wanted


@pytest.mark.parametrize("name", ["C1_map_matching", "C2_nearest_edge", "C3_attach_geometry"])
def test_every_event_has_its_road(spark, name):
    """Over all pairs, by the reference's rule: the box holds the candidates of C1; where it has none, and in C2 always, the plain nearest."""
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    cost = "d" if name == "C2_nearest_edge" else f"CASE WHEN inside THEN round(d + {case('osm_highway', R.SNAP_PENALTY, 0.0)}, 12) ELSE d END"
    first = "" if name == "C2_nearest_edge" else "inside DESC, "
    pairs = f"SELECT e.id, ln.road, ln.osm_highway, lon1, lat2, {more._DIST} AS d, {more._BOX} AS inside FROM cleaned1 e, (SELECT segment_id AS road, osm_highway, lon1, lat1, lon2, lat2 FROM roads) ln"
    shown = "round(lon1, 9), round(lat2, 9)" if name == "C3_attach_geometry" else "round(d, 9)"
    wanted = con.execute(oracle(f"SELECT id, road, {shown} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {first}{cost}, road) AS n FROM ({pairs})) WHERE n = 1")).fetchall()
    columns = ["id", "segment_id", "lon1", "lat2"] if name == "C3_attach_geometry" else ["id", "segment_id", "distance_deg"]
    got = registry.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted((tuple(map(plain, r)) for r in got), key=str) == sorted((tuple(map(plain, r)) for r in wanted), key=str)
    assert len({r.id for r in got}) == con.execute(oracle("SELECT count(*) FROM cleaned1")).fetchone()[0]


def test_active_events_are_told_of_every_segment_and_hour(spark):
    hours, got = core.hours(spark, SF), registry.QUERIES["C9_active_events"](spark, SF)
    assert got.count() == core.dimension(spark, SF).count() * hours.select("target_hour").distinct().count() > hours.count()


def test_nearest_road_is_not_the_diagonal_one_of_the_box(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0), (3, None, 0.0), (4, float("nan"), 0.0)], "id long, lon double, lat double")
    line = lambda x1, y1, x2, y2: [(x1, y1), (x2, y2)]
    roads = spark.createDataFrame([("far", "primary", line(0.0019, 0.0019, 0.0019, 0.01)), ("near", "primary", line(0.0021, -1.0, 0.0021, 1.0)), ("dot", "primary", [(0.0, 0.0)])], "segment_id string, osm_highway string, points array<struct<lon double, lat double>>")
    named = lambda p: {r.id: r.segment_id for r in spatial.match_roads(points, roads, penalties=p).collect()}
    assert named({}) == {1: "near", 2: "near"}
    assert named(None) == {1: "far", 2: "near"}
    assert spatial.match_roads(points, roads.limit(0)).count() == 0


def test_every_count_is_forecast(spark):
    rows = registry.QUERIES["H1_poisson_chain"](spark, SF)
    names = [f"pred_{c}" for c in R.COUNTS]
    assert rows.columns == ["segment_id", "target_hour", *names] and len(names) == 6
    assert all(r[n] is not None and 0 <= r[n] < float("inf") for r in rows.collect() for n in names)


def test_the_next_24_hours_are_scored(spark):
    rows = registry.QUERIES["predict_next_24h"](spark, SF).collect()
    hours = {r.target_hour for r in rows}
    assert len(hours) == 24 and len(rows) == 24 * len({r.segment_id for r in rows}) == registry.QUERIES["G4_future_grid"](spark, SF).count()
    assert all(0 <= r.eps <= 100 and 0 <= r.priority <= 1 and r.predicted_total >= 0 for r in rows)
    assert all(r.priority_band in ("Red Line", "Orange Line", "Watchlist", "Low") for r in rows)


def test_first_rows_and_running_sums(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), F.col("id").alias("b"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    plain = sorted(tuple(r) for r in rows.select("a", "b").collect())
    assert sorted(tuple(r)[:2] for r in shared.first_rows(rows.select("a", "b"), ["a", "b"], 77).collect()) == plain[:77]
    got = {(r.g, r.a, r.b): r.s for r in shared.running_sum(rows, ["a", "b"], "b", "s", group="g").collect()}
    for g in (None, 1, 2):
        total = 0
        for a, b in sorted((r.a, r.b) for r in rows.collect() if r.g == g):
            assert got[g, a, b] == total
            total += b


def test_spread_join_of_a_hot_key(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), F.col("id"))
    single = spark.createDataFrame([(7, "hot"), (3500, "one"), (9999, "none")], "k long, v string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = shared.spread_join(rows, single, ["k"], counts, F.col("id"), "left").groupBy("v").count().rdd.collectAsMap()
    assert got == {"hot": 3000, "one": 1, None: 999}


def test_nearest_on_the_globe_is_brute_force(spark):
    place = lambda k, m: (f"{k}", (k * m % 179) - 89.0, (k * m * 7 % 359) - 179.5)  # noqa: E731 - near poles and the date line, too
    a = spark.createDataFrame([place(k, 37) for k in range(60)] + [("null", None, 1.0)], "a string, lat double, lon double")
    b = spark.createDataFrame([place(k, 53) for k in range(25)], "b string, rlat double, rlon double")
    got = {r.a: r.distance_km for r in spatial.haversine_nearest(a, b, "a", ["b"], ["b"]).collect()}
    d = F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")), 9)
    assert got == {r.a: r.d for r in a.where("lat is not null").crossJoin(b).groupBy("a").agg(F.min(d).alias("d")).collect()}
    assert spatial.haversine_nearest(a, b.limit(0), "a", ["b"], ["b"]).count() == 0


def test_the_first_volume_column_counts(spark):
    from kerbline.operators import context

    s = spark.createDataFrame([("x",), ("y",), ("z",)], "segment_id string")
    v = spark.createDataFrame([("x", 9.0, 2.0, 5.0), ("y", 9.0, -2.0, 5.0)], "segment_id string, volume double, segment_total_events double, count_total double")
    assert {r.segment_id: r.volume for r in context.attach_volume(s, v).collect()} == {"x": 2.0, "y": 0.0, "z": 0.0}


def one(spark, **columns):
    return lambda *out: spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).select(*out).first()


def test_severity_of_bad_json_and_null(spark):
    rows = spark.createDataFrame([('["WRONG PARKING","DOUBLE PARKING"]',), ("[broken PARKING",), (" no parking ",), (None,), ("[]",)], "t string")
    assert [r[0] for r in rows.select(clean.violation_severity(F.col("t"))).collect()] == [2.0, 1.0, 1.2, 1.0, 1.0]


def test_bands_at_their_edges(spark):
    rows = spark.createDataFrame([(80.0,), (79.99,), (50.0,), (35.0,), (34.9,)], "e double")
    assert [r[0] for r in rows.select(scoring.band(F.col("e"))).collect()] == ["Red Line", "Orange Line", "Orange Line", "Watchlist", "Low"]


def test_capacity_words_and_ranges(spark):
    rows = spark.createDataFrame([("10",), ("yes",), ("5-12",), ("~7 cars",), ("",), (None,), ("0",)], "t string")
    assert [r[0] for r in rows.select(tags.capacity(F.col("t"))).collect()] == [10.0, None, 12.0, 7.0, None, None, None]


def test_grid_join_is_brute_force(spark):
    a = spark.range(60).select(F.col("id").alias("a"), (F.col("id") * 37 % 61 / 10).alias("ax"), (F.col("id") * 17 % 53 / 10).alias("ay"))
    b = spark.range(80).select(F.col("id").alias("b"), (F.col("id") * 29 % 67 / 10).alias("bx"), (F.col("id") * 13 % 59 / 10).alias("by"))
    got = {(r.a, r.b) for r in geo.grid_join(a, b, ("ax", "ay"), ("bx", "by"), 1.0).select("a", "b").collect()}
    brute = {(r.a, r.b) for r in a.crossJoin(b).where("sqrt(pow(ax - bx, 2) + pow(ay - by, 2)) <= 1.0").select("a", "b").collect()}
    assert got == brute


def test_no_nested_loops_in_spatial_plans(spark):
    for name in ("C1_map_matching", "C12_radius_counts", "C16_ripples"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        if name == "C12_radius_counts":  # in the others a row is broadcast: the scales, the root of the tree
            assert "BroadcastNestedLoopJoin" not in plan


def test_wkt_bad_text_is_null(spark):
    rows = spark.createDataFrame([("LINESTRING (1 2, 3 4)",), ("MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))",), ("POINT (1 2)",), ("LINESTRING (a b)",), (None,)], "t string")
    assert [None if r[0] is None else len(r[0]) for r in rows.select(geo.wkt_points(F.col("t"))).collect()] == [2, 2, None, None, None]
