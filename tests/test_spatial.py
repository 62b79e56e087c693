"""Spatial joins against all pairs: packed trees, the grid with levels, lines near lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo, tree
from kerbline.operators import spatial

LINE = "segment_id string, osm_highway string, points array<struct<lon double, lat double>>"


@pytest.fixture(params=["broadcast", "joined"])
def way(request, monkeypatch):
    """Both ways by which queries meet a level of the tree."""
    if request.param == "joined":
        monkeypatch.setattr(tree, "SMALL", 0)


def crowd(n: int, seed: int = 3) -> list[tuple]:
    """90 % of the places lie within a few metres, a third of those in one spot."""
    r = random.Random(seed)
    return [(f"r{i:04}", 12.97, 77.59) if i % 10 < 3 else (f"r{i:04}", 12.97 + r.random() / 1e4, 77.59 + r.random() / 1e4) if i % 10 < 9 else (f"r{i:04}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(n)]


def test_nearest_in_a_crowd_is_brute_force(spark, way):
    r = random.Random(1)
    asked = [(f"q{i}", 12.97 + r.uniform(-2, 2) / 1e4, 77.59 + r.uniform(-2, 2) / 1e4) for i in range(40)] + [(f"p{i}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(40)]
    a = spark.createDataFrame([*asked, ("none", None, 1.0), ("nan", float("nan"), 1.0), ("pole", 90.0, 0.0)], "a string, lat double, lon double")
    b = spark.createDataFrame(crowd(3000), "b string, rlat double, rlon double")
    got = {x.a: (x.distance_km, x.b) for x in spatial.haversine_nearest(a, b, "a", ["b"], ["b"]).collect()}
    d = F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")), 9)
    pairs = a.where("lat is not null and not isnan(lat)").crossJoin(b).groupBy("a").agg(F.min(F.struct(d.alias("d"), "b")).alias("m"))
    assert got == {x.a: (x.m.d, x.m.b) for x in pairs.collect()}


def test_nearest_of_each_kind_is_brute_force(spark, way):
    r = random.Random(2)
    a = spark.createDataFrame([(i, r.uniform(0, 1e4), r.uniform(0, 1e4)) for i in range(50)] + [(99, None, 0.0)], "a int, lx double, ly double")
    places = [(i, "many" if i % 10 else "few", 5000.0 if i % 3 else r.uniform(0, 1e4), r.uniform(0, 1e4)) for i in range(1500)] + [(-1, "one", 0.0, 0.0), (-2, "none", None, 0.0)]
    b = spark.createDataFrame(places, "b int, kind string, rx double, ry double").withColumn("more", F.col("b") * 2)
    got = {(x.a, x.kind): (round(x.distance, 6), x.b, x.more) for x in spatial.ring_nearest(a, b, "a", "b", ["more"], "kind").collect()}
    want = {}
    for i, x, y in [tuple(q) for q in a.where("lx is not null").collect()]:
        for kind in ("many", "few", "one"):
            d, n = min((math.dist((x, y), (p[2], p[3])), p[0]) for p in places if p[1] == kind)
            want[i, kind] = round(d, 6), n, n * 2
    assert got == want
    assert spatial.ring_nearest(a, b.limit(0), "a", "b", ["more"], "kind").count() == 0


def test_leaves_hold_equally_many(spark):
    b = spark.createDataFrame(crowd(4000), "b string, x double, y double").dropDuplicates(["x", "y"])
    packed = tree.pack(b, ["x", "y"], ["x", "y"], keep=["b"])
    sizes = [r.n for r in packed.levels[0].select(F.size("kids").alias("n")).collect()]
    assert max(sizes) <= tree.FAN and sum(sizes) == b.count() and len(sizes) <= 2 + b.count() // tree.FAN + 2 * 8
    assert packed.sizes[-1] == 1


def roads(n: int) -> list[tuple]:
    r = random.Random(7)
    out = [("long", "primary", [(77.0, 10.0), (79.0, 13.0), (82.0, 15.0)]), ("dot", "primary", [(77.5, 12.9)]), ("none", "primary", None)]
    for i in range(n):
        x, y = 77.5 + r.random() / 20, 12.9 + r.random() / 20
        path = [(x, y)]
        for _ in range(r.randrange(1, 4)):
            x, y = x + r.uniform(-1, 1) * 10 ** r.uniform(-4, -2), y + r.uniform(-1, 1) * 10 ** r.uniform(-4, -2)
            path.append((x, y))
        out.append((f"r{i:03}", r.choice(["motorway", "primary", "residential"]), path))
    return out


@pytest.mark.parametrize("penalties", [None, {}])
def test_roads_are_matched_as_over_all_pairs(spark, penalties, way):
    r, reach = random.Random(4), 0.002
    points = [(i, 77.5 + r.random() / 20, 12.9 + r.random() / 20) for i in range(80)] + [(100 + i, r.uniform(70, 90), r.uniform(5, 20)) for i in range(20)]
    known = roads(150)
    got = {x.id: (x.segment_id, round(x.distance_deg, 9)) for x in spatial.match_roads(spark.createDataFrame([*points, (999, None, 1.0)], "id int, lon double, lat double"), spark.createDataFrame(known, LINE), penalties=penalties).collect()}

    def apart(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.dist(p, (a[0] + t * dx, a[1] + t * dy))

    fee = {"motorway": 0.0005, "primary": 0.0002} if penalties is None else {}
    for i, *p in points:
        every = [(round(min(apart(p, a, b) for a, b in zip(path, path[1:])), 12), name, kind, path) for name, kind, path in known if path and len(path) > 1]
        near = [e for e in every if all(min(c) - reach <= v <= max(c) + reach for v, c in zip(p, zip(*e[3])))] if penalties is None else []
        best = min(near, key=lambda e: (round(e[0] + fee.get(e[2], 0), 12), e[1])) if near else min(every)
        assert got[i] == (best[1], round(best[0], 9)), i
    assert len(got) == len(points)


def test_a_long_road_is_a_few_rows(spark):
    box = spark.createDataFrame(roads(0)[:1], LINE).select(F.lit(77.0).alias("x1"), F.lit(10.0).alias("y1"), F.lit(82.0).alias("x2"), F.lit(15.0).alias("y2"))
    assert geo.in_levels(box.withColumn("level", geo.level("x1", "y1", "x2", "y2", 0.008)), "x1", "y1", "x2", "y2", 0.008).count() <= 4


@pytest.mark.parametrize("reach", [1e-4, 4e-3])
def test_lines_near_lines_are_all_pairs(spark, reach):
    lines = {name: path for name, _, path in roads(60) if path}
    df = spark.createDataFrame([*lines.items(), ("copy", lines["r001"]), ("gone", None)], "id string, points array<struct<lon double, lat double>>")
    lines |= {"copy": lines["r001"]}
    got = {(x.id, x.other): round(x.distance, 9) for x in spatial.near_lines(df.where("id != 'r002'"), df, reach).collect()}

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def point(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.dist(p, (a[0] + t * dx, a[1] + t * dy))

    def apart(a, b, c, d):
        if cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0:
            return 0.0
        return min(point(a, c, d), point(b, c, d), point(c, a, b), point(d, a, b))

    want = {}
    for i, p in lines.items():
        for j, q in lines.items():
            if i != j and i != "r002" and len(p) > 1 and len(q) > 1:
                d = min(apart(a, b, c, e) for a, b in zip(p, p[1:]) for c, e in zip(q, q[1:]))
                if d <= reach:
                    want[i, j] = round(d, 9)
    assert got == want and ("r001", "copy") in got


def test_ripples_fade_with_the_distance_of_the_centroids(spark):
    metre = 1 / 111195
    line = lambda y: [(77.0, 12 + y * metre), (77.0 + 1e-4, 12 + y * metre)]
    rows = spark.createDataFrame([("a", 1, 70.0), ("b", 1, 10.0), ("c", 1, 20.0), ("d", 1, 5.0), ("b", 2, 90.0), ("e", 1, 99.0)], "segment_id string, target_hour int, eps double")
    known = spark.createDataFrame([("a", line(0)), ("b", line(10)), ("c", line(30)), ("d", line(60)), ("e", None)], "segment_id string, points array<struct<lon double, lat double>>")
    got = {(r.source_bottleneck, r.segment_id, r.target_hour): (round(r.decay, 3), r.eps_spillover) for r in spatial.ripples(rows, known).collect()}
    assert got == {("a", "b", 1): (0.89, 62.3), ("a", "c", 1): (0.73, 51.1)}


def test_only_asked_hours_have_events(spark):
    asked = spark.createDataFrame([("s", "2024-01-01 05:00:00", 12.9, 77.5), ("s", "2024-01-01 07:00:00", 12.9, 77.5), ("t", "2024-01-01 05:00:00", None, 77.5)], "segment_id string, h string, lat double, lon double")
    asked = asked.withColumn("target_hour", F.col("h").cast("timestamp_ntz")).drop("h")
    events = [("e1", "V1", "x", 12.95, 77.5, "2024-01-01 04:30:00", "2024-01-01 06:00:00"), ("e2", "V2", "y", 12.91, 77.5, "2024-01-01 05:59:00", "2024-01-01 06:01:00"), ("e3", "V3", "z", 12.9, 77.5, "2024-01-01 05:00:00", "2024-01-01 05:00:00")]
    c = spark.createDataFrame(events, "event_key string, venue string, label string, elat double, elon double, s string, e string").selectExpr("*", "cast(s as timestamp_ntz) start_ts", "cast(e as timestamp_ntz) end_ts")
    got = {(r.segment_id, r.target_hour.hour): (r.active_event_count, round(r.nearest_event_distance_m), r.venue) for r in spatial.active_events(asked, c).collect()}
    assert got == {("s", 5): (2, 1112, "V2"), ("s", 7): (0, 1000000, None), ("t", 5): (2, 1000000, None)}


def test_nearest_is_worked_out_by_many_tasks(spark):
    """Queries and lots are few bytes: as they come they would be one task's."""
    from kerbline.plans import more

    left = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("k"), (F.col("id") * 7 % 40).cast("double").alias("lx"), F.lit(0.0).alias("ly"))
    right = spark.range(0, 200, 1, 1).select(F.col("id").alias("r"), (F.col("id") / 5).alias("rx"), F.lit(1.0).alias("ry"))
    found = spatial.ring_nearest(left, right, "k", "r", [])
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {int(r.k): r.r for r in found.collect()} == {i: i * 7 % 40 * 5 for i in range(40)}
    assert "TAN(" not in more.lots_m(spark, "/root/testdata/sf0.001").where("rx > 0")._jdf.queryExecution().optimizedPlan().toString()
