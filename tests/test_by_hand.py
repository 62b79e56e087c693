"""Rows whose results were worked out with pencil and paper: a wrong entry of a fixed table can't pass on both sides here."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kerbline.operators import clean, scoring

TICKET = "id long, ts timestamp, latitude double, longitude double, location string, vehicle_type string, updated_vehicle_type string, violation_type string, police_station string, junction_name string, validation_status string"


def test_three_tickets(spark):
    at = datetime(2024, 1, 15, 3, 40)  # 09:10 local time, a holiday
    rows = [
        (1, at, 12.9716, 77.5946, "Outer Ring Road", "CAR", None, '["NO PARKING","DOUBLE PARKING"]', " Halasuru  Gate ", None, " Approved "),
        (2, at, 12.9716, 77.5946, "Some Layout", "scooter", " LORRY/GOODS  VEHICLE", "PARKING ON FOOTPATH", None, "BTP01 - Circle", None),
        (3, at, 12.9716, 77.5946, "x", "CAR", None, "NO PARKING", "x", None, "Rejected"),
        (4, at, 12.9716, 77.5946, "x", "CAR", None, "DEFECTIVE NUMBER PLATE", "x", None, "created1"),
    ]
    df = spark.createDataFrame(rows, TICKET).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.id: r for r in clean.clean_events(df).collect()}
    assert set(got) == {1, 2}  # a rejected one, and one that is no parking
    a, b = got[1], got[2]
    assert (a.vehicle_class, a.violation_severity_weight, a.sample_weight, a.road_class, a.road_width_m) == ("car", 2.0, 1.0, "primary", 12.0)
    assert a.severity_weight == pytest.approx(2.0 * 1.5 * 1.0) and a.police_station == "Halasuru Gate" and a.junction_bucket == "No Junction"
    assert (b.vehicle_class, b.violation_severity_weight, b.sample_weight, b.road_class, b.road_width_m) == ("heavy", 1.4, 0.5, "secondary", 9.0)  # the junction is a circle
    assert b.severity_weight == pytest.approx(1.4 * 2.5 * 0.5) and b.police_station == "Unknown" and b.junction_bucket == "Named Junction"
    assert str(a.event_time) == "2024-01-15 09:10:00" and str(a.target_hour) == "2024-01-15 09:00:00" and a.segment_id == "grid_12971_77594"


def test_one_score(spark):
    counts = {"count_two_wheeler": 2, "count_car": 1, "count_auto": 0, "count_light_commercial": 0, "count_heavy": 0, "count_other": 0}
    row = spark.createDataFrame([("s", 9, "primary", 12.0, 0.8, 1.2, *counts.values())], "segment_id string, hour int, road_class string, road_width_m double, priority double, congestion double, " + ", ".join(f"{c} long" for c in counts))
    r = scoring.score(row, spark.createDataFrame([(4.0, 0.2)], "count_p95 double, interruption_p95 double")).first()
    assert r.predicted_total == 3 and r.expected_parked_width_m == pytest.approx(0.81)  # 2 x 0.8 x 0.15 + 1.9 x 0.3
    assert r.peak_multiplier == 1.8 and r.interruption_raw == pytest.approx(0.00820125) and r.clearance_after_predicted_load_m == pytest.approx(11.19)
    assert r.parking_risk_0_100 == pytest.approx(77.687, abs=1e-3) and r.traffic_interruption_0_100 == pytest.approx(7.874, abs=1e-3)
    assert (r.hotspot_score, round(r.severity_score, 6), r.live_bonus) == (pytest.approx(80.0), 93.0, pytest.approx(5.0))  # (2 x 0.8 + 1.5) x 1.2 / 2 x 50
    assert r.vulnerability_score == pytest.approx(44.4444, abs=1e-4)
    assert r.eps == 85.99 and (r.priority_band, r.confidence_band, r.recommended_action, r.recommended_force_units) == ("Red Line", "High", "Immediate dispatch", 3)
    assert r.economic_loss_inr == pytest.approx(2418, abs=1)
