"""DuckDB's own text of the steps, as common table expressions that the oracles share."""

from __future__ import annotations

from ..functions import refdata as R
from .fixtures import LINES, VIEWS


def case(column: str, table: dict, default) -> str:
    show = lambda x: f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    return f"CASE {column} " + " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in table.items()) + f" ELSE {show(default)} END"


def listed(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


WIDTH_SUM = " + ".join(f"count_{c} * {R.CLASS_WIDTH[c] * R.OCCUPANCY[c]!r}::DOUBLE" for c in R.CLASSES)
FOOT_SUM = " + ".join(f"count_{c} * {R.FOOTPRINT[c] * 1.2!r}::DOUBLE" for c in R.CLASSES)

STEPS: dict[str, str] = {name: text.strip() for name, text in VIEWS.items()}
STEPS["kept"] = f"""SELECT *, lower(trim(validation_status)) AS status,
  upper(trim(regexp_replace(coalesce(updated_vehicle_type, vehicle_type, 'OTHERS'), '\\s+', ' ', 'g'))) AS label,
  CASE WHEN starts_with(ltrim(violation_type), '[') AND json_valid(violation_type) THEN from_json(violation_type, '["VARCHAR"]') ELSE [violation_type] END AS terms
 FROM violations WHERE validation_status IS NULL OR lower(trim(validation_status)) NOT IN ({listed(R.EXCLUDED_STATUS)})"""
STEPS["cleaned_all"] = f"""SELECT id, latitude, longitude, violation_type, validation_status, label, ts + INTERVAL 330 MINUTE AS event_time, date_trunc('hour', ts + INTERVAL 330 MINUTE) AS target_hour,
  {case("status", R.STATUS_WEIGHT, 0.5)} AS w0, {case("label", R.VEHICLE_CLASS, "other")} AS vehicle_class,
  greatest(1.0::DOUBLE, coalesce(list_max([{case("upper(trim(t))", R.SEVERITY, 1.0)} FOR t IN terms]), 1.0::DOUBLE)) AS violation_severity_weight,
  CAST(floor(latitude / 0.001::DOUBLE) AS BIGINT) AS lat_bin, CAST(floor(longitude / 0.001::DOUBLE) AS BIGINT) AS lon_bin,
  coalesce(nullif(trim(regexp_replace(coalesce(police_station, 'Unknown'), '\\s+', ' ', 'g')), ''), 'Unknown') AS police_station,
  coalesce(nullif(trim(regexp_replace(coalesce(junction_name, 'No Junction'), '\\s+', ' ', 'g')), ''), 'Unknown') AS junction_name,
  coalesce(nullif(trim(regexp_replace(coalesce(location, ''), '\\s+', ' ', 'g')), ''), 'Unknown') AS location,
  contains(upper(coalesce(violation_type, '')), 'PARKING') OR contains(upper(coalesce(violation_type, '')), 'FOOTPATH') AS is_parking FROM kept"""
STEPS["cleaned0"] = f"""SELECT *, 'grid_' || lat_bin || '_' || lon_bin AS segment_id, {case("vehicle_class", R.FOOTPRINT, 1.0)} AS vehicle_footprint_weight,
  CASE WHEN junction_name = 'No Junction' THEN 'No Junction' ELSE 'Named Junction' END AS junction_bucket,
  CASE WHEN regexp_matches(upper(concat_ws(' ', location, junction_name, violation_type)), '{R.PRIMARY_TEXT}') THEN 'primary'
   WHEN regexp_matches(upper(concat_ws(' ', location, junction_name, violation_type)), '{R.SECONDARY_TEXT}') THEN 'secondary' ELSE 'residential' END AS road_class FROM cleaned_all WHERE is_parking"""
STEPS["cleaned1"] = f"""SELECT *, {case("road_class", R.ROAD_WIDTH, 6.0)} AS road_width_m, violation_severity_weight * vehicle_footprint_weight * w0 AS s0 FROM cleaned0"""
STEPS["bulk"] = "SELECT segment_id, CAST(avg(CASE WHEN hour(event_time) < 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.35 AS INT) AS is_bulk_artifact_segment FROM cleaned1 GROUP BY 1"
STEPS["cleaned"] = """SELECT c.*, is_bulk_artifact_segment, w0 * CASE WHEN is_bulk_artifact_segment = 1 AND hour(event_time) < 6 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS sample_weight,
  s0 * CASE WHEN is_bulk_artifact_segment = 1 AND hour(event_time) < 6 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS severity_weight FROM cleaned1 c JOIN bulk USING (segment_id)"""
STEPS["active"] = "SELECT segment_id, count(*) AS event_count FROM cleaned GROUP BY 1 HAVING count(*) >= 20"
STEPS["hours0"] = "SELECT segment_id, target_hour, " + ", ".join(f"count(*) FILTER (vehicle_class = '{c}') AS count_{c}" for c in R.CLASSES) + """, count(*) AS count_total,
  sum(severity_weight) AS severity_weighted_count, least(sum(sample_weight), 5.0::DOUBLE) AS sample_weight FROM cleaned WHERE segment_id IN (SELECT segment_id FROM active) GROUP BY 1, 2"""
STEPS["hours"] = "SELECT *, CAST(round(severity_weighted_count, 9) >= 2 AS INT) AS is_hotspot, CAST(hour(target_hour) AS INT) AS hour, CAST(isodow(target_hour) - 1 AS INT) AS day_of_week FROM hours0"
STEPS["seg"] = """SELECT segment_id, count(*) AS event_count, avg(latitude) AS lat_mean, avg(longitude) AS lon_mean, min(lat_bin) AS lat_bin, min(lon_bin) AS lon_bin, avg(violation_severity_weight) AS severity_mean,
  avg(vehicle_footprint_weight) AS footprint_mean, max(road_width_m) AS road_width_m, (min(lat_bin) + 0.5::DOUBLE) * 0.001::DOUBLE AS lat_center, (min(lon_bin) + 0.5::DOUBLE) * 0.001::DOUBLE AS lon_center FROM cleaned GROUP BY 1"""
for _c in ("police_station", "junction_name", "road_class", "junction_bucket"):
    STEPS[f"mode_{_c}"] = f"SELECT segment_id, {_c} FROM (SELECT segment_id, {_c}, row_number() OVER (PARTITION BY segment_id ORDER BY count(*) DESC, {_c}) AS n FROM cleaned GROUP BY 1, 2) WHERE n = 1"
STEPS["dim"] = "SELECT * FROM seg JOIN mode_police_station USING (segment_id) JOIN mode_junction_name USING (segment_id) JOIN mode_road_class USING (segment_id)"
STEPS["bounds"] = "SELECT min(target_hour) AS start_hour, max(target_hour) AS end_hour, max(target_hour) - INTERVAL 7 DAY AS cutoff FROM hours"
STEPS["train"] = "SELECT * FROM hours WHERE target_hour < (SELECT cutoff FROM bounds)"
STEPS["span"] = "SELECT CAST(date_diff('hour', start_hour, cutoff) AS DOUBLE) AS h FROM bounds"
STEPS["past_hour"] = "SELECT segment_id, hour AS hr, avg(count_total) AS m FROM hours GROUP BY 1, 2"
STEPS["past_dow"] = "SELECT segment_id, day_of_week AS dow, hour AS hr, avg(count_total) AS m FROM hours GROUP BY 1, 2, 3"
STEPS["lagged"] = "SELECT h.*, " + ", ".join(f"t{k}.count_total AS true_{k}" for k in (1, 2, 3, 24, 168)) + ", " + ", ".join(f"coalesce(CAST(t{k}.count_total AS DOUBLE), f{k}.m, 0.0::DOUBLE) AS lag_{k}h_total" for k in (1, 2, 3, 24, 168)) + " FROM hours h " + " ".join(f"LEFT JOIN hours t{k} ON t{k}.segment_id = h.segment_id AND t{k}.target_hour = h.target_hour - INTERVAL {k} HOUR" for k in (1, 2, 3, 24, 168)) + " " + " ".join(f"LEFT JOIN past_hour f{k} ON f{k}.segment_id = h.segment_id AND f{k}.hr = (h.hour - {k} + 24) % 24" for k in (1, 2, 3)) + " LEFT JOIN past_hour f24 ON f24.segment_id = h.segment_id AND f24.hr = h.hour LEFT JOIN past_dow f168 ON f168.segment_id = h.segment_id AND f168.dow = h.day_of_week AND f168.hr = h.hour"
STEPS["near"] = "SELECT a.segment_id, b.segment_id AS neighbour FROM seg a JOIN seg b ON a.segment_id <> b.segment_id AND sqrt((a.lon_center - b.lon_center) ** 2 + (a.lat_center - b.lat_center) ** 2) <= 0.005::DOUBLE"
STEPS["lines"] = LINES.strip()
STEPS["scale"] = f"SELECT greatest(1.0::DOUBLE, quantile_cont(count_total::DOUBLE, 0.95)) AS count_p95, greatest(0.05::DOUBLE, quantile_cont((({WIDTH_SUM}) / road_width_m) ** 2, 0.95)) AS interruption_p95 FROM hours JOIN (SELECT segment_id, road_width_m FROM seg) USING (segment_id)"
# what is scored: the facts, with a priority and a congestion multiplier drawn from the row itself
STEPS["to_score"] = "SELECT h.*, d.road_class, d.road_width_m, d.police_station, d.lat_center, d.lon_center, CAST((h.count_total * 17 + h.hour * 5) % 100 AS DOUBLE) / 100 AS priority, 0.9::DOUBLE + CAST((h.hour * 7 + h.count_total) % 10 AS DOUBLE) / 10 AS congestion FROM hours h JOIN dim d USING (segment_id)"
STEPS["s1"] = f"""SELECT *, CAST(count_total AS DOUBLE) AS predicted_total, {WIDTH_SUM} AS expected_parked_width_m, CASE WHEN hour IN ({listed(R.PEAK)}) THEN 1.8::DOUBLE WHEN hour >= 23 OR hour <= 5 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS peak_multiplier,
  greatest(3.0::DOUBLE, road_width_m) AS rw, {case("hour", R.DAMPENER, 1.0)} AS damp, greatest(0.1::DOUBLE, congestion) AS m, greatest(1.0::DOUBLE, count_p95) / 2 AS cs, greatest(0.01::DOUBLE, interruption_p95) / 2 AS isc,
  {case("road_class", R.VULNERABILITY, 0.9)} + CASE WHEN greatest(3.0::DOUBLE, road_width_m) < 7 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS vm FROM to_score, scale"""
STEPS["s2"] = f"""SELECT *, (expected_parked_width_m / rw) ** 2 * peak_multiplier AS interruption_raw, rw - expected_parked_width_m AS clearance_after_predicted_load_m, 100 * (1 - exp(-predicted_total / cs)) AS parking_risk_0_100,
  greatest(0.0::DOUBLE, least(15.0::DOUBLE, (m - 1) * 25)) AS live_bonus, priority * 100 * damp AS hotspot_score, greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({FOOT_SUM}) / cs * 50 * damp)) AS severity_score,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, (vm - 0.7::DOUBLE) / 1.8::DOUBLE * 100 * damp)) AS vulnerability_score FROM s1"""
STEPS["s3"] = """SELECT *, 100 * (1 - exp(-interruption_raw / isc)) AS traffic_interruption_0_100, CAST(clearance_after_predicted_load_m < 1.5 AS INT) AS emergency_gridlock_flag,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.55::DOUBLE * hotspot_score + 0.35::DOUBLE * severity_score + 0.10::DOUBLE * vulnerability_score + live_bonus)) AS eps_raw FROM s2"""
STEPS["s4"] = """SELECT *, round_even(round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN clearance_after_predicted_load_m < 0 THEN greatest(eps_raw, 85.0::DOUBLE)
  WHEN clearance_after_predicted_load_m < 1.5 THEN eps_raw + (1.5::DOUBLE - clearance_after_predicted_load_m) * 10 ELSE eps_raw END)), 9), 2) AS e0 FROM s3"""
STEPS["s5"] = """SELECT *, CASE WHEN priority < 0.35 AND e0 >= 80 THEN 79.0::DOUBLE ELSE e0 END AS eps, CASE WHEN priority > 0.6 THEN 'High' WHEN priority >= 0.35 THEN 'Medium' WHEN greatest(priority, parking_risk_0_100 / 100) > 0.4 THEN 'Medium' ELSE 'Low' END AS confidence_band FROM s4"""
STEPS["s6"] = f"""SELECT *, CASE WHEN eps >= 80 THEN 'Red Line' WHEN eps >= 50 THEN 'Orange Line' WHEN eps >= 35 THEN 'Watchlist' ELSE 'Low' END AS priority_band, CAST({case("road_class", R.BASE_SPEED, 30)} AS DOUBLE) AS speed,
  CAST({case("road_class", R.TRAFFIC_VOLUME, 500)} AS DOUBLE) AS volume, least(100.0::DOUBLE, expected_parked_width_m / rw * 100) AS choke FROM s5"""
STEPS["scored"] = """SELECT *, CASE WHEN priority_band = 'Red Line' AND confidence_band = 'High' THEN 'Immediate dispatch' WHEN priority_band = 'Red Line' THEN 'Immediate dispatch or tow readiness'
  WHEN priority_band = 'Orange Line' AND confidence_band = 'High' THEN 'Preventative dispatch' WHEN priority_band = 'Orange Line' THEN 'Monitor (Low Confidence)' WHEN priority_band = 'Low' AND m >= 1.2 THEN 'Stand down: congestion likely not parking-led' ELSE 'Monitor' END AS recommended_action,
  CASE WHEN eps < 40 OR confidence_band = 'Low' THEN 0 ELSE least(3, CAST(ceil(eps / 35) AS INT)) END AS recommended_force_units,
  round_even(round(volume * (0.5::DOUBLE / greatest(5.0::DOUBLE, speed * (1 - least(95.0::DOUBLE, choke * 1.3::DOUBLE + eps * 0.15::DOUBLE) / 100)) - 0.5::DOUBLE / speed) * 233, 6), 0) AS economic_loss_inr FROM s6"""


def oracle(select: str) -> str:
    """``select`` with the steps before it."""
    used, text = [], select
    for name in reversed(STEPS):
        if f" {name}" in f" {text}".replace("(", " ").replace(",", " ").replace("\n", " "):
            used.append(name)
            text += " " + STEPS[name]
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in reversed(used)) + "\n" + select if used else select
