"""Events: status filter, local time, classes, weights, grid, text; bulk-entry detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refdata as R

ZONE, GRID = "Asia/Kolkata", 0.001
NIGHT_SHARE, NIGHT_FACTOR = 0.35, 0.1


def status_kept(status: Column) -> Column:
    """Null and unknown statuses are kept."""
    return F.coalesce(~F.lower(F.trim(status)).isin(*R.EXCLUDED_STATUS), F.lit(True))


def status_weight(status: Column) -> Column:
    return R.lookup(F.lower(F.trim(status)), R.STATUS_WEIGHT, 0.5)


def local_time(utc: Column, zone: str = ZONE) -> Column:
    """Wall-clock time without zone of a UTC time without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def vehicle_label(corrected: Column, original: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.coalesce(corrected, original, F.lit("OTHERS")), r"\s+", " ")))


def vehicle_class(label: Column) -> Column:
    return R.lookup(label, R.VEHICLE_CLASS, "other")


def violation_severity(text: Column) -> Column:
    """Largest weight of the terms of a JSON array, or of the text itself where it is none; 1 at least."""
    parsed = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}))
    terms = F.when(F.size(parsed) > 0, parsed).otherwise(F.array(text))
    weights = F.transform(terms, lambda t: R.lookup(F.upper(F.trim(t)), R.SEVERITY, 1.0))
    return F.greatest(F.lit(1.0), F.coalesce(F.array_max(weights), F.lit(1.0)))


def is_parking(text: Column) -> Column:
    upper = F.upper(F.coalesce(text, F.lit("")))
    return upper.contains("PARKING") | upper.contains("FOOTPATH")


def grid_id(lat: Column, lon: Column, size: float = GRID) -> Column:
    return F.concat_ws("_", F.lit("grid"), F.floor(lat / size).cast("string"), F.floor(lon / size).cast("string"))


def text_or(text: Column, default: str) -> Column:
    """Trimmed, white space collapsed; null gives ``default``, blank gives Unknown."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit(default)), r"\s+", " "))
    return F.when(clean == "", "Unknown").otherwise(clean)


def road_class_of_text(*texts: Column) -> Column:
    text = F.upper(F.concat_ws(" ", *texts))
    return F.when(text.rlike(R.PRIMARY_TEXT), "primary").when(text.rlike(R.SECONDARY_TEXT), "secondary").otherwise("residential")


def road_class_of_highway(highway: Column) -> Column:
    return R.lookup(F.lower(highway), {h: c for c, hs in R.HIGHWAY_CLASS.items() for h in hs}, "residential")


def clean_events(raw: DataFrame, grid: float = GRID, parking_only: bool = True) -> DataFrame:
    """Cleaned events from raw ones (id, ts in UTC without zone, latitude, longitude, location, vehicle types, violation_type, ...).

    Status and coordinates are filtered before anything is parsed; rows without coordinates or time go.
    """
    c = F.col
    rows = raw.where(status_kept(c("validation_status")) & c("latitude").isNotNull() & c("longitude").isNotNull() & c("ts").isNotNull())
    if parking_only:
        rows = rows.where(is_parking(c("violation_type")))
    rows = rows.select(
        "id", "latitude", "longitude", "violation_type", "validation_status",
        local_time(c("ts")).alias("event_time"), status_weight(c("validation_status")).alias("sample_weight"),
        vehicle_class(vehicle_label(c("updated_vehicle_type"), c("vehicle_type"))).alias("vehicle_class"),
        violation_severity(c("violation_type")).alias("violation_severity_weight"),
        F.floor(c("latitude") / grid).alias("lat_bin"), F.floor(c("longitude") / grid).alias("lon_bin"), grid_id(c("latitude"), c("longitude"), grid).alias("segment_id"),
        text_or(c("police_station"), "Unknown").alias("police_station"), text_or(c("junction_name"), "No Junction").alias("junction_name"), text_or(c("location"), "").alias("location"),
    )
    rows = rows.withColumns({
        "target_hour": F.date_trunc("hour", "event_time").cast("timestamp_ntz"),
        "vehicle_footprint_weight": R.lookup(c("vehicle_class"), R.FOOTPRINT, 1.0),
        "junction_bucket": F.when(c("junction_name") == "No Junction", "No Junction").otherwise("Named Junction"),
        "road_class": road_class_of_text(c("location"), c("junction_name"), c("violation_type")),
    })
    return rows.withColumns({"road_width_m": R.lookup(c("road_class"), R.ROAD_WIDTH, 6.0), "severity_weight": c("violation_severity_weight") * c("vehicle_footprint_weight") * c("sample_weight")})


def mark_bulk_entry(events: DataFrame, share: float = NIGHT_SHARE, factor: float = NIGHT_FACTOR) -> DataFrame:
    """Flags segments with over ``share`` of their events at hours 0 to 5, and scales those rows' weights by ``factor``.

    Shares are one partial aggregate per segment, joined back; AQE broadcasts it while it is small.
    """
    night = F.hour("event_time") < 6
    bulk = events.groupBy("segment_id").agg((F.count_if(night) / F.count("*") > share).cast("int").alias("is_bulk_artifact_segment"))
    scale = F.when((F.col("is_bulk_artifact_segment") == 1) & night, factor).otherwise(1.0)
    return events.join(bulk, "segment_id").withColumns({"sample_weight": F.col("sample_weight") * scale, "severity_weight": F.col("severity_weight") * scale})
