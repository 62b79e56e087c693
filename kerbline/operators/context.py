"""Weather, event calendar, traffic and run-to-run changes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import staged


def congestion_multiplier(travel: Column, free_travel: Column, speed: Column, free_speed: Column) -> Column:
    """Current over free travel time, else free over current speed, else 1."""
    by_time = F.when((travel > 0) & (free_travel > 0), travel / free_travel)
    return F.coalesce(by_time, F.when((speed > 0) & (free_speed > 0), free_speed / speed), F.lit(1.0))


def _rain(mm: Column, hour: Column, missing: str) -> Column:
    """Rainfall of an hour: where there is none, 0 (``missing="zero"``), or an error that names the hour when the row is read (``"error"``)."""
    if missing not in ("zero", "error"):
        raise ValueError("missing is zero or error")
    none = F.raise_error(F.concat(F.lit("no rainfall for "), hour.cast("string"))).cast("double") if missing == "error" else F.lit(0.0)
    return F.coalesce(mm, none)


def hourly_weather(payload: DataFrame, bounds: DataFrame, threshold: float = 0.0, missing: str = "zero") -> DataFrame:
    """target_hour, rainfall_mm, is_raining for each hour of a one-row (start_hour, end_hour), from parallel arrays time, rain, precipitation.

    The last reading of an hour counts; rain stands before precipitation; hours without a reading are dry, or with ``missing="error"`` an error when the rows are read.
    """
    if "time" not in payload.columns or not {"rain", "precipitation"} & {*payload.columns}:
        raise ValueError("a weather payload has time, and rain or precipitation")
    none = F.array().cast("array<double>")  # arrays_zip gives nothing where one array is null
    given = lambda c: F.coalesce(F.col(c), none).alias(c) if c in payload.columns else none.alias(c)
    read = payload.select("time", given("rain"), given("precipitation")).select(F.posexplode(F.arrays_zip("time", "rain", "precipitation")).alias("i", "r"))
    rain = F.coalesce(F.col("r.rain"), F.col("r.precipitation"))
    read = read.select("i", F.date_trunc("hour", F.col("r.time").cast("timestamp_ntz")).cast("timestamp_ntz").alias("target_hour"), rain.alias("mm"))
    read = read.groupBy("target_hour").agg(F.max_by("mm", "i").alias("mm"))
    spine = bounds.select(F.explode(F.sequence("start_hour", "end_hour", F.expr("interval 1 hour"))).alias("target_hour"))
    out = spine.join(read, "target_hour", "left").select("target_hour", _rain(F.col("mm"), F.col("target_hour"), missing).alias("rainfall_mm"))
    return out.withColumn("is_raining", (F.col("rainfall_mm") > threshold).cast("int"))


def join_weather(rows: DataFrame, weather: DataFrame, missing: str = "zero") -> DataFrame:
    """``rows`` with rainfall_mm and is_raining of their target_hour; rows of hours that ``weather`` lacks are dry, or with ``missing="error"`` an error when they are read."""
    met = rows.join(weather.select("target_hour", "rainfall_mm", "is_raining"), "target_hour", "left")
    mm = _rain(F.col("rainfall_mm"), F.col("target_hour"), missing)
    return met.withColumns({"rainfall_mm": mm, "is_raining": F.coalesce("is_raining", F.lit(0))})


def join_hubs(calendar: DataFrame, hubs: DataFrame) -> DataFrame:
    """Calendar rows with their hub's place; a venue that no hub has, or that two have, is an error when the rows are read."""
    one = hubs.groupBy("venue").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in hubs.columns if c != "venue"])
    rows = calendar.join(one, "venue", "left")
    fault = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no hub for venue "), F.coalesce("venue", F.lit("null"))))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two hubs for venue "), "venue")))
    return rows.withColumn("_f", fault.cast("string")).where(F.col("_f").isNull()).drop("_n", "_f")


def local_time(text: Column, zone: str) -> Column:
    """Text as a time without zone: as it stands, or moved to ``zone`` where it names an offset; null where it is no time."""
    text = F.trim(text)
    moved = F.convert_timezone(F.current_timezone(), F.lit(zone), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(F.regexp_like(text, F.lit(r":.*(Z|[+-]\d\d:?\d\d)$")), moved).otherwise(text.try_cast("timestamp_ntz"))


def _faults(**tests: Column) -> Column:
    """The names of the tests that hold, in their order."""
    return F.array_compact(F.array(*[F.when(t, F.lit(n.replace("_", " "))) for n, t in tests.items()]))


def checked_hubs(rows: DataFrame) -> DataFrame:
    """Hubs from text (venue, latitude, longitude), trimmed and as numbers, and ``faults``: blank venue, repeated venue (all of its rows), no number."""
    number = {c: F.trim(F.col(c).cast("string")).try_cast("double") for c in ("latitude", "longitude")}
    rows = rows.withColumns({"venue": F.trim(F.coalesce(F.col("venue").cast("string"), F.lit(""))), **number})
    seen = rows.groupBy("venue").agg(F.count("*").alias("_n"))
    bad = reduce(or_, [F.col(c).isNull() | F.isnan(c) for c in number])
    return rows.join(seen, "venue").withColumn("faults", _faults(blank_venue=F.col("venue") == "", repeated_venue=(F.col("_n") > 1) & (F.col("venue") != ""), no_number=bad)).drop("_n")


def checked_calendar(rows: DataFrame, hubs: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Events from text (venue, start_ts, end_ts, label), trimmed, as local times, with their hub's latitude and longitude, and ``faults``.

    Faults: blank venue, no start, no end, end not after start, no hub (among good ones, each venue once). A missing label is empty.
    """
    label = F.coalesce(F.col("label").cast("string"), F.lit("")) if "label" in rows.columns else F.lit("")
    rows = rows.withColumns({"venue": F.trim(F.coalesce(F.col("venue").cast("string"), F.lit(""))), "label": label, "start_ts": local_time(F.col("start_ts"), zone), "end_ts": local_time(F.col("end_ts"), zone)})
    rows = rows.join(hubs.select("venue", "latitude", "longitude"), "venue", "left")
    start, end = F.col("start_ts"), F.col("end_ts")
    found = _faults(blank_venue=F.col("venue") == "", no_start=start.isNull(), no_end=end.isNull(), end_not_after_start=end <= start, no_hub=(F.col("venue") != "") & F.col("latitude").isNull())
    return rows.withColumn("faults", found)


def routed(checked: DataFrame, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(good rows, faulty rows with their ``faults``) of a table that is gone through once; with ``mode="error"`` a faulty row is an error."""
    if mode not in ("quarantine", "error"):
        raise ValueError("mode is quarantine or error")
    if mode == "error":
        told = F.raise_error(F.concat(F.lit("faulty row: "), F.concat_ws(", ", "faults"), F.lit(" in "), F.to_json(F.struct(*checked.columns))))
        checked = checked.withColumn("faults", F.when(F.size("faults") > 0, told.cast("array<string>")).otherwise(F.col("faults")))
    rows = staged(checked)
    return rows.where(F.size("faults") == 0).drop("faults"), rows.where(F.size("faults") > 0)


def band_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose priority_band differs from ``old``'s; rows that ``old`` lacks have not changed.

    Both sides grow alike: the join is a sort-merge one, or the scores could be broadcast through the driver.
    """
    before = old.select(*keys, F.col("eps").alias("old_eps"), F.col("priority_band").alias("old_band"))
    after = new.select(*keys, F.col("eps").alias("new_eps"), F.col("priority_band").alias("new_band"))
    rows = after.join(before.hint("merge"), keys).where("old_band != new_band")
    return rows.withColumn("direction", F.when(F.col("new_eps") > F.col("old_eps"), "escalated").otherwise("deescalated"))


def weather_table(rows: DataFrame, order: str) -> DataFrame:
    """target_hour, rainfall_mm, is_raining from a table that calls them time or target_hour, and rain, precipitation or rainfall_mm; the last row (by ``order``) of an hour counts."""
    first = lambda names: F.coalesce(*[F.col(c) for c in names if c in rows.columns])
    mm = first(("rainfall_mm", "rain", "precipitation")).try_cast("double")
    flag = first(("is_raining",)).cast("int") if "is_raining" in rows.columns else None
    read = rows.select(F.date_trunc("hour", first(("target_hour", "time")).cast("timestamp_ntz")).cast("timestamp_ntz").alias("target_hour"), F.coalesce(mm, F.lit(0.0)).alias("rainfall_mm"), F.coalesce(flag, F.lit(None)).alias("flag") if flag is not None else F.lit(None).cast("int").alias("flag"), F.col(order).alias("_o"))
    read = read.groupBy("target_hour").agg(F.max_by(F.struct("rainfall_mm", "flag"), "_o").alias("r")).select("target_hour", "r.*")
    return read.select("target_hour", "rainfall_mm", F.when(F.col("flag").isNotNull(), F.least(F.lit(1), F.abs("flag"))).otherwise((F.col("rainfall_mm") > 0).cast("int")).alias("is_raining"))


def rain_shelter(raining: Column, structure: Column) -> Column:
    return raining * structure


def live_weather(rows: DataFrame, live: DataFrame | None) -> DataFrame:
    """``rows`` with the live row's rainfall_mm and is_raining where one is given (one row); shelter is recomputed only while it rains."""
    if live is None:
        return rows
    one = live.select(F.col("rainfall_mm").alias("_mm"), F.col("is_raining").alias("_r")).limit(1)
    rows = rows.join(F.broadcast(one), how="left")
    shelter = F.when(F.col("_r") == 1, F.col("_r") * F.col("is_structure")).otherwise(F.col("rain_shelter"))
    return rows.withColumns({"rain_shelter": F.coalesce(shelter, F.col("rain_shelter")), "rainfall_mm": F.coalesce("_mm", "rainfall_mm"), "is_raining": F.coalesce("_r", "is_raining")}).drop("_mm", "_r")


def structure_flags(rows: DataFrame, dimension: DataFrame, own: Column) -> DataFrame:
    """is_structure of the segment's dimension row, else of the row itself, else 0."""
    return rows.join(dimension.select("segment_id", F.col("is_structure").alias("_s")), "segment_id", "left").withColumn("is_structure", F.coalesce("_s", own, F.lit(0))).drop("_s")


# Where a table has several of these columns, the first is its volume.
VOLUMES = ("historical_volume", "segment_total_events", "event_count", "count_total", "predicted_total", "volume")


def attach_volume(segments: DataFrame, volumes: DataFrame) -> DataFrame:
    """``segments`` with volume: the first of ``VOLUMES`` that ``volumes`` has, summed per segment, negative sums as 0, none as 0."""
    name = next(c for c in VOLUMES if c in volumes.columns)
    sums = volumes.groupBy("segment_id").agg(F.greatest(F.lit(0.0), F.sum(F.col(name).cast("double"))).alias("volume"))
    return segments.join(sums, "segment_id", "left").fillna(0.0, ["volume"])


def merge_features(segments: DataFrame, spatial: DataFrame, parking: DataFrame) -> DataFrame:
    """``segments`` with spatial and parking columns; where a segment has none, distances to places are 5000 m and all else is 0."""
    far = {c: 5000.0 for c in spatial.columns if c.startswith("dist_to_")}
    none = {c: 0 for c in spatial.columns if c.startswith(("poi_count_", "poi_gravity_"))}
    rows = segments.join(spatial, "segment_id", "left").fillna(far | none)
    return rows.join(parking, "segment_id", "left").fillna({c: 0.0 for c in parking.columns if c != "segment_id"})
