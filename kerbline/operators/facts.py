"""Segment-hour facts, segment dimension, climatology, sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import refdata as R
from ..functions.shared import first_rows, running_sum, spread_join, staged
from .clean import NIGHT_FACTOR, NIGHT_SHARE

HOTSPOT = 2.0


def active_segments(events: DataFrame, least: int = 20, most: int | None = None) -> DataFrame:
    """segment_id and event_count of segments with ``least`` events; the ``most`` busiest where given."""
    found = events.groupBy("segment_id").agg(F.count("*").alias("event_count")).where(F.col("event_count") >= least)
    return found.orderBy(F.desc("event_count"), "segment_id").limit(most) if most else found


def segment_hours(events: DataFrame) -> DataFrame:
    """Class counts, total, severity, hotspot flag and clipped weight of each segment and hour: one partial aggregate, one shuffle."""
    return _flagged(_hour_sums(events))


def active_hours(events: DataFrame, least: int = 20, share: float = NIGHT_SHARE, factor: float = NIGHT_FACTOR) -> DataFrame:
    """``segment_hours`` of the ``active_segments``, of events that ``mark_bulk_entry`` has not seen yet.

    Which segments are active, which are entered in bulk and which hours are scaled for it follow from the hours' own counts; so events are read once and no event is joined.
    """
    night, whole = F.hour("target_hour") < 6, W.partitionBy("segment_id")  # a row an hour
    rows = _hour_sums(events).withColumns({"_all": F.sum("count_total").over(whole), "_night": F.sum(F.when(night, F.col("count_total")).otherwise(0)).over(whole)})
    scale = F.when(night & (F.col("_night") / F.col("_all") > share), factor).otherwise(1.0)
    return _flagged(rows.where(F.col("_all") >= least).withColumns({c: F.col(c) * scale for c in ("severity_weighted_count", "sample_weight")}).drop("_all", "_night"))


def _hour_sums(events: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("vehicle_class") == c).alias(f"count_{c}") for c in R.CLASSES]
    return events.groupBy("segment_id", "target_hour").agg(*counts, F.count("*").alias("count_total"), F.sum("severity_weight").alias("severity_weighted_count"), F.sum("sample_weight").alias("sample_weight"))


def _flagged(sums: DataFrame) -> DataFrame:
    return sums.withColumns({"sample_weight": F.least("sample_weight", F.lit(5.0)), "is_hotspot": (F.round("severity_weighted_count", 9) >= HOTSPOT).cast("int")})


def mode_of(rows: DataFrame, keys: list[str], value: str, times: Column | None = None) -> DataFrame:
    """Most frequent ``value`` per keys, the least one on ties; two partial aggregates. A row counts as many ``times``, once by default."""
    n = rows.groupBy(*keys, value).agg((F.count("*") if times is None else F.sum(times)).alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


#: Columns of text whose most frequent value describes a segment, where the events have them.
TEXTS = ("police_station", "junction_name", "road_class", "junction_bucket", "map_matching_mode", "location", "road_name", "osm_highway", "geometry_wkt")


def segment_dimension(events: DataFrame, grid: float = 0.001, texts: tuple[str, ...] = ("police_station", "junction_name", "road_class", "geometry_wkt")) -> DataFrame:
    """Centre, modes of those of ``texts`` that the events have, means and counts of each segment.

    The centre is the centroid of the segment's geometry_wkt; of text that is no line the mean place; and where there is no geometry the middle of the least grid cell.
    Events are read once, for the sums of each segment and combination of texts; the rest is made of these, which are staged.
    """
    texts = tuple(c for c in texts if c in events.columns)
    means = {"lat_mean": "latitude", "lon_mean": "longitude", "severity_mean": "violation_severity_weight", "footprint_mean": "vehicle_footprint_weight"}
    bounds = [F.min("lat_bin").alias("lat_bin"), F.min("lon_bin").alias("lon_bin"), F.max("road_width_m").alias("road_width_m")]
    parts = [x for name, c in means.items() for x in (F.sum(c).alias(f"_s_{name}"), F.count(c).alias(f"_n_{name}"))]
    alike = staged(events.groupBy("segment_id", *texts).agg(F.count("*").alias("_n"), *parts, *bounds))
    base = alike.groupBy("segment_id").agg(F.sum("_n").alias("event_count"), *[F.try_divide(F.sum(f"_s_{name}"), F.sum(f"_n_{name}")).alias(name) for name in means], *bounds)
    for column in texts:
        base = base.join(mode_of(alike, ["segment_id"], column, F.col("_n")), "segment_id")
    lat, lon = (F.col("lat_bin") + 0.5) * grid, (F.col("lon_bin") + 0.5) * grid
    if "geometry_wkt" in texts:
        base = base.withColumn("_line", geo.wkt_points(F.col("geometry_wkt")))
        middle_lon, middle_lat = geo.line_centroid(F.col("_line"))
        given, drawn = F.coalesce(F.col("geometry_wkt"), F.lit("")) != "", F.size("_line") > 1
        lat, lon = (F.when(given & drawn, m).when(given, F.col(mean)).otherwise(c) for m, mean, c in ((middle_lat, "lat_mean", lat), (middle_lon, "lon_mean", lon)))
    return base.withColumns({"lat_center": lat, "lon_center": lon}).drop("_line")


def approval_rates(raw: DataFrame) -> DataFrame:
    """Approved over approved and rejected of each station, from events before the status filter; 0.5 where there are neither."""
    status = F.lower(F.trim("validation_status"))
    yes, no = F.count_if(status == "approved"), F.count_if(status == "rejected")
    return raw.groupBy("police_station").agg(F.coalesce(F.try_divide(yes, yes + no), F.lit(0.5)).alias("approval_rate"))


def average_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the rank by ``value`` over all rows as a share, ties averaged. Running sums go over the distinct values."""
    n = staged(rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("n")))
    ranks = running_sum(n, ["_v"], "n", "_below").join(F.broadcast(n.agg(F.sum("n").alias("_all"))))
    ranks = ranks.select(F.col("_v").alias(value), ((F.col("_below") + 1 + (F.col("n") - 1) / 2) / F.col("_all")).alias(name))
    return spread_join(rows, ranks, [value], n.withColumnRenamed("_v", value), F.xxhash64(*rows.columns))


def segment_totals(hours: DataFrame, train_hours: int) -> DataFrame:
    totals = hours.groupBy("segment_id").agg(F.sum("count_total").alias("segment_total_events"))
    return average_rank(totals.withColumn("segment_event_rate", F.col("segment_total_events") / train_hours), "segment_total_events", "segment_rank_pct")


def climatology(hours: DataFrame, keys: list[str], periods: float, name: str) -> DataFrame:
    """Sum of count_total by keys over the number of periods observed, rows or not."""
    return hours.groupBy(*keys).agg((F.sum("count_total") / periods).alias(name))


def hour_spine(bounds: DataFrame, first: str, last: str, name: str = "target_hour") -> DataFrame:
    """Every hour from ``first`` to ``last`` of a one-row table."""
    return bounds.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 hour"))).alias(name))


def absent_pairs(segments: DataFrame, first, last, positives: DataFrame, wanted: int, seed: int = 42, salt: str = "zero") -> DataFrame:
    """``wanted`` absent (segment_id, target_hour) pairs of the hours from ``first`` to ``last``, drawn without replacement with weights ln(1 + event_count).

    The least of -ln(u) / weight are kept, u from a hash of the pair: the same rows whatever the partitions. A segment makes its own absent hours, so their
    product is neither joined nor written; it is gone through once. How many pairs lie below a key follows from the segments alone, and so a lower and an upper bound of
    the cut: what is below the lower is in, what is above the upper is never kept, and only what lies between is sorted. The counts are then checked.
    """
    hours = F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"), F.expr("interval 1 hour"))
    held = positives.groupBy("segment_id").agg(F.collect_set("target_hour").alias("held"))  # an hour each, at most
    absent = F.array_except(hours, F.coalesce("held", F.array().cast("array<timestamp_ntz>")))
    line = staged(segments.select("segment_id", "event_count").join(held, "segment_id", "left").withColumns({"absent": F.size(absent), "weight": F.log1p("event_count")}))
    low, high = _cut(line, wanted)
    pairs = line.select("segment_id", "weight", F.explode(absent).alias("target_hour"))
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), "segment_id", F.date_format("target_hour", "yyyyMMddHH"))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    pairs = pairs.select(F.round(-F.log(u) / F.col("weight"), 9).alias("key"), "segment_id", "target_hour")
    while True:
        near = staged(pairs.where(F.col("key") <= high))
        counts = near.agg(F.count_if(F.col("key") < low).alias("sure"), F.count("*").alias("all")).first()
        if counts.sure > wanted:
            low = 0.0
        elif counts.all < wanted and high < math.inf:
            high = math.inf
        else:
            break
    columns = ["segment_id", "target_hour"]
    return near.where(F.col("key") < low).select(columns).unionByName(first_rows(near.where(F.col("key") >= low), ["key", *columns], wanted - counts.sure).select(columns))


def _cut(line: DataFrame, wanted: int) -> tuple[float, float]:
    """Keys between which the ``wanted``-th least one lies but for a chance below 10**-14; a pair is below k with a chance of 1 - exp(-weight k)."""
    keys = [10 ** (-9 + 12 * i / 400) for i in range(401)]
    alike = line.groupBy("weight").agg(F.sum("absent").alias("absent"))  # n distinct event counts need n * n / 2 events, so these rows are few
    below = alike.select("weight", "absent", F.posexplode(F.lit(keys))).groupBy("pos").agg(F.sum(F.col("absent") * (1 - F.exp(-F.col("weight") * F.col("col")))).alias("n"))
    held = {r.pos: r.n for r in below.collect()}
    sums = [held.get(i) for i in range(len(keys))]
    slack = 8 * math.sqrt(wanted + 1) + 8
    low = max((k for k, n in zip(keys, sums, strict=True) if n is not None and n <= wanted - slack), default=0.0)
    return low, min((k for k, n in zip(keys, sums, strict=True) if n is not None and n >= wanted + slack), default=math.inf)


def with_zeros(hours: DataFrame, zeros: DataFrame, weight: float = 0.3) -> DataFrame:
    """Facts and sampled absences (absences never displace facts), with the weights of rare classes raised."""
    blank = zeros.select("segment_id", "target_hour", *[F.lit(0).cast("long").alias(c) for c in (*R.COUNTS, "count_total")], F.lit(0.0).alias("severity_weighted_count"), F.lit(weight).alias("sample_weight"), F.lit(0).alias("is_hotspot"))
    rows = hours.withColumn("_first", F.lit(0)).unionByName(blank.withColumn("_first", F.lit(1)))
    order = W.partitionBy("segment_id", "target_hour").orderBy("_first")
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_first")
    rare = 1 + 2 * (F.col("count_heavy") > 0).cast("double") + (F.col("count_light_commercial") > 0).cast("double")
    return rows.withColumn("sample_weight", F.col("sample_weight") * rare)
