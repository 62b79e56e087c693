"""Queries of the learned and the streaming operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refdata as R
from ..functions import shared
from ..operators import learning
from ..streaming import live
from . import core
from .sql import oracle

QUERIES: dict = {}
ORACLES: dict = {}


def folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return shared.folder(spark, "live")


COEFFICIENTS = {"count_total": 0.5, "hour": -0.1, "severity_weighted_count": 0.25}


def h5_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.hours(spark, sf_dir).select("segment_id", "target_hour", *COEFFICIENTS)
    return learning.contributions(rows, COEFFICIENTS, ["segment_id", "target_hour"], 5, 1).select("segment_id", "target_hour", "feature", F.round("impact", 6).alias("impact"))


def h6_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.hours(spark, sf_dir).select("segment_id", "target_hour", "count_total", "hour")
    predict = lambda d: d.withColumn("forecast", F.col("count_total") * 0.8 + F.when(F.col("hour") > 12, 0.5).otherwise(0.0))
    out = learning.ablations(rows, {"count_total": 1.0, "hour": 10.0}, ["segment_id", "target_hour"], predict)
    return out.select("segment_id", "target_hour", "feature", F.round("impact", 6).alias("impact"))


def j1_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events arrive in three parts by time; the query is stopped after each and goes on from its checkpoint. Old events that come with the last part are late."""
    return _complete(spark, sf_dir)[0].select("segment_id", F.col("target_hour").cast("timestamp_ntz").alias("target_hour"), *R.COUNTS, "count_total")


def j1_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events the same stream dropped as late."""
    return spark.range(1).select(F.lit(_complete(spark, sf_dir)[1]).cast("long").alias("late_rows"))


def _complete(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Final counts: a last row far ahead moves the watermark past every hour, so append mode emits them all."""
    rows = shared.staged(core.events(spark, sf_dir).select("id", F.col("event_time").cast("timestamp").alias("event_time"), "segment_id", "vehicle_class"))
    b = rows.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b")).first()
    thirds = [b.a + (b.b - b.a) * k / 3 for k in (1, 2)]
    first, last = rows.where(F.col("event_time") < F.lit(thirds[0])), rows.where(F.col("event_time") >= F.lit(thirds[1]))
    middle = rows.where((F.col("event_time") >= F.lit(thirds[0])) & (F.col("event_time") < F.lit(thirds[1])))
    late = first.where((F.col("id") % 10 == 0) & (F.col("event_time") < F.lit(thirds[0] - timedelta(hours=3)))).withColumn("id", -F.col("id"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(b.b + timedelta(days=10)).alias("event_time"), F.lit("end").alias("segment_id"), F.lit("other").alias("vehicle_class"))
    out, dropped = live.resumed(spark, [first, middle, last.unionByName(late), end], live.segment_hours, folder(spark))
    return out.where("segment_id != 'end'"), dropped


def j3_stream_band_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band changes between a segment's successive scored hours, by state that outlives two restarts."""
    rows = core.scored(spark, sf_dir).select("segment_id", F.col("target_hour").cast("timestamp").alias("target_hour"), "eps", "priority_band")
    b = rows.agg(F.min("target_hour").alias("a"), F.max("target_hour").alias("b")).first()
    thirds = [b.a + (b.b - b.a) * k / 3 for k in (1, 2)]
    third = F.when(F.col("target_hour") < F.lit(thirds[0]), 0).when(F.col("target_hour") < F.lit(thirds[1]), 1).otherwise(2)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = live.resumed(spark, [rows.where(third == k) for k in range(3)], live.band_changes, folder(spark))[0]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.select("segment_id", F.col("target_hour").cast("timestamp_ntz").alias("target_hour"), "old_eps", "new_eps", "old_band", "new_band", "direction")


def j4_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = folder(spark), folder(spark)
    rows = core.scored(spark, sf_dir).select("segment_id", "target_hour", "eps")
    rows.where(F.hour("target_hour") >= 12).write.parquet(f"{path}/half=1")  # at least two batches, the later hours first
    rows.where(F.hour("target_hour") < 12).write.parquet(f"{path}/half=2")
    half = max(1, spark.read.schema(rows.schema).parquet(path).select(F.input_file_name()).distinct().count() // 2)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", half).option("recursiveFileLookup", "true").parquet(path)
    q = stream.writeStream.foreachBatch(live.upsert(out, "segment_id", "target_hour")).option("checkpointLocation", folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return live.newest(spark.read.schema(rows.schema).parquet(out).select(*rows.columns), "segment_id", "target_hour")


QUERIES |= {"H5_contributions": h5_contributions, "H6_ablations": h6_ablations, "J1_stream_counts": j1_stream_counts, "J1_late_rows": j1_late_rows, "J3_stream_band_changes": j3_stream_band_changes, "J4_stream_latest": j4_stream_latest}
_TALL = " UNION ALL ".join(f"SELECT segment_id, target_hour, '{c}' AS feature, round({w}::DOUBLE * ({c} - (SELECT avg({c}) FROM hours)), 9) AS impact FROM hours" for c, w in COEFFICIENTS.items())
ORACLES["H5_contributions"] = oracle(f"SELECT segment_id, target_hour, feature, round(impact, 6) AS impact FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, target_hour, impact > 0 ORDER BY abs(impact) DESC, feature) AS n FROM ({_TALL}) WHERE impact <> 0) WHERE n <= CASE WHEN impact > 0 THEN 5 ELSE 1 END")
ORACLES["H6_ablations"] = oracle("SELECT segment_id, target_hour, 'count_total' AS feature, round((count_total - 1) * 0.8::DOUBLE, 6) AS impact FROM hours UNION ALL SELECT segment_id, target_hour, 'hour', CASE WHEN hour > 12 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END FROM hours")
ORACLES["J1_stream_counts"] = oracle("SELECT segment_id, target_hour, " + ", ".join(f"count(*) FILTER (vehicle_class = '{c}') AS count_{c}" for c in R.CLASSES) + ", count(*) AS count_total FROM cleaned GROUP BY 1, 2")
ORACLES["J1_late_rows"] = oracle("SELECT count(*) AS late_rows FROM cleaned, (SELECT min(event_time) AS a, max(event_time) AS b FROM cleaned) WHERE id % 10 = 0 AND event_time < a + to_microseconds((epoch_us(b) - epoch_us(a)) // 3) - INTERVAL 3 HOUR")
ORACLES["J3_stream_band_changes"] = oracle("SELECT segment_id, target_hour, old_eps, eps AS new_eps, old_band, priority_band AS new_band, CASE WHEN eps > old_eps THEN 'escalated' ELSE 'deescalated' END AS direction FROM (SELECT segment_id, target_hour, eps, priority_band, lag(eps) OVER w AS old_eps, lag(priority_band) OVER w AS old_band FROM scored WINDOW w AS (PARTITION BY segment_id ORDER BY target_hour)) WHERE old_band <> priority_band")
ORACLES["J4_stream_latest"] = oracle("SELECT segment_id, max(target_hour) AS target_hour, arg_max(eps, target_hour) AS eps FROM scored GROUP BY 1")
