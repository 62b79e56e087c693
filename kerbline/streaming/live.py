"""Structured Streaming forms of the live loop. Event times are without zone in the tables: they are cast to TIMESTAMP for watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import refdata as R
from ..operators import spatial


def segment_hours(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Class counts of each segment and hour from cleaned events (id, event_time TIMESTAMP, segment_id, vehicle_class); tickets seen twice count once."""
    rows = events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["id"])
    counts = [F.count(F.when(F.col("vehicle_class") == c, 1)).alias(f"count_{c}") for c in R.CLASSES]
    out = rows.groupBy(F.window("event_time", "1 hour"), "segment_id").agg(*counts, F.count("*").alias("count_total"))
    return out.select("segment_id", F.col("window.start").alias("target_hour"), *R.COUNTS, "count_total")


class BandChanges(StatefulProcessor):
    """Keeps each segment's last score and band; tells of a change of band once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "eps double, band string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told, old = [], self.last.get()  # each call to the state goes to the JVM and back: once for all rows of a batch
        frame = pd.concat(list(rows)).sort_values("target_hour", kind="stable")
        for time, eps, band in zip(frame["target_hour"], frame["eps"], frame["priority_band"], strict=True):
            if old is not None and old[1] != band:
                told.append((key[0], time, old[0], eps, old[1], band, "escalated" if eps > old[0] else "deescalated"))
            old = eps, band
        self.last.update(old)
        if told:
            yield pd.DataFrame(told, columns=["segment_id", "target_hour", "old_eps", "new_eps", "old_band", "new_band", "direction"])

    def close(self) -> None:
        pass


def band_changes(scores: DataFrame) -> DataFrame:
    """Alerts from a stream of (segment_id, target_hour, eps, priority_band). Needs the RocksDB state store."""
    return scores.groupBy("segment_id").transformWithStateInPandas(
        BandChanges(), outputStructType="segment_id string, target_hour timestamp, old_eps double, new_eps double, old_band string, new_band string, direction string", outputMode="Append", timeMode="None"
    )


def feedback_accuracy(feedback: DataFrame) -> DataFrame:
    """Accuracy of predictions by segment from officers' answers (edge_id, actual_accuracy)."""
    yes = F.lower("actual_accuracy").isin("accurate", "yes", "true", "1")
    return feedback.groupBy("edge_id").agg(F.avg(yes.cast("double")).alias("accuracy"), F.count("*").alias("answers"))


def upsert(table: str, key: str, order: str):
    """A foreachBatch function that adds each batch's latest row of each key to the folder ``table``; a batch that runs again replaces its own rows, and none reads another's."""

    def run(batch: DataFrame, number: int) -> None:
        newest(batch, key, order).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return run


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key: of a batch, or of all that ``upsert`` wrote."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def rescore(table: str, live, score):
    """A foreachBatch function that joins each batch with ``live()``, read anew, and keeps ``score`` of it in ``table``; a batch that runs again replaces its own rows.

    ``live()`` gives segment_id, target_hour and congestion; rows that it lacks have a congestion of 1.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.join(live(), ["segment_id", "target_hour"], "left").fillna(1.0, ["congestion"])
        score(rows).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return run


def refresh_ripples(table: str, lines: DataFrame, **reach):
    """A foreachBatch function that keeps the ripples of each batch, which holds whole hours, along ``lines`` in ``table``."""

    def run(batch: DataFrame, number: int) -> None:
        spatial.ripples(batch, lines, **reach).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return run


def run_batches(stream: DataFrame, function, checkpoint: str, mode: str = "append") -> None:
    """Runs ``function`` over what is there."""
    stream.writeStream.foreachBatch(function).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def resumed(spark: SparkSession, parts: list[DataFrame], make, folder: str, files: int = 100000) -> tuple[DataFrame, int]:
    """(result, rows dropped as late) of the stream that ``make`` makes of a folder of files: ``parts`` arrive there one after the other, and after each the
    query runs over what is new and stops. The next one starts from the checkpoint, with its watermark, state and results."""
    dropped, stream = 0, None
    for number, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/part={number}")
        stream = make(spark.readStream.schema(part.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{folder}/in"))
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), dropped


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs ``stream`` over what is there, into Parquet under ``folder``, and reads the result."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
