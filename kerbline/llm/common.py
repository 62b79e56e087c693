"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import folder, running_sum, shared_dir, spread_join, staged  # noqa: F401

#: Words are runs of anything but these six bytes; ``bytes.split()`` cuts at just these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with its session's batches to Python held to ``rows`` rows: texts are long, and a worker holds a batch whole."""
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 4; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, per_class: int, seed: int) -> DataFrame:
    """Texts of at most ``per_class`` training rows of each value of ``grade`` (a small fixed set), in hash order.

    Fold 2 is never used. Only ids pass the bounded top-n; they are broadcast (at most a few
    ``per_class`` rows of two numbers), so the documents aren't shuffled.
    """
    usable = labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")]
    picked = None
    for value in (0, 1, 2):
        part = usable.where(F.col(grade) == value).select("doc_id", F.col(grade).cast("int").alias("grade"))
        part = part.dropDuplicates(["doc_id"]).orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    return short_batches(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
