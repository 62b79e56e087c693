"""Tables in the folder that driver and executors share, and joins and running sums that no key or order brings to one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key is hot where it holds over one in so many rows; there are fewer hot keys than that, whatever the data.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it is unset, a folder of our own. A cluster must name one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def folder(spark: SparkSession, name: str = "stage") -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later steps restart from it when an executor is lost."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, tuple[str, object]] = {}


def kept(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, staged once for each application, name and state of the table at ``source``: what many queries start from.

    It is made anew where the source has changed or the staged files have gone.
    """
    hadoop = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path)
    files = lambda path: hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    size = files(source).getContentSummary(hadoop(source)).getLength()
    key = spark.sparkContext.applicationId, name, source, size, files(source).getFileStatus(hadoop(source)).getModificationTime()
    if key not in _KEPT or not files(_KEPT[key][0]).exists(hadoop(f"{_KEPT[key][0]}/_SUCCESS")):
        df, path = make(), folder(spark, name)
        df.write.parquet(path)
        _KEPT[key] = path, df.schema
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, also where ``use`` asks for it for each element of an array."""
    return F.transform(F.array(value), use)[0]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as a shuffle has, however few bytes it is: for rows that are small but dear to work out, which would else go to one task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def removed(df: DataFrame) -> None:
    """Deletes the files of a ``staged`` table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spread_join(rows: DataFrame, single: DataFrame, keys: list[str], counts: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``single`` (one row for each value of ``keys``) by null-free ``keys``, with hot keys dealt to many tasks.

    ``counts``, a staged table, has the keys' row counts n, ``salt`` is a number that differs among a key's rows. A key with over one in ``HOT`` rows
    is cut into as many parts as it holds such shares, so the broadcast table of them has fewer than ``HOT`` rows.
    """
    n = F.col("n") * HOT
    total = counts.agg(F.sum("n").alias("_total"))
    hot = counts.join(F.broadcast(total), n > F.col("_total")).select(*keys, F.ceil(n / F.col("_total")).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.withColumn("_salt", salt).join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod("_salt", parts)).drop("_parts", "_salt")
    right = single.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def running_sum(df: DataFrame, order: list[str], value: str | list[str], name: str | list[str], group: str | None = None) -> DataFrame:
    """``df``, staged, with ``name``: the sum of ``value`` over the rows before it by ``order`` (nulls first), within its ``group`` where one is given; several values and names go together.

    Names of ``df`` with a leading underscore are ours. Rows are range-sorted over all tasks by group and order; the ranges' totals, as many as tasks (and groups), are summed up,
    and each range sums its own rows. Equal rows in ``order`` come in any order.
    ``df`` is read twice, first for the ranges: stage one that is dear to make.
    """
    values, names = ([x] if isinstance(x, str) else x for x in (value, name))
    keys = [c for c in (group, *order) if c]
    columns = df.columns
    ranged = staged(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("_range", F.spark_partition_id()))
    by = [group] if group else []
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_total{i}") for i, v in enumerate(values)])
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ahead = [F.coalesce(F.sum(f"_total{i}").over(before), F.lit(0)).alias(f"_ahead{i}") for i in range(len(values))]
    totals = totals.select(F.col(group).alias("_g") if group else F.lit(None).cast("string").alias("_g"), F.col("_range").alias("_r"), *ahead)
    same = (F.col("_range") == F.col("_r")) & (F.col(group).eqNullSafe(F.col("_g")) if group else F.lit(True))
    inside = W.partitionBy(*by, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumns({f"_inside{i}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for i, v in enumerate(values)})
    return summed.join(totals, same).select(*columns, *[(F.col(f"_ahead{i}") + F.col(f"_inside{i}")).alias(n) for i, n in enumerate(names)])


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of ``df`` by the columns ``order``, which tell rows apart: for an ``n`` that grows with the data."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_n").where(F.col("_n") < n).drop("_one", "_n")
