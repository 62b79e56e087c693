"""Centroid clustering on an incremental distance matrix: exact integers, no vector is multiplied with a centroid twice.

Vectors become integers. A table in the shared folder keeps each vector with its dot products with all centroids. A round moves the
centroids; for each one only the components that changed are multiplied in and added to the kept products. The squared
distances follow from those and the two norms, and the nearest centroid is their least.

Nothing is shuffled but one row of sums for each task and cluster; the centroids, ``k`` times ``size`` numbers, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import removed
from .common import short_batches, staged

SIZE, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Integers are below this; squared distances of 2**20 components then fit in 64 bits. Larger ones raise.
MOST = 1 << 20


def integers(table: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, vec: each vector of exactly ``size`` finite components as floor(scale * x), x as double; the others are left out."""
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) == size) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    large = F.exists(x, lambda v: F.abs(v.cast("double") * scale) >= MOST)
    return table.where(good).select("vec_id", F.when(large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(scaled).alias("vec"))


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``salt:vec_id``, in that order; null ids come last, equal ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(name.alias("name"), "vec").orderBy(F.col("name").asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r.vec for r in rows], np.int64)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def update(rows: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, vec, dots) after the centroids moved from ``old`` to ``new``: dots, cluster (the first of the nearest) and squared distance."""
    change = new - old
    moves = [(c, at, change[c, at]) for c in range(len(new)) if len(at := np.flatnonzero(change[c]))]
    norms, (k, size) = (new * new).sum(1), new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, dots = _matrix(b.column(1), size), _matrix(b.column(2), k).copy()
            for c, at, by in moves:
                dots[:, c] += v[:, at] @ by
            far = norms - 2 * dots
            cluster = far.argmin(1)
            distance = far[np.arange(len(v)), cluster] + (v * v).sum(1)
            kept = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * k, pa.int32()), pa.array(dots.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), kept, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "vec", "dots", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return short_batches(rows).select("vec_id", "vec", "dots").mapInArrow(run, f"vec_id {kind}, vec array<bigint>, dots array<bigint>, cluster int, distance bigint")


def moved(assigned: DataFrame, old: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; one without vectors stays. Tasks add up their own rows first."""
    k, size = old.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            at = b.column(0).to_numpy()
            n += np.bincount(at, minlength=k)
            np.add.at(sums, at, _matrix(b.column(1), size))
        c = np.flatnonzero(n)
        held = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * size, pa.int32()), pa.array(sums[c].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(n[c], pa.int64()), held], ["cluster", "n", "sums"])

    parts = assigned.select("cluster", "vec").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    new = old.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(size)]).alias("sums")).collect():
        new[r.cluster] = [s // r.n for s in r.sums]
    return new


def clusters(table: DataFrame, size: int = SIZE, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of ``table`` (vec_id, embedding) that is ``integers``.

    ``rounds`` times vectors go to the nearest centroid (ties: the smaller number) and centroids to their vectors' floored mean; then
    vectors are assigned once more. With fewer than ``k`` vectors there are as many centroids. Null vectors, other lengths and
    vectors with a null or non-finite component are left out; null ids stay; repeated rows count each time; no vectors, no rows.
    Other columns don't matter. Components of ``MOST`` / ``scale`` or over raise an error, as their sums could leave 64 bits.
    A round's table goes once the next one is written.
    """
    spark, vectors = table.sparkSession, integers(table, size, scale)
    new = seeds(vectors, k, salt)
    k = len(new)
    if not k:
        kind = table.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    old, state = np.zeros((k, size), np.int64), vectors.withColumn("dots", F.array_repeat(F.lit(0).cast("long"), k))
    for turn in range(rounds + 1):
        before, state = state, staged(update(state, old, new))
        if turn:
            removed(before)
        if turn < rounds:
            old, new = new, moved(state, new)
    sums = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    at = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)  # noqa: E731 - one value for each centroid
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in new.tolist()]
    inertia = [F.lit(sums.get(c, 0)).cast("long") for c in range(k)]
    return state.select("vec_id", "cluster", "distance", at(inertia).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), at(map(F.lit, names)).alias("centroid_sha256"))


def _sql() -> str:
    """DuckDB's own computation: every distance of every round anew, over all component pairs."""
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) FOR x IN embedding] AS vec FROM embeddings
    WHERE len(embedding) = {SIZE} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
e AS MATERIALIZED (SELECT r, unnest(range(1, {SIZE + 1})) AS j, unnest(vec) AS x FROM v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec) - 1 AS k, r FROM v ORDER BY sha256('2:' || vec_id), vec LIMIT {CENTROIDS}),
m0 AS MATERIALIZED (SELECT k, j, x AS y FROM c0 JOIN e USING (r))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (SELECT r, k, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM e JOIN m{i} USING (j) GROUP BY r, k),
a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""
s{i} AS MATERIALIZED (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{i} USING (r) GROUP BY k, j),
m{i + 1} AS MATERIALIZED (SELECT k, j, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM m{i} LEFT JOIN s{i} USING (k, j))""")
    last = f"""
h AS (SELECT k, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM m{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM v JOIN a{ROUNDS} USING (r) JOIN h USING (k)"""
    return "WITH " + ",".join(steps) + "," + last


SQL = _sql()
