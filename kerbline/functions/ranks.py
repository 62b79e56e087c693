"""Exact order statistics of a column without sorting it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import running_sum, staged

#: Ranks that ``percentile_approx`` tells are off by a part of the rows at most.
ACCURACY = 10000


def percentiles(rows: DataFrame, columns: dict[str, Column], p: float) -> dict[str, float | None]:
    """The exact percentile ``p`` (0..1, between two neighbours in proportion) of each of ``columns`` by name; nulls don't count, and none but nulls give None.

    A sketch of bounded size tells an interval that must hold the rank. The values below it are counted, and only those in it, a few thousandths of the rows, are
    grouped by value and summed up in order over range partitions.
    """
    values = staged(rows.select(*[c.cast("double").alias(n) for n, c in columns.items()]))
    sizes = values.agg(*[F.count(n).alias(n) for n in columns]).first().asDict()
    off = {n: 2 / ACCURACY + 2 / k for n, k in sizes.items() if k}  # twice the sketch's fault, and what rounding of ranks may add
    if not off:
        return dict.fromkeys(columns)
    sketch = values.agg(*[F.percentile_approx(n, [max(0.0, p - x), min(1.0, p + x)], ACCURACY).alias(n) for n, x in off.items()]).first()
    known = {n: {"n": sizes[n], "q": sketch[n]} for n in off}
    within = {n: (F.col(n) >= s["q"][0]) & (F.col(n) <= s["q"][1]) for n, s in known.items()}
    below = values.agg(*[F.struct(F.count_if(F.col(n) < s["q"][0]).alias("n"), F.min(F.when(F.col(n) > s["q"][1], F.col(n))).alias("next")).alias(n) for n, s in known.items()]).first()
    inside = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.when(w, F.col(n)).alias("value")) for n, w in within.items()]))
    counts = values.select(inside.alias("x")).select("x.*").where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    line = running_sum(staged(counts), ["value"], "n", "ahead", group="name")
    ranks = {n: (math.floor(p * (s["n"] - 1)) - below[n]["n"], p * (s["n"] - 1) % 1) for n, s in known.items()}
    wanted = [(F.col("name") == n) & (F.col("ahead") <= k + 1) & (F.col("ahead") + F.col("n") > k) for n, (k, _) in ranks.items()]
    found: dict[str, list] = {n: [] for n in known}
    for r in line.where(_any(wanted)).collect():  # the one or two values of each rank
        found[r["name"]].append((r.ahead, r.n, r.value))
    out: dict[str, float | None] = dict.fromkeys(columns)
    for n, (k, part) in ranks.items():
        at = lambda i, n=n: next((v for ahead, count, v in found[n] if ahead <= i < ahead + count), below[n]["next"])
        low = at(k)
        out[n] = low + part * (at(k + 1) - low) if part else low
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def one_row(like: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """A row of numbers."""
    return like.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in values.items()])
