"""Nearest rows by a packed tree of boxes: its nodes hold equal numbers of rows, however unevenly these lie.

Rows are range-sorted along a space-filling curve, and each ``FAN`` of them in that order are a leaf with the box around them; each ``FAN`` leaves are a node of
the next level, and so on up to one root. A hundred rows or a city of a million in one street make equal leaves; a level has a ``FAN``-th of the rows of the one below.

A query starts at the root. Of the children of its nodes it keeps those whose box comes nearer than the farthest corner of the best box: usually two or
three. At the leaves the rows' own boxes are compared in the same way, and of what is left the exact distance decides. Nodes of a level are broadcast where there are at most ``SMALL``; beyond that they meet the
queries by a join that deals nodes of many queries to many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dealt, once, spread_join, staged

FAN_BITS = 5
FAN = 1 << FAN_BITS
#: Nodes of a level that are broadcast at most; a node has ``FAN`` rows.
SMALL = 2048


@dataclass
class Tree:
    """``levels[0]`` has the leaves; of each level a row per group and node, with its children in ``kids``. ``sizes``: the levels' rows."""

    levels: list[DataFrame]
    sizes: list[int]
    by: list[str]
    axes: int


def curve(position: Column) -> Column:
    """The 21 bits of a number with two free bits before each, for the codes of three axes to be laid into one another."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        position = position.bitwiseOR(F.shiftleft(position, shift)).bitwiseAND(F.lit(mask))
    return position


def pack(rows: DataFrame, low: list[str], high: list[str], by: list[str] | None = None, keep: list[str] | None = None) -> Tree | None:
    """The tree of ``rows`` with boxes from ``low`` to ``high`` (finite; the same columns for points), one for each value of ``by``; leaves have ``keep``. None of no rows."""
    by, keep, axes = by or [], keep or [], len(low)
    boxes = [c for i in range(axes) for c in (F.col(low[i]).alias(f"l{i}"), F.col(high[i]).alias(f"h{i}"))]
    rows = staged(rows.select(*by, *boxes, F.struct(*([F.col(c) for c in keep] or [F.lit(0)])).alias("kept")))
    edges = rows.agg(*[f(f"{c}{i}").alias(f"{c}{i}") for i in range(axes) for f, c in ((F.min, "l"), (F.max, "h"))]).first()
    if edges["l0"] is None:
        return None
    codes = [F.lit(0).cast("long"), F.lit(0).cast("long")]
    for i in range(axes):
        wide = (edges[f"h{i}"] - edges[f"l{i}"]) * 2 or 1.0
        at = F.floor((F.col(f"l{i}") + F.col(f"h{i}") - 2 * edges[f"l{i}"]) / wide * float((1 << 42) - 1))
        parts = (F.shiftright(at, 21), at.bitwiseAND(F.lit((1 << 21) - 1)))
        codes = [c.bitwiseOR(F.shiftleft(curve(p), i)) for c, p in zip(codes, parts, strict=True)]
    order = [*by, "_high", "_low"]
    line = rows.withColumns({"_high": codes[0], "_low": codes[1]}).repartitionByRange(*order).sortWithinPartitions(*order).drop("_high", "_low")
    line = staged(line.withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    most = line.agg(F.max(part).alias("parts"), F.max(at).alias("rows")).first()
    bits = -(-max(1, most.rows.bit_length()) // FAN_BITS) * FAN_BITS  # each partition's numbers fill whole nodes
    level = line.withColumn("node", F.shiftleft(part, bits) + at).drop("_id")
    levels, last = [], (most.parts << bits) + most.rows
    while not levels or last > 0:
        last >>= FAN_BITS
        kid = F.struct(*([] if not levels else ["node"]), *[f"{c}{i}" for i in range(axes) for c in "lh"], *(["kept"] if not levels else [])).alias("kid")
        boxes = [f(f"{c}{i}").alias(f"{c}{i}") for i in range(axes) for f, c in ((F.min, "l"), (F.max, "h"))]
        level = staged(level.select("*", kid).withColumn("up", F.shiftright("node", FAN_BITS)).groupBy(*by, "up").agg(*boxes, F.collect_list("kid").alias("kids")).withColumnRenamed("up", "node"))
        levels.append(level)
    return Tree(levels, [x.count() for x in levels], by, axes)


def _square(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [p * p for p in parts])


def nearest(tree: Tree | None, queries: DataFrame, at: list[str], distance: Callable[[Column], Column], best: Callable[[Column, Column], Column], slack: tuple[float, float] = (1e-9, 1e-15)) -> DataFrame:
    """``queries`` (distinct rows with positions ``at`` and the tree's groups) with ``best``: the least struct that ``best`` makes of a distance and of a row's kept columns.

    ``distance`` takes a row's kept columns. Boxes are compared by straight distances squared, of which the exact ones must be a rising function but for ``slack`` (relative, absolute).
    Queries whose group the tree lacks have no answer.
    """
    columns = queries.columns
    if tree is None:
        nothing = queries.limit(0).withColumn("kept", F.lit(None).cast("struct<>"))
        return nothing.select(*columns)
    spread = lambda k: (  # noqa: E731 - squared distances from the nearest and the farthest point of a box
        _square([F.greatest(F.lit(0.0), k[f"l{i}"] - F.col(c), F.col(c) - k[f"h{i}"]) for i, c in enumerate(at)]),
        _square([F.greatest(F.abs(F.col(c) - k[f"l{i}"]), F.abs(F.col(c) - k[f"h{i}"])) for i, c in enumerate(at)]),
    )
    told = [c for c, kind in queries.dtypes if "double" not in kind] or columns  # numbers are made alike before they are grouped, which would shuffle again
    asked = dealt(queries, *told).withColumn("node", F.lit(0).cast("long"))
    for n in reversed(range(1, len(tree.levels))):
        met = _met(tree, n, asked)
        near = F.transform("kids", lambda k: F.struct(k["node"].alias("node"), spread(k)[0].alias("low"), spread(k)[1].alias("high")))
        least = lambda near: F.array_min(F.transform(near, lambda k: k["high"])) * (1 + slack[0]) + slack[1]
        under = lambda near, b: F.transform(F.filter(near, lambda k: k["low"] <= b), lambda k: F.struct(k["node"].alias("node"), k["low"].alias("low")))
        kept = once(near, lambda near: once(least(near), lambda b: F.struct(b.alias("bound"), under(near, b).alias("near"))))  # noqa: B023
        met = met.select(*columns, kept.alias("kept"))
        if n == len(tree.levels) - 1:  # at the root each query is one row
            asked = met.select(*columns, F.explode("kept.near.node").alias("node"))
        else:
            met = met.groupBy(*columns).agg(F.min("kept.bound").alias("bound"), F.flatten(F.collect_list("kept.near")).alias("near"))
            asked = met.select(*columns, F.explode(F.filter("near", lambda k: k["low"] <= F.col("bound"))["node"]).alias("node"))
    bound = F.array_min(F.transform("kids", lambda k: spread(k)[1])) * (1 + slack[0]) + slack[1]
    rows = _met(tree, 0, asked).select(*columns, F.explode(once(bound, lambda b: F.filter("kids", lambda k: spread(k)[0] <= b))).alias("kid"))
    kept = F.col("kid.kept")
    return rows.groupBy(*columns).agg(F.min(best(distance(kept), kept)).alias("best"))


def _met(tree: Tree, n: int, asked: DataFrame) -> DataFrame:
    level, keys = tree.levels[n].select(*tree.by, "node", "kids"), [*tree.by, "node"]
    if tree.sizes[n] <= SMALL:
        return asked.join(F.broadcast(level), keys)
    asked = staged(asked)
    return spread_join(asked, level, keys, staged(asked.groupBy(*keys).agg(F.count("*").alias("n"))), F.xxhash64(*asked.columns))
