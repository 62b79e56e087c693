"""Models that are tables: a base and an effect for each bin of each feature, fitted by rounds of sums over bins.

A forecast is base * exp(sum of effects) for counts, base + sum of effects for plain scores. A round adds up truth and forecast of each
bin in one pass over the rows, and moves each effect a part of the way to where the bin's sums agree; so a fit is a few aggregations whose results have as many
rows as there are bins, whatever the data. Several fits, of the rows outside each fold and of all, run in the same passes.
Effects are stored, read and joined as any table is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import staged

RATE, ROUNDS = 0.3, 4
TABLE = "model int, feature string, bin int, effect double"


@dataclass
class Additive:
    """``base`` of each model and ``effects`` of each (model, feature, bin); a bin that was never seen has effect 0."""

    kind: str  # counts or scores
    features: list[str]
    base: dict[int, float]
    effects: dict[tuple[int, str, int], float]

    def forecast(self, model: int) -> Column:
        """The forecast of a row with the features' bins in columns of their names."""
        total = "0.0D"
        for f in self.features:
            own = {b: e for (m, g, b), e in self.effects.items() if (m, g) == (model, f)}
            if own:
                held = " ".join(repr(own.get(b, 0.0)) for b in range(max(own) + 1))  # a constant: folded once
                total += f" + coalesce(get(cast(split('{held}', ' ') AS array<double>), cast(`{f}` AS int)), 0.0D)"
        base = f"cast('{self.base[model]!r}' AS double)"
        return F.expr(f"{base} * exp({total})" if self.kind == "counts" else f"{base} + {total}")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(m, "", 0, b) for m, b in self.base.items()] + [(m, f, b, e) for (m, f, b), e in self.effects.items()]
        return spark.createDataFrame(rows, TABLE)


def cells(rows: DataFrame, truths: list[str], weight: str, features: list[str], also: list[str]) -> DataFrame:
    """What fits see of ``rows``: for each combination of the features' bins and of ``also``, which tells the models' rows apart, the weight and the weighted mean of each truth.

    A forecast depends on the bins alone, so a fit's sums over these, which are staged, are those over the rows.
    """
    w = F.col(weight).cast("double")
    means = [F.try_divide(F.sum(w * F.col(t).cast("double")), F.sum(w)).alias(t) for t in truths]
    return staged(rows.groupBy(*features, *also).agg(F.sum(w).alias(weight), *means))


def fit(rows: DataFrame, truth: str, weight: str, features: list[str], models: dict[int, Column], kind: str = "counts", rate: float = RATE, rounds: int = ROUNDS) -> Additive:
    """An ``Additive`` of ``rows`` for each of ``models``, which name the rows that each may see. Features are bins, small whole numbers; ``rows`` is read once a round.

    Bins are drawn to the base by one row of it. A model that sees no weight has base 0.
    """
    y, w = F.col(truth).cast("double"), F.col(weight).cast("double")
    seen = {m: F.when(c, w).otherwise(0.0) for m, c in models.items()}
    first = rows.agg(*[F.struct(F.sum(s * y).alias("y"), F.sum(s).alias("w")).alias(f"m{m}") for m, s in seen.items()]).first()
    out = Additive(kind, features, {m: (first[f"m{m}"]["y"] or 0.0) / (first[f"m{m}"]["w"] or 1.0) for m in models}, {})
    bins = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("bin")) for f in features])).alias("at")
    for _ in range(rounds):
        each = [F.struct((s * y).alias("y"), (s * out.forecast(m)).alias("p"), s.alias("w")).alias(f"m{m}") for m, s in seen.items()]
        sums = rows.select(bins, *each).groupBy("at.feature", "at.bin").agg(*[F.struct(*[F.sum(f"m{m}.{x}").alias(x) for x in "ypw"]).alias(f"m{m}") for m in models])
        for r in sums.collect():
            for m in models:
                s, b, key = r[f"m{m}"], out.base[m], (m, r.feature, r.bin)
                if s["w"] > 0:
                    out.effects[key] = out.effects.get(key, 0.0) + rate * _step(kind, s["y"], s["p"], s["w"], b)
    return out


def _step(kind: str, y: float, p: float, w: float, base: float) -> float:
    """How far a bin's effect is from making its forecasts add up to its truth."""
    import math

    if kind == "scores":
        return (y - p) / (w + 1)
    return math.log((y + base) / (p + base)) if base > 0 else 0.0


def loaded(table: DataFrame, kind: str, features: list[str]) -> Additive:
    """The model that ``table`` holds: a row a bin, so a small one."""
    rows = table.collect()
    return Additive(kind, features, {r.model: r.effect for r in rows if not r.feature}, {(r.model, r.feature, r.bin): r.effect for r in rows if r.feature})


def joined(rows: DataFrame, table: DataFrame, model: int, features: list[str], key: list[str], kind: str = "counts") -> DataFrame:
    """``key`` and forecast of ``rows``, by joins with a model's table alone."""
    base = table.where((F.col("model") == model) & (F.col("feature") == "")).select(F.col("effect").alias("base"))
    effects = table.where((F.col("model") == model) & (F.col("feature") != "")).select("feature", "bin", "effect")
    tall = rows.select(*key, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("bin")) for f in features])).alias("at")).select(*key, "at.*")
    sums = tall.join(F.broadcast(effects), ["feature", "bin"], "left").groupBy(*key).agg(F.coalesce(F.sum("effect"), F.lit(0.0)).alias("total"))  # a row a bin
    total = F.col("base") * F.exp("total") if kind == "counts" else F.col("base") + F.col("total")
    return sums.join(F.broadcast(base)).select(*key, total.alias("forecast"))


def fold(key: list[str], folds: int) -> Column:
    """A row's fold by a hash of its key's text."""
    text = F.concat_ws(":", *[F.date_format(k, "yyyyMMddHH") if k.endswith("hour") else F.col(k) for k in key])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def chain(train: DataFrame, rows: DataFrame, targets: list[str], features: list[str], weight: str = "sample_weight", folds: int = 3, width: int = 10, most: int = 9) -> tuple[DataFrame, dict[str, Additive]]:
    """``rows`` with pred_{target} for each target in turn, and the models: later targets also see the bins of earlier forecasts.

    ``train`` has a column fold; its own forecasts are those of the model that has not seen its fold, as a row to come would have them. These too depend on
    bins and fold alone, so all fits go over the ``cells`` of ``train``, which is read once.
    """
    seen, models, train = list(features), {}, cells(train, targets, weight, features, ["fold"])
    parts = {k: F.col("fold") != k for k in range(folds)} | {folds: F.lit(True)}
    for t in targets:
        model = models[t] = fit(train, t, weight, seen, parts)
        own = F.lit(0.0)
        for k in range(folds):
            own = F.when(F.col("fold") == k, model.forecast(k)).otherwise(own)
        at = lambda d, p: d.withColumn(f"pred_{t}", p).withColumn(f"bin_{t}", F.least(F.lit(most), F.floor(F.round(f"pred_{t}", 9) * width)).cast("int"))  # noqa: B023, E731
        train, rows = staged(at(train, own)), at(rows, model.forecast(folds))
        seen = [*seen, f"bin_{t}"]
    return rows, models


def platt(rows: DataFrame, score: str, label: str, rounds: int = 6) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of ``label`` over ``score`` by Newton steps, each from five sums; the slope is held by one row's weight."""
    import math

    n, ones = rows.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    if not n or not ones or ones == n:
        return 1.0, 0.0
    a, b = 0.0, math.log(ones / (n - ones))
    x, y = F.col(score), F.col(label).cast("double")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * x + F.lit(b))))
        v = p * (1 - p)
        ga, gb, haa, hab, hbb = rows.agg(F.sum((y - p) * x), F.sum(y - p), F.sum(v * x * x), F.sum(v * x), F.sum(v)).first()
        ga, haa, det = ga - a, haa + 1, (haa + 1) * hbb - hab * hab
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    return a, b
