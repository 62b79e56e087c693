"""URL filters with built-in functions only: domain rules, then logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled table (url, blocked) by Spark ML; judging is one column
expression: n-grams of each padded part, their hashes modulo ``DIM``, and the sum of their weights.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

DIM = 4096
GRAMS = (3, 4)
THRESHOLD = 0.5
#: (host, path, verdict): a rule fits its host and all subdomains where the url's path starts with the rule's; the longest wins.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
# The labelled table that the model is fitted on where no other is given.
BLOCKED = (
    "http://casino-bonus.test/free-spins", "http://www.poker-casino.test/play/slots", "https://adserver.test/banner/click?id=3", "http://ads.tracker.test/pixel.gif",
    "http://cheap-viagra.test/buy-pills-online", "https://pharmacy-pills.test/order/cialis", "http://xxx-porn.test/videos/sex", "https://adult-cams.test/live-sex",
    "http://free-movies-torrent.test/download/crack", "https://warez.test/keygen/serial-crack", "http://get-rich-quick.test/win-money-now", "https://payday-loans.test/apply/fast-cash",
    "http://doubleclick-ads.test/adclick", "https://popup-ads.test/banner/728x90", "http://spam-links.test/seo/buy-backlinks", "https://betting-odds.test/casino/bet-now",
    "http://replica-watches.test/cheap-rolex", "https://malware-host.test/payload.exe", "http://phish-login.test/account/verify-password", "https://lottery-winner.test/claim-prize",
)
ALLOWED = (
    "https://docs.library.test/en/guide/12", "http://www.news-daily.test/fr/article/2031.html", "https://blog.gardening.test/de/2020/05/roses", "http://encyclopedia.test/es/wiki/Historia",
    "https://university.test/en/courses/1044", "http://museum.test/fr/collection/88", "https://forum.cooking.test/en/thread/4711?page=2", "http://weather.test/de/berlin/",
    "https://m.recipes.test/en/20789#top", "http://blog.travel.test/es/35056", "https://science-journal.test/en/8724.html", "http://city-council.test/fr/19406/",
    "https://school.test/de/6316", "http://m.history.test/en/47521#top", "https://stories.test/en/9211", "http://planet.test/es/32911?page=2",
    "https://dictionary.test/en/the", "http://press.test/fr/44382/", "https://open-source.test/en/project/readme", "http://radio.test/de/46695?ref=x",
)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def buckets(text: Column, mark: str) -> Column:
    """Hash buckets of the character n-grams of ``text`` between two blanks; ``mark`` keeps host and path apart."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))

    def grams(n: int) -> Column:
        last = F.greatest(F.length(padded) - n + 1, F.lit(0))
        at = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(padded, i, F.lit(n))), F.lit(DIM)).cast("int"))
        return F.coalesce(F.when(last > 0, at), F.array().cast("array<int>"))

    return F.concat(*map(grams, GRAMS))


def _all_buckets(url: Column) -> Column:
    return F.concat(buckets(host(url), "h"), buckets(path(url), "p"))


def labelled(spark: SparkSession) -> DataFrame:
    """The table above as (url, blocked); a caller may give any small one of his own."""
    rows = F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("blocked")) for y, us in ((1, BLOCKED), (0, ALLOWED)) for u in us]))
    return spark.range(1).select(rows.alias("r")).select("r.*")


def fit(table: DataFrame) -> tuple[list[float], float]:
    """Weights of the ``DIM`` buckets and the bias, from a small table (url, blocked)."""
    known = staged(table.select(F.array_distinct(_all_buckets(F.col("url"))).alias("b"), F.col("blocked").cast("double").alias("label")).coalesce(1))
    hot = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.when(F.array_contains("b", i.cast("int")), 1.0).otherwise(0.0))
    rows = known.select(array_to_vector(hot).alias("features"), "label")
    model = LogisticRegression(maxIter=30, regParam=0.02, standardization=False).fit(rows)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def risk(url: Column, weights: list[float], bias: float) -> Column:
    """Probability that ``url`` is to be blocked: each n-gram counts once."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # a constant: folded once
    z = F.aggregate(F.array_distinct(_all_buckets(url)), F.lit(bias), lambda acc, b: acc + F.element_at(table, b + 1))
    return 1 / (1 + F.exp(-z))


def url_filter(pages: DataFrame, table: DataFrame | None = None, rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, risk, verdict for each row; a null or empty url has empty parts, fits no rule and is judged by the model.

    A risk at the threshold blocks. Very long urls are read whole, null ids stay, repeated rows give repeated results, an empty table gives no
    rows; other columns don't matter.
    """
    weights, bias = fit(table if table is not None else labelled(pages.sparkSession))
    h, p = host(F.col("url")), path(F.col("url"))
    rows = pages.select("page_id", "url", h.alias("host"), p.alias("path"))
    # longest host first, then longest path: the first rule that fits wins
    rule = verdict = None
    for name, start, says in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        shown = F.lit(name + start)
        rule = F.when(fits, shown) if rule is None else rule.when(fits, shown)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("risk", risk(F.col("url"), weights, bias))
    said = F.coalesce("ruled", F.when(F.col("risk") >= threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", "risk", said.alias("verdict"))
