"""Fitted operators against plain recomputations of their features, fits and verdicts, and held-out labels."""

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kerbline.llm import quality, toxicity, urls

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- op3
def plain_features(text: str | None) -> dict[int, float]:
    count: Counter = Counter()
    before = None
    for word in (text or "").split():
        bare = word.lower().strip("\"'.,;:!?()[]{}<>*#$%&|")
        shape = re.sub(r"(.)\1+", r"\1\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
        half = quality.DIM // 2
        one = xxhash.xxh64_intdigest(("w" + bare).encode()) % half + half
        two = xxhash.xxh64_intdigest(("s" + shape).encode()) % (half - 1) + 1
        count[one] += 1
        count[two] += 1
        count[0] += (one, two) == before
        before = one, two
    total = sum(count.values())
    return {f: math.sqrt(n) / math.sqrt(total) for f, n in count.items() if n}


def test_grades_are_those_of_a_plain_fit(spark):
    docs, labels = read(spark, "documents").where("doc_id < 260"), read(spark, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rating = {r.doc_id: r.rating for r in quality.grades(labels).collect() if r.rating is not None and r.doc_id in texts}
    import zlib

    ids = [i for i in rating if zlib.crc32(str(i).encode()) % 4 != 2]
    made = {i: plain_features(t) for i, t in texts.items()}
    used = sorted({f for i in ids for f in made[i]})
    place = {f: k for k, f in enumerate(used)}
    x, y = np.zeros((len(ids), len(used))), np.array([rating[i] for i in ids])
    for k, i in enumerate(ids):
        for f, v in made[i].items():
            x[k, place[f]] = np.float32(v)
    share = np.array([sum(y == g) or 1 for g in range(3)])
    weight = 1 / share[y]
    weight /= weight.sum()
    p = np.zeros(len(used) + 2)
    m, v = p.copy(), p.copy()
    for t in range(1, 201):
        s, low, gap = x @ p[:-2], p[-2], math.exp(p[-1])
        q = [1 / (1 + np.exp(-(s - low))), 1 / (1 + np.exp(-(s - low - gap)))]
        a, b = np.choose(y, [np.ones(len(y)), q[0], q[1]]), np.choose(y, [q[0], q[1], np.zeros(len(y))])
        da, db = a * (1 - a) / np.maximum(a - b, 1e-12), b * (1 - b) / np.maximum(a - b, 1e-12)
        first = np.where(y == 0, db, np.where(y == 1, -da, 0.0))  # by the two thresholds
        second = np.where(y == 1, db, np.where(y == 2, -da, 0.0))
        grad = np.append(1e-4 * p[:-2] - x.T @ (weight * (1 - a - b)), [-(weight * (first + second)).sum(), -(weight * second).sum() * gap])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    seen = set()
    for r in quality.quality(docs, labels).collect():
        s = sum(p[place[f]] * v for f, v in made[r.doc_id].items() if f in place)
        over = [1 / (1 + math.exp(-(s - th))) for th in (p[-2], p[-2] + math.exp(p[-1]))]
        assert abs(r.expected_grade - sum(over)) < 1e-3 and abs(r.tail_prob - over[0]) < 1e-3
        assert abs(over[0] - 0.5) < 1e-3 or r.kept == (over[0] >= 0.5)
        seen.add(r.kept)
    assert seen == {True, False}


def test_equal_grades_come_in_any_order(spark):
    rows = [(i, "good words here" if i % 2 else "bad bad bad", "x") for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct()
    one, two = ({(r.doc_id, r.tail_prob, r.kept) for r in quality.quality(d, labels).collect()} for d in (docs, docs.orderBy(F.desc("doc_id"))))
    assert one == two and all(kept == bool(i % 2) for i, _, kept in one)


# --- op8
def test_url_weights_are_the_optimum(spark):
    w, b = urls.fit(urls.labelled(spark))
    rows = urls.labelled(spark).select("blocked", F.array_distinct(urls._all_buckets(F.col("url"))).alias("at")).collect()
    w, grad, bias = np.array(w), np.zeros(len(w)), 0.0
    for r in rows:
        z = 1 / (1 + math.exp(-(b + sum(w[i] for i in r["at"])))) - r.blocked
        grad[r["at"]] += z / len(rows)
        bias += z / len(rows)
    assert np.abs(grad + 0.02 * w).max() < 2e-3 and abs(bias) < 2e-3  # of a strictly convex loss: there is no other


# --- op1
def test_held_out_toxic_documents_are_found(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    # some forty toxic documents to learn words from: 10 of the 14 held out are found; with ten times as many nearly all are (see the README)
    assert len(toxic) == 14 and sum(r.predicted for r in toxic) >= 10 and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert np.mean([r.score for r in toxic]) > 5 * np.mean([r.score for r in clean])


def test_the_lexicon_is_plain_counts(spark):
    said = ["you are a stupid man", "what a stupid thing", "stupid is he", "so stupid again", "a stupid st0p", "he is stupid too", "my stupid dog", "the nice man", "a nice day today", "what a nice thing", "day by day we go"]
    rows = [(t, int("stupid" in t), i % 2) for i, t in enumerate(said * 3)]
    sample = spark.createDataFrame(rows, "text string, grade int, half int")
    model = toxicity.character_model(sample)
    sizes = {(g, h): sum(1 for _, a, b in rows if (a, b) == (g, h)) for g in (0, 1) for h in (0, 1)}
    whole, half = toxicity.lexicon(sample, model, sizes)
    places: dict = {}
    for text, grade, part in rows:
        words = toxicity.restored_words(text, model)
        around = ["", *words, ""]
        for i, word in enumerate(words):
            for f in toxicity._features(word):
                key = f, f"{around[i]} {around[i + 2]}"
                places[key] = max(places.get(key, 0), 2 * grade + part)
    want: tuple[dict, dict] = {}, {}
    for f in {f for f, _ in places}:
        n = Counter(c for (g, _), c in places.items() if g == f)
        for out, t, c, nt, nc in ((want[0], n[2] + n[3], n[0] + n[1], sizes[1, 0] + sizes[1, 1], sizes[0, 0] + sizes[0, 1]), (want[1], n[2], n[0], sizes[1, 0], sizes[0, 0])):
            odds = math.log((t + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))
            if t >= toxicity.LEAST and odds >= toxicity.ODDS:
                out[f] = odds
    assert want[0] and set(whole) == set(want[0]) and set(half) == set(want[1])
    assert all(abs(whole[f] - want[0][f]) < 1e-12 for f in whole)
