"""Ranked search, substring dedup and clustering against brute force, and on awkward rows."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kerbline.llm import clusters, lexical, substrings

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AWKWARD = [(1, None), (2, ""), (3, "word"), (4, "word"), (5, " \n\t ,.;"), (6, "long " * 30000 + "tail"), (6, "long " * 30000 + "tail"), (None, "no id but a word"), (8, "Ünï ☃ 日本 x_y A-b"), (-9, "İ STRASSE straße K")]


def corpus(seed: int, n: int, vocabulary: int = 60) -> list[tuple]:
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6)) % vocabulary}" for _ in range(4000)]
    return [(i, " ".join(r.choices(words, k=r.randrange(1, 80)))) for i in range(100, 100 + n)]


# --- op11
def ranked(docs: list[tuple], items: list[tuple], k: int = 50) -> list[tuple]:
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = lambda t: TERM.findall((t or "").translate(fold))
    texts = [(d, x) for d, t in docs if (x := terms(t))]
    n, length = len(texts), sum(len(x) for _, x in texts)
    out = []
    for item, t in items:
        scores = []
        asked = {q: sum(q in x for x in held) for q in set(terms(t))} if (held := [set(x) for _, x in texts]) else {}
        for d, x in texts:
            m = 50 + 50 * len(x) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * x.count(q) // (1000 * x.count(q) + 20 * m)) for q, df in asked.items() if q in x)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, rank + 1, None if absent else d, -s) for rank, (s, absent, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **kw) -> list[tuple]:
    d, i = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    return sorted(map(tuple, lexical.ranked(d.repartition(3, "text"), i, **kw).collect()), key=str)


def test_ranking_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DOCUMENTS", 37)  # several shards in a task
    monkeypatch.setattr(lexical, "ITEMS", 4)  # and several blocks of items
    docs = corpus(1, 400) + AWKWARD
    items = [(1, "w1 w2 w3"), (2, "W1 w1, word"), (3, ""), (4, None), (5, "nothing"), (6, "long tail 日本"), (7, "straße a b X y"), (None, "w5 w7 w11 w13 w17"), (9, " ".join(f"w{i}" for i in range(60))), (9, "w4")]
    assert found(spark, docs, items) == ranked(docs, items)
    assert found(spark, docs, items, k=3) == ranked(docs, items, 3)


def test_equal_scores_come_by_document(spark):
    docs = [(i, "same text here") for i in range(90, 0, -1)] + [(200 + i, f"other {i}") for i in range(50)]
    assert [(r[1], r[2]) for r in sorted(found(spark, docs, [(1, "same")]))] == [(i, i) for i in range(1, 51)]


def test_search_of_empty_tables(spark):
    assert found(spark, [], [(1, "w1")]) == found(spark, [(1, "w1")], []) == found(spark, [(1, None)], [(1, "w1")]) == []


def test_no_more_than_a_shard_is_written_or_read_at_once(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DOCUMENTS", 37)
    indexed = lexical.index(spark.createDataFrame(corpus(1, 400), "doc_id long, text string").repartition(1))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in indexed.inputFiles()]
    assert [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)] == [1] * 11  # a reader's batch ends with its row group
    assert sorted(d for r in indexed.collect() for d in r.doc_ids) == list(range(100, 500))


@pytest.mark.parametrize("seed", range(4))
def test_treap_holds_every_cell(seed):
    r = np.random.default_rng(seed)
    cells = np.unique(r.integers(0, [300, 50], (700, 2)), axis=0)
    values = r.integers(1, 10**6, len(cells))
    treap = lexical.Treap(*(x if isinstance(x, int) else x.tobytes() for x in lexical.quadtree(cells[:, 0], cells[:, 1], values)))
    for rows in (r.integers(0, 300, 1), np.unique(r.integers(0, 300, 40))):
        weights, got = r.integers(1, 9, len(rows)), {}

        def take(columns, scores, got=got):
            got.update(zip(columns.tolist(), scores.tolist(), strict=True))
            return 1

        treap.best(rows, weights, 1, take)
        sums = {c: sum(int(v) * int(w) for row, w in zip(rows, weights, strict=True) for (a, b), v in zip(cells, values, strict=True) if (a, b) == (row, c)) for c in range(50)}
        assert got == {c: s for c, s in sums.items() if s}


def test_ranges_that_can_not_reach_are_not_split():
    cells = [(0, c) for c in range(1024)]
    treap = lexical.Treap(*(x if isinstance(x, int) else x.tobytes() for x in lexical.quadtree(*np.array(cells).T, np.arange(1024) + 1)))
    seen = []
    treap.best(np.array([0]), np.array([1]), 1, lambda columns, scores: seen.extend(columns) or 1024)
    assert len(seen) <= lexical.WIDTH and 1023 in seen


# --- op12
def judged(docs: list[tuple]) -> list[tuple]:
    words, least = [(t or "").encode().split() for _, t in docs], {}
    for (d, _), w in zip(docs, words, strict=True):
        for i in range(len(w) - 12) if d is not None else ():
            key = tuple(w[i : i + 13])
            least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = {j for i in range(len(w) - 12) if d is not None and least[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


def deduplicated(spark, docs, **kw) -> list[tuple]:
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hashes", F.lit("clash"))
    return sorted(map(tuple, substrings.deduplicated(df.repartition(3, "text"), **kw).collect()), key=str)


@pytest.mark.parametrize("stretch", [substrings.STRETCH, 40])
def test_substrings_are_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(substrings, "STRETCH", stretch)  # documents of a stretch meet at once, and across stretches
    r = random.Random(5)
    passages = [[f"p{r.randrange(10**6)}" for _ in range(n)] for n in (12, 13, 14, 20, 60)]
    docs = list(AWKWARD)
    for i in range(120):
        parts = [[f"u{r.randrange(10**6)}" for _ in range(r.randrange(0, 25))] for _ in range(4)]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            parts.insert(r.randrange(4), p[r.randrange(3) :])  # at any place modulo the period
        docs.append((500 - i, r.choice(" \n\t").join(w for part in parts for w in part)))
    docs += [(700, "a b " * 40), (701, "a b " * 30), (702, docs[40][1]), (702, docs[40][1]), (703, docs[41][1]), (None, docs[42][1]), (-(2**63), docs[43][1]), (2**63 - 1, docs[44][1])]
    assert deduplicated(spark, docs) == judged(docs)


def test_any_window_shares_an_anchor():
    cover = {p % substrings.PERIOD for p in substrings.COVER}
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + d) % substrings.PERIOD in cover and (j + d) % substrings.PERIOD in cover for d in range(substrings.WINDOW - substrings.ANCHOR + 1))


def test_kept_words_and_empty_table(spark):
    docs = [(1, " ".join(map(str, range(20)))), (2, "x  y\n" + " ".join(map(str, range(20))) + " z")]
    assert {r[0]: r[4] for r in deduplicated(spark, docs, keep_text=True)} == {1: docs[0][1], 2: "x y z"}
    assert deduplicated(spark, []) == []


# --- op13
def clustered(vectors: list[tuple], size: int, k: int, rounds: int) -> list[tuple]:
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    named = sorted(((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept))
    centroids = [list(v) for _, _, v in named[:k]]
    for turn in range(rounds + 1):
        at = [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        for n in range(len(centroids)) if turn < rounds else ():
            if own := [v for (_, v), (_, m) in zip(kept, at, strict=True) if m == n]:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sums = [sum(d for d, n in at if n == c) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sums[n], sum(sums), names[n]) for (i, _), (d, n) in zip(kept, at, strict=True)), key=str)


@pytest.mark.parametrize("n", [3, 200])
def test_clusters_are_brute_force(spark, n):
    r = random.Random(n)
    rows = [(i, [r.choice([-1, 1]) * r.random() for _ in range(6)]) for i in range(n)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [None] + [1.0] * 5), (905, [float("nan")] * 6), (906, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (907, [0.5] * 6), (907, [0.5] * 6), (908, [-0.0] * 6), (909, [1e-30] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash"))
    got = clusters.clusters(df.repartition(3, "vec_id"), size=6, k=8, rounds=5)
    assert sorted(map(tuple, got.collect()), key=str) == clustered(rows, 6, 8, 5)


def test_only_changed_components_are_multiplied(spark):
    v = np.arange(12).reshape(3, 4)
    old, new = np.array([[1, 2, 3, 4], [5, 6, 7, 8]]), np.array([[1, 2, 9, 4], [5, 6, 7, 8]])
    dots = v @ old.T
    dots[:, 1] += 1000  # an unmoved centroid's products are taken as they are kept
    rows = spark.createDataFrame([(i, v[i].tolist(), dots[i].tolist()) for i in range(3)], "vec_id long, vec array<long>, dots array<long>")
    got = {r.vec_id: r.dots for r in clusters.update(rows, old, new).collect()}
    assert got == {i: [int(v[i] @ new[0]), int(v[i] @ new[1]) + 1000] for i in range(3)}


def test_no_vectors_and_large_ones(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert clusters.clusters(df).count() == 0 and clusters.clusters(df.limit(0)).columns == clusters.clusters(df).columns
    with pytest.raises(Exception, match="too large"):
        clusters.clusters(spark.createDataFrame([(1, [5000.0] * 64)], df.schema)).collect()
