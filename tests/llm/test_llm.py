"""The training-data operators against brute force, round trips and held-out labels, and on awkward rows."""

import hashlib
import base64
import cmath
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kerbline.llm import html, media, mixing, packing, quality, queries, rules, simhash, toxicity, urls, warc
from kerbline.llm.common import shared_dir

SF = "/root/testdata/sf0.01"
AWKWARD = [(1, None, "a"), (2, "", None), (3, "word", "a"), (4, "word", "a"), (5, " \n\t ", "b"), (6, "long " * 30000, "b"), (6, "long " * 30000, "b"), (None, "no id", None), (8, "Ünï ☃ 日本 x", "c")]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, s, "en", len(t or ""), "x") for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(spark, docs):
    return docs.limit(0)


# --- op1
def test_restores_disguised_words(spark):
    text = "the stupid idiot and the clown " * 50
    model = toxicity.character_model(spark.createDataFrame([(text,)], "text string"))
    assert [toxicity.restore(w, model) for w in ("stup1d", "1d10t", "cl0wn", "stuuuupid", "st.u.p.i.d", "the", "123")] == ["stupid", "idiot", "clown", "stupid", "stupid", "the", "123"]
    assert "idiot" in toxicity.restored_words("an i d i o t here", model)


def test_restores_spacing_and_doubling(spark):
    text = "the stupid idiot and the fool, scum and a scumbag with an ass " * 50
    model = toxicity.character_model(spark.createDataFrame([(text,)], "text string"))
    for said, word in (("s t u p i d.", "stupid."), ("f o o l!", "fool!"), ("s  c  u  m", "scum"), ("$ c u m b a g", "scumbag"), ("a s c u m", "scum"), ("i d 1 o t", "idiot")):
        assert word in toxicity.restored_words(f"they were {said} there", model), said
    assert [toxicity.restore(w, model) for w in ("f00l", "a55", "iiddiioott", "letter", "balloon")] == ["fool", "ass", "idiot", "letter", "balloon"]
    assert toxicity.respaced("x x x", model) == toxicity.respaced("1 2 3", model) == []


def test_scores_are_brute_force(spark, docs, labels):
    d = docs.unionByName(spark.createDataFrame([(50 + i, t, "a", "en", 1, "x") for i, t in enumerate(["you stup1d man", "s t u p i d", "a kind man", "stupid idiot stupid"])], docs.schema))
    fitted = {"model": toxicity.character_model(d), "logit": np.array([-4.0, 1.0, 0.5])}
    fitted["weights"] = {toxicity._features(w)[0]: v for w, v in (("stupid", 3.0), ("idiot", 5.0))}
    texts = [r.text for r in d.collect()]
    for r, text in zip(toxicity.score(d, fitted, ["text"]).collect(), texts, strict=True):
        words = (text or "").lower().split() + [w for w in toxicity.restored_words(text or "", fitted["model"])[len((text or "").split()) :]]
        hits = sorted(({"stupid": 3.0, "idiot": 5.0}.get(toxicity.restore(w, fitted["model"]), 0.0) for w in words), reverse=True)
        first, second = (hits + [0.0, 0.0])[:2]
        assert r.k0 == text and abs(r.score - 1 / (1 + np.exp(4 - first - 0.5 * second))) < 1e-12


def test_viterbi_is_the_best_path(spark):
    model = toxicity.character_model(spark.createDataFrame([("some words to count letters of, stupid and clown",)], "text string"))
    from itertools import product

    for token in ("st0p!d", "c1o.wn"):
        best, found = None, None
        for path in product(*toxicity._candidates(token)):
            c = toxicity.CLASS[np.frombuffer((" " * 2 + "".join(s for s, _ in path) + " ").encode(), np.uint8)]
            p = sum(x for _, x in path) + sum(model[c[i], c[i + 1], c[i + 2]] for i in range(len(c) - 2))
            if best is None or p > best:
                best, found = p, "".join(s for s, _ in path)
        assert toxicity.restore(token, model) == found


def test_toxicity_awkward(docs, labels, empty):
    assert toxicity.toxicity(docs, labels).count() == len(AWKWARD)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


# --- op2
def _check_pieces(rows, docs):
    ids = packing.Ids(queries.tokenizer_path())
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    for doc_id, text in docs:
        want = np.frombuffer(ids.of(text), "<u4")
        full = ids.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert want.tolist() == full
        mine = sorted({(r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc_id})
        at = 0
        for start, n, crc in mine:
            assert start == at and crc == zlib.crc32(want[start : start + n].tobytes())
            at += n
        assert at == len(want)
    total = sum(r.length for r in rows)
    pad = sum(0 if n & (n - 1) == 0 else 4096 - n for n in (sum(x for _, x in p) for p in used.values()))
    return total, pad


def test_packing(spark, docs, empty):
    _check_pieces(packing.pack(docs.where("doc_id is not null and doc_id != 6"), queries.tokenizer_path()).collect(), [(i, t) for i, t, _ in AWKWARD if i not in (None, 6)])
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    total, pad = _check_pieces(packing.pack(d, queries.tokenizer_path()).collect(), [tuple(r) for r in d.collect()])
    assert pad < 0.01 * total
    rows, ids = packing.pack(docs, queries.tokenizer_path()).collect(), packing.Ids(queries.tokenizer_path())
    assert sum(r.length for r in rows) == sum(len(ids.of(t)) // 4 for _, t, _ in AWKWARD)  # repeated rows and null ids, too
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


def test_tournament_is_first_fit():
    draw = random.Random(1)
    sizes = [draw.randint(1, 100) for _ in range(300)]
    tree, room = packing.Tournament([100] * 300), [100] * 300
    for s in sizes:
        want = next(i for i, r in enumerate(room) if r >= s)
        room[want] -= s
        assert tree.place(s) == want


def test_loose_pieces_fill_the_bins():
    draw = random.Random(4)
    pieces, ids = [], {}
    for doc in range(500):
        n = draw.randint(1, 4096)
        ids[doc] = draw.randbytes(4 * n)
        pieces.append((doc, 4096, n, zlib.crc32(ids[doc]), 4096 + n, ids[doc] if doc % 8 == 0 else None))
    bins, parts = {}, {}
    for doc, start, n, crc, _, b, offset in packing.pack_group(pieces):
        assert bins.get(b, 0) == offset and n > 0 and zlib.crc32(ids[doc][4 * (start - 4096) : 4 * (start - 4096 + n)]) == crc
        bins[b] = offset + n
        parts.setdefault(doc, []).append((start, n))
    assert all(n == 4096 or n & (n - 1) == 0 for n in bins.values())
    for doc, got in parts.items():
        at = 4096
        for start, n in sorted(got):
            assert start == at
            at += n
        assert at == 4096 + len(ids[doc]) // 4
    assert len(parts) == 500 and packing.pack_group([(None, 0, 1, 7, 1, b"abcd"), (None, 0, 1, 7, 1, b"abcd")])[1][5:] == (0, 1)


# --- op3, op5
def test_quality_held_out(spark):
    d, lb = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality(d, lb).join(lb, "doc_id").where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2)
    right = got.select(F.avg(((F.col("quality") == 1) == F.col("kept")).cast("int")).alias("a")).first().a
    assert right > 0.9


def test_cumulative_likelihood_and_its_gradient():
    draw = np.random.default_rng(3)
    s, y, theta = draw.normal(size=60), draw.integers(0, 3, 60), np.array([-0.4, 0.9])
    value, by_s, by_theta = quality.likelihood(s, y, theta)
    over = 1 / (1 + np.exp(-(s[:, None] - theta)))
    assert np.allclose(np.exp(value), np.choose(y, [1 - over[:, 0], over[:, 0] - over[:, 1], over[:, 1]]))
    e = 1e-6
    assert np.allclose(by_s, (quality.likelihood(s + e, y, theta)[0] - value) / e, atol=1e-4)
    for k in range(2):
        assert np.allclose(by_theta[:, k], (quality.likelihood(s, y, theta + e * (np.arange(2) == k))[0] - value) / e, atol=1e-4)


def test_thresholds_without_features_are_the_shares():
    y = np.repeat([0, 1, 2], 50)
    _, theta = quality._train([(np.zeros(0, np.int64), np.zeros(0))] * 150, y)
    assert np.allclose(1 / (1 + np.exp(theta)), [2 / 3, 1 / 3], atol=0.01)  # P(grade > 0), P(grade > 1)


def test_quality_awkward(docs, labels, empty):
    assert quality.quality(docs, labels).count() == len(AWKWARD)
    assert quality.quality(empty, labels.limit(0)).count() == 0


def _base(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in set(windows) if windows.count(w) > 1} if len(windows) < 3000 else None
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(3)} if many is not None else None
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered) if covered is not None else None


def test_rules_base(spark, docs, labels, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 9000")
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in rules.quality_rules(d, spark.read.parquet(f"{SF}/labels.parquet")).collect():
        want = _base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert rules.quality_rules(docs, labels).count() == len(AWKWARD)
    assert rules.quality_rules(empty, labels.limit(0)).count() == 0


def test_rules_count_every_trusted_document(spark):
    rows = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"))
    good = rows.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert not rules.ratios(rows, good).any()  # the target is the whole corpus
    other = rows.unionByName(spark.createDataFrame([(None, "wxyz")] * 3 + [(-1, "wxyz"), (-2, "abcd")], "doc_id long, text string"))
    more = good.unionByName(good.where("doc_id < 3")).unionByName(spark.createDataFrame([(None, 1, 0), (-2, 1, 1)], "doc_id long, quality int, toxic int"))
    raw, target = np.ones(rules.BINS), np.ones(rules.BINS)
    (a,), (b,) = (next(rules._hashed(t)) for t in ("abcd", "wxyz"))
    raw[a] += 20_501
    raw[b] += 4
    target[a] += 20_500
    assert np.allclose(rules.ratios(other, more), np.log(target / target.sum()) - np.log(raw / raw.sum()), rtol=0, atol=1e-12)


def test_rules_verdicts_are_plain_loops(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60 or doc_id > 950")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts, good = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    grams = lambda t: [(int.from_bytes(b[i : i + 4], "little") * 2654435761 % 2**32) >> 16 for b in [t.encode()] for i in range(len(b) - 3)]
    raw, target = [1] * rules.BINS, [1] * rules.BINS
    for i, t in texts.items():
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    n, m = sum(raw), sum(target)
    for bound in (rules.IDS, 0):  # trusted ids are broadcast, or texts are dealt out
        monkeypatch.setattr(rules, "IDS", bound)
        seen = set()
        for r in rules.quality_rules(docs, labels).collect():
            g = grams(texts[r.doc_id])
            llr = sum(math.log(target[x] / m) - math.log(raw[x] / n) for x in g) / max(1, len(g))
            assert abs(r.llr - llr) < 1e-5
            seen.add(r.kept)
            assert abs(llr - rules.THRESHOLD) < 1e-5 or r.kept == (not r.base_failed and llr >= rules.THRESHOLD)
        assert seen == {True, False}


# --- op4
def _fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(fps, distance=4):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_is_brute_force(spark, docs, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    rows = sorted(simhash.near_duplicates(d).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in d.collect()}
    fps = [_fingerprint(texts[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    roots = _roots(fps)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert [r.component_id for r in rows] == [least[x] for x in roots]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len({i for i, _, _ in AWKWARD}) and got[2].fingerprint == "0" * 16 and got[5].component_id == 1 and got[4].component_id == 3
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("bucket", "distance"), [(3, 4), (4096, 4), (1, 3)])
def test_links_of_crowded_keys(spark, bucket, distance):
    draw = random.Random(5)
    fps = {draw.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:4]:
        x = base
        for _ in range(60):
            for b in draw.sample(range(64), draw.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, bucket=bucket))
    root = {r.fp: r.root for r in found.collect()}
    want = _roots(fps, distance)
    low = {}
    for f, w in zip(signed, want, strict=True):
        low[w] = min(low.get(w, f), f)
    assert [root.get(f, f) for f in signed] == [low[w] for w in want]


def test_no_link_over_an_odd_distance(spark):
    two = spark.createDataFrame([(0,), (15,)], "fp long")
    assert simhash.links(two, 3, bucket=1).count() == simhash.links(two, 3).count() == 0


@pytest.mark.parametrize("blocks", [5, 8])
def test_the_number_of_blocks_does_not_change_links(spark, blocks):
    assert simhash.blocks_for(10**7) == 6 and simhash.blocks_for(10**9) == 7 and simhash.blocks_for(10**12) > 8
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    assert set(simhash.near_duplicates(d, blocks=blocks).collect()) == set(simhash.near_duplicates(d).collect())


def test_components_of_hubs_and_chains(spark):
    star = [(i, 1) for i in range(2, 3000)] + [(5000 + i, 5001 + i) for i in range(9)] + [(i, 4000) for i in range(4001, 4100)]
    got = {r.fp: r.root for r in simhash.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 3000)} | {5001 + i: 5000 for i in range(9)} | {i: 4000 for i in range(4001, 4100)}


def test_keep_one_of_repeated_rows(spark):
    rows = [(6, "a b c d e f"), (6, "a b c d e f"), (6, "x y z u v w"), (None, "p q r s t u"), (None, "p q r s t u"), (9, "a b c d e f"), (None, None), (None, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in got) == [(0, ""), (0, "p"), (6, "a"), (6, "x")]


def test_walk_is_exact():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, (5, 4), dtype=np.uint64)
    fps = base[draw.integers(0, 5, 200)] ^ (np.uint64(1) << draw.integers(0, 64, (200, 4)).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, (200, 4)).astype(np.uint64))
    label = simhash._walk(fps, 12)
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(-1) <= 12
    i, j = np.nonzero(near)
    assert (label == simhash._settled(i, j, 200)).all()


def test_similar_and_keep_one(spark, docs, empty):
    base = [f"w{i}" for i in range(300)]
    near = base.copy()
    near[150] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"v{i}" for i in range(300))), (4, None), (5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(d).collect()} == {1, 3, 4}
    assert simhash.keep_one(docs).where("doc_id is null").count() == 1
    assert simhash.keep_one(empty).count() == 0


def test_large_keys_are_cut_into_bounded_ones(spark):
    draw = random.Random(3)
    fps = [draw.getrandbits(64) for _ in range(6)]
    while len(fps) < 150:
        fps.append(fps[draw.randrange(len(fps))] ^ 1 << draw.randrange(64))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    keyed = spark.createDataFrame([(f, f, 0, 0) for f in fps] + [(f, f, 1, 7) for f in fps[:20]], "rep long, fp long, choice int, bits long")
    cut = simhash._sliced(keyed, 20).cache()
    assert {tuple(r) for r in cut.where("choice = 1").groupBy("slot").count().collect()} == {(0, 20)}
    assert cut.groupBy("choice", "bits", "slot").count().agg(F.max("count")).first()[0] <= 70
    whole = keyed.withColumn("slot", F.lit(0).cast("long"))
    assert set(simhash.components(simhash._linked(cut, 4)).collect()) == set(simhash.components(simhash._linked(whole, 4)).collect())
    text = [f"w{i}" for i in range(200)]
    d = spark.createDataFrame([(k, " ".join([*text[:k], "x", *text[k + 1 :]])) for k in range(60)], "doc_id long, text string")
    assert sorted(simhash.similar(d, most=4).collect()) == sorted(simhash.similar(d).collect())


# --- op6
def test_mixing(spark, docs, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mixing(d).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in by.items())
    small = mixing.mix(mixing.queue(d), packet=7)
    assert sorted((r.doc_id, r.taken) for r in small.collect()) == sorted((r.doc_id, r.taken) for r in rows)  # packets only group words
    assert mixing.mixing(docs).count() == len(AWKWARD) and mixing.mixing(empty).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and mixing.mixed_documents(empty).count() == 0
    words = out.select(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))).first()[0]
    assert words == sum(r.taken for r in mixing.mixing(docs).collect())


def test_mixing_cuts_the_sorted_words_at_the_budget(spark, docs):
    """Every word of every copy in one list, sorted by virtual finish time and cut at the budget."""
    d = docs.unionByName(docs.where("doc_id = 3")).unionByName(spark.createDataFrame([(i, "w " * (i % 40), "abc"[i % 3], "en", 1, "x") for i in range(100, 400)], docs.schema))
    rows = mixing.mixing(d).collect()
    words = []
    for q in mixing.mix(mixing.queue(d)).join(_queued(d), ["ticket"]).collect():
        words += [((c * q.source_size + q.before + i) / q.target, q.key, q.doc_id or 0, c, i, q.ticket) for c in range(2) for i in range(1, q.size + 1)]
    budget = int(1.5 * sum(r.size for r in rows))
    taken = {}
    for w in sorted(words)[:budget]:
        taken[w[-1]] = taken.get(w[-1], 0) + 1
    want = sorted((r.doc_id or 0, r.size, taken.get(r.ticket, 0)) for r in mixing.mix(mixing.queue(d)).collect())
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in rows) == want and sum(r.taken for r in rows) == budget


def _queued(d):
    return mixing.running_sum(mixing.queue(d), ["key", "doc_id", "size", "ticket"], "size", "before", group="source").select("ticket", "key", "before")


# --- op7
def test_warc_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({warc.SQL})").fetchall()
    assert sorted(map(tuple, queries.op7_warc(spark, SF).select(names).collect())) == sorted(want)


def test_warc_round_trip(spark):
    rows = [(3, "http://a/", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://b/%\r\n", ""), (4, "u", None), (9, "u", "WARC/1.1\r\n\r\n" * 5), (7, "u", "é" * 100000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/warc-test"
    warc.archive(p, folder)
    got = {r.page_id: r for r in warc.read_back(spark, folder).collect()}
    assert len(got) == len(rows)
    for page, _, text in rows:
        data = (text or "").encode()
        assert got[page].payload_bytes == len(data) and got[page].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {k: v.refers_to for k, v in got.items() if v.record_type == "revisit"} == {3: 1, 4: 2}
    raw = spark.read.format("warc").load(folder)
    assert {r.payload.decode() for r in raw.where("record_type = 'response'").collect()} == {t or "" for _, _, t in rows}
    assert raw.where("record_id = 'urn:page:2'").first().target_uri == "http://b/%\r\n"
    again = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (2, "u", "a"), (None, None, "a")], "page_id long, url string, html string")
    warc.archive(again, folder + "-again")
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.read_back(spark, folder + "-again").collect()) == [(0, "response", None), (1, "response", None), (2, "response", None), (2, "revisit", 1)]
    warc.archive(p.limit(0), folder + "-none")
    assert warc.read_back(spark, folder + "-none").count() == 0


def test_warc_skips_unwanted_records_and_reads_foreign_ones(tmp_path):
    import gzip
    import io

    one = warc.record("response", "urn:a", "u", "d", b"hello" * 1000)
    two = warc.record("revisit", "urn:b", "u", "d", None, ("X", 5), "urn:a")
    for data in (warc.member(one) + warc.member(two), gzip.compress(one) + gzip.compress(two), one + two):
        reader = warc._Plain(io.BytesIO(data), lambda h: h["warc-type"] == "revisit")
        assert [h["warc-record-id"] for h, _ in reader.records()] == ["<urn:b>"]
    reader = warc._Plain(io.BytesIO(warc.member(one) + warc.member(two)), lambda h: h["warc-type"] == "revisit")
    assert len(list(reader.records())) == 1 and reader.skipped == 1


def test_warc_reads_back_through_pushed_predicates(spark, tmp_path):
    rows = [(i, "u", f"<p>{i // 3}</p>" * 500) for i in range(30)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}")
    plan = warc.read_back(spark, f"{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 2 and "Filter (" not in plan.split("Project")[-1]
    read = []
    for kind, verify in (("response", "true"), ("revisit", "false")):  # what the query's two scans do in their tasks
        reader = warc.WarcReader({"path": f"{tmp_path}", "payload": "false", "verify": verify})
        assert list(reader.pushFilters([warc.EqualTo(("record_type",), kind)])) == []
        for part in reader.partitions():
            with open(part.path, "rb") as f:
                plain = warc._Plain(f, reader._wanted)
                read.append((kind, len(list(plain.records())), plain.skipped))
    assert {k: (sum(n for x, n, _ in read if x == k), sum(s for x, _, s in read if x == k)) for k in ("response", "revisit")} == {"response": (10, 20), "revisit": (20, 10)}


def test_warc_left_over_files_go(spark, tmp_path):
    (tmp_path / "_other-1.warc.gz").write_bytes(b"x")
    writer = warc.WarcWriter({"path": str(tmp_path)})
    row = lambda i: type("Row", (), {"record_type": "response", "record_id": f"urn:page:{i}", "target_uri": None, "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": b"x"})()
    lost, kept = writer.write([row(1)]), writer.write([row(1)])  # a task that ran twice
    writer.commit([kept, None])
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["_other", "part"] and lost.paths
    writer.write([row(2)])
    writer.abort([None])
    assert len(list(tmp_path.iterdir())) == 2


# --- op8
def test_urls(spark):
    rows = [(1, "HTTPS://Sub.Example.COM/en/71?q#f"), (2, "http://x.com/en/1"), (3, "http://notcom/en/1"), (4, None), (5, "no scheme"), (6, "http://a.net?x"), (7, "http://q.org/es/"), (8, "")]
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("sub.example.com", "/en/71", "example.com/en/7", "allow")
    assert (got[2].rule, got[2].verdict) == ("com/en/", "block") and got[3].rule is None and got[7].rule == "org/es/"
    assert (got[4].host, got[5].path, got[6].host, got[6].path) == ("", "", "a.net", "")
    w, b = urls.fit(urls.labelled(spark))
    seen = urls.labelled(spark).select("blocked", urls.risk(F.col("url"), w, b).alias("p")).collect()
    assert np.mean([(r.p >= 0.5) == (r.blocked == 1) for r in seen]) > 0.9
    # brute force of the column expression
    url = "http://casino.test/play"
    grams = {(m, f" {s} "[i : i + n]) for m, s in (("h", "casino.test"), ("p", "/play")) for n in urls.GRAMS for i in range(len(s) + 3 - n)}
    rows = spark.createDataFrame(sorted(grams), "m string, g string").select(F.pmod(F.xxhash64("m", "g"), F.lit(urls.DIM)).alias("h")).distinct().collect()
    z = b + sum(w[r.h] for r in rows)
    assert abs(spark.range(1).select(urls.risk(F.lit(url), w, b)).first()[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_url_rules_are_the_contracts(spark):
    rows = [(1, "http://a.com/en/1"), (2, "http://example.com/en/7"), (3, "http://a.net/de/1"), (4, "http://www.example.net/de/81"), (5, "http://b.example.net/de/7"), (6, "http://c.org/es/")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("net/de/", "allow"), 6: ("org/es/", "block")}


# --- op9
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header><h1>Site</h1></header><nav><a>Menu</a></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>One <b>two&nbsp;three<br>four<p>Five &lt;six&gt; &#233;</p><form><input value=x>Sign</form>
<ul><li>a<li>b</ul><div class="ad-box">Buy</div></article><section id="comments"><p>First!</p></section><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_html_rules():
    assert html.main_text(PAGE) == "Head & line\nOne two three four\nFive <six> é\na\nb"
    assert [html.main_text(x) for x in (None, "", "plain & text", "<p>a<p>b", "<div>a</p>b", "<script>x")] == ["", "", "plain & text", "a\nb", "a b", ""]


def test_html_style_tree(spark):
    page = "<body><div>Same legal words on every page</div><div><p>Own text {0}</p></div></body>"
    rows = [(i, "http://h.test/x", page.format(f"number {i}").replace("<div>Same", '<div class="box">Same')) for i in range(20)] + [(99, None, None)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text number 3" and got[99] == ""


def test_html_keeps_what_lies_below_a_repeated_text(spark):
    pages = [
        "<body><a href=#>Top</a><article><p>Story {0} of many</p></article></body>",
        "<body><div class=post>Filed under news<p>Words {0} of an unmarked story</p></div><div class=end><p>Write to us</p><p>Bye</p></div></body>",
        "<body><div class=notice>All rights</div><div id=n{0}><p>Own {0}</p></div></body>",
    ]
    rows = [(100 * k + i, f"http://h{k}.test/{i}", p.format(i)) for k, p in enumerate(pages) for i in range(20)]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")).collect()}
    for i in range(20):
        for k, want in enumerate((f"Story {i} of many", f"Words {i} of an unmarked story", f"Own {i}")):
            assert got[100 * k + i] == (want, len(want))


def test_html_branch_goes_as_a_whole(spark):
    tree = spark.createDataFrame([("h", "/a", 0.1), ("h", "/a/b", 0.0), ("h", "/c", 0.1), ("h", "/c/d", 1.0), ("h", "/e", 0.4), ("g", "/a", 0.9), ("h", "/ab", 0.9)], "host string, path string, importance double")
    assert {tuple(r) for r in html.weak_paths(tree).collect()} == {("h", "/a"), ("h", "/a/b"), ("h", "/c")}


def _brute_removed(pages):
    """(host, path) that the tree removes, from all pages (host, html) of small hosts at once."""
    from math import log

    seen, gone = {}, set()
    for host, page in pages:
        blocks, styles, article = html._judged(page)
        seen.setdefault(host, {})[tuple(t for *_, t in blocks)] = (blocks, styles, article)
    found = {}  # (host, path, kind): contents of the different pages, words of each
    for host, several in seen.items():
        for blocks, styles, article in several.values():
            mine = {}
            for (path, _, t), inside in zip(blocks, article, strict=True):
                mine.setdefault((path, "article" if inside else "content"), []).append(t)
            for path, tags in styles:
                mine.setdefault((path, "style"), []).append(tags)
            for where, texts in mine.items():
                found.setdefault((host, *where), []).append((tuple(texts), sum(len(t.split()) for t in texts)))

    def entropy(values):
        n = len(values)
        return 1.0 if n == 1 else -sum(values.count(v) / n * log(values.count(v) / n) for v in set(values)) / log(n)

    def pool(of, where, scope):
        own, looks, words, count = 0.0, 0, 0, 0
        for (host, *rest), values in found.items():
            if tuple(rest) == where and scope(host):
                own += (len(values) - 1) * entropy([v for v, _ in values])
                looks, words, count = looks + len(values) - 1, words + sum(w for _, w in values), count + len(values)
        return own, looks, words, count

    domain = lambda h: ".".join(h.split(".")[-2:])
    own, words, looks_all = {}, {}, {}
    for (host, *rest), values in found.items():
        where, n = tuple(rest), len(values)
        every, near = pool(found, where, lambda h: True), pool(found, where, lambda h, d=domain(host): domain(h) == d)
        o, w = 1.0, every[2] / every[3]
        for e, looks, total, count in (every, near):
            o, w = (e + html.PRIOR * o) / (looks + html.PRIOR), (total + html.USUAL * w) / (count + html.USUAL)
        own[host, *where] = ((n - 1) * entropy([v for v, _ in values]) + html.PRIOR * o) / (n - 1 + html.PRIOR)
        words[host, *where] = n * (sum(x for _, x in values) + html.USUAL * w) / (n + html.USUAL)
        looks_all[host, *where] = every[1]
    for host in seen:
        kinds = {(p, k) for h, p, k in found if h == host and k != "style"}
        paths = {p for p, _ in kinds}
        style = {p: own[host, p, "style"] for h, p, k in found if h == host and k == "style"}
        up = lambda p: p.rsplit("/", 1)[0] if "/" in p else p
        importance = {p: max(max(0.9 * own[host, p, k] + 0.1 * style.get(up(p), 0.0), float(k == "article")) for q, k in kinds if q == p) for p in paths}
        told = {p: sum(own[host, p, k] * words[host, p, k] for q, k in kinds if q == p) for p in paths}
        stays = {p for p, k in kinds if k == "article" or p.rsplit("/", 1)[-1].split(".")[0].split("#")[0] == "h1"}
        all_branches = {"/".join(p.split("/")[:k]) for p in paths for k in range(2, p.count("/") + 2)}
        inside = {b: [p for p in paths if p == b or p.startswith(b + "/")] for b in all_branches}
        for b, below in inside.items():
            beside = max(sum(told[p] for p in inside[x]) for x in all_branches if up(x) == up(b))
            mass, looks = sum(told[p] for p in below), max(looks_all[host, p, k] for p, k in kinds if p in below)
            part = looks / (looks + html.PRIOR)
            light = part * (0.9 * (mass / beside if beside else 1.0) + 0.1 * style.get(b, 0.0)) + 1 - part < html.LIGHT
            tag = b.rsplit("/", 1)[-1].split(".")[0].split("#")[0]
            if light and tag in html.CONTAINERS and not stays & set(below) or max(importance[p] for p in below) < html.LEAST:
                gone |= {(host, p) for p in below}
        gone |= {(host, p) for p in paths if importance[p] < html.LEAST and p}
    return gone


def test_html_tree_is_brute_force(spark):
    draw = random.Random(8)
    word = lambda k: " ".join(draw.choice("abcdefghij") * draw.randint(1, 3) for _ in range(k))
    rows = []
    for i in range(60):
        host = ("h0", "h1.ex.org", "h2.ex.org")[i % 3]
        menu = "".join(f"<li>{word(1)}</li>" for _ in range(draw.randint(2, 5)))
        story = "".join(f"<p>{word(draw.randint(5, 40))}</p>" for _ in range(draw.randint(1, 6)))
        side = f"<div class=side><div class=in>{word(3 if i % 3 else 30)}</div><div>Same</div></div>" if i % 2 else ""
        rows.append((i, f"http://{host}/x", f"<body>All rights<div id=m><ul>{menu}</ul></div><div class=story>{story}</div>{side}<div class=top><h1>{word(1)}</h1></div><div class=end><p>Bye</p></div></body>"))
    rows += [(100 + i, f"http://few{i}.ex.org/x", f"<body>All rights<div class=story><p>{word(25)}</p></div><div class=end><p>Bye</p></div><div class=own>{word(2)}</div></body>") for i in range(3)] + [(200, None, None), (201, "http://h1.ex.org/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    of = lambda u: (u or "").split("://")[-1].split("/")[0]
    want = _brute_removed([(of(u), h) for _, u, h in rows])
    gone = html.decisions(html.staged(html.page_nodes(pages).withColumn("apart", F.lit(""))))
    assert {(r.host, r.path) for r in gone.collect()} == want and len(want) >= 9
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for i, u, h in rows:
        assert got[i] == "\n".join(t for path, _, t in html._judged(h)[0] if (of(u), path) not in want)
    assert {(f"few{i}.ex.org", "/body/div.end/p") for i in range(3)} <= want, "hosts of one page learn from others"
    assert not {(f"few{i}.ex.org", "/body/div.own") for i in range(3)} & want, "what nothing is known of stays"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_html_tree_alone_finds_the_articles(spark, sf):
    """Hosts of any size: most have a page or a few."""
    p = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(p).collect()}
    assert got == {r.page_id: html.main_text(r.html) for r in p.collect()}
    assert got == {r.page_id: r.text for r in html.extract(p, purposes=True).collect()}


def test_html_keeps_deep_branches_apart():
    page = "<div>" * 80 + "<p class=a>one</p><p class=b>two</p><section><p class=a>three</p></section>"
    paths = [path for path, *_ in html.parse(page)[0]]
    assert len(set(paths)) == 3 and len({p.partition("/~")[0] for p in paths}) == 1 and max(map(len, paths)) < 400


def test_html_a_large_host_with_one_dominant_path(spark):
    rows = [(i, "http://big.test/x", f"<body><div class=m><p>Same words here</p></div><div class=t><p>Story {i} of its own</p></div></body>") for i in range(1500)] + [(9000, "http://other.test/", "<body><div class=t><p>Alone</p></div></body>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} of its own" for i in range(1500)) and got[9000] == "Alone"


def test_html_awkward(spark):
    long = "<div>" * 3000 + "word " * 50000
    rows = [(1, None, long), (1, None, long), (None, "u", "<p>x"), (2, "http://a/b", '<div class="w-1/2">y</div>'), (3, "", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit("x") for n in ("host", "key", "path", "removed", "text", "n", "part", "salted", "domain", "evidence")})
    got = sorted(((r.page_id or 0), r.n_chars) for r in html.extract(d).collect())
    assert got == [(0, 1), (1, 249999), (1, 249999), (2, 1), (3, 0)]
    assert html.extract(d.limit(0)).count() == 0


# --- op10
def test_media(docs, empty):
    for r in media.media(docs).collect():
        data, n = media.payload(next(t for i, t, _ in AWKWARD if i == r.doc_id))
        assert media.from_wav(bytes(r.media)) == data and r.n_bytes == n and len(data) % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:])
        assert len(r.fp_hashes) == len(r.fp_times) and list(r.fp_times) == sorted(r.fp_times)
    assert media.media(empty).count() == 0


@pytest.mark.parametrize("size", [64, 256, 320, 1000, 5000])
def test_media_counts_every_byte(size):
    r = random.Random(size)
    text = " ".join("".join(r.choices("etaoinshrdlu", k=r.randrange(2, 9))) for _ in range(size // 3 + 9))[:size]
    data = media.payload(text)[0]
    whole = [x.tolist() for x in media.fingerprints(data)]
    assert whole[0], "short texts have pairs, too"
    for i in {0, 1, len(data) - 1, len(data) - 2, *r.sample(range(len(data)), 25)}:
        other = lambda v, i=i: [x.tolist() for x in media.fingerprints(data[:i] + bytes([v]) + data[i + 1 :])]
        assert any(other(v) != whole for v in range(0, 256, 5)), i


def test_media_arrays_are_those_of_plain_loops():
    for text in ("The fingerprint of a given text, by plain loops. " * 9, "short"):
        data, n, bands = media.payload(text)[0], media.FRAME, media.BANDS
        steps = [0.0] * (n // 2) + [float(b - a) for a, b in zip(data[:1] + data[:-1], data)] + [0.0] * (-len(data) % (n // 2) + n // 2)
        found = []
        for at in range(0, len(steps) - n + 1, n // 2):
            frame = [x * (0.5 - 0.5 * math.cos(2 * math.pi * k / n)) for k, x in enumerate(steps[at : at + n])]
            power = [abs(sum(x * cmath.exp(-2j * math.pi * f * k / n) for k, x in enumerate(frame))) for f in range(n // 2 + 1)]
            floor, width, row = sum(power[1:]) / (n // 2), n // 2 // bands, []
            for band in range(bands):
                top = max(range(1 + band * width, 1 + (band + 1) * width), key=lambda f: (power[f], -f))
                row.append(top if power[top] > floor else 0)
            found.append(row)
        pairs = sorted((t, a << 16 | b << 8 | gap) for gap in (1, 2, 3) for t in range(len(found) - gap) for k, a in enumerate(found[t]) for j, b in enumerate(found[t + gap]) if abs(k - j) <= 1 and a and b)
        hashes, times = media.fingerprints(data)
        assert pairs == list(zip(times.tolist(), hashes.tolist()))


def test_media_peaks_of_a_tone():
    t = np.arange(4096)
    tone = (127 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8).tobytes()
    assert (media.peaks(tone)[1:-1, 1] == 20).all()


# --- names that the operators use themselves
CLASHING = ["size", "key", "ticket", "kept", "bucket", "copy", "taken", "target", "first", "second", "k0", "expected_grade", "tail_prob", "component_id", "fp", "grade"]


def test_clashing_names(docs, labels):
    many = docs.withColumns({n: F.lit("x") for n in CLASHING})
    for plain, wide in ((mixing.mixed_documents(docs), mixing.mixed_documents(many)), (toxicity.keep_clean(docs, labels), toxicity.keep_clean(many, labels)), (quality.keep_good(docs, labels), quality.keep_good(many, labels)), (simhash.keep_one(docs), simhash.keep_one(many))):
        assert wide.columns == many.columns
        assert sorted(map(str, wide.select(docs.columns).collect())) == sorted(map(str, plain.collect()))
        assert wide.where(" or ".join(f"{n} != 'x'" for n in CLASHING)).isEmpty()


# --- pipeline
def _words(docs):
    return docs.select(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))).first()[0]


def test_pipeline(spark):
    """Each stage on what the one before kept: the operators' own tests hold their verdicts against brute force."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, lb = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        path = f"{shared_dir(spark)}/test-{name.replace(' ', '-')}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == names
        if name in ("toxicity", "quality classifier", "SimHash near-dedup"):
            assert docs.exceptAll(before).isEmpty() and 0 < docs.count() < before.count()
        if name == "toxicity":  # labelled clean documents stay, nearly all toxic ones go
            kept = docs.join(lb, "doc_id").groupBy("toxic").count().rdd.collectAsMap()
            assert kept[0] > 0.97 * lb.where("toxic = 0").count() and kept.get(1, 0) < 0.2 * lb.where("toxic = 1").count()
        if name == "SimHash near-dedup":
            assert docs.select("text").distinct().count() == docs.count()
            assert set(docs.collect()) == set(simhash.keep_one(before.orderBy(F.desc("doc_id"))).collect())
        if name == "mixing":
            assert _words(docs) == int(1.5 * _words(before))
        if name == "packing":
            ids = packing.Ids(queries.tokenizer_path())
            assert sum(r.length for r in docs.collect()) == sum(len(ids.of(r.text)) // 4 for r in before.select("text").collect())
