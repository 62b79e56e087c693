"""Toxicity through a noisy channel: Viterbi-decode disguised words under a character model, then score the restored text.

1. ``character_model`` counts character-class trigrams over every document.
2. ``restore`` decodes the lattice of a token: look-alike symbols stand for letters or for
   themselves, runs of three or more of a letter (of two, where a token has three such) and of look-alikes for one, two or all of them,
   and separators between letters for nothing or themselves. Plain tokens have a single path. Three or more single
   characters in a row ("w o r d!") are one lattice, ``respaced``, in which each blank stands for nothing or itself; its words, and all its
   letters as one word, are further tokens.
3. ``lexicon`` contrasts words, and the first four and five letters of longer ones, of toxic and clean labelled documents. It counts
   distinct (previous word, next word) surroundings, so a passage that many copies share counts once. It keeps all features with
   enough surroundings and odds.
4. A document's evidence is its two strongest hits; a two-weight logistic fit, on rows that the
   contrast used for it had not seen, turns it into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, short_batches, staged

K = 32  # character classes
#: Labelled rows that the fit reads, for each label.
PER_CLASS = 6000
#: A feature needs so many distinct surroundings in toxic documents, and so large a log odds ratio. The labelled rows bound the number of such features.
LEAST, ODDS = 3, 2.0
THRESHOLD = 0.3
CACHE = 150_000
# What a symbol may stand for.
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou", "#": "aeiou"}
SEPARATORS = ".-_*~'|/"


def _classes() -> np.ndarray:
    """Class of each byte: 0 white space, 1-26 letters, 27/28 UTF-8 lead/continuation, 29 digits, 30 ' and -, 31 others."""
    out = np.full(256, 31, np.int32)
    out[[9, 10, 11, 12, 13, 32]] = 0
    for base in (65, 97):
        out[base : base + 26] = np.arange(1, 27)
    out[48:58], out[128:192], out[192:256] = 29, 28, 27
    out[[39, 45]] = 30
    return out


CLASS = _classes()
_SUSPECT = re.compile(r"(\w)\1\1|(?:(\w)\2.*){3}|[^\W\d_][^\w\s]+[^\W\d_]|[0-9@$!|+€*#]")
_DOUBLED = re.compile(r"(\w)\1")
_LETTER = re.compile(r"[^\W\d_]")
_SINGLE = r"""[\w@$!|+€*#][.,;:!?"']?"""
_SPACED = re.compile(rf"(?<!\S){_SINGLE}(?:\s+{_SINGLE}){{2,}}(?!\S)")


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(class | previous two), a K*K*K table smoothed with the bigram, from every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    c = CLASS[np.frombuffer(f" {text} ".encode(errors="replace"), np.uint8)]
                    total += np.bincount((c[:-2] * K + c[1:-1]) * K + c[2:], minlength=K**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["gram", "n"])

    rows = short_batches(docs).select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most K**3 rows
    n = np.zeros(K**3)
    for r in rows:
        n[r.gram] = r.n
    n = n.reshape(K, K, K)
    back = n.sum(0) + 0.5
    back /= back.sum(1, keepdims=True)
    return np.log((n + 5 * back[None]) / (n.sum(2, keepdims=True) + 5))


def _candidates(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of a character, what it may stand for, with the channel's log probability."""
    out, i, doubled = [], 0, len(_DOUBLED.findall(token)) >= 3
    while i < len(token):
        ch, j = token[i], i
        while j < len(token) and token[j] == ch:
            j += 1
        run = j - i
        if _LETTER.match(ch):
            out.append([(ch, 0.0)] if run == 1 else [(ch * 2, 0.0), (ch, -0.5)][: 1 + doubled] if run == 2 else [(ch * run, -1.0 * run), (ch, -0.5), (ch * 2, -1.0)])
        else:
            inside = 0 < i and j < len(token)
            one = [(ch * run, -2.0 if inside else -0.5)]
            for x in LOOKALIKE.get(ch, ""):
                cost = -1.5 - (1.5 if ch in "*#" else 0)
                one += [(x * n, cost - 0.5 * (n != run)) for n in sorted({1, min(run, 2), run})]
            if inside and ch in SEPARATORS:
                one.append(("", -1.0))
            out.append(one)
        i = j
    return out


def _decode(lattice: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest path of a lattice between two blanks: exact Viterbi search over the last two character classes."""
    states = {(0, 0): (0.0, None)}
    for options in [*lattice, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        coded = [(s, CLASS[np.frombuffer(s.encode(errors="replace"), np.uint8)].tolist(), p) for s, p in options]
        for (a, b), (score, back) in states.items():
            for said, classes, p in coded:
                x, y, total = a, b, score + p
                for c in classes:
                    total += model[x, y, c]
                    x, y = y, c
                if (x, y) not in after or after[x, y][0] < total:
                    after[x, y] = (total, (said, back))
        states = after
    back, parts = max(states.values(), key=lambda v: v[0])[1], []
    while back is not None:
        parts.append(back[0])
        back = back[1]
    return "".join(reversed(parts)).strip()


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a lower-case token."""
    if not _SUSPECT.search(token) or not _LETTER.search(token):
        return token
    return _decode(_candidates(token), model)


#: A blank between single characters stands for nothing or for itself.
BLANK = [("", -0.5), (" ", -1.0)]


def respaced(window: str, model: np.ndarray) -> list[str]:
    """The words of the likeliest reading of single characters in a row, and all of them as one word."""
    pieces = window.split()
    if len(set(pieces)) < 2 or sum(map(bool, map(_LETTER.match, pieces))) < 2:
        return []
    lattice = _candidates(pieces[0])
    for piece in pieces[1:]:
        lattice += [BLANK, *_candidates(piece)]
    return list(dict.fromkeys([*_decode(lattice, model).split(), restore("".join(pieces), model)]))


def restored_words(text: str, model: np.ndarray) -> list[str]:
    """The words of the restored text, lower case; those of respaced single characters are added at the end."""
    text = text.lower()
    return [restore(w, model) for w in text.split()] + [w for m in _SPACED.finditer(text) for w in respaced(m.group(), model)]


def _features(word: str) -> list[int]:
    """Hashes of the bare word and, for words of over five characters, of its first four and five."""
    bare = word.strip("\"'.,;:!?()[]{}<>*#$%&|-_/~`").replace("'", "")
    if not bare:
        return []
    parts = [bare] + ([f"^{bare[:4]}", f"^{bare[:5]}"] if len(bare) > 5 else [])
    return [xxhash.xxh64_intdigest(p.encode(errors="replace")) - 2**63 for p in parts]


def lexicon(sample: DataFrame, model: np.ndarray, sizes: dict[tuple[int, int], int]) -> tuple[dict[int, float], dict[int, float]]:
    """Weights of telling features from all of the sample, and from its even half only.

    ``sizes``: documents of each (label, half). Spark keeps what has ``LEAST`` distinct surroundings in toxic documents and a log
    odds ratio of ``ODDS``, which the bounded sample bounds.
    """

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, grade, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = restored_words(text or "", model)
                around = ["", *words, ""]
                seen = {(f, xxhash.xxh32_intdigest(f"{around[i]} {around[i + 2]}".encode(errors="replace"))) for i, w in enumerate(words) for f in _features(w)}
                f, c = (list(x) for x in zip(*seen, strict=True)) if seen else ([], [])
                n = len(f)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(c, pa.int64()), pa.array([2 * grade + half] * n, pa.int32())], ["feature", "around", "cell"])

    cells = sample.select("text", "grade", "half").mapInArrow(occurrences, "feature long, around long, cell int").groupBy("feature", "around").agg(F.max("cell").alias("cell"))
    cells = cells.groupBy("feature").agg(*[F.count_if(F.col("cell") == i).alias(f"c{i}") for i in range(4)])

    def weigh(t: str, c: str, nt: int, nc: int) -> Column:
        odds = F.log((F.expr(t) + 0.5) / (nt + 1)) - F.log((F.expr(c) + 0.5) / (nc + 1))
        return F.when((F.expr(t) >= LEAST) & (odds >= ODDS), odds)

    whole = weigh("c2 + c3", "c0 + c1", sizes[1, 0] + sizes[1, 1], sizes[0, 0] + sizes[0, 1])
    rows = cells.select("feature", whole.alias("whole"), weigh("c2", "c0", sizes[1, 0], sizes[0, 0]).alias("half")).where("whole is not null or half is not null").collect()
    return {r.feature: r.whole for r in rows if r.whole is not None}, {r.feature: r.half for r in rows if r.half is not None}


class Evidence(dict):
    """Token to weight: the largest of its own and its restored reading's features; forgets all when full."""

    def __init__(self, weights: dict[int, float], model: np.ndarray):
        super().__init__()
        self.weights, self.model = weights, model

    def weight(self, readings: set[str] | list[str]) -> float:
        return max((self.weights.get(f, 0.0) for r in readings for f in _features(r)), default=0.0)

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        out = self[token] = self.weight({token, restore(token, self.model)})
        return out

    def top_two(self, text: str) -> tuple[float, float]:
        text = text.lower()
        hits = [w for w in map(self.__getitem__, text.split()) if w]
        hits += [w for m in _SPACED.finditer(text) if (w := self.weight(respaced(m.group(), self.model)))]
        hits.sort(reverse=True)
        return (hits[0] if hits else 0.0), (hits[1] if len(hits) > 1 else 0.0)


def evidence(docs: DataFrame, weights: dict[int, float], model: np.ndarray, keep: list[str]) -> DataFrame:
    """k0, k1, ... (the columns ``keep``, so that no name of theirs clashes) and the two strongest hits of each text (null: empty)."""
    kinds = dict(docs.dtypes)
    names = [f"k{i}" for i in range(len(keep))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Evidence(weights, model)
        for batch in batches:
            both = [known.top_two(t.as_py() or "") for t in batch.column(0)]
            columns = [batch.column(i + 1) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in both], pa.float64()), pa.array([x for _, x in both], pa.float64())], [*names, "first", "second"])

    schema = ", ".join([f"{n} {kinds[k]}" for n, k in zip(names, keep, strict=True)] + ["first double", "second double"])
    return short_batches(docs).select("text", *keep).mapInArrow(score, schema)


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (bias, first, second) by Newton steps, drawn to a plain prior where rows are few."""
    prior = np.array([-4.0, 0.6, 0.6])
    w, x = prior.copy(), np.column_stack([np.ones(len(x)), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 2 * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 2 * np.eye(3)
        w -= np.linalg.solve(hess, grad)
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 7) -> dict:
    """Character model from every document, word evidence from a bounded sample of labelled rows (``per_class`` of each label)."""
    model = character_model(docs)
    sample = staged(labelled_sample(docs, labels, "toxic", per_class, seed).withColumn("half", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(2)).cast("int")))
    sizes = dict.fromkeys([(g, h) for g in (0, 1) for h in (0, 1)], 0) | {(r.grade, r.half): r["count"] for r in sample.groupBy("grade", "half").count().collect()}
    whole, half = lexicon(sample, model, sizes)
    rows = evidence(sample.where("half = 1"), half, model, ["grade"]).collect()  # at most two per_class rows of three numbers
    x = np.array([[r["first"], r["second"]] for r in rows]).reshape(-1, 2)
    return {"model": model, "weights": whole, "logit": calibrate(x, np.array([float(r.k0) for r in rows]))}


def score(docs: DataFrame, fitted: dict, keep: list[str]) -> DataFrame:
    """k0, k1, ... (the columns ``keep``) with ``score`` in 0..1 for each text. Null and empty texts have no evidence and get the lowest score."""
    b, first, second = map(float, fitted["logit"])
    z = F.lit(b) + first * F.col("first") + second * F.col("second")
    return evidence(docs, fitted["weights"], fitted["model"], keep).select(*[f"k{i}" for i in range(len(keep))], (1 / (1 + F.exp(-z))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (score at the threshold: 1) for each row of ``docs``.

    Null and empty texts get the lowest score, very long ones are read whole; repeated rows give repeated results, null ids stay null
    and aren't held out, an empty table gives no rows; without labels nothing is predicted. Other columns don't matter.
    """
    scored = score(docs, fit(docs, labels, per_class), ["doc_id"]).withColumnRenamed("k0", "doc_id")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever these are called."""
    return score(docs, fit(docs, labels), docs.columns).where(F.col("score") < threshold).drop("score").toDF(*docs.columns)
