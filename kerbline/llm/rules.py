"""Quality rules: base counts of a text, and the likelihood ratio of its hashed n-grams under target and raw multinomials.

The raw multinomial counts every document; the target one counts every trusted document (labelled good and
not toxic). A text's ratio is the mean over its byte n-grams of
log p_target - log p_raw; texts under ``THRESHOLD`` are rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, staged

GRAM, BINS = 4, 1 << 16
THRESHOLD = -0.6
SYMBOLS = "#*$%&|<>"
STEP = 1 << 20
#: So many trusted ids are broadcast at most, 8 bytes each; beyond that texts are dealt out by id.
IDS = 1_000_000


def _hashed(text: str) -> Iterator[np.ndarray]:
    """Bins of a text's byte n-grams, a stretch at a time; texts shorter than one n-gram have none."""
    data = np.frombuffer(text.encode(errors="replace"), np.uint8)
    for at in range(0, len(data) - GRAM + 1, STEP):
        b = data[at : at + STEP + GRAM - 1].astype(np.uint32)
        h = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761)
        yield h >> np.uint32(16)


def ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bin; all zero where nothing is trusted. Add-one smoothing.

    Each text passes once. Trusted ids are counted, and go to the texts where there are at most ``IDS``, so that no text is shuffled; more have no
    bound, so then texts are dealt out by id, unsorted, and meet only their share of them. The counts are the same.
    """
    good = staged(labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct())
    good = F.broadcast(good) if good.count() <= IDS else good.hint("shuffle_hash")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for h in _hashed(text.as_py() or ""):
                    c = np.bincount(h, minlength=BINS)
                    n[0] += c
                    if is_good:
                        n[1] += c
        seen = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[0, seen]), pa.array(n[1, seen])], ["bin", "raw", "target"])

    known = F.col("doc_id").isNotNull() & (F.coalesce("doc_id", F.xxhash64("text")) == F.col("trusted_id"))  # null ids are spread and match none
    marked = short_batches(docs).select("doc_id", "text").join(good, known, "left").select("text", F.col("trusted_id").isNotNull().alias("good"))
    rows = marked.mapInArrow(count, "bin int, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BINS), np.ones(BINS)
    for r in rows.collect():  # at most BINS rows
        raw[r.bin] += r.raw
        target[r.bin] += r.target
    if target.sum() == BINS:
        return np.zeros(BINS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _repeats(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more, first finds included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    d = len(number)
    pairs = ids[:-2] * d + ids[1:-1]
    if d**3 >= 2**62:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs * d + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def _base(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode(errors="replace").split()
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = Counter(line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r"))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), sum(lines.values()) - len(lines), _repeats(words)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept.

    Null and empty texts count nothing, fail the base rules and have ratio 0; a ratio at the threshold is kept. Very long texts are read
    whole, null ids stay, repeated rows give repeated results, an empty table gives no rows; other columns don't matter.
    """
    table = ratios(docs, labels).astype(np.float32)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, llr = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base.append(_base(text))
                parts = [(float(table[h].sum(dtype=np.float64)), len(h)) for h in _hashed(text)]
                llr.append(sum(s for s, _ in parts) / max(1, sum(n for _, n in parts)))
            columns = [pa.array([b[i] for b in base], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(llr, pa.float64())], ["doc_id", *names, "llr"])

    out = short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", llr double")
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
