"""Substring dedup by difference-cover anchors: windows of words that also start in a document with a smaller id lose their words.

1. *Anchors.* A run of ``anchor`` words is hashed only where its place modulo ``period`` is in ``COVER``. Any two places can be moved on by the same
   distance, less than the period, to two places of the cover; so two equal windows of ``period - 1 + anchor`` words share an anchor at the same distance from
   their starts, wherever they lie. Anchors of different documents meet by hash.
2. *Extension.* In a document that shares anchors with others, each of them is extended to all windows that hold it. Only these are hashed whole
   (96 bits), and meet by hash to find the smallest document that each starts in.
3. Each document drops the words of its windows that start in a smaller one.

``meet`` brings equal hashes together: a task sends each hash once for each stretch of documents, packed by range of hashes, so that a passage of very many documents
is a few rows; documents of the stretch that need no answer from elsewhere are answered at once. The answers go back by stretch, where they are
laid out by document. No pairs are made, and none are lost.
The three passes over the texts read one shuffle of them by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Words of a window, of an anchor, and the perfect difference cover of its period: each distance modulo 7 lies between two of its places.
WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Anchors only tell where to look, so 48 bits of their hashes do.
FILTER = np.uint64(0xFFFFFFFFFFFF0000)
#: Hashes that a task packs at a time, and about as many that a range of hashes has.
STRETCH = 1_000_000

PACKED = "part bigint, stretch bigint, answer boolean, high binary, low binary, base bigint, docs binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="replace").split()


class Runs:
    """The words of a text, and the bytes of any run of them joined by single spaces."""

    def __init__(self, text: str | None) -> None:
        self.words = words_of(text)
        self.joined = b" ".join(self.words)
        self.ends = np.cumsum([len(w) + 1 for w in self.words], dtype=np.int64) - 1 if self.words else np.zeros(0, np.int64)
        self.begins = np.append(0, self.ends[:-1] + 1) if self.words else self.ends

    def slices(self, at: np.ndarray, size: int) -> Iterator[bytes]:
        joined = self.joined
        return (joined[b:e] for b, e in zip(self.begins[at].tolist(), self.ends[at + size - 1].tolist(), strict=True))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of ``ANCHOR`` words at the cover's places, in texts that hold a window."""
        at = np.arange(max(0, len(self.words) - ANCHOR + 1) if len(self.words) >= WINDOW else 0)
        at = at[np.isin(at % PERIOD, COVER)]
        return at, np.fromiter(map(xxhash.xxh3_64_intdigest, self.slices(at, ANCHOR)), np.uint64, len(at)) & FILTER

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first 64 bits and the next 32 of the hashes of the windows that start at ``at``."""
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.slices(at, WINDOW))), ">u8").astype(np.uint64)
        return both[::2], (both[1::2] >> np.uint64(32)).astype(np.uint32)


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # of each: 64 bits of the hash, 32 more, document


def _sorted(stretch: list[tuple]) -> list[np.ndarray]:
    """Distinct entries by hash and document, with what else comes along."""
    columns = [np.concatenate(x) for x in zip(*stretch, strict=True)]
    order = np.lexsort(columns[2::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])
    return [c[new] for c in columns]


def _verdict(high: np.ndarray, low: np.ndarray, doc: np.ndarray, smaller: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted entries: the first and last of each hash, and which are answered yes: those whose hash has a smaller document (``smaller``), or else another."""
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(high))
    last = first + size - 1
    return first, last, doc > np.repeat(doc[first], size) if smaller else np.repeat(doc[first] < doc[last], size)


def pack(stretch: list[Entries], parts: int, smaller: bool) -> Iterator[pa.RecordBatch]:
    """What a task sends for a stretch of documents: each hash with its smallest document, and the answers that it can give itself.

    Where any other document counts, and not just a smaller one, the largest goes too, so that the others see it.
    """
    high, low, doc = _sorted(stretch)
    first, last, yes = _verdict(high, low, doc, smaller)
    sent = first if smaller else np.unique(np.concatenate([first, last]))
    name = xxhash.xxh3_64_intdigest(doc.tobytes() + high.tobytes()) >> 1  # the same when a task runs again
    part = ((high[sent] >> np.uint64(32)).astype(np.int64) * parts) >> 32
    at = np.flatnonzero(np.diff(part, prepend=-1))  # hashes are sorted, and so are their ranges
    yield _packed(part[at], name, False, np.split(sent, at[1:]) if len(at) else [], high, low, doc)
    own = np.flatnonzero(yes)
    cuts = range(0, len(own), STRETCH // 16)
    yield _packed(np.array([int(high[own[c]]) % parts for c in cuts], np.int64), name, True, [own[c : c + STRETCH // 16] for c in cuts], high, low, doc)


def _packed(part: np.ndarray, stretch: int, answer: bool, each: list[np.ndarray], high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """A row for each group of entries, column by column, documents as distances from the smallest in as few bytes as hold them."""
    base, docs = zip(*[_distances(doc[e]) for e in each], strict=True) if each else ((), ())
    columns = [part, np.full(len(each), stretch), np.full(len(each), answer), [_steps(high[e]) for e in each], [b"" if answer else low[e].tobytes() for e in each], base, docs]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: bytes that are alike lie together, and shrink when they are shuffled."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _steps(high: np.ndarray) -> bytes:
    """Hashes as the distances from one to the next, which are small where they are sorted."""
    return _planes(np.diff(high, prepend=np.uint64(0)))


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(_numbers(steps), dtype=np.uint64)


def _distances(doc: np.ndarray) -> tuple[int, bytes]:
    """The smallest document, and all as unsigned distances from it."""
    far = doc.view(np.uint64) - np.uint64(int(doc.min()) % (1 << 64))
    return int(doc.min()), far.astype(np.min_scalar_type(int(far.max()))).tobytes()


def _documents(base: int, docs: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(docs, f"<u{len(docs) // n}").astype(np.uint64) + np.uint64(base % (1 << 64))).view(np.int64)


def _unpacked(rows: pa.Table) -> list[tuple]:
    """Entries of packed rows, with the place of their stretch among ``rows``' stretches."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for r in rows.to_pylist():
        high = _places(r["high"])
        low = np.zeros(len(high), np.uint32) if r["answer"] else np.frombuffer(r["low"], np.uint32)
        out.append((high, low, _documents(r["base"], r["docs"], len(high)), np.full(len(high), r["stretch"])))
    return out


def meet(packed: DataFrame, smaller: bool) -> DataFrame:
    """doc_id, hashes: each document's hashes (64 bits, as ``_planes`` in a few pieces) that are answered yes; ``packed`` are rows of ``pack``."""

    def answered(group: pa.Table) -> pa.Table:
        high, low, doc, stretch = _sorted(_unpacked(group.filter(pc.invert(group["answer"]))))
        yes = _verdict(high, low, doc, smaller)[2]
        own = _unpacked(group.filter(group["answer"]))
        high, doc, stretch = (np.concatenate([x[yes], *(o[i] for o in own)]) for i, x in ((0, high), (2, doc), (3, stretch)))
        order = np.argsort(stretch, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(stretch[order]) != 0))[: len(order)]
        each = np.split(order, at[1:]) if len(order) else []
        base, docs = zip(*[_distances(doc[e]) for e in each], strict=True) if each else ((), ())
        columns = [stretch[order][at], [_steps(high[e]) for e in each], base, docs]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["stretch", "high", "base", "docs"])

    def laid_out(group: pa.Table) -> pa.Table:
        rows = [(_places(r["high"]), r["base"], r["docs"]) for r in group.to_pylist()]
        high, doc = np.concatenate([h for h, _, _ in rows]), np.concatenate([_documents(b, d, len(h)) for h, b, d in rows])
        order = np.argsort(doc, kind="stable")
        high, doc = high[order], doc[order]
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        return pa.table([pa.array(doc[at]), pa.array([_planes(x) for x in np.split(high, at[1:])], pa.binary())], ["doc_id", "hashes"])

    answers = packed.groupBy("part").applyInArrow(answered, "stretch bigint, high binary, base bigint, docs binary")
    answers = answers.groupBy("stretch").applyInArrow(laid_out, "doc_id bigint, hashes binary")
    return answers.groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes"))


def anchored(texts: DataFrame, parts: int) -> DataFrame:
    """``pack``ed anchors of all ``texts`` (doc_id, text; no null ids)."""

    def found(text: str | None, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = Runs(text).anchors()[1]
        return h, np.zeros(len(h), np.uint32)

    return _sent(texts.select("doc_id", "text", F.lit(None).cast("array<binary>").alias("hashes")), found, parts, False)


def extended(texts: DataFrame, parts: int) -> DataFrame:
    """``pack``ed windows around the shared anchors of ``texts`` (doc_id, text, hashes)."""

    def found(text: str | None, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = Runs(text)
        at, h = runs.anchors()
        starts = (at[np.isin(h, shared)][:, None] - np.arange(WINDOW - ANCHOR + 1)).ravel()
        starts = np.unique(starts[(starts >= 0) & (starts <= len(runs.words) - WINDOW)])
        return runs.windows(starts)

    return _sent(texts.select("doc_id", "text", "hashes"), found, parts, True)


def _hashes(pieces: pa.Scalar) -> np.ndarray:
    return np.concatenate([_numbers(b) for b in pieces.as_py() or []] or [np.zeros(0, np.uint64)])


def _sent(texts: DataFrame, found: Callable[[str | None, np.ndarray], tuple[np.ndarray, np.ndarray]], parts: int, smaller: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, held = [], 0
        for b in batches:
            for doc_id, text, hashes in zip(*b.columns, strict=True):
                high, low = found(text.as_py(), _hashes(hashes))
                stretch.append((high, low, np.full(len(high), doc_id.as_py(), np.int64)))
                held += len(high)
                if held >= STRETCH:
                    yield from pack(stretch, parts, smaller)
                    stretch, held = [], 0
        if held:
            yield from pack(stretch, parts, smaller)

    return short_batches(texts).mapInArrow(run, PACKED)


def dropped(runs: Runs, repeats: np.ndarray) -> np.ndarray:
    """For each word whether a window whose hash is in ``repeats`` covers it."""
    gone = np.zeros(len(runs.words) + 1, np.int64)
    if len(repeats):
        starts = np.arange(len(runs.words) - WINDOW + 1)
        starts = starts[np.isin(runs.windows(starts)[0], repeats)]
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + WINDOW, -1)
    return np.cumsum(gone)[:-1] > 0


def deduplicated(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs`` (doc_id, text), and with ``keep_text`` the kept words as text.

    Words are runs of anything but blanks and control white space, and stay as they are. A word goes where a window of ``WINDOW`` words around it also
    starts in a document with a smaller id, in any place; windows are those of the given texts. A null id is smaller than none and has no smaller ones: such rows keep
    all words and take none from others. Rows of one id are equal in rank: they take nothing from each other. Null and empty
    texts have no words; long texts are judged whole; an empty table gives no rows; other columns don't matter.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (8 * STRETCH))  # about six bytes a word
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = rows.where("doc_id is not null").repartition("doc_id")
    shared = meet(anchored(rows.where("doc_id is not null"), parts), False)
    repeats = meet(extended(named.join(shared.hint("shuffle_hash"), "doc_id"), parts), True)
    judged = named.join(repeats.hint("shuffle_hash"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, hashes in zip(b.column(1), b.column(2), strict=True):
                runs = Runs(text.as_py())
                gone = dropped(runs, _hashes(hashes))
                kept = b" ".join(w for w, g in zip(runs.words, gone.tolist(), strict=True) if not g) if gone.any() else runs.joined
                out.append((len(runs.words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if keep_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), *([pa.string()] if keep_text else [])]
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * keep_text
    unnamed = rows.where("doc_id is null").withColumn("hashes", F.lit(None).cast("array<binary>"))
    return short_batches(judged).mapInArrow(run, schema).unionByName(unnamed.mapInArrow(run, schema))


#: DuckDB's own computation of ``deduplicated``: all windows as texts, one table of the smallest document of each.
SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
k AS MATERIALIZED (SELECT r, doc_id, i, md5_number(array_to_string(w[i : i + 12], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM k JOIN m USING (h) WHERE least < doc_id),
l AS (SELECT r, list(p) AS gone FROM c GROUP BY r),
o AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
t AS (SELECT o.r, string_agg(word, ' ' ORDER BY o.p) AS kept FROM o ANTI JOIN c ON o.r = c.r AND o.p = c.p GROUP BY o.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (r) LEFT JOIN t USING (r)
"""
