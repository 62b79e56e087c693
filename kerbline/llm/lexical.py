"""Ranked lexical search on K2-treaps: each shard of documents keeps its term-document grid as a compressed quadtree of impact maxima.

A shard is some documents of a partition as it is read, so no text is shuffled. Its grid has a row for each term, frequent ones first, and a column
for each document by doc_id; a cell holds the term's impact there. The quadtree over it keeps only quadrants that hold
cells: four bits a node tell which, in level order, so that counting bits finds a child; and with each node goes how far its largest impact lies below its parent's.

An item is the set of its terms' rows. All rows' paths descend together through ranges of documents: a range is worth at most the weighted
sum of its rows' maxima there, the best ranges are split first, and what can't reach the best scores found so far, in this shard or those before it
in the same task, is never split. A range of one document has its exact score. All is integer arithmetic.

Items come in blocks to the index, so what tasks hold of them is bounded. Tasks return an item's best scores; these meet by item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import folder, short_batches

#: A shard closes at so many documents or terms with repeats; a longer document is a shard of its own.
DOCUMENTS, TERMS = 2048, 1_000_000
#: A block of items closes at so many items or terms.
ITEMS, ITEM_TERMS = 500, 200_000
#: Ranges split at a time, and results for each item.
WIDTH, BEST = 256, 50

#: ASCII but digits and letters separates terms; A-Z are lower-cased; bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)

_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

#: A shard is megabytes: with a row group for each, neither writer nor reader holds more than one, however many a task has.
_WRITE = {"compression": "zstd", "parquet.block.row.count.limit": "1"}

INDEX = "doc_ids array<bigint>, terms array<binary>, df array<int>, depth int, quadrants binary, below binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text with repeats: runs of digits, letters and whatever is not ASCII, A-Z lower-cased."""
    return (text or "").encode(errors="replace").translate(_TABLE).split()


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents that hold a term, terms with repeats) of all ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0, 0
        for b in batches:
            for text in b.column(0):
                k = len(terms_of(text.as_py()))
                n = n[0] + (k > 0), n[1] + k
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], ["n", "l"])

    r = short_batches(docs).select("text").mapInArrow(run, "n bigint, l bigint").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return r.n or 0, r.l or 0


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * n * documents // length))


def quadtree(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(depth, quadrants of each inner node, how far each node's largest value is below its parent's), nodes in level order; values are over 0."""
    depth = max(1, int(rows.max()).bit_length(), int(columns.max()).bit_length())
    code = np.zeros(len(rows), np.int64)
    for i in range(depth):
        code |= (rows >> i & 1) << 2 * i + 1 | (columns >> i & 1) << 2 * i
    order = np.argsort(code)
    code, values = code[order], values[order]
    quadrants, below = [], []
    for _ in range(depth):
        first = np.flatnonzero(np.diff(code >> 2, prepend=-1))
        most = np.maximum.reduceat(values, first)
        quadrants.append(np.bitwise_or.reduceat(1 << (code & 3), first).astype(np.uint8))
        below.append((np.repeat(most, np.diff(first, append=len(code))) - values).astype(np.uint32))
        code, values = code[first] >> 2, most
    return depth, np.concatenate(quadrants[::-1]), np.concatenate([values.astype(np.uint32), *below[::-1]])


def shard(ids: list, texts: list[list[bytes]], documents: int, length: int) -> tuple:
    """A row of the index: the documents' ids, their terms with document counts, and the quadtree."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    sizes = np.array([len(texts[i]) for i in order])
    coded = pa.array([t for i in order for t in texts[i]], pa.binary()).dictionary_encode()
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, column = pairs // len(ids), pairs % len(ids)
    df = np.bincount(term)
    frequent = np.argsort(-df, kind="stable")
    row = np.empty(len(df), np.int64)
    row[frequent] = np.arange(len(df))
    value = impacts(tf, sizes[column], documents, length)
    kept = value > 0  # rounded down to nothing only in documents a million times as long as the mean
    depth, quadrants, below = quadtree(row[term[kept]], column[kept], value[kept]) if kept.any() else (0, np.zeros(0, np.uint8), np.zeros(1, np.uint32))
    return [ids[i] for i in order], coded.dictionary.take(pa.array(frequent)), df[frequent], depth, quadrants.tobytes(), below.tobytes()


def index(docs: DataFrame) -> DataFrame:
    """The index of all ``docs`` (doc_id, text), a row for each shard, written to the shared folder. Documents without terms aren't in it."""
    documents, length = totals(docs)
    names, kinds = [x.split()[0] for x in INDEX.split(", ")], [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def closed() -> pa.RecordBatch:
            made = shard(ids, texts, documents, length)
            out = pa.RecordBatch.from_arrays([pa.array([x if not isinstance(x, pa.Array) else x.to_pylist()], k) for x, k in zip(made, kinds, strict=True)], names)
            ids.clear()
            texts.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if found := terms_of(text.as_py()):
                    if ids and (len(ids) == DOCUMENTS or held + len(found) > TERMS):
                        yield closed()
                        held = 0
                    ids.append(doc_id)
                    texts.append(found)
                    held += len(found)
        if ids:
            yield closed()

    path = folder(docs.sparkSession, "index")
    short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX).write.options(**_WRITE).parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Treap:
    """A shard's quadtree as arrays: for each node its quadrants, the place of its first child and its largest value; the last node stands for an empty quadrant."""

    def __init__(self, depth: int, quadrants: bytes, below: bytes) -> None:
        inner = np.frombuffer(quadrants, np.uint8)
        self.depth, self.values = depth, np.append(np.frombuffer(below, np.uint32).astype(np.int64), 0)
        self.empty = len(self.values) - 1
        self.quadrants = np.zeros(self.empty + 1, np.int64)
        self.quadrants[: len(inner)] = inner
        ones = _ONES[inner]
        self.first = np.zeros(self.empty + 1, np.int64)
        self.first[: len(inner)] = 1 + np.cumsum(ones) - ones
        begin, end = 0, 1
        for _ in range(depth):  # a level's children follow it
            children = slice(end, end + int(ones[begin:end].sum()))
            self.values[children] = np.repeat(self.values[begin:end], ones[begin:end]) - self.values[children]
            begin, end = end, children.stop

    def best(self, rows: np.ndarray, weights: np.ndarray, least: int, take) -> None:
        """Hands documents (columns, scores) of at least ``least`` to ``take``, best ranges first; it returns the new ``least``."""
        cells = np.zeros((1, len(rows)), np.int64)
        bound, level, at = self.values[cells] @ weights, np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(bound):
            chosen = np.argpartition(-bound, WIDTH - 1)[:WIDTH] if len(bound) > WIDTH else np.arange(len(bound))
            leaf = level[chosen] == self.depth
            if leaf.any():
                done = chosen[leaf]
                least = take(at[done], bound[done])
            split = chosen[~leaf & (bound[chosen] >= least)]
            parents, side = cells[split], rows >> (self.depth - 1 - level[split])[:, None] & 1
            quadrants, first = self.quadrants[parents], self.first[parents]
            rest = np.ones(len(bound), bool)
            rest[chosen] = False
            parts = [(bound[rest], level[rest], at[rest], cells[rest])]
            for half in (0, 1):
                q = 2 * side + half
                child = np.where(quadrants >> q & 1, first + _ONES[quadrants & (1 << q) - 1], self.empty)
                parts.append((self.values[child] @ weights, level[split] + 1, 2 * at[split] + half, child))
            bound, level, at, cells = (np.concatenate(x) for x in zip(*parts, strict=True))
            keep = bound >= least
            if not keep.all():
                bound, level, at, cells = bound[keep], level[keep], at[keep], cells[keep]


def _asked(block: list[tuple]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct terms of a block of (item_id, terms), and each item's as their places."""
    every = sorted({t for _, terms in block for t in terms})
    place = {t: i for i, t in enumerate(every)}
    return pa.array(every, pa.binary()), [np.array([place[t] for t in terms], np.int64) for _, terms in block]


def weights(indexed: DataFrame, every: pa.Array) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term, over all shards; tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(every), np.int64), 0
        for b in batches:
            for i in range(len(b)):
                n += len(b.column(0)[i].values)
                row = pc.index_in(every, value_set=b.column(1)[i].values)
                found = np.flatnonzero(row.is_valid().to_numpy(zero_copy_only=False))
                df[found] += b.column(2)[i].values.to_numpy()[row.fill_null(0).to_numpy()[found]]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(df[held], n))], ["term", "df"])

    counts = indexed.select("doc_ids", "terms", "df").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r.term: r.df for r in counts.collect()}
    n = df.get(-1, 0)
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(every))], np.int64)


def _search(indexed: DataFrame, number: int, block: list[tuple], k: int, kind: str) -> DataFrame:
    """block, item, item_id, doc_id, score: each task's ``k`` best documents for each item of the block."""
    every, places = _asked(block)
    weight = weights(indexed, every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in block]
        for b in batches:
            for i in range(len(b)):
                treap = Treap(b.column(2)[i].as_py(), b.column(3)[i].as_py(), b.column(4)[i].as_py())
                if not treap.depth:
                    continue
                own = b.column(0)[i].values
                absent, ids = own.is_null().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy()
                row = pc.index_in(every, value_set=b.column(1)[i].values).fill_null(-1).to_numpy().astype(np.int64)
                for item, terms in enumerate(places):
                    terms = terms[(row[terms] >= 0) & (weight[terms] > 0)]
                    if not len(terms):
                        continue

                    def take(columns: np.ndarray, scores: np.ndarray, item: int = item) -> int:
                        s, a, d = (np.concatenate(x) for x in zip(found[item], (scores, absent[columns], ids[columns]), strict=True))
                        first = np.lexsort((d, a, -s))[:k]
                        found[item] = s[first], a[first], d[first]
                        return max(1, int(s[first[-1]])) if len(first) == k else 1

                    treap.best(row[terms], weight[terms], take(np.zeros(0, np.int64), np.zeros(0, np.int64)), take)
        n = np.repeat(np.arange(len(block)), [len(s) for s, _, _ in found])
        s, a, d = (np.concatenate(x) for x in zip(*found, strict=True))
        names = pa.array([block[x][0] for x in n], _KINDS[kind])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number)), pa.array(n), names, pa.array(d, pa.int64(), mask=a), pa.array(s)], ["block", "item", "item_id", "doc_id", "score"])

    return indexed.select("doc_ids", "terms", "depth", "quadrants", "below").mapInArrow(run, f"block bigint, item bigint, item_id {kind}, doc_id bigint, score bigint")


def search(indexed: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of ``indexed`` for each row of ``items`` (item_id, text). Blocks of items pass the driver, a partition of items at a time."""
    kind = items.schema["item_id"].dataType.simpleString()
    if kind not in _KINDS:
        items, kind = items.withColumn("item_id", F.col("item_id").cast("string")), "string"
    block, held, out = [], 0, []
    for r in items.select("item_id", "text").toLocalIterator():
        terms = sorted(set(terms_of(r.text)))
        if block and (len(block) == ITEMS or held + len(terms) > ITEM_TERMS):
            out.append(_search(indexed, len(out), block, k, kind))
            block, held = [], 0
        if terms:
            block.append((r.item_id, terms))
            held += len(terms)
    if block:
        out.append(_search(indexed, len(out), block, k, kind))
    if not out:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    best = W.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: ``search`` of all ``items`` (item_id, text) in the ``index`` of all ``docs`` (doc_id, text).

    Equal scores come by ascending doc_id, null ids last. Null and empty texts have no terms: such documents count nowhere, such items have no rows.
    Each row is a document or an item of its own, so repeated ones come repeatedly. Whole texts count, however long. Empty tables give no rows; other columns don't matter.
    """
    return search(index(docs), items, k)


#: DuckDB's own computation of ``ranked``.
SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS MATERIALIZED (SELECT *, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0),
z AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
c AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, z GROUP BY term, nn),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
q AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(terms) AS term FROM i)),
s AS (SELECT i, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l)))) AS BIGINT) AS score FROM q JOIN c USING (term) JOIN w USING (term) JOIN d USING (r), z GROUP BY i, item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM o WHERE rank <= 50
"""
