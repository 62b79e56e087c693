"""Near duplicates by SimHash: fingerprints of word shingles, matched on pigeonhole blocks.

64-bit fingerprints within ``DISTANCE`` bits agree on at least ``blocks - DISTANCE`` of any number of blocks.
Each distinct fingerprint gets one key for each choice of so many blocks; fingerprints with a key in
common are compared. A key's fingerprints yield a star for each linked set, never all pairs. More blocks mean more and rarer
keys, so their number follows from that of the distinct fingerprints; it doesn't change the links. A key
with over ``BUCKET`` distinct fingerprints, which Spark counts beforehand, goes an exact linear way instead: two fingerprints are within
4 bits just if some number is within 2 bits of both, so each is linked with the least fingerprint
near each such number.

At a shingle similarity of 0.8, texts differ in about 15 of 100 bits, which is too many for blocks that are sure
to be shared. ``similar`` therefore takes 256 bits and splits them into ``WIDE_BLOCKS`` blocks in each of
``ORDERS`` orders: pairs share a block with high probability (README has the recall), and the Hamming
distance over all 256 bits decides. There, a key with over ``SLICE`` members is cut into slices, and each two slices
are compared in a task of their own, so that all pairs meet and none needs the whole key in memory. Spark counts
the keys beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, spread_join, staged

DISTANCE = 4
#: A key's fingerprints that are compared at once; larger keys go the other way, with the same links.
BUCKET = 4096
#: Fingerprints of a key, on average, that the number of blocks is chosen for. Any number over DISTANCE gives the same links.
SHARE = 64
#: Members of a key that are compared at once are at most about twice as many.
SLICE = 16384
#: Of the wide fingerprints. 39 of 256 bits is what a shingle similarity of 0.8 leaves on average.
WIDE, WIDE_DISTANCE, ORDERS, WIDE_BLOCKS = 256, 39, 4, 14
#: Keys up to so many members are compared all at once.
SMALL = 48


def fingerprint(text: str | None, shingle: int = 4, bits: int = 64) -> bytes:
    """Big-endian fingerprint: a bit is 1 where over half the shingles' hashes have it; no word gives 0.

    The first 64 bits of a shingle's hash are its XXH64 with seed 42; further ones are drawn from that.
    """
    words = (text or "").encode(errors="replace").lower().split()
    n = len(words)
    if not n:
        return bytes(bits // 8)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    count = max(1, n - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:count].tolist()
    ends = ends[shingle - 1 :].tolist() if n >= shingle else [len(joined)]
    votes = np.zeros(bits, np.int64)
    for at in range(0, count, 16384):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[at : at + 16384], ends[at : at + 16384], strict=True)], np.uint64)
        for k in range(bits // 64):
            part = hashes if k == 0 else _mixed(hashes, k)
            votes[64 * k : 64 * k + 64] += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > count).tobytes()


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits for each number: two rounds of xor-shift and odd multiplication."""
    x = x + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 4, bits: int = 64, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The numbers ``ids`` of each row and its whole text's fingerprint ``fp``: a signed long, or, of over 64 bits, binary."""
    kind = "long" if bits == 64 else "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), shingle, bits) for t in batch.column(0)]
            column = pa.array([int.from_bytes(x, "big", signed=True) for x in fp], pa.int64()) if bits == 64 else pa.array(fp, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], column], [*ids, "fp"])

    return short_batches(docs).select("text", *[F.col(c).cast("long") for c in ids]).mapInArrow(run, "".join(f"{c} long, " for c in ids) + f"fp {kind}")


def _settled(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least index that each of ``n`` is linked with through the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _stars(fps: np.ndarray, first: np.ndarray, last: np.ndarray, distance: int) -> np.ndarray:
    """For rows whose keys are the runs first..last (exclusive): the least row each is linked with inside its key."""
    n, i, j = len(fps), [], []
    end = np.repeat(last, last - first)
    small = np.repeat(last - first <= SMALL, last - first)
    row = np.arange(n)
    for gap in range(1, min(SMALL, int((last - first).max(initial=0)))):
        a = row[small & (row + gap < end)]
        a = a[_distance(fps[a], fps[a + gap]) <= distance]
        i.append(a)
        j.append(a + gap)
    label = _settled(np.concatenate(i), np.concatenate(j), n) if i else row
    for a, b in zip(first[last - first > SMALL].tolist(), last[last - first > SMALL].tolist(), strict=True):
        label[a:b] = a + _walk(fps[a:b], distance)
    return label


def _walk(fps: np.ndarray, distance: int) -> np.ndarray:
    """Labels of one large key: from each start, rows are compared only with those not reached yet, so a dense set costs little more than its size."""
    label, left = np.full(len(fps), -1), np.arange(len(fps))
    while len(left):
        start, left = left[0], left[1:]
        label[start], front = start, np.array([start])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            step = max(1, (1 << 21) // (len(left) * fps.shape[1]))
            taken, front = front[:step], front[step:]
            for at in range(0, len(left), 1 << 20):
                near[at : at + (1 << 20)] = (_distance(fps[taken][:, None], fps[left[at : at + (1 << 20)]][None]) <= distance).any(0)
            found = left[near]
            label[found], left, front = start, left[~near], np.concatenate([front, found])
    return label


def _over(keyed: DataFrame, most: int) -> DataFrame:
    """(choice, bits, n) of the keys with over ``most`` members, written out: Spark broadcasts it only where its real size allows."""
    return staged(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > most))


def _sliced(keyed: DataFrame, most: int) -> DataFrame:
    """``keyed`` with a column slot: one for a key of up to ``most`` members; larger ones have one for each two of their slices, with the members of both."""
    slices = F.ceil(F.coalesce("n", F.lit(1)) / most)
    mine = F.pmod(F.xxhash64("rep"), F.col("slices"))
    rows = keyed.join(_over(keyed, most), ["choice", "bits"], "left").withColumn("slices", slices).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).where("slices = 1 or mine != other")
    return rows.select("rep", "fp", "choice", "bits", (F.least("mine", "other") * F.col("slices") + F.greatest("mine", "other")).alias("slot"))


def _linked(keyed: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of ``rep`` that span the linked sets of each key of (rep, fp, choice, bits, slot).

    Keys are dealt out and sorted by Spark; a task holds one batch and one key at a time, so keys must be bounded.
    """
    keyed = keyed.select("rep", "choice", "bits", "fp", "slot").repartition("choice", "bits", "slot").sortWithinPartitions("choice", "bits", "slot", "rep")

    def words(column: pa.Array) -> np.ndarray:
        if pa.types.is_int64(column.type):
            return column.to_numpy().view(np.uint64).reshape(-1, 1)
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)

    def pairs(rep: np.ndarray, fps: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(rep)]])
        label = _stars(fps, first, last, distance)
        moved = np.flatnonzero(label != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(rep[moved], pa.int64()), pa.array(rep[label[moved]], pa.int64())], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows of the last key so far
        for batch in batches:
            if not len(batch):
                continue
            rep, fps = batch.column(0).to_numpy(), words(batch.column(3))
            key = np.stack([batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(), batch.column(4).to_numpy()], axis=1)
            same = (key == key[-1]).all(1)
            tail = len(key) - (np.flatnonzero(~same)[-1] + 1 if not same.all() else 0)
            split = len(key) - tail
            if split or held and (held[-1][2][0] != key[0]).any():
                parts = [*held, (rep[:split], fps[:split], key[:split])]
                held = []
                yield pairs(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
            held.append((rep[split:], fps[split:], key[split:]))
        if held:
            yield pairs(*(np.concatenate([p[k] for p in held]) for k in range(3)))

    return keyed.mapInArrow(compare, "a long, b long").distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The fewest blocks whose keys hold ``SHARE`` of ``n`` random fingerprints or fewer, of up to twice ``distance`` and six."""
    most = 2 * distance + 6
    return next((b for b in range(distance + 2, most) if n <= SHARE << 64 * (b - distance) // b), most)


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of fingerprints that span each set linked at ``distance`` bits or fewer; ``distinct`` has one column fp."""
    blocks = blocks or blocks_for(distinct.count(), distance)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen)
        keys.append(F.struct(F.lit(number).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bits")))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select(F.col("fp").alias("rep"), "fp", "key.choice", "key.bits")
    over = _over(keyed, bucket)
    crowded = staged(keyed.join(over, ["choice", "bits"], "left_semi").select(F.col("rep").alias("a")).distinct())
    rest = keyed.join(over, ["choice", "bits"], "left_anti").withColumn("slot", F.lit(0).cast("long"))
    return _linked(rest, distance).unionByName(_through_middles(crowded, distance)).distinct()


def _through_middles(fps: DataFrame, distance: int) -> DataFrame:
    """Links among ``fps`` (column a) through numbers between them; exact, linear in rows.

    Two are within ``distance`` bits just if some number is within half of that, rounded down, of one and half, rounded up, of the
    other. So all within the larger reach of a number are linked with the least one within the smaller reach.
    """
    low, high = distance // 2, -(-distance // 2)
    level = fps.select("a", F.col("a").alias("middle"), F.lit(-1).alias("bit"))
    spread = level.select("a", "middle", F.lit(True).alias("near"))
    for k in range(1, high + 1):  # numbers k bits away, by one more bit, in rising order
        level = level.where("bit < 63").withColumn("bit", F.explode(F.sequence(F.col("bit") + 1, F.lit(63)))).withColumn("middle", F.expr("middle ^ shiftleft(1L, bit)"))
        spread = spread.unionByName(level.select("a", "middle", F.lit(k <= low).alias("near")))
    least = spread.groupBy("middle").agg(F.min(F.when(F.col("near"), F.col("a"))).alias("b"), F.max("a").alias("most"), F.min("a").alias("first")).where("b is not null and first < most").select("middle", "b")
    return spread.join(least, "middle").where("a != b").select("a", "b").distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, root): each linked number's least reachable number, by alternating large-star and small-star steps.

    Edges (a, b) have a > b. A hub, the centre of a large star, holds many edges; joins are dealt so that no task gets a hub whole.
    """
    edges, before = staged(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for _ in range(rounds):
        # large star: larger neighbours of a node go to its least neighbour (or itself)
        ends = edges.select(F.col("b").alias("node"), F.col("b").alias("m"), F.lit(1).alias("n")).unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("m"), F.lit(0).alias("n")))
        least = staged(ends.groupBy("node").agg(F.min("m").alias("m"), F.sum("n").cast("long").alias("n")).where("n > 0"))
        large = spread_join(edges.withColumnRenamed("b", "node"), least.select("node", "m"), ["node"], least.select("node", "n"), F.xxhash64("a")).select("a", F.col("m").alias("b"))
        # small star: smaller neighbours and the node itself go to the least one; few larger nodes have many smaller ones, and each of those is a hub's edge
        large = staged(large.distinct())
        low = staged(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, low.select("a", "m"), ["a"], low.select("a", "n"), F.xxhash64("b")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int | None = None, shingle: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable, itself included) for each row.

    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id is never
    a component's id unless all its members are null. Equal texts share a fingerprint, so groups of copies
    are one class before any comparison; repeated rows give repeated results, an empty table gives no rows, other columns don't matter.
    """
    marked = staged(fingerprints(docs, shingle))
    classes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(classes.select("fp"), distance, blocks, bucket))
    rooted = staged(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    ids = staged(ids)
    named = spread_join(rooted, ids.select("root", "component_id"), ["root"], ids.select("root", "n"), F.xxhash64("fp")).select("fp", "component_id")
    out = spread_join(marked, named, ["fp"], classes.select("fp", "n"), F.xxhash64("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _families(docs: DataFrame, shingle: int, distance: int, orders: int, blocks: int, most: int) -> DataFrame:
    """ticket, doc_id, root for each row of ``docs`` (with a number of its own, ticket): rows of the same root are linked."""
    marked = staged(fingerprints(docs, shingle, WIDE, ("ticket", "doc_id")))
    classes = staged(marked.groupBy("fp").agg(F.min("ticket").alias("rep"), F.count("*").alias("n")))
    draw = np.random.default_rng(64)
    order = [np.arange(WIDE)] + [draw.permutation(WIDE) for _ in range(orders - 1)]
    cuts = [WIDE * i // blocks for i in range(blocks + 1)]
    weight = 1 << np.arange(max(b - a for a, b in zip(cuts, cuts[1:], strict=False)), dtype=np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), -1), axis=1)
                for o, columns in enumerate(order):
                    for b in range(blocks):
                        value = bits[:, columns[cuts[b] : cuts[b + 1]]] @ weight[: cuts[b + 1] - cuts[b]]
                        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(np.full(len(batch), o * blocks + b, np.int32)), pa.array(value, pa.int64())], ["rep", "fp", "choice", "bits"])

    keyed = classes.select("fp", "rep").mapInArrow(keys, "rep long, fp binary, choice int, bits long")
    roots = components(_linked(_sliced(keyed, most), distance)).withColumnRenamed("fp", "rep")
    named = classes.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("root"))
    return spread_join(marked, named, ["fp"], classes.select("fp", "n"), F.col("ticket")).select("ticket", "doc_id", "root")


def similar(docs: DataFrame, shingle: int = 5, distance: int = WIDE_DISTANCE, orders: int = ORDERS, blocks: int = WIDE_BLOCKS, most: int = SLICE) -> DataFrame:
    """doc_id, component_id (least doc_id reachable) for each row: texts whose ``shingle``-word shingles have a similarity of about 0.8 or more are linked.

    Null and empty texts are equal to each other and linked. A null doc_id is no component's id unless all its members are null.
    """
    rows = staged(_families(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("ticket")), shingle, distance, orders, blocks, most))
    ids = staged(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    return spread_join(rows, ids.select("root", "component_id"), ["root"], ids.select("root", "n"), F.col("ticket")).select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of ``docs`` for each group of ``similar`` ones, with all its columns, whatever these are called: that of the least doc_id (null: last).

    Of repeated rows, and of rows without an id, one stays likewise.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("kept")
    rows = staged(docs.select("doc_id", "text", row, F.monotonically_increasing_id().alias("ticket")))
    families = _families(rows.select("doc_id", "text", "ticket"), shingle, WIDE_DISTANCE, ORDERS, WIDE_BLOCKS, SLICE)
    first = families.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "ticket")).getField("ticket").alias("ticket"))
    kept = rows.select("ticket", "kept").join(first.select("ticket"), "ticket", "left_semi")
    return kept.select(*[F.col("kept").getField(c).alias(c) for c in docs.columns])
