"""Mixing sources to target weights by weighted fair queueing, with built-in functions only.

Each source gets a target share of the budget. Its documents, shuffled by a hash, queue up as often as the target may
need. A word's virtual finish time is the words of its source up to and with it, divided by the source's target. In the order of
finish over all sources, the mix ends where the budget is spent, so each source is served its target.

As in fair queueing of a network, what is sorted are packets, of ``PACKET`` words at most (most documents are one or a few): they
are range-sorted by finish and their words summed up. Only the packets at the end of the budget, a few of each source, are
cut into words, which are sorted and summed up the same way.

All running sums, of a source's words, of packets and of the last words, go over range partitions, so no task holds a source or the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, running_sum, staged

SHARE, MOST = 1.5, 2
CYCLE = (3, 1, 2)
#: Words of a packet at most.
PACKET = 256


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """source, source_size, target from (source, size) rows.

    Sources by code point, null last, have the weights of ``cycle`` in turn. A target never exceeds ``most`` times
    its source; what is over goes to the others by weight: with sources in order of most * size / weight, all
    before the first whose level fits are full, and the level is what is left divided by the weights left.
    One row per source; the windows below hold those rows only.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    t = by_source.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(share)).withColumn("r", F.col("cap") / F.col("weight"))
    rising = W.orderBy("r", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("level", (F.col("budget") - before) / F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))).withColumn("n", F.row_number().over(rising))
    first = F.min(F.when(F.col("level") <= F.col("r"), F.struct("n", "level"))).over(W.partitionBy())
    target = F.least(F.coalesce(first["level"] * F.col("weight"), F.col("cap")), F.col("cap"))
    return t.select("source", "source_size", target.alias("target"))


def queue(docs: DataFrame, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Each row's ticket (its number), doc_id, source, size and shuffling key, staged; the columns ``keep`` come in one struct, kept, so that no name of theirs clashes."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    named = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named).cast("binary")), 1, 15), 16, 10).cast("long")
    kept = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    rows = docs.select(F.monotonically_increasing_id().alias("ticket"), F.col("doc_id"), F.col("source"), words.alias("size"), key.alias("key"), *kept)
    return staged(rows)


def packets(line: DataFrame, goals: DataFrame, most: int = MOST, packet: int = PACKET) -> DataFrame:
    """The packets of ``most`` copies of each document of ``line``: ticket, key, doc_id, copy, begin (words queued ahead of it in its source), words, target, finish."""
    rows = line.where("size > 0").join(goals, F.col("source").eqNullSafe(F.col("s"))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long")))
    rows = rows.withColumn("at", at).withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("at")))
    rows = rows.withColumn("begin", F.col("copy") * F.col("source_size") + F.col("before") + F.col("at"))
    return rows.select("ticket", "key", "doc_id", "copy", "begin", "words", "target", ((F.col("begin") + F.col("words")) / F.col("target")).alias("finish"))


def served(queued: DataFrame, budget: DataFrame, packet: int = PACKET) -> DataFrame:
    """(ticket, taken) of the documents that the budget reaches, from all ``packets``; ``budget`` has one row: budget, sources."""
    order = ["finish", "key", "doc_id", "copy", "begin", "ticket"]
    line = staged(running_sum(queued, order, "words", "ahead"))
    # before ``sure`` no word is left out: what the packets being served there can hold is still within the budget; nothing is taken from packets after ``end``
    whole = F.col("ahead") + F.col("words") <= F.col("budget") - F.col("sources") * packet
    marks = line.join(F.broadcast(budget), F.lit(True)).groupBy("budget").agg(F.coalesce(F.max(F.when(whole, F.col("finish"))), F.lit(-1.0)).alias("sure"), F.max(F.when(F.col("ahead") < F.col("budget"), F.col("finish"))).alias("end"))
    marks = staged(marks)  # one row
    line = line.join(F.broadcast(marks), F.lit(True))
    sure = line.where("finish <= sure").select("ticket", "words")
    spent = marks.join(F.broadcast(sure.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("spent"))), F.lit(True)).select((F.col("budget") - F.col("spent")).alias("rest"))
    last = line.where("finish > sure and begin / target < end").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("words"))))
    last = last.select("ticket", "key", "doc_id", "copy", (F.col("begin") + F.col("i")).alias("begin"), ((F.col("begin") + F.col("i")) / F.col("target")).alias("finish"), F.lit(1).cast("long").alias("words"))
    last = running_sum(last, order, "words", "ahead").join(F.broadcast(spent), F.col("ahead") < F.col("rest")).select("ticket", "words")
    return sure.unionByName(last).groupBy("ticket").agg(F.sum("words").alias("taken"))


def mix(queued: DataFrame, share: float = SHARE, most: int = MOST, packet: int = PACKET) -> DataFrame:
    """doc_id, ticket, size, source_size, target for each row of ``queue``, and taken: the words of its copies that the budget reaches in the order of finish."""
    line = staged(running_sum(queued.select("ticket", "doc_id", "source", "size", "key"), ["key", "doc_id", "size", "ticket"], "size", "before", group="source"))
    goals = targets(line, share, most).select(F.col("source").alias("s"), "source_size", "target")
    budget = line.agg(F.floor(F.coalesce(F.sum("size"), F.lit(0)) * F.lit(min(share, float(most)))).alias("budget")).join(F.broadcast(goals.agg(F.count("*").alias("sources"))), F.lit(True))
    taken = served(packets(line, goals, most, packet), budget, packet)
    rows = line.join(goals, F.col("source").eqNullSafe(F.col("s"))).join(taken, "ticket", "left")
    return rows.select("doc_id", "ticket", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix as rows of ``docs``' columns: a document comes once per copy taken; a cut copy keeps its first words, and n_chars follows.

    Documents without words are in it once. The texts are shuffled once, to meet their taken words.
    """
    queued = queue(docs, seed, docs.columns)
    m = mix(queued, share, most).where("taken > 0 or size = 0").select("ticket", "size", "taken")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    m = queued.select("ticket", "kept").join(m, "ticket").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    m = m.withColumn("left", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
    kept = {c: F.col("kept").getField(c) for c in docs.columns}
    is_cut = F.col("left") < F.col("size")
    words = F.split(F.trim(F.regexp_replace(kept["text"], r"[\x20\x09-\x0D]+", " ")), " ")
    kept["text"] = F.when(is_cut, F.array_join(F.slice(words, 1, F.col("left").cast("int")), " ")).otherwise(kept["text"])
    if "n_chars" in kept:
        kept["n_chars"] = F.when(is_cut, F.length(kept["text"]).cast(dict(docs.dtypes)["n_chars"])).otherwise(kept["n_chars"])
    return m.select(*[v.alias(c) for c, v in kept.items()])


def mixing(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``, its copies' words added up.

    Null and empty texts have size 0 and take nothing; an empty table gives no rows. The shuffle goes by doc_id, and where that is
    null by the text; repeated rows queue one after the other. A null source is a source of its own. Other columns don't matter.
    """
    return mix(queue(docs, seed)).drop("ticket")


#: DuckDB's own computation of ``mixing``.
SQL = """
WITH d AS (SELECT doc_id, source, CAST('0x' || substr(md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))))), 1, 15) AS BIGINT) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS r, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT level FROM l WHERE level <= r ORDER BY r, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM f) * weight, cap), cap) AS target FROM l),
q AS (SELECT d.*, row_number() OVER () AS ticket, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, unnest([0, 1]) AS copy FROM q WHERE size > 0),
w AS (SELECT *, copy * source_size + before + unnest(range(1, size + 1)) AS pos FROM c),
o AS (SELECT ticket, row_number() OVER (ORDER BY CAST(pos AS DOUBLE) / target, k, doc_id NULLS FIRST, copy, pos, ticket) AS place FROM w),
n AS (SELECT ticket, count(*) AS taken FROM o WHERE place <= (SELECT floor(1.5::DOUBLE * sum(size)) FROM d) GROUP BY ticket)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN n USING (ticket)
"""
