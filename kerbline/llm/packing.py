"""Packing into fixed-length sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents become token ids and one closing id. Whole sequences are cut off first; the remainders are
dealt to groups by hash and packed by first-fit decreasing. One remainder in eight is *loose*: it
carries its ids, so it can be cut anywhere. Loose pieces go through the same tree after the others, largest first; one that
fits nowhere is cut to the largest room, and what is left of it waits for its turn by size. Before them the group opens sequences for as
many ids as the others leave no room for: full ones, and then ones whose lengths are powers of two, which need no padding. So loose
pieces fill every sequence to its end, as long as there are enough of them.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, staged

LENGTH = 4096
CLOSING = 2
#: Pieces of a group, on average: its memory bound.
GROUP = 4096
#: One remainder in so many is loose.
LOOSE = 8
CACHE = 300_000


# The steps before the merges that the quick way below stands in for.
NORMAL = ["NFC", "Replace", "Lowercase"]
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin-1 characters that these steps treat alike whatever stands around: no white space, no controls, nothing to compose.
_LETTERS, _NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xa1-\xff]*")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}\x09-\x0d\x20]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies show a byte as itself where it is printable, else as the next letter from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


class Ids(dict):
    """Chunk of UTF-8 without white space to its ids as little-endian 32-bit bytes; forgets all when full.

    A text of plain Latin-1 characters is lower-cased and parted here, and only its parts, which recur, go to the
    tokenizer's merges. Any other text goes through the tokenizer by its chunks, which ASCII white space always parts.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        plan = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (plan["normalizer"] or {}).get("normalizers", [])]
        parts = [x.get("pattern", {}).get("Regex") for x in (plan["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.quick = steps == NORMAL and parts == [PARTS, None] and plan["model"]["type"] == "BPE"
        self.parts = Parts(self.tokenizer.model)

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[chunk] = array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
        return out

    def of(self, text: str | None) -> bytes:
        """The ids of a whole text and the closing id."""
        text = text or ""
        if self.quick and _PLAIN.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower()))) + _CLOSING
        return b"".join(map(self.__getitem__, text.encode(errors="replace").split())) + _CLOSING


class Parts(dict):
    """Part of a plain text to its ids; forgets all when full."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        shown = part.encode().decode("latin-1").translate(self.letters)
        out = self[part] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return out


_CLOSING = array("I", [CLOSING]).tobytes()


def tokenised(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of each document: doc_id, start, length, ids_crc32, doc_tokens, slot (random, for dealing), ids (of a loose piece, else null)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, row = Ids(path), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids.of(text.as_py())
                n = len(data) // 4
                for start in range(0, n, length):
                    piece = data[4 * start : 4 * (start + length)]
                    slot = zlib.crc32(f"{doc_id} {start} {task} {row}".encode())
                    loose = len(piece) < 4 * length and zlib.crc32(f"loose {doc_id} {task} {row}".encode()) % LOOSE == 0
                    out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, slot, piece if loose else None))
                row += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot", "ids"])

    return short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slot long, ids binary")


class Tournament:
    """Leftmost bin with room: a tree whose nodes hold the larger capacity of their two children; at the root, that of all bins."""

    def __init__(self, rooms: list[int]):
        self.leaves = 1 << max(0, len(rooms) - 1).bit_length()
        self.room = [0] * self.leaves + rooms + [0] * (self.leaves - len(rooms))
        for at in reversed(range(1, self.leaves)):
            self.room[at] = max(self.room[2 * at], self.room[2 * at + 1])

    def place(self, size: int) -> int:
        """Puts ``size``, not over the root's room, into the first bin that has room, and returns the bin."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        where = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return where


def pack_group(pieces: list[tuple], length: int = LENGTH) -> list[tuple]:
    """Packs one group's pieces (as ``tokenised`` has them, without slot): gives (doc_id, start, length, crc, doc_tokens, bin, offset). Ties go by doc_id (null last) and start."""
    firm = sorted((p for p in pieces if p[5] is None), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1]))
    loose = [(-p[2], p[0] is None, p[0] or 0, p[1], number, p) for number, p in enumerate(pieces) if p[5] is not None]
    tree, used, out = Tournament([length] * len(firm)), [], []

    def put(doc_id, start, n, crc, tokens, b):
        out.append((doc_id, start, n, crc, tokens, b, used[b]))
        used[b] += n

    for doc_id, start, n, crc, tokens, _ in firm:
        b = tree.place(n)
        if b == len(used):
            used.append(0)
        put(doc_id, start, n, crc, tokens, b)
    rooms = [length - u for u in used]
    rest = max(0, -sum(p[0] for p in loose) - sum(rooms))
    rooms += [length] * (rest // length) + [1 << k for k in reversed(range(length.bit_length())) if (rest % length) >> k & 1]
    used += [0] * (len(rooms) - len(used))
    tree = Tournament(rooms)
    heapq.heapify(loose)
    while loose:
        size, *order, start, number, piece = heapq.heappop(loose)
        doc_id, first, _, _, tokens, data = piece
        n = min(-size, tree.room[1])
        put(doc_id, start, n, zlib.crc32(data[4 * (start - first) : 4 * (start - first + n)]), tokens, tree.place(n))
        if n < -size:
            heapq.heappush(loose, (size + n, *order, start + n, number, piece))
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per piece of each document of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the closing id alone, very long ones many pieces. Repeated rows are packed once each, null ids too; an empty table
    gives no rows; other columns don't matter. A group gets about ``group`` pieces whatever the table's size, so a task's memory is bounded.
    """
    pieces = staged(tokenised(docs, path, length))
    groups = -(-pieces.count() // group) or 1

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")), strict=True))
        columns = list(zip(*pack_group(rows, length), strict=True))
        columns[5] = [(key[0].as_py() << 32) + b for b in columns[5]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.withColumn("group", F.col("slot") % groups).groupBy("group").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
