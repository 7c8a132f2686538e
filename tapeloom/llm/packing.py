"""Sequence packing by minimum bin slack.

Every input partition packs its own documents: no shuffle, nothing grows with a key. Documents stream in; what is longer
than a sequence is cut into whole sequences, and the remainders wait in a window. When the window is full, the longest
remainder opens a sequence and a bitset subset-sum program picks, from the lengths that wait, the multiset that fills the
room best; the counts are found by walking the bitsets back. Slack that is left is filled by cutting one more remainder.
At the end of the partition the last, partly filled sequence is written as sequences of powers of two, which need no
padding.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.tokens import Memo, PreTokens, texts

#: Remainders that wait at most before sequences are filled from them.
WINDOW = 512


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths (length -> how many, at most counts) whose sum is nearest to room from below.

    Bit s of `reach` says that some multiset sums to s. Each length enters in lots of 1, 2, 4, ... copies, so that a
    length with k copies costs log k shifts; the bitset before each lot is kept and the lots are walked back.
    """
    mask, reach, lots = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left > 0:
            take = min(lot, left)
            lots.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, lot = left - take, lot * 2
        if reach >> room & 1:
            break
    total, picked = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(lots):
        if not before >> total & 1:
            total -= length * take
            picked[length] += take
    return dict(picked)


class Packer:
    """Packs a stream of documents. Pieces come out as (document, start, length, sequence, offset, bytes of the ids)."""

    def __init__(self, size: int = 4096, window: int = WINDOW):
        self.size, self.window = size, window
        self.wait: dict[int, deque] = defaultdict(deque)  # length -> remainders (document, start, bytes)
        self.waiting = self.sequence = 0

    def _put(self, doc, start: int, data) -> None:
        self.wait[len(data) // 4].append((doc, start, data))
        self.waiting += 1

    def _take(self, length: int):
        queue = self.wait[length]
        got = queue.popleft()
        if not queue:
            del self.wait[length]
        self.waiting -= 1
        return got

    def add(self, doc, data: bytes) -> Iterator[tuple]:
        whole = 4 * self.size
        view = memoryview(data)
        for a in range(0, len(view), whole):
            part = view[a : a + whole]
            if len(part) == whole:
                yield doc, a // 4, self.size, self.sequence, 0, part
                self.sequence += 1
            else:
                self._put(doc, a // 4, bytes(part))
        while self.waiting > self.window:
            yield from self._one()

    def _one(self) -> Iterator[tuple]:
        """One full sequence, if what waits is enough for it."""
        first = max(self.wait)
        chosen = [self._take(first)]
        room = self.size - first
        for length, k in fill(room, {n: len(q) for n, q in self.wait.items()}).items() if room else ():
            chosen += [self._take(length) for _ in range(k)]
            room -= length * k
        if room and self.wait:  # every waiting piece is longer than the slack: cut the shortest
            doc, start, data = self._take(min(self.wait))
            chosen.append((doc, start, data[: 4 * room]))
            self._put(doc, start + room, data[4 * room :])
            room = 0
        yield from self._lay(chosen, self.size - room)

    def _lay(self, chosen: list, total: int) -> Iterator[tuple]:
        """Pieces one after another; a total under the size goes into sequences of falling powers of two."""
        ends = [self.size] if total == self.size else [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        at, end = 0, iter(ends)
        cap = next(end)
        for doc, start, data in chosen:
            while data:
                part = data[: 4 * (cap - at)]
                n = len(part) // 4
                yield doc, start, n, self.sequence, at, part
                data, start, at = data[4 * n :], start + n, at + n
                if at == cap:
                    self.sequence, at, cap = self.sequence + 1, 0, next(end, self.size)

    def close(self) -> Iterator[tuple]:
        while self.wait:
            yield from self._one()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pack whole texts into sequences of `size` token ids: one row per piece.

    (id, start, length, ids (array of int), ids_crc32, doc_tokens, sequence_id, offset). A document is the ids of its
    text and then end_id; null and empty texts are that one id. Each id lies in exactly one piece; the offsets of a
    sequence run without gaps from 0. Sequences hold `size` ids, but for the last ones of a partition, whose lengths are
    powers of two: nothing is padded. sequence_id is the partition's number above bit 40 and a count below. Repeated
    rows and ids are packed one by one; null ids stay null; further columns are ignored; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.LongType()) for n in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    names = schema.names

    def run(batches):
        pre = PreTokens(path)
        words = Memo(lambda w: struct.pack(f"<{len(i := pre.ids(w))}I", *i))
        chunks = Memo(lambda chunk: b"".join(map(words.__getitem__, pre.cut(chunk))), 200_000)
        tail = struct.pack("<I", end_id)
        packer, base = Packer(size, window), TaskContext.get().partitionId() << 40
        ids: list = []  # the id column's values as Arrow scalars, by document number of this batch
        rows: list = []

        def batch():
            cols = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in cols[0]], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([bytes(x) for x in cols[5]], pa.binary()), pa.array([zlib.crc32(x) for x in cols[5]], pa.int64()), pa.array([d[1] for d in cols[0]], pa.int64()), pa.array([base + s for s in cols[3]], pa.int64()), pa.array(cols[4], pa.int64())], names=names)
            rows.clear()
            return out

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            ids = b.column(0).to_pylist()
            for i, x in texts(b, "_text"):
                x = x or ""
                data = (b"".join(map(chunks.__getitem__, x.lower().split())) if pre.plain(x) else b"".join(map(words.__getitem__, pre.cut(x)))) + tail
                rows += packer.add((ids[i], len(data) // 4), data)
                if len(rows) > 4096:
                    yield batch()
        rows += packer.close()
        if rows:
            yield batch()

    return docs.select(F.col(id_col), F.col(text).alias("_text")).mapInArrow(run, schema)


def unpack_ids(column):
    """The ids of a piece as an array of ints, from their little-endian bytes."""
    word = F.transform(F.sequence(F.lit(0), (F.octet_length(column) / 4).cast("int") - 1), lambda i: F.conv(F.concat(*(F.hex(F.substring(column, i * 4 + k, 1)) for k in (4, 3, 2, 1))), 16, 10).cast("int"))
    return F.when(F.octet_length(column) > 0, word).otherwise(F.array().cast("array<int>"))
