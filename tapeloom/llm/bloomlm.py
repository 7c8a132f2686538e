"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale; an n-gram of level q is kept as the q pairs (n-gram, 1)
to (n-gram, q) in a Bloom filter. Asking for (n-gram, 1), (n-gram, 2), ... until one is absent gives the level back: never too
low, and too high by one with the filter's small error. The filter comes in blocks by the leading bits of an n-gram's hash,
each as large as its entries need. Blocks are broadcast in segments of bounded size; texts are read once a segment.

Text is handled as arrays: a task turns a few megabytes of UTF-8 at a time into one 64-bit hash a word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import materialise

#: A segment of the filter, what is broadcast at once, has at most this many bytes (one block at least).
SEGMENT_BYTES = 64 << 20
#: Training tokens of a block, about: a block's n-grams are gathered in one task.
BLOCK_TOKENS = 500_000
#: Most frequent words whose exact counts go to every task, at most.
HEAD = 1 << 18
#: Bytes of text turned into hashes at once, and tokens counted before their counts are sent.
CHUNK, HOLD = 1 << 20, 4_000_000
#: Quantisation: counts of one level differ by this factor at most. Hash functions of the filter: an absent entry is found
#: with probability 2 ** -HASHES.
BASE, HASHES = 1.5, 6
#: Weight of the distribution of single words in that of a word's followers, in counts.
PRIOR = 300.0

_U = np.uint64
_BREAKS = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_SIGN = np.random.default_rng(20_07).integers(1, 1 << 63, 256, dtype=_U)  # a random number for each byte
_SIGN[list(_BREAKS)] = 0
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, CHUNK + 1), _powers(_BACK, CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


START, END = (mix(np.asarray([k], _U)) for k in (1, 2))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a word pair."""
    return mix(a * _U(0xD6E8FEB86659FD93) + (b ^ (b >> _U(32))))


def _piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    signs = _SIGN[np.frombuffer(data, np.uint8)]
    held = signs != 0
    starts = np.flatnonzero(held & ~np.concatenate(([False], held[:-1])))
    if not len(starts):
        return np.zeros(0, _U), starts
    up, down = (_UP, _DOWN) if len(data) < len(_UP) else (_powers(_STEP, len(data)), _powers(_BACK, len(data)))
    return mix(np.add.reduceat(signs * up[: len(data)], starts) * down[starts]), starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every word of lower-case UTF-8; long data piece by piece, cut between words."""
    if len(data) <= CHUNK:
        return _piece(data)
    hashes, places, a = [], [], 0
    while a < len(data):
        b = min(a + CHUNK, len(data))
        if b < len(data):
            cut = max(data.rfind(bytes([s]), a, b) for s in _BREAKS)
            if cut < a:  # a word longer than a piece
                cut = min((x for x in (data.find(bytes([s]), b) for s in _BREAKS) if x >= 0), default=len(data) - 1)
            b = cut + 1
        h, at = _piece(data[a:b])
        hashes.append(h)
        places.append(at + a)
        a = b
    return np.concatenate(hashes), np.concatenate(places)


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the words of each text, A-Z made lower case, and an end after each; ends: where the next text begins."""
    joined = b"\n".join(x or b"" for x in texts).translate(_LOWER)
    offsets = np.cumsum([len(x or b"") + 1 for x in texts])
    hashes, places = word_hashes(joined)
    ends = np.searchsorted(places, offsets) + np.arange(1, len(texts) + 1)
    out = np.empty(len(hashes) + len(texts), _U)
    closing = np.zeros(len(out), bool)
    closing[ends - 1] = True
    out[closing], out[~closing] = END, hashes
    return out, ends


def before(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The word before each token, START at the beginning of a text."""
    out = np.concatenate((START, hashes[:-1]))
    out[ends[:-1]] = START
    return out


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, next row, hashes, ends) over a batch, about CHUNK bytes of text at a time."""
    col = batch.column(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, side="right")))
        yield a, b, *tokens(col.slice(a, b - a).to_pylist())
        a = b


def _counted(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(hashes), return_counts=True)


def word_counts(texts: DataFrame) -> DataFrame:
    """texts (_text as bytes) -> (h, c): how often each token stands in them all."""

    def count(batches):
        held, n = [], 0
        for b in batches:
            for _, _, h, _ in chunks(b, 0):
                held.append(h)
                n += len(h)
                if n >= HOLD:
                    yield batch(*_counted(held))
                    held, n = [], 0
        if held:
            yield batch(*_counted(held))

    def batch(h, c):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["h", "c"])

    return texts.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words whose count reaches the least power of two that at most `most` words reach."""
    power = F.floor(F.log2("c"))
    kept, least = 0, 63
    for r in words.groupBy(power.alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("p")).collect():  # a row per power of two
        if kept + r["n"] > most:
            break
        kept, least = kept + r["n"], r["p"]
    return words.where(power >= least)


def _bounds() -> np.ndarray:
    """The smallest count of each level."""
    return np.asarray([math.ceil(BASE**q) for q in range(int(62 * math.log(2) / math.log(BASE)))], np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_bounds(), counts, side="right")


def _places(keys: np.ndarray, q: int):
    """The filter's places of (key, q) before they are fitted to a block: one array for each hash function."""
    x = mix(keys + _U(q * _STEP % (1 << 64)))
    a, b = x >> _U(32), (x & _U(0xFFFFFFFF)) | _U(1)
    for i in range(HASHES):
        yield a + _U(i) * b


def fill_block(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(size in bits, bits) of the filter block of n-grams with their counts."""
    q = level(counts)
    size = max(64, math.ceil(int(q.sum()) * HASHES / math.log(2)))
    bits = np.zeros(size, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        for at in _places(keys[q >= j], j):
            bits[at % _U(size)] = True
    return size, np.packbits(bits, bitorder="little").tobytes()


def filter_blocks(texts: DataFrame, words: DataFrame, depth: int) -> DataFrame:
    """(block, n_bits, bits, stats): the filter over words and word pairs, 2 ** depth blocks, those without entries left out.
    stats: for single words (1) and pairs (2) and each level the number of n-grams and the sum of their counts."""

    def cut(kind, keys, counts):
        """Rows of the blocks that sorted keys fall into."""
        at = np.searchsorted(keys >> _U(64 - depth), np.arange((1 << depth) + 1).astype(_U)) if depth else np.asarray([0, len(keys)])
        some = np.flatnonzero(np.diff(at))
        parts = [(int(k), keys[at[k] : at[k + 1]].tobytes(), counts[at[k] : at[k + 1]].astype(np.int64).tobytes()) for k in some]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([kind] * len(parts), pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names=["block", "kind", "keys", "counts"])

    def pairs(batches):
        held, n = [], 0
        for b in batches:
            for _, _, h, ends in chunks(b, 0):
                held.append(pair(before(h, ends), h))
                n += len(h)
                if n >= HOLD:
                    yield cut(2, *_counted(held))
                    held, n = [], 0
        if held:
            yield cut(2, *_counted(held))

    def singles(batches):
        for b in batches:
            keys, counts = b.column(0).to_numpy().view(_U), b.column(1).to_numpy()
            order = np.argsort(keys)
            yield cut(1, keys[order], counts[order])

    def fill(group: pa.Table) -> pa.Table:
        every, stats = [], []
        for kind in (1, 2):
            some = group.filter(pc.equal(group["kind"], kind))
            keys, counts = (np.concatenate([np.frombuffer(x.as_py(), t) for x in some[c]] or [np.zeros(0, t)]) for c, t in (("keys", _U), ("counts", np.int64)))
            keys, at = np.unique(keys, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, counts)
            every.append((keys, total))
            q = level(total)
            stats += [{"kind": kind, "level": int(j), "n": int((q == j).sum()), "c": int(total[q == j].sum())} for j in np.unique(q)]
        n_bits, bits = fill_block(*(np.concatenate(x) for x in zip(*every)))
        return pa.table([pa.array([group["block"][0].as_py()], pa.int64()), pa.array([n_bits], pa.int64()), pa.array([bits], pa.binary()), pa.array([stats], pa.list_(pa.struct([("kind", pa.int32()), ("level", pa.int32()), ("n", pa.int64()), ("c", pa.int64())])))], names=["block", "n_bits", "bits", "stats"])

    parts = "block long, kind int, keys binary, counts binary"
    rows = texts.mapInArrow(pairs, parts).unionByName(words.select("h", "c").mapInArrow(singles, parts))
    return rows.groupBy("block").applyInArrow(fill, "block long, n_bits long, bits binary, stats array<struct<kind:int,level:int,n:long,c:long>>")


class Segment:
    """Some blocks of a filter, for probing. Blocks that aren't among them hold nothing."""

    def __init__(self, depth: int, blocks, n_bytes: int):
        """blocks: (block, bits in number, bits), n_bytes in all; one after another, so that nothing is held twice."""
        self.depth, self.size, self.first = depth, np.zeros(1 << depth, np.int64), np.zeros(1 << depth, np.int64)
        self.data, at = np.zeros(n_bytes, np.uint8), 0
        for k, n_bits, bits in blocks:
            self.size[k], self.first[k] = n_bits, 8 * at
            self.data[at : at + len(bits)] = np.frombuffer(bits, np.uint8)
            at += len(bits)

    def levels(self, keys: np.ndarray, most: int) -> np.ndarray:
        """The level of each key: the last q for which (key, 1) to (key, q) are all found."""
        out = np.zeros(len(keys), np.uint8)
        block = (keys >> _U(64 - self.depth)).astype(np.int64) if self.depth else np.zeros(len(keys), np.int64)
        left = np.flatnonzero(self.size[block] > 0)
        for q in range(1, most + 1):
            for i in range(HASHES):
                if i == 0:
                    x = mix(keys[left] + _U(q * _STEP % (1 << 64)))
                at = ((x >> _U(32)) + _U(i) * ((x & _U(0xFFFFFFFF)) | _U(1))) % self.size[block[left]].astype(_U)
                at = at.astype(np.int64) + self.first[block[left]]
                held = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                left, x = left[held], x[held]
            if not len(left):
                break
            out[left] = q
        return out


def _looked_up(keys: np.ndarray, look) -> np.ndarray:
    """look for each distinct key once, in their order (neighbours are in one block)."""
    distinct, at = np.unique(keys, return_inverse=True)
    return look(distinct)[at]


def segments(blocks: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """(first, last) blocks of each segment of at most limit bytes; blocks: (block, bits) in order."""
    out, size = [], 0
    for k, n_bits in blocks:
        n = (n_bits + 7) // 8
        if out and size + n <= limit:
            out[-1], size = (out[-1][0], k), size + n
        else:
            out.append((k, k))
            size = n
    return out


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES, head: int = HEAD, prior: float = PRIOR) -> DataFrame:
    """Every document's log10 probability: (id, n_tokens, n_known, train_tokens, base_score, score), learned from the rows where
    the condition `train` holds.

    Tokens are words, A-Z made lower case, and an end. base_score takes them singly, log10((c + 0.5) / (N + 0.5 (V + 1))) each
    by exact counts: those of the `head` most frequent words are at hand in every task, the others are joined. score is that
    of word pairs: p(w | v) = (c(v w) + prior * p(w)) / (c(v) + prior), where all three counts come from the filter, each level
    standing for the mean count of its n-grams, so that the sum of all counts stays what it was.

    Null texts count as empty: an end alone. Repeated rows and rows without an id each come back. Without training rows every
    token has probability 1 by itself and all scores are 0. Further columns are ignored. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text).cast("binary").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    texts = rows.where("_train").select("_text")
    words = materialise(word_counts(texts), "word-counts")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    depth = max(0, math.ceil(math.log2(max(1, n) / BLOCK_TOKENS)))
    blocks = materialise(filter_blocks(texts, words, depth), "filter")
    sizes = [(r["block"], r["n_bits"]) for r in blocks.select("block", "n_bits").orderBy("block").collect()]  # a number for every BLOCK_TOKENS tokens
    means = {(r["kind"], r["level"]): r["c"] / r["n"] for r in blocks.select(F.inline("stats")).groupBy("kind", "level").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()}
    most = max((q for _, q in means), default=0)
    mean = [np.zeros(most + 2)] + [np.asarray([0.0] + [means.get((kind, q), float(_bounds()[q - 1])) for q in range(1, most + 2)]) for kind in (1, 2)]
    starts = float(words.where(F.col("h") == int(END.view(np.int64)[0])).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    top = frequent(words, head).toArrow()  # at most `head` rows
    keys, counts = top["h"].to_numpy().view(_U), top["c"].to_numpy()
    order = np.argsort(keys)
    share = math.log10(n + 0.5 * (v + 1))
    exact = spark.sparkContext.broadcast((keys[order], counts[order]))

    def segment(first: int, last: int):
        n_bytes = sum((n_bits + 7) // 8 for k, n_bits in sizes if first <= k <= last)  # at most segment_bytes
        got = blocks.where((F.col("block") >= first) & (F.col("block") <= last)).select("block", "n_bits", "bits")
        return spark.sparkContext.broadcast(Segment(depth, map(tuple, got.toLocalIterator()), n_bytes))

    def found(part, h, back, known):
        """Levels of words and pairs: what this segment has, or else what an earlier one had."""
        out = [_looked_up(k, lambda x: part.levels(x, most + 1)) for k in (h, pair(back, h))]
        return out if known is None else [np.maximum(a, b) for a, b in zip(out, known)]

    def known_of(b, col, a, z):
        return np.frombuffer(b"".join(b.column(col).slice(a, z - a).to_pylist()), np.uint8)

    def look(part):
        """A pass over the texts that adds what one segment holds to the levels of their tokens, a byte each."""

        def run(batches):
            for b in batches:
                for a, z, h, ends in chunks(b, 2):
                    was = None if b.num_columns == 3 else [known_of(b, c, a, z) for c in (3, 4)]
                    one, two = found(part.value, h, before(h, ends), was)
                    at = np.concatenate(([0], ends))
                    cols = [pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(z - a)], pa.binary()) for x in (one, two)]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(a, z - a) for c in range(3)), *cols], names=["_row", "_id", "_text", "one", "two"])

        return run

    def final(part):
        def run(batches):
            head_keys, head_counts = exact.value
            for b in batches:
                for a, z, h, ends in chunks(b, 2):
                    was = None if b.num_columns == 3 else [known_of(b, c, a, z) for c in (3, 4)]
                    one, two = found(part.value, h, before(h, ends), was) if part else (np.zeros(len(h), np.uint8),) * 2
                    begin = np.concatenate(([0], ends[:-1]))
                    # the model
                    c1 = mean[1][one]
                    p1 = (c1 + 0.5) / (n + 0.5 * (v + 1))
                    history = np.concatenate(([starts], c1[:-1]))
                    history[begin] = starts
                    c2 = np.where((one > 0) & (history > 0), np.minimum(mean[2][two], history), 0.0)
                    score = np.add.reduceat(np.log10((c2 + prior * p1) / (history + prior)), begin)
                    # exact counts of the frequent words; the others go on as rows
                    distinct, at = np.unique(h, return_inverse=True)
                    place = np.minimum(np.searchsorted(head_keys, distinct), max(len(head_keys) - 1, 0))
                    is_head = head_keys[place] == distinct if len(head_keys) else np.zeros(len(distinct), bool)
                    value = np.where(is_head, np.log10(np.where(is_head, head_counts[place] if len(head_keys) else 0, 0) + 0.5) - share, 0.0)
                    sure = is_head[at]
                    size = np.diff(np.append(begin, len(h)))
                    yield batch(b, np.arange(a, z), None, size, np.add.reduceat(sure.astype(np.int64), begin), np.add.reduceat(value[at], begin), score)
                    doc = np.repeat(np.arange(z - a), size)[~sure]
                    if len(doc):
                        order = np.lexsort((h[~sure], doc))
                        d, w = doc[order], h[~sure][order]
                        first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1]))))
                        yield batch(b, d[first] + a, w[first], np.diff(np.append(first, len(d))))

        def batch(b, at, word, size, known=None, base=None, score=None):
            null = lambda t: pa.nulls(len(at), t)
            cols = [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), null(pa.int64()) if word is None else pa.array(word.view(np.int64)), pa.array(size, pa.int64())]
            cols += [null(t) if x is None else pa.array(x, t) for x, t in ((known, pa.int64()), (base, pa.float64()), (score, pa.float64()))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        return run

    fields = [rows.schema["_row"], rows.schema["_id"]]
    schema = T.StructType([*fields, *(T.StructField(x, t) for x, t in (("h", T.LongType()), ("k", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType())))])
    names = schema.names
    now, parts = rows.select("_row", "_id", "_text"), segments(sizes, segment_bytes)
    held = T.StructType([*now.schema.fields, T.StructField("one", T.BinaryType()), T.StructField("two", T.BinaryType())])
    for first, last in parts[:-1]:
        part = segment(first, last)
        now = materialise(now.mapInArrow(look(part), held), "levels")
        part.destroy()  # the pass is written: the workers make room for the next segment
    part = segment(*parts[-1]) if parts else None
    scored = materialise(now.mapInArrow(final(part), schema), "scored")
    for sent in (part, exact):
        if sent:
            sent.destroy()
    own = scored.where("h is null").select("_row", "_id", F.col("k").alias("n"), "known", "base", "score")
    rare = scored.where("h is not null").join(words, "h", "left")
    base = F.col("k") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - share)
    rest = rare.groupBy("_row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("known"), F.sum(base).alias("base"))
    every = own.join(rest.select("_row", F.col("known").alias("more"), F.col("base").alias("less")), "_row", "left")
    return every.select(F.col("_id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("less", F.lit(0.0))).alias("base_score"), "score")
