"""Ranked lexical search: documents grouped by the mask of an item's terms that they hold, masks in order of their best score.

Each task turns a batch of indexed documents into one bitmap per term. For an item, the bitmaps of its terms, read across,
give every document's mask of matched terms; documents of one mask have one highest possible score, that of its terms at
their best in the batch. Masks are scored in descending order of it, and the rest is left out as soon as it can't reach the
k-th best score found so far. What a task puts out is k documents an item at most; a second ranking merges the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import materialise, small

#: Items go to the tasks in blocks of at most this many bytes of text (one item at least), whatever their number.
ITEM_BYTES = 4 << 20
#: Documents of one bitmap block.
BLOCK = 8192

_BREAKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_BREAKS + _UPPER, b" " * len(_BREAKS) + _UPPER.lower())


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and digits and of all non-ASCII characters, A-Z made lower case."""
    return (text or b"").translate(_FOLD).split()


def item_blocks(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[list[tuple[int, Counter]]]:
    """items (_item, _text) as blocks of (_item, its terms with repeats); one block at a time is in the driver."""
    block, size = [], 0
    for r in items.toLocalIterator():
        text = bytes(r["_text"] or b"")
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((r["_item"], Counter(terms(text))))
        size += len(text)
    if block:
        yield block


def index_documents(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs (_id, _text as bytes) -> (_id, n, t, tf): a document's terms with repeats, those of the vocabulary and their counts."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of one block of items

    def index(batches):
        get = known.value.get
        for b in batches:
            n, ends, ts, tfs = [], [0], [], []
            for x in b.column(1):
                words = terms(x.as_py())
                found = Counter(map(get, words))
                found.pop(None, None)
                n.append(len(words))
                ts.extend(found.keys())
                tfs.extend(found.values())
                ends.append(len(ts))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (ts, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["_id", "n", "t", "tf"])

    return docs.mapInArrow(index, "_id long, n long, t array<int>, tf array<int>")


class Block:
    """A batch of indexed documents as postings and bitmaps."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, t: np.ndarray, tf: np.ndarray, n_terms: int, n_docs: int, length: int):
        m = 75 + (25 * n * n_docs) // length
        self.ends, self.t = ends, t
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        #: What a term adds to a document's score, by weight.
        self.gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        self.best = np.zeros(n_terms, np.int64)
        np.maximum.at(self.best, t, self.gain)
        here, at = np.unique(t, return_inverse=True)
        held = np.zeros((len(here), len(n)), bool)
        held[at, doc] = True
        self.row = np.full(n_terms, -1)
        self.row[here] = np.arange(len(here))
        self.bits = np.packbits(held, axis=1)
        self.size = len(n)

    def masks(self, item: np.ndarray) -> np.ndarray:
        """A row per document: its mask of the item's terms, eight to a byte."""
        rows = np.unpackbits(self.bits[self.row[item]], axis=1, count=self.size)
        return np.ascontiguousarray(np.packbits(rows, axis=0).T)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The exact scores of some documents; weights: of every term, 0 where the item hasn't it."""
        starts, sizes = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        sums = np.concatenate(([0], np.cumsum(weights[self.t[at]] * self.gain[at])))
        last = np.cumsum(sizes)
        return sums[last] - sums[last - sizes]


class Best:
    """The k best (score, id) of an item so far: higher scores first, equal ones by smaller id, rows without one last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """No document below it can be among the k best; documents without a score are none."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, ids, null):
        some = score > 0
        score, ids, null = (np.concatenate(x) for x in ((self.score, score[some]), (self.id, ids[some]), (self.null, null[some])))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def rank_block(block: Block, item: np.ndarray, weights: np.ndarray, best: Best, ids: np.ndarray, null: np.ndarray) -> int:
    """Add the block's documents to best; item: the item's terms, weights: its weights by term. -> documents evaluated."""
    item = item[block.row[item] >= 0]
    if not len(item):
        return 0
    masks = block.masks(item)
    wide = -(-masks.shape[1] // 8)
    words = np.zeros((block.size, wide * 8), np.uint8)
    words[:, : masks.shape[1]] = masks
    words = words.view(np.uint64)
    order = np.lexsort(words.T) if wide > 1 else np.argsort(words[:, 0], kind="stable")
    words = words[order]
    first = np.concatenate(([0], np.flatnonzero((words[1:] != words[:-1]).any(axis=1)) + 1))
    size = np.diff(np.append(first, len(order)))
    held = np.unpackbits(masks[order[first]], axis=1, count=len(item)).astype(np.float64)
    highest = (held @ (weights[item] * block.best[item]).astype(np.float64)).astype(np.int64)  # below 2**53: exact
    turn = np.argsort(-highest, kind="stable")
    turn = turn[highest[turn] > 0]
    done, step, seen = 0, 4 * best.k, 0
    while done < len(turn) and highest[turn[done]] >= best.floor:
        upto = done + max(1, int(np.searchsorted(np.cumsum(size[turn[done:]]), step)))
        some = turn[done:upto]
        some = some[highest[some] >= best.floor]
        docs = np.concatenate([order[first[g] : first[g] + size[g]] for g in some])
        best.add(block.scores(docs, weights), ids[docs], null[docs])
        done, step, seen = upto, 2 * step, seen + len(docs)
    return seen


def rank_indexed(indexed: DataFrame, block: list[tuple[int, Counter]], vocabulary: dict[bytes, int], weight: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """(_item, _id, score): the k best documents of every item and task."""
    asked = [(i, np.fromiter((vocabulary[t] for t in c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))) for i, c in block if c]
    sent = indexed.sparkSession.sparkContext.broadcast((asked, weight))

    def rank(batches):
        asked, weight = sent.value
        best = {i: Best(k) for i, _, _ in asked}
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                b = whole.slice(a, BLOCK)
                col = b.column(0)
                null, ids = col.is_null().to_numpy(zero_copy_only=False), col.fill_null(0).to_numpy()
                t, tf = (b.column(c).flatten().to_numpy() for c in (2, 3))
                ends = np.concatenate(([0], np.cumsum(b.column(2).value_lengths().to_numpy())))
                made = Block(b.column(1).to_numpy(), ends, t, tf.astype(np.int64), len(weight), n_docs, length)
                of = np.zeros(len(weight), np.int64)
                for i, item, times in asked:
                    of[item] = weight[item] * times
                    rank_block(made, item, of, best[i], ids, null)
                    of[item] = 0
        for i, x in best.items():
            if len(x.score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(x.score), pa.int64()), pa.array(x.id, pa.int64(), mask=x.null), pa.array(x.score, pa.int64())], names=["_item", "_id", "score"])

    return indexed.mapInArrow(rank, "_item long, _id long, score long")


def _top(found: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Each item's k best documents: (item id, rank from 1, document id, score), by integer scores of term frequency and rarity.

    With N documents that hold a term, L terms in all of them, n in one, df documents with a term and tf times in one: a term
    weighs w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25 n N div L, and adds w * (10^9 tf div (1000 tf + 12 m)) for each
    time the item has it. Equal scores go by ascending document id, rows without an id last; only scores above 0 count.

    Every row of items is an item of its own, repeated ids too, and every row of docs a document. Null and empty texts have no
    terms; items without any, or none that a document holds, have no rows. Ids of documents are integers. Further columns are
    ignored. Items pass through the driver in blocks of `item_bytes`; documents never do.
    """
    items = materialise(items.select(F.monotonically_increasing_id().alias("_item"), F.col(item_id).alias("_of"), F.col(item_text).cast("binary").alias("_text")), "items")
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    found, whole = [], None
    for block in item_blocks(items.select("_item", "_text"), item_bytes):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, c in block for t in c))}
        if not vocabulary:
            continue
        indexed = materialise(index_documents(docs, vocabulary), "indexed")
        if whole is None:
            whole = indexed.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not whole["n"]:
            break
        held = indexed.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # a row per term of the block at most
        weight = np.zeros(len(vocabulary), np.int64)
        for r in held:
            weight[r["t"]] = math.floor(1000 * math.log((2 * whole["n"] + 2) / (2 * r["df"] + 1)))
        found.append(materialise(rank_indexed(indexed, block, vocabulary, weight, whole["n"], whole["l"], k).withColumn("_task", F.spark_partition_id() % 64), "found"))
    spark = docs.sparkSession
    named = T.StructType([T.StructField(item_id, items.schema["_of"].dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())])
    if not found:
        return spark.createDataFrame([], named)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    best = _top(_top(rows, k, "_item", "_task").drop("rank"), k, "_item")  # of many tasks, some at a time
    return best.join(small(items.select("_item", "_of")), "_item").select(F.col("_of").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")
