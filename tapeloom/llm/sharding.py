"""Sharding by extendible hashing, in DataFrame operations alone.

A document's key is a string of hash bits. The directory starts with one bucket; a bucket over its byte limit splits on
the next bit, and nothing else does. Bytes are added up by cells of eight more bits at a time, so that each round looks
only at documents of buckets that are still too large, and a cell table of at most 256 rows per such bucket decides eight
splits at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import materialise, small

_STEP = 8


def hash_bits(id_col: str, text: str):
    """240 bits as text: of the id, then of id and text, so that rows of one id come apart as well where they differ."""
    bits = lambda column, n: F.concat(*(F.lpad(F.conv(F.substring(F.md5(column), 1 + 12 * i, 12), 16, 2), 48, "0") for i in range(n)))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.concat(bits(key.cast("binary"), 2), bits(F.concat(key, F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).cast("binary"), 2))


def shard(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text: str = "text", max_depth: int = 192, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: (id, n_bytes, shard (its hash prefix), depth, shard_bytes, shard_docs, fits).

    The shard of a row is the shortest prefix of its hash bits whose rows hold at most limit_bytes of UTF-8 together, and
    no shorter prefix does; so all shards fit, except where one text alone is over the limit, or rows alike in id and
    text are (they have equal bits to the end; fits is false for them). Null texts have 0 bytes; null ids share a key and
    are parted by their texts. Columns other than id and text are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), *columns, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(id_col, text).alias("bits"))
    rows = materialise(rows, "keys")
    directory = None
    open_rows = rows
    depth = 0
    while True:
        cells = open_rows.groupBy(F.substring("bits", 1, depth + _STEP).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("d"), F.max("n_bytes").alias("largest"))
        cells = materialise(cells, "cells")
        levels = range(depth if depth == 0 else depth + 1, depth + _STEP + 1)
        at = lambda k: F.substring("cell", 1, k)
        sums = cells.select("cell", *(f(c).over(Window.partitionBy(at(k))).alias(f"{c}_{k}") for k in levels for f, c in ((F.sum, "b"), (F.sum, "d"))))
        last = depth + _STEP >= max_depth
        # a bucket of one row, or at the last bit, can't split
        leaf = F.coalesce(*(F.when((F.col(f"b_{k}") <= limit_bytes) | (F.col(f"d_{k}") == 1), k) for k in levels), F.lit(max_depth if last else None).cast("int"))
        pick = lambda c: F.coalesce(*(F.when(F.col("depth") == k, F.col(f"{c}_{k}")) for k in levels))
        decided = sums.withColumn("depth", leaf).select("cell", "depth", F.expr("substring(cell, 1, depth)").alias("shard"), pick("b").alias("shard_bytes"), pick("d").alias("shard_docs"))
        decided = materialise(decided, "directory")
        done = decided.where("depth is not null")
        placed = open_rows.withColumn("cell", F.substring("bits", 1, depth + _STEP)).join(small(done), "cell").drop("cell")
        directory = placed if directory is None else directory.unionByName(placed)
        left = decided.where("depth is null").select("cell")
        if left.isEmpty():
            break
        open_rows = materialise(open_rows.withColumn("cell", F.substring("bits", 1, depth + _STEP)).join(small(left), "cell").drop("cell"), "open")
        depth += _STEP
    return directory.select(id_col, *columns, "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") <= limit_bytes).alias("fits"))


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ()) -> None:
    """Write the shards of docs as Parquet, a folder shard=b<bits> for each, with id, text and the named columns. A task
    writes whole shards, each of which holds limit_bytes at most, but for those that can't be split (see `shard`)."""
    placed = shard(docs, limit_bytes, id_col, text, columns=(text, *columns))
    named = F.concat(F.lit("b"), "shard").alias("shard")  # bits alone would be read back as numbers
    placed.select(id_col, text, *columns, named).repartition("shard").write.partitionBy("shard").parquet(path)
