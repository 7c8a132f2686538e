"""Shared plumbing of the training-data operators: input tables, scratch tables, row keys, sized broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only after its bytes were added up and found to be at most this many.
MAX_BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors, spark.checkpoint.dir. Where it is unset, a local session (tests) gets a
    temporary folder; on a cluster, whose executors would each write to their own disk, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-tapeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tapeloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it again.

    Unlike cached blocks the files survive the loss of any executor, and readers of a few columns read only those.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(f: T.StructField):
    """Bytes of a column's value, about."""
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(f.name), F.lit(0))
    if isinstance(f.dataType, T.ArrayType):
        inner = F.octet_length(F.array_join(f.name, "")) if isinstance(f.dataType.elementType, T.StringType) else F.lit(0)
        return 16 + 16 * F.coalesce(F.size(f.name), F.lit(0)) + F.coalesce(inner, F.lit(0))
    return F.lit(8)


def small(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most limit bytes, else df as it is, so that the join shuffles. df should be
    cheap to read (a table)."""
    size = df.agg(F.sum(sum((_width(f) for f in df.schema.fields), F.lit(8)).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def is_held_out(key: str, mod: int, remainder: int):
    """crc32 of the key as text, modulo mod, equals remainder. A null key counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod) == remainder
