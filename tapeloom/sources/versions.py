"""Tables that are merged into by copy-on-write, and read at the last committed version.

    <path>/data/version=<n>-<id>/part=<p>/ the partitions that a version rewrote
    <path>/manifests/<version>-<id>/       every partition of the version: its folder, rows, least and largest key
    <path>/commits/<version>               names the manifest; it appears at once, and only then the version exists

A merge reads only partitions that hold keys of the changes, writes them anew beside the old ones, then the manifest, then the
commit. Whatever it leaves behind when it dies is in nobody's way. Two merges onto the same version: one of them fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.lineage import cut


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, ascending."""
    jvm, at, fs = _files(spark, f"{path}/commits")
    if not fs.exists(at):
        return []
    return sorted(int(n) for s in fs.listStatus(at) if (n := s.getPath().getName()).isdigit())


def _commit(spark: SparkSession, path: str, version: int, manifest: str) -> None:
    """Make a version exist: a written file takes its name, unless another has it."""
    jvm, at, fs = _files(spark, f"{path}/commits/{version:012d}")
    _, draft, _ = _files(spark, f"{path}/commits/_{manifest}")
    out = fs.create(draft, True)
    out.write(bytearray(manifest.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(at), spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """(part, folder, rows, low, high) of a version, by default the last; None for an empty table."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    _, at, fs = _files(spark, f"{path}/commits/{version if version is not None else known[-1]:012d}")
    stream = fs.open(at)
    name = bytes(stream.readAllBytes()).decode()
    stream.close()
    return spark.read.parquet(f"{path}/manifests/{name}")


def _read(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """The rows of some partitions with their part."""
    folders = sorted(f"{path}/data/version={r["folder"]}/part={r["part"]}" for r in parts.collect())  # a name for each partition
    return spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*folders).drop("version", "part")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table at a version, by default the last committed one; None if there is none."""
    parts = manifest(spark, path, version)
    return None if parts is None else _read(spark, path, parts).drop("_part")


def touched(spark: SparkSession, path: str, parts: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Of the partitions those that hold one of the keys: by their bounds first, then by their key columns alone."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    near = parts.where((F.col("high") >= F.lit(low)) & (F.col("low") <= F.lit(high))) if low is not None else parts.limit(0)
    if near.isEmpty():
        return near
    held = _read(spark, path, near).select(key, "_part").join(keys.select(key), key, "left_semi").select(F.col("_part").alias("part")).distinct()
    return near.join(held, "part", "left_semi")


def merge(spark: SparkSession, path: str, changes: DataFrame, key: str, part: Column, newest: str | None = None, insert: bool = True) -> int:
    """Merge changes into the table, and return the version that has them.

    A row whose key the table holds takes over all columns that changes has, nulls too, and stays in its partition; its other
    columns stay. Other rows are inserted, into the partition named by `part` (a short text or number made of columns of
    changes), or left out if not insert. Of changes with one key the one with the largest `newest` counts (needed where keys
    repeat). Rows without a key are left out. Changes that change nothing make no version.
    """
    known = versions(spark, path)
    base = known[-1] if known else 0
    parts = manifest(spark, path, base) if known else None
    fresh = changes.where(F.col(key).isNotNull()).withColumn("_to", part.cast("string"))
    if newest:
        rest = [c for c in fresh.columns if c != key]
        fresh = fresh.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(newest, *(c for c in rest if c != newest))).alias("_r")).select(key, "_r.*")
    fresh = cut(fresh, "changes")
    columns = [c for c in fresh.columns if c not in (key, "_to")]
    if parts is None:
        rows = fresh.withColumnRenamed("_to", "_part") if insert else fresh.limit(0).withColumnRenamed("_to", "_part")
        kept = None
    else:
        now = _read(spark, path, parts)
        hit = cut(touched(spark, path, parts, fresh, key), "touched")
        old = _read(spark, path, hit) if not hit.isEmpty() else now.limit(0)
        if insert:  # partitions that only get new rows are rewritten too
            new = fresh.join(old.select(key), key, "left_anti").select(F.col("_to").alias("part")).distinct()
            hit = cut(hit.unionByName(parts.join(new, "part", "left_semi")).dropDuplicates(["part"]), "touched")
            old = _read(spark, path, hit) if not hit.isEmpty() else now.limit(0)
        put = fresh.select(F.col(key), "_to", F.struct(*columns).alias("_new"))
        both = old.withColumn("_old", F.lit(True)).join(put, key, "full" if insert else "left")
        seen, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
        every = list(dict.fromkeys([*(c for c in old.columns if c not in (key, "_part")), *columns]))

        def value(c):
            mine = F.col(c) if c in old.columns else F.lit(None)
            return F.when(seen, F.col("_new").getField(c)).otherwise(mine).alias(c) if c in columns else mine.alias(c)

        rows = both.select(key, *(value(c) for c in every), F.when(is_old, F.col("_part")).otherwise(F.col("_to")).alias("_part"))
        kept = parts.join(hit.select("part"), "part", "left_anti")
    version, name = base + 1, f"{base + 1:012d}-{uuid.uuid4().hex}"
    rows = rows.withColumn("part", F.coalesce("_part", F.lit("none")))
    if rows.isEmpty():
        return base
    rows.withColumn("_part", F.col("part")).repartition("part").write.partitionBy("part").parquet(f"{path}/data/version={name}")
    written = spark.read.parquet(f"{path}/data/version={name}")
    stats = written.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")).withColumn("folder", F.lit(name)).select("part", "folder", "rows", "low", "high")
    (stats if kept is None else kept.unionByName(stats)).write.parquet(f"{path}/manifests/{name}")
    _commit(spark, path, version, name)
    return version


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete partitions that none of the last `keep` versions reads, those of merges that never committed among them; how many
    went. Not while another merge runs, or old versions are read."""
    known, used = versions(spark, path), set()
    for v in known[-keep:]:
        used |= {f"version={r['folder']}/part={r['part']}" for r in manifest(spark, path, v).select("folder", "part").collect()}
    _, at, fs = _files(spark, f"{path}/data")
    gone = 0
    for version in fs.listStatus(at) if fs.exists(at) else []:
        parts = [s.getPath() for s in fs.listStatus(version.getPath()) if s.isDirectory() and s.getPath().getName().startswith("part=")]
        unused = [p for p in parts if f"{version.getPath().getName()}/{p.getName()}" not in used]
        for p in [version.getPath()] if len(unused) == len(parts) else unused:
            fs.delete(p, True)
        gone += len(unused)
    for v in known[:-keep]:
        fs.delete(_files(spark, f"{path}/commits/{v:012d}")[1], False)
    return gone
