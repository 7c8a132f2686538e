"""The tape store: typed CSV ingest, partitioned Parquet tables, range scans, inventory, checks and ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _L, _S, _I, _B = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()
_OHLC = ("open", "high", "low", "close", "volume")

# Columns of the exchange's files, in order, with their types; and the names that some of them get.
SCHEMAS = {
    "klines": [("open_time", _L), *((c, _D) for c in _OHLC), ("close_time", _L), ("quote_volume", _D), ("count", _I), ("taker_buy_volume", _D), ("taker_buy_quote_volume", _D), ("ignore", _D)],
    "funding_rate": [("fundingTime", _L), ("fundingRate", _D), ("markPrice", _D), ("symbol", _S)],
    "metrics": [("create_time", _S), ("symbol", _S), ("sum_open_interest", _D), ("sum_open_interest_value", _D), ("count_toptrader_long_short_ratio", _D), ("sum_toptrader_long_short_ratio", _D), ("count_long_short_ratio", _D), ("sum_taker_long_short_vol_ratio", _D)],
    "agg_trades": [("agg_trade_id", _L), ("price", _D), ("qty", _D), ("first_trade_id", _L), ("last_trade_id", _L), ("transact_time", _L), ("is_buyer_maker", _B)],
}
RENAMES = {"count": "trade_count", "qty": "quantity"}
TIME = {"klines": "open_time", "funding_rate": "fundingTime", "metrics": "create_time", "agg_trades": "transact_time"}


def kind_of(data_type: str) -> str:
    """klines_4h, klines_15m ... are all klines."""
    return "klines" if data_type.startswith("klines") else data_type


def read_csv(spark: SparkSession, path, data_type: str, symbol: str | None = None, header: bool = True) -> DataFrame:
    """Exchange CSV with its declared types; '', NA and N/A are null, bad cells too, and rows with any are marked in _bad.
    Times become long milliseconds UTC; symbol is filled in where the file has none; source file and date (from its name)
    are kept."""
    kind = kind_of(data_type)
    fields = SCHEMAS[kind]
    raw = T.StructType([T.StructField(n, _S) for n, _ in fields] + [T.StructField("_corrupt", _S)])
    d = spark.read.schema(raw).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).csv(path)
    text = lambda c: F.when(~F.trim(c).isin("", "NA", "N/A"), F.trim(c))
    cols, bad = [], F.lit(False)
    for n, t in fields:
        v = text(n)
        if n == TIME[kind]:
            x = F.coalesce(v.try_cast("long"), F.unix_millis(F.try_to_timestamp(v)))
        else:
            x = v.try_cast(t)
        bad = bad | (v.isNotNull() & x.isNull())
        cols.append(x.alias(RENAMES.get(n, n)))
    name = F.col("_metadata.file_path")
    d = d.select(*cols, bad.alias("_bad"), name.alias("_file"), F.regexp_extract(name, r"(\d{4}-\d{2}(?:-\d{2})?)", 1).alias("_file_date"))
    if symbol:
        d = d.withColumn("symbol", F.coalesce("symbol", F.lit(symbol)) if "symbol" in d.columns else F.lit(symbol))
    return d


def read_kline_files(spark: SparkSession, path, symbol: str, interval: str) -> DataFrame:
    """Kline files without (or with) a header, of 11 or 12 columns: missing columns and bad cells are null, header lines go."""
    d = read_csv(spark, path, "klines", symbol, header=False)
    return d.where("open_time is not null").withColumn("interval", F.lit(interval))


def write_store(df: DataFrame, root: str, data_type: str, mode: str = "append", extra: tuple[str, ...] = ()) -> None:
    """Append to (or overwrite partitions of) the table of a data type, by symbol and UTC date, sorted by time in files."""
    ts = TIME[kind_of(data_type)]
    d = df.withColumn("date", F.date_format(F.timestamp_millis(F.col(ts)), "yyyy-MM-dd"))
    keys = ["symbol", *extra, "date"]
    d = d.repartition(*keys).sortWithinPartitions(*keys, ts)
    d.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(f"{root}/{data_type}")


def store(spark: SparkSession, root: str, data_type: str) -> DataFrame:
    """A table of the store, files merged by column names; partition columns stay text."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:  # the session's own setting holds again once the folders are listed
        return spark.read.option("mergeSchema", "true").parquet(f"{root}/{data_type}")
    finally:
        spark.conf.set(name, before)


def scan(df: DataFrame, symbol: str, start_ms: int, end_ms: int, columns: list[str] | None = None, ts: str = "open_time", closed: bool = True) -> DataFrame:
    """Rows of a symbol from start to end (both included, or the end left out), in time order. Where the table has a date
    partition, its bounds are added, so that other dates are not read."""
    t = F.col(ts)
    d = df.where((F.col("symbol") == symbol) & (t >= start_ms) & (t <= end_ms if closed else t < end_ms))
    if "date" in df.columns:
        day = lambda ms: F.date_format(F.timestamp_millis(F.lit(ms)), "yyyy-MM-dd")
        d = d.where((F.col("date") >= day(start_ms)) & (F.col("date") <= day(end_ms)))
    return (d.select(*columns) if columns else d).orderBy(ts)


def bar_events(df: DataFrame, symbol: str, start_ms: int, end_ms: int, smallest: float = 0.001) -> DataFrame:
    """Bars that open in [start, end) as events: ts_event is when they close (their open time where there is no
    close_time), volumes are at least `smallest`; in the order of events."""
    d = scan(df, symbol, start_ms, end_ms, ts="open_time", closed=False)
    when = F.coalesce("close_time", "open_time") if "close_time" in df.columns else F.col("open_time")
    return d.withColumn("volume", F.greatest("volume", F.lit(smallest))).withColumn("ts_event", when).orderBy("ts_event")


def first_filled(spark: SparkSession, roots: list[str], data_type: str) -> DataFrame | None:
    """The table of the first root that has rows of a data type; None if none has."""
    for root in roots:  # a few places
        try:
            d = store(spark, root, data_type)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        if not d.isEmpty():
            return d
    return None


def stride_sample(trades: DataFrame, start_ms: int, end_ms: int, k: int) -> DataFrame:
    """Every n-th trade of each symbol in time order, n so that at most k stay."""
    from tapeloom.operators.series import index_bars

    d = index_bars(trades.where(F.col("transact_time").between(start_ms, end_ms)), "symbol", "transact_time")
    n = d.groupBy("symbol").agg(F.count("*").alias("_n"))
    d = d.join(n, "symbol")
    return d.where(F.col("bar_idx") % F.ceil(F.col("_n") / F.lit(k)) == 0).drop("_n", "bar_idx")


def deduplicated(*parts: DataFrame) -> DataFrame:
    """Union by name, one row per symbol and open_time: the one of the last part that has it."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("symbol", "open_time", "_part")]
    return out.groupBy("symbol", "open_time").agg(F.max_by(F.struct(*rest), F.struct("_part", *rest)).alias("_r")).select("symbol", "open_time", "_r.*")


def better_source(local: DataFrame, other: DataFrame, end_ms: int, bar_ms: int) -> DataFrame:
    """Per symbol the local bars if they reach to within two bars of the end, else the other source's."""
    ok = local.groupBy("symbol").agg((F.max("open_time") >= end_ms - 2 * bar_ms).alias("_ok")).where("_ok").select("symbol")
    return local.join(ok, "symbol", "left_semi").unionByName(other.join(ok, "symbol", "left_anti"), allowMissingColumns=True)


def inventory(spark: SparkSession, root: str, data_type: str) -> DataFrame:
    """Per symbol: rows, files, megabytes, first and last date."""
    d = store(spark, root, data_type).select("symbol", "date", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
    files = d.groupBy("symbol", "f").agg(F.count("*").alias("n"), F.max("b").alias("b"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    return files.groupBy("symbol").agg(F.sum("n").alias("rows"), F.count("*").alias("files"), F.round(F.sum("b") / 1e6, 3).alias("mb"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"))


def validate_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Per file: rows, rows with a time, bytes, and whether it has rows and any times."""
    d = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("b"), F.col(key))
    return d.groupBy("file").agg(F.count("*").alias("rows"), F.count(key).alias("keys"), F.max("b").alias("bytes")).withColumn("valid", (F.col("rows") > 0) & (F.col("keys") > 0))


def manifest_path(root: str, data_type: str) -> str:
    """Where the manifest of a table is by default: a folder that readers of the table pass over."""
    return f"{root}/{data_type}/_manifest"


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, source, batch, rows, converted_at) of every committed conversion of a file; None before the first."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def source_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified, bytes) of the files under a pattern, empty ones too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    rows = [(s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in found if s.isFile()]
    return spark.createDataFrame(rows, "path string, modified long, bytes long").withColumn("modified", F.timestamp_millis("modified"))


def pending_files(spark: SparkSession, pattern: str, done: DataFrame | None) -> DataFrame:
    """Source files (path, modified) that the manifest (path, converted_at) lacks or has older."""
    found = source_files(spark, pattern)
    if done is None:
        return found
    newest = done.groupBy("path").agg(F.max("converted_at").alias("converted_at"))
    return found.join(newest, "path", "left").where(F.col("converted_at").isNull() | (F.col("converted_at") < F.col("modified"))).drop("converted_at")


def convert(spark: SparkSession, pattern: str, root: str, data_type: str, symbol: str, manifest_at: str | None = None) -> DataFrame:
    """Convert what is new under a pattern: one row of counts (converted, skipped, empty, failed).

    Rows are written first, as a batch of their own (a level of folders between symbol and date); then one file of the manifest
    names the batch and its sources, and only then readers see it. A run that dies in between leaves a batch that is nobody's,
    and the next run does the work again. A file that has changed is converted anew, and its older rows are passed over. Files
    without a row that has a time are failed and tried again by the next run; empty ones are done.
    """
    where = manifest_at or manifest_path(root, data_type)
    done = manifest(spark, where)
    todo = pending_files(spark, pattern, done).select("path", "bytes", F.current_timestamp().alias("at")).collect()  # file names only
    full = [r["path"] for r in todo if r["bytes"]]
    batch, total = uuid.uuid4().hex, source_files(spark, pattern).count()
    found = spark.createDataFrame([], "path string, rows long")
    if full:
        d = read_csv(spark, full, data_type, symbol).where(F.col(TIME[kind_of(data_type)]).isNotNull())
        d = d.withColumns({"source": F.xxhash64(_file_key("_file")), "batch": F.lit(batch)})
        write_store(d.drop("_file", "_file_date", "_bad"), root, data_type, extra=("batch",))
        counted = spark.read.parquet(f"{root}/{data_type}/symbol=*/batch={batch}").groupBy("source").agg(F.count("*").alias("rows")) if not d.isEmpty() else None
        names = spark.createDataFrame([(p,) for p in full], "path string").withColumn("source", F.xxhash64(_file_key("path")))
        found = names.join(counted, "source").select("path", "rows") if counted is not None else found
    ok = [(r["path"], r["rows"]) for r in found.collect()] + [(r["path"], 0) for r in todo if not r["bytes"]]
    if ok:
        rows = spark.createDataFrame(ok, "path string, rows long").select("path", F.xxhash64(_file_key("path")).alias("source"), F.lit(batch).alias("batch"), "rows", F.lit(todo[0]["at"]).alias("converted_at"))
        _commit(rows, where)
    empty = len(todo) - len(full)
    return spark.createDataFrame([(len(ok) - empty, total - len(todo), empty, len(full) - len(ok) + empty)], "converted long, skipped long, empty long, failed long")


def _file_key(c: str):
    """The part of a file's address that is the same however it is written."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(F.col(c), r"\+", "%2B")), "^[a-z]+:/+", "/")


def _commit(rows: DataFrame, where: str) -> None:
    """One file, which is there as a whole or not at all."""
    rows.coalesce(1).write.mode("append").parquet(where)


def committed(spark: SparkSession, root: str, data_type: str, manifest_at: str | None = None) -> DataFrame:
    """A converted table as its manifest has it: of each source the rows of its last committed batch."""
    done = manifest(spark, manifest_at or manifest_path(root, data_type))
    if done is None:
        raise FileNotFoundError(f"no conversion of {data_type} under {root} was committed")
    valid = done.groupBy("source").agg(F.max_by("batch", "converted_at").alias("batch"))
    return store(spark, root, data_type).join(valid, ["source", "batch"], "left_semi").drop("source", "batch")


def checksums(spark: SparkSession, pattern: str, published: DataFrame) -> DataFrame:
    """Files against published hashes (name, sha256): ok, mismatch or unpublished."""
    f = spark.read.format("binaryFile").load(pattern).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    d = f.join(published, "name", "left")
    return d.select("name", F.when(F.col("sha256").isNull(), "unpublished").when(F.lower("sha256") == F.col("actual"), "ok").otherwise("mismatch").alias("state"))


def write_splits(rows: DataFrame, root: str, tags: dict[str, object]) -> None:
    """A dataset once for every split whose condition a row meets, by symbol and split; the whole set is the table."""
    split = F.array_compact(F.array(*(F.when(c, n) for n, c in tags.items())))
    rows.withColumn("split", F.explode(split)).repartition("symbol", "split").write.mode("overwrite").partitionBy("symbol", "split").parquet(root)


def monthly_funding(funding: DataFrame, root: str) -> None:
    month = F.date_format(F.timestamp_millis("fundingTime"), "yyyy-MM")
    funding.withColumn("month", month).repartition("symbol", "month").write.mode("overwrite").partitionBy("symbol", "month").parquet(root)


def sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Any query over the named tables."""
    for name, d in tables.items():
        d.createOrReplaceTempView(name)
    return spark.sql(text)
