"""From raw documents to packed token sequences: five stages, each written as Parquet and read again by the next.

Part of the training-data subpackage. Every stage works on all rows that the one before it kept. All stages but the last
return the columns of documents: doc_id, text, lang, source, n_chars; further columns of docs, whatever their names, are
left out. Any of the columns may be null. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontamination, neardup, packing, pii, toxicity
from tapeloom.llm.common import is_held_out, materialise, scratch_path, small, table
from tapeloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. It learns from the labelled rows that are not held out. Null and empty
    texts, and all without labels to learn from, stay; of repeated ids and rows each is judged by its own text."""
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), ~is_held_out("doc_id", 4, 2))
    return scored.where("predicted = 0").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row, _key, written once: ids may be missing or repeated."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("_key"), *COLUMNS), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row stays, that of the smallest id (rows
    without an id come last). Blank texts are in no group: of those alike in id and text one stays, and all without an id."""
    docs = numbered(docs)
    rows = materialise(neardup.deduplicate(docs, size=5, num=80, den=100, row_col="_key"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")).alias("first")
    firsts = materialise(rows.groupBy("group").agg(F.count("*").alias("k"), first).where("k > 1").select("group", F.col("first._key").alias("_first")), "firsts")
    gone = rows.join(small(firsts), "group").where("_key != _first").select("_key", F.lit(True).alias("_gone"))
    blank = rows.where("n_shingles = 0 and doc_id is not null").select("_key", F.lit(False).alias("_gone"))
    marked = docs.join(small(materialise(gone.unionByName(blank), "marks")), "_key", "left")
    again = marked.where("not _gone").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return marked.where("_gone is null").select(*COLUMNS).unionByName(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten consecutive words of a benchmark item, or a shorter item as a whole, go; others of the same id
    stay, and so do null and empty texts. Without items all rows stay."""
    docs = numbered(docs)
    hit = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, row_col="_key").where("contaminated")
    return docs.join(small(materialise(hit.select("_key"), "contaminated")), "_key", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, is replaced by its kind; n_chars is counted anew (null for a null text). All rows
    stay."""
    clean = pii.detect(docs.select(*COLUMNS), redacted="clean")
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as sequences of 4096 token ids, a row per piece with its ids. Null and empty texts are their end sign alone;
    rows of repeated or missing ids are packed one by one."""
    return packing.pack(docs, tokenizer_path(), size=4096, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: Learned scores, random trees and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
