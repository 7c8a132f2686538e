"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations alone.

A window of an item (consecutive words) is a set of shingles. A document contains the window only if it contains each of
them, so the prefix of its shingles in the order of rarity that is necessary to find it is one: the rarest. Rarity is
reckoned from the frequencies of the items' words over all documents, counted first, so that only the rarest shingle of
each window is ever joined to the documents. Its place in the window and in the document fix where the window would have
to begin, which bounds position and length, and the words that stand there prove or disprove the containment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import materialise, small

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    """The words of a text: runs of ASCII letters and digits and of all non-ASCII characters, A-Z made lower case."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _SPLIT), "")  # only the first and the last part can be empty


def shingles(w: str, size: int):
    """A hash of `size` words from every place of the array w on; the last size - 1 hold fewer words."""
    rest = "".join(f", get({w}, i + {k})" for k in range(1, size))
    return F.expr(f"transform({w}, (x, i) -> xxhash64(x{rest}))")


def item_windows(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """(item_id, words of one window): every run of `size` words of an item, or a shorter item as a whole."""
    rows = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("w"))


def necessary(windows: DataFrame, tokens: DataFrame, shingle: int) -> DataFrame:
    """windows (window, w) -> (window, n, k, place, h): the rarest shingle of each window, k words from place on.

    The documents' frequencies of the windows' words, of which a shingle's expected frequency is the product, rank the
    shingles; a window with a word that stands nowhere is nowhere, and left out.
    """
    vocabulary = materialise(windows.select(F.explode("w").alias("word")).distinct(), "vocabulary")
    counted = tokens.select(F.explode("w").alias("word")).join(small(vocabulary), "word").groupBy("word").agg(F.count("*").alias("f"))
    counted = materialise(counted, "word-counts")
    placed = windows.select("window", F.size("w").alias("n"), F.posexplode("w").alias("at", "word"))
    known = placed.join(small(counted), "word").groupBy("window", "n").agg(F.array_sort(F.collect_list(F.struct("at", F.log("f").alias("f"), "word"))).alias("p"))
    parts = known.where(F.size("p") == F.col("n")).withColumn("k", F.least("n", F.lit(shingle)))
    sums = "transform(sequence(0, n - k), i -> struct(aggregate(slice(p, i + 1, k), 0D, (s, x) -> s + x.f) AS f, i AS place))"
    best = parts.select("window", "n", "k", F.expr("transform(p, x -> x.word)").alias("w"), F.expr(f"array_min({sums})").alias("best"))
    sizes = [F.when(F.col("k") == size, F.get(shingles("w", size), F.col("best.place"))) for size in range(1, shingle + 1)]
    return best.select("window", "n", "k", F.col("best.place").alias("place"), F.coalesce(*sizes).alias("h"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", row_col: str | None = None) -> DataFrame:
    """Which words of each document lie in an occurrence of a window of a benchmark item.

    One row per row of docs: (id, n_words, n_hit, n_items, items (ids as sorted strings), contaminated). Null and empty
    texts have no words; items without words and null item texts have no windows; null item ids never count, though
    their windows hit. Repeated items count once an id, repeated documents each come back. Without items nothing is hit.
    Columns other than id and text are ignored. row_col: a column of docs, a written table, with a number of each row; the
    result has it too.
    """
    key = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    split = docs.select(key.alias("_row"), F.col(id_col).alias("_id"), words(F.col(text)).alias("w"))
    tokens = materialise(split.select("_row", "_id", F.size("w").cast("long").alias("n_words"), "w"), "words")  # split once, numbered once
    own = [F.col("_row").alias(row_col)] if row_col else []
    of_item = materialise(item_windows(items, window, item_id, item_text), "item-windows")
    windows = materialise(of_item.select("w").distinct().select(F.monotonically_increasing_id().alias("window"), "w"), "windows")
    prefix = materialise(necessary(windows, tokens, shingle), "prefix")

    # candidates: where the necessary shingle of a window stands, and the window fits around it
    candidates = None
    for k in sorted(r["k"] for r in prefix.select("k").distinct().collect()):  # at most `shingle` values
        stands = tokens.where(F.col("n_words") >= k).select("_row", "n_words", F.posexplode(shingles("w", k)).alias("pos", "h"))
        start = F.col("pos") - F.col("place")
        here = stands.join(small(prefix.where(F.col("k") == k).drop("k")), "h").where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        here = here.select("_row", start.alias("start"), "window", "n")
        candidates = here if candidates is None else candidates.unionByName(here)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    columns = [F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"), *own]
    if candidates is None:
        return tokens.withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items": F.array().cast("array<string>")}).select(*columns)
    candidates = materialise(candidates, "candidates")

    # the words that stand there are those of the window
    there = tokens.select("_row", "w").join(small(candidates), "_row").select("_row", "start", "window", "n", F.slice("w", F.col("start") + 1, F.col("n")).alias("x"))
    hits = there.join(small(windows), "window").where("x = w").select("_row", "start", "n", "window")
    hits = materialise(hits, "hits")

    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("_row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, "start")))
    covered = hits.withColumn("fresh", fresh).groupBy("_row").agg(F.sum("fresh").alias("n_hit"))
    named = materialise(of_item.where("item_id is not null").join(small(windows), "w").select("window", F.col("item_id").cast("string").alias("item_id")).distinct(), "named")
    which = hits.select("_row", "window").distinct().join(small(named), "window").select("_row", "item_id").distinct().groupBy("_row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items"))
    result = materialise(covered.join(which, "_row", "left"), "hit-documents")
    return tokens.select("_row", "_id", "n_words").join(small(result), "_row", "left").select(*columns)
