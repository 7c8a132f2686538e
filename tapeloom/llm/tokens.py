"""Token counts and token ids by way of pre-tokens.

A byte-pair tokenizer first cuts a text into pre-tokens and then splits each one by itself, so a pre-token always gives
the same pieces. `PreTokens` cuts texts exactly as the tokenizer file says; `count_tokens` counts the pieces of every
distinct pre-token once and joins those counts to the pre-token frequencies of each document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import materialise

#: Pre-tokens whose piece counts go to every task: the most frequent ones, at most this many.
HEAD = 65_536

#: Texts of these characters alone have one spelling under the tokenizer's normaliser but for white space and case, and
#: its classes of letters, digits and the rest are plain on them: ASCII and accented Latin letters.
_PLAIN = re.compile(r"[\t\n\r -~À-ĩĲ-ňŊ-ž]*\Z")
_CLIP = re.compile(r"[a-zß-öø-ž]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9ß-öø-ž]+")
#: The split pattern that _CLIP restates for plain texts (a fixed value of the vocabulary file).
_CLIP_OF = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: The sign of each byte in byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = dict(zip((b for b in range(256) if b not in _SHOWN), range(256, 512)))


class PreTokens:
    """Cuts texts into pre-tokens as a tokenizers file does; with added tokens as pieces of their own.

    Words are cut by one regular expression where the text and the file allow it, else by the library's own normaliser
    and pre-tokenizer. Added tokens (their strings in a text stand for themselves) are yielded as they are.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = self.tok.model
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pres = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and len(pres) == 2 and pres[0].get("pattern", {}).get("Regex") == _CLIP_OF and pres[1].get("type") == "ByteLevel" and not pres[1].get("add_prefix_space")
        self._marks = tuple(self.added)
        #: No pre-token goes across white space, so a plain text is cut word by word, and each word only once.
        self.words = Memo(_CLIP.findall, 100_000)

    def plain(self, text: str) -> bool:
        return self.fast and not any(m in text for m in self._marks) and _PLAIN.match(text) is not None

    def frequencies(self, text: str) -> dict[str, int]:
        if not self.plain(text):
            return Counter(self.cut(text))
        out: dict[str, int] = {}
        for word, k in Counter(text.lower().split()).items():
            for w in self.words[word]:
                out[w] = out.get(w, 0) + k
        return out

    def cut(self, text: str) -> list[str]:
        if self.plain(text):
            return _CLIP.findall(text.lower())
        out, at = [], 0
        for m in self.specials.finditer(text) if self.specials else ():
            out += self._slow(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._slow(text[at:])

    def _slow(self, text: str) -> list[str]:
        if self.tok.normalizer is not None:
            text = self.tok.normalizer.normalize_str(text)
        if not text or self.tok.pre_tokenizer is None:
            return [text] if text else []
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        if self.fast:  # a pre-token is normalised and cut already: only the merges are left
            if not (word.isascii() and word.isprintable()):
                word = word.encode().decode("latin-1").translate(_BYTE_SIGNS)
            return [t.id for t in self.model.tokenize(word)]
        return self.tok.encode(word, add_special_tokens=False).ids


class Memo(dict):
    """word -> make(word), kept for at most limit words at a time, so that a worker's memory stays bounded."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


def texts(batch: pa.RecordBatch, column: str = "text", step: int = 512) -> Iterator[tuple[int, str | None]]:
    """(row, text) of a batch, turned into Python strings a few rows at a time."""
    col = batch.column(batch.schema.get_field_index(column))
    for a in range(0, len(col), step):
        for i, x in enumerate(col.slice(a, step).to_pylist()):
            yield a + i, x


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """words (pretoken, ...) with pieces: how many ids the tokenizer makes of each pre-token."""

    def count(batches):
        pre = PreTokens(path)
        for b in batches:
            ws = b.column(b.schema.get_field_index("pretoken")).to_pylist()
            n = [len(pre.ids(w)) for w in ws]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "pieces"])

    return words.mapInArrow(count, T.StructType([*words.schema.fields, T.StructField("pieces", T.LongType())]))


def pretoken_totals(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pretoken, n): corpus frequency of every pre-token. Each task adds up what it reads before anything is shuffled."""

    def tally(batches):
        pre, seen = PreTokens(path), {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "n"])
            seen.clear()
            return out

        for b in batches:
            for _, x in texts(b, text):
                if x:
                    for w, k in pre.frequencies(x).items():
                        seen[w] = seen.get(w, 0) + k
                if len(seen) > 150_000:
                    yield flush()
        yield flush()

    return docs.select(text).mapInArrow(tally, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 2048, head: int = HEAD) -> DataFrame:
    """Tokens of every text: (id, n_bytes, n_tokens, over_limit), without making the ids of any document.

    Pass 1 finds the distinct pre-tokens and counts the pieces of each once. Pass 2 makes each document's pre-token
    frequencies; those of the `head` most frequent pre-tokens are weighted where they arise (a fixed number of entries
    goes to every task, which also takes care of hot keys), the rest are joined to the piece counts and summed.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows each come back. Null ids are kept. Columns of docs other
    than id and text are ignored. An empty table gives an empty result. path: a tokenizers .json file on every worker.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    counted = materialise(piece_counts(pretoken_totals(rows, path, "_text"), path), "pieces")
    top = counted.orderBy(F.desc("n"), "pretoken").limit(head).select("pretoken", "pieces").toPandas()  # at most `head` rows
    known = spark.sparkContext.broadcast(dict(zip(top["pretoken"].tolist(), top["pieces"].tolist(), strict=True)))

    def weigh(batches):
        pre, have = PreTokens(path), known.value

        def out(b, src, word, freq, size):
            at = pa.array(src, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(word, pa.string()), pa.array(freq, pa.int64()), pa.array(size, pa.int64())], names=names)

        for b in batches:
            src, word, freq, size = [], [], [], []
            for i, x in texts(b, "_text"):
                total, n = 0, 0
                if x:
                    n = len(x.encode())
                    for w, k in pre.frequencies(x).items():
                        p = have.get(w)
                        if p is None:
                            src.append(i), word.append(w), freq.append(k), size.append(None)
                        else:
                            total += k * p
                src.append(i), word.append(None), freq.append(total), size.append(n)
                if len(src) > 30_000:
                    yield out(b, src, word, freq, size)
                    src, word, freq, size = [], [], [], []
            if src:
                yield out(b, src, word, freq, size)

    schema = T.StructType([rows.schema["_row"], rows.schema["_id"], T.StructField("pretoken", T.StringType()), T.StructField("k", T.LongType()), T.StructField("n_bytes", T.LongType())])
    names = schema.names
    freqs = materialise(rows.mapInArrow(weigh, schema), "frequencies")
    rare = freqs.where("pretoken is not null").join(counted.select("pretoken", "pieces"), "pretoken").select("_row", "_id", (F.col("k") * F.col("pieces")).alias("k"), F.lit(None).cast("long").alias("n_bytes"))
    whole = freqs.where("pretoken is null").select("_row", "_id", "k", "n_bytes").unionByName(rare)
    total = F.sum("k")
    return whole.groupBy("_row").agg(F.max("_id").alias(id_col), F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"), (total > limit).alias("over_limit")).drop("_row")
