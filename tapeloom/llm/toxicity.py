"""Toxicity by Levenshtein automata intersected with a lexicon trie, and scores of the window around each hit.

The lexicon is learned from labelled rows. All its terms stand in one trie; the automaton that accepts every word within
a term's edit budget is run over the trie and made deterministic as words ask for it, so that most words die after a few
characters. A hit counts in full where it is abuse, and little where its window shows that it is quoted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import materialise, small
from tapeloom.llm.neardup import shingle_set, signature
from tapeloom.llm.tokens import Memo, texts

#: Labelled rows that the lexicon and the weights are learned from, at most (about: rows are picked by a hash of their id).
FIT_ROWS = 30_000
#: Tokens of a signature by which near-copies among them are told, and the share of equal ones that makes two rows copies.
COPY_TOKENS, COPY_SHARE = 16, 0.5

_EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’*_~-–—…|%&$#"
_QUOTES = "\"«»„“”"
# Words that report what somebody else said.
_REPORTS = frozenset(
    "said says wrote called quote quoted quoting word words term phrase meaning definition example"
    " sagte schrieb nannte zitat zitiert wort wörter begriff dit écrit appelé citation cite mot mots terme"
    " dijo escribió llamó cita citó palabra palabras término".split()
)
#: Letters of a beginning that may be a stem, least and most; states that an automaton keeps before it starts afresh.
STEM_LETTERS, MOST_STATES = (4, 24), 200_000
_SPAN = 8  # words on either side of a hit that make its window
_FUZZY, _QUOTED, _REPORTED = 0.7, 0.3, 0.1


def budget(term: str) -> int:
    """Edits that a misspelling may have: none for short terms, one from 5 letters on, two from 10 on."""
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


class Automaton:
    """Levenshtein automata (with transpositions) of all terms, intersected with their trie, determinised lazily.

    A state is a set of (trie node, edits so far, awaited letter); the letter is set halfway through a transposition.
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = ()):
        self.child: list[dict[str, int]] = [{}]
        self.most = [0]  # the largest budget of the terms below a node
        self.term: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        for word, ends, edits in [*((t, self.term, budget(t)) for t in terms), *((s, self.stem, 0) for s in stems)]:
            at = 0
            self.most[0] = max(self.most[0], edits)
            for c in word:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({}), self.most.append(0)
                at = self.child[at][c]
                self.most[at] = max(self.most[at], edits)
            ends[at] = word
        self._forget()

    def _forget(self) -> None:
        """No states but the first two: they come back as words ask for them."""
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[int, str] | None] = []  # (edits, term) if a word may end here
        self.done: list[tuple[int, str] | None] = []  # set where a stem has been read in full: the rest doesn't matter
        self.dead = self._state(frozenset())
        self.start = self._state(self._close({(0, 0, "")}))

    def _close(self, states: set) -> frozenset:
        """With the states that leave out letters of a term."""
        todo, out = list(states), set(states)
        while todo:
            node, e, wait = todo.pop()
            if wait:
                continue
            for to in self.child[node].values():
                if e + 1 <= self.most[to] and (to, e + 1, "") not in out:
                    out.add((to, e + 1, ""))
                    todo.append((to, e + 1, ""))
        return frozenset(out)

    def _state(self, states: frozenset) -> int:
        if states in self.ids:
            return self.ids[states]
        k = self.ids[states] = len(self.sets)
        self.sets.append(states), self.next.append({})
        ends = [(e, self.term[n]) for n, e, wait in states if not wait and n in self.term and e <= budget(self.term[n])]
        self.found.append(min(ends, default=None))
        self.done.append(min(((e, self.stem[n]) for n, e, wait in states if not wait and e == 0 and n in self.stem), default=None))
        return k

    def _step(self, at: int, c: str) -> int:
        out = set()
        for node, e, wait in self.sets[at]:
            if wait:
                if wait == c:
                    out.add((node, e, ""))
                continue
            for x, to in self.child[node].items():
                if x == c:
                    out.add((to, e, ""))
                elif e + 1 <= self.most[to]:
                    out.add((to, e + 1, ""))
                    over = self.child[to].get(c)
                    if over is not None and e + 1 <= self.most[over]:
                        out.add((over, e + 1, x))
            if e + 1 <= self.most[node]:
                out.add((node, e + 1, ""))
        k = self.next[at][c] = self._state(self._close(out))
        return k

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term, or None. A word that begins with a stem is a match without edits."""
        if len(self.sets) > MOST_STATES:
            self._forget()
        at, rows, done = self.start, self.next, self.done
        for c in word:
            to = rows[at].get(c)
            if to is None:
                to = self._step(at, c)
            if to == self.dead:
                return None
            if done[to] is not None:
                return done[to]
            at = to
        return self.found[at]


def _signs(word: str) -> tuple[bool, bool]:
    """(opens, closes): a quote sign stands before, or behind, all letters and digits of the word."""
    if not any(q in word for q in _QUOTES):
        return False, False
    core = [k for k, c in enumerate(word) if c.isalnum()]
    if not core:  # a sign that stands alone may be either
        return True, True
    return any(c in _QUOTES for c in word[: core[0]]), any(c in _QUOTES for c in word[core[-1] + 1 :])


def in_quotes(words: list[str], i: int) -> bool:
    """Whether, within _SPAN words of word i, the nearest sign before it opens a quotation and the nearest behind it closes
    one. Signs further off, or without a partner there, play no part."""
    opens, closes = _signs(words[i])
    if not opens:
        for k in range(i - 1, max(-1, i - _SPAN - 1), -1):
            before = _signs(words[k])
            if any(before):
                opens = before[0] and not (before[1] and any(c.isalnum() for c in words[k]))
                break
    if not closes:
        for k in range(i + 1, min(len(words), i + _SPAN + 1)):
            after = _signs(words[k])
            if any(after):
                closes = after[1] and not (after[0] and any(c.isalnum() for c in words[k]))
                break
    return opens and closes


class Lexicon:
    """Terms and stems with what is needed to judge a text; small, and sent to every task."""

    def __init__(self, terms: Iterable[str] = (), stems: Iterable[str] = (), allowed: Iterable[str] = (), weights: tuple = ()):
        self.terms, self.stems, self.allowed, self.weights = list(terms), list(stems), frozenset(allowed), weights

    def matcher(self):
        """A memo of word -> weight of a hit on it (0 for none), or (the bare word, its stem) where it begins with one."""
        auto, allowed, stems, terms = Automaton(self.terms, self.stems), self.allowed, frozenset(self.stems), frozenset(self.terms)

        def judge(word: str):
            w = word.strip(_EDGE)
            if len(w) < 3:
                return 0.0
            got = auto.match(w)
            if got is None:
                return 0.0
            edits, term = got
            if term in stems and w not in terms:
                return w, term
            if edits == 0:
                return 1.0
            if w in allowed or len(term) < 5 and w.isalpha():
                return 0.0
            return _FUZZY**edits

        return Memo(judge)

    def features(self, text: str, memo) -> list[float]:
        """(abuse, quoted, densest window): what the score is made of; zeros without a hit. The length plays no part.

        A stem is abuse where the text has two or more different words that begin with it; one such word is chance.
        """
        words = text.lower().split()
        hits = {w: k for w in set(words) if (k := memo[w])}
        endings: dict[str, set[str]] = {}
        for k in hits.values():
            if isinstance(k, tuple):
                endings.setdefault(k[1], set()).add(k[0])
        if endings:
            hits = {w: 1.0 if isinstance(k, tuple) else k for w, k in hits.items() if not isinstance(k, tuple) or len(endings[k[1]]) > 1}
        if not hits:
            return [0.0, 0.0, 0.0]
        spots = [(i, hits[w]) for i, w in enumerate(words) if w in hits]
        abuse = quoted = 0.0
        kept = []
        for i, weight in spots:
            factor = 1.0
            if in_quotes(words, i):
                near = {w.strip(_EDGE) for w in words[max(0, i - _SPAN) : i + _SPAN + 1]}
                factor = _REPORTED if near & _REPORTS else _QUOTED
                quoted += weight
            abuse += weight * factor
            kept.append((i, weight * factor))
        best, low, total = 0.0, 0, 0.0
        for i, weight in kept:
            total += weight
            while kept[low][0] < i - 50:
                total -= kept[low][1]
                low += 1
            best = max(best, total)
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(best)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(x))
        w = np.asarray(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -60, 60)))


def _grams(text: str) -> set[str]:
    """Distinct words of a text and, marked by a star, the beginnings that two or more of them share."""
    words = {w.strip(_EDGE) for w in set(text.lower().split())}
    words.discard("")
    least, most = STEM_LETTERS
    once: set[str] = set()
    shared: set[str] = set()
    for w in words:
        for n in range(least, min(len(w), most + 1)):
            head = w[:n]
            (shared if head in once else once).add(head)
    return words | {h + "*" for h in shared}


def one_of_copies(rows: DataFrame) -> DataFrame:
    """rows (_id, text, y) without near-copies: of those that share the least hash of their word pairs, the one of the smallest
    id stays, and those with under half of its minwise tokens, so that the words of one much-copied text don't pass for
    evidence. Rows without words teach nothing and go."""

    def run(batches):
        memo = Memo(xxhash.xxh3_64_intdigest)
        for b in batches:
            sets = [shingle_set(x, 2, memo) for _, x in texts(b, "text")]
            least = [int(s[0]) - (1 << 63) if len(s) else None for s in sets]
            signs = [signature(s, COPY_TOKENS).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(least, pa.int64()), pa.array(signs, pa.binary())], names=["_id", "least", "sig"])

    schema = T.StructType([rows.schema["_id"], T.StructField("least", T.LongType()), T.StructField("sig", T.BinaryType())])
    known = materialise(rows.select("_id", "text").mapInArrow(run, schema).where("least is not null"), "toxic-signatures")
    first = known.groupBy("least").agg(F.min(F.struct("_id", "sig")).alias("f")).select("least", F.col("f._id").alias("first"), F.col("f.sig").alias("other"))

    def apart(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, COPY_TOKENS) for k in (2, 3))
            keep = ((x == y).mean(axis=1) < COPY_SHARE) | np.asarray(pc.equal(b.column(0), b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["_id"]).filter(pa.array(keep))

    kept = known.join(first, "least").select("_id", "first", "sig", "other").mapInArrow(apart, T.StructType([rows.schema["_id"]])).distinct()
    return rows.join(small(materialise(kept, "toxic-kept")), "_id")


def word_counts(rows: DataFrame) -> DataFrame:
    """rows (text, y) -> (word, toxic, clean): in how many rows of either label a word or a beginning stands."""

    def tally(batches):
        seen: dict[str, list[int]] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["word", "clean", "toxic"])
            seen.clear()
            return out

        for b in batches:
            ys = b.column(1).to_pylist()
            for i, x in texts(b, "text"):
                y = ys[i]
                for w in _grams(x or ""):
                    got = seen.get(w)
                    if got is None:
                        got = seen[w] = [0, 0]
                    got[y] += 1
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    return rows.select("text", F.col("y").cast("int").alias("y")).mapInArrow(tally, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def choose_terms(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """Words that stand in toxic rows too often for chance (binomial log-likelihood against the number of candidates), and
    productive stems: beginnings that two or more different words of a row share, by the same test over rows. Of stems that
    begin alike the strongest stays, the longest if equal; words that begin with a stem are no terms of their own."""
    base = n_toxic / max(1, n_toxic + n_clean)
    if not 0 < base < 1:
        return [], []
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = a / (a + b)
    gain = a * F.log(share / base) + F.when(b > 0, b * F.log((1 - share) / (1 - base))).otherwise(0.0)
    tried = counts.where("toxic > 1").count()
    strong = (share >= 0.6) & (share > base) & (gain >= math.log(max(2, tried)) + 3)
    rows = counts.where("toxic > 1").where(strong).withColumn("gain", gain).orderBy(F.desc("gain"), F.desc(F.length("word")), "word").collect()  # of a bounded sample
    stems: list[str] = []
    for r in rows:
        s = r["word"][:-1]
        if r["word"].endswith("*") and not any(s.startswith(k) or k.startswith(s) for k in stems):
            stems.append(s)
    heads = tuple(stems)
    terms = [r["word"] for r in rows if not r["word"].endswith("*") and len(r["word"]) > 2 and not (heads and r["word"].startswith(heads))]
    return terms, sorted(stems)


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 40) -> tuple:
    """Logistic regression by Newton's method with an L2 penalty; rows of equal statistics weigh alike."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w)), grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def feature_rows(rows: DataFrame, lexicon, keep: list[str]) -> DataFrame:
    """rows (text, keep...) -> keep... and x, the statistics of the text."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        lex = lexicon.value
        memo = lex.matcher()
        for b in batches:
            x = [lex.features(t or "", memo) for _, t in texts(b, "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(keep))), pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    return rows.select("text", *keep).mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", id_col: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> Lexicon:
    """The lexicon, the clean words near it and the weights, from at most about fit_rows labelled rows."""
    spark = docs.sparkSession
    known = labels.where(train).where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).alias("y"))
    n = known.count()
    share = min(1.0, fit_rows / n) if n else 1.0
    known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))  # about fit_rows: small enough to send to every task
    rows = materialise(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(small(materialise(known.withColumnRenamed(id_col, "_id"), "toxic-labels")), "_id").select("_id", "text", "y"), "toxic-copies")
    rows = materialise(one_of_copies(rows).select("text", "y"), "toxic-fit")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    counts = materialise(word_counts(rows), "toxic-words")
    terms, stems = choose_terms(counts, sizes.get(1, 0), sizes.get(0, 0))
    if not terms and not stems:
        return Lexicon()
    draft = spark.sparkContext.broadcast(Lexicon(terms, stems))

    def near(batches):
        lex = draft.value
        auto = Automaton(lex.terms)
        for b in batches:
            ws = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([w for w in ws if (m := auto.match(w)) and m[0] > 0], pa.string())], names=["word"])

    clean = counts.where("clean > 0 and clean >= toxic and not endswith(word, '*')")
    allowed = [r["word"] for r in clean.select("word").mapInArrow(near, "word string").collect()]  # of a bounded sample
    lexicon = Lexicon(terms, stems, allowed)
    got = feature_rows(rows, spark.sparkContext.broadcast(lexicon), ["y"]).groupBy("y", "x").agg(F.count("*").alias("n")).toPandas()  # of a bounded sample
    x, y, n_rows = np.asarray(got["x"].tolist(), float).reshape(-1, 3), got["y"].to_numpy(float), got["n"].to_numpy(int)
    lexicon.weights = fit_weights(np.repeat(x, n_rows, axis=0), np.repeat(y, n_rows))
    return lexicon


def score_toxicity(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", id_col: str = "doc_id", text: str = "text", threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Learn from the labelled rows for which `train` holds and score every row of docs: docs with score and predicted.

    score is the probability of label 1, predicted is 1 from the threshold on. Null and empty texts have no hits. Ids
    labelled more than once count with their largest label; null ids and labels teach nothing; without rows of both
    labels, or without any term, every score is 0. All columns and rows of docs are kept (score and predicted are
    replaced); repeated rows each come back; nothing of the texts is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, train, label, id_col, text, fit_rows))
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    at, names = docs.schema.names.index(text), docs.schema.names

    def run(batches):
        lex = shared.value
        memo = lex.matcher()
        for b in batches:
            x = np.array([lex.features(t or "", memo) for _, t in texts(b.select([at]), text)], float).reshape(-1, 3)
            s = lex.score(x)
            cols = [b.column(names.index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"), pa.int32())], names=[f.name for f in keep] + ["score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
