"""Near-duplicate documents by a chosen-path set similarity join.

Each document is a set of word shingles with a signature of minwise tokens. A tree starts with all documents at its root;
every node picks, by its own hash, on average 1 / threshold places of the signature, and its documents go down to the
children named by the tokens they have there, so that similar ones tend to stay together. Small nodes compare all their
documents, on their full sets, and give no more links than it takes to join what belongs together; larger ones do so in
blocks that all hold the node's pivot. Independent trees repeat this, a few at a time, until the recall aimed at is reached,
and look only at what is not in one group yet. What shares a larger node and is still apart starts again at the roots of
deeper trees, as many more as that depth takes for the same recall, so that no pair depends on staying together in trees
counted for fewer levels. Components of links are the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import materialise, small
from tapeloom.llm.components import components
from tapeloom.llm.tokens import Memo, texts

#: Minwise tokens of a signature, and levels of the trees of each round.
TOKENS, DEPTHS = 64, (3, 6, 9)
#: The first trees that a new turn begins with: the first tree alone joins most of what belongs together.
TURNS = (1, 3)
#: Documents of a block, and shingles of all its documents together; a node of one block is compared in full.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Documents of either side of a cell, in which larger nodes are compared in the end.
CELL = 1024
#: Documents that each document may be compared with there, on average over all documents, before nodes are split further.
COMPARED = 4096
_MULT = np.random.default_rng(20240517).integers(1, 2**63, (2, TOKENS), dtype=np.uint64) | np.uint64(1)
_C1, _C2, _C3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> _S)


def shingle_set(text: str | None, size: int, memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z, words end at ASCII white space. A text of
    fewer words is one shingle, one without words the empty set."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64) + np.uint64(n)
    for k in range(n):
        out = _mix(out * _C3 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(hashes: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """The first of TOKENS minwise tokens of a set, 32 bits each."""
    best = np.full(tokens, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 4096):
        z = hashes[None, a : a + 4096] * _MULT[0][:tokens, None] + _MULT[1][:tokens, None]
        best = np.minimum(best, (z ^ (z >> _S)).min(axis=1))
    return (_mix(best) >> _S).astype(np.uint32)


def trees_needed(threshold: float, levels: int, recall: float) -> int:
    """Trees for which two sets of the threshold's similarity share a node at that depth, in one at least, with
    probability recall; a node picks one place, and a second one with probability 1 / threshold - 1. All trees share the
    signature, so the probability is taken over the number of its places at which such sets agree."""
    extra = min(1.0, 1 / threshold - 1)
    p = np.arange(TOKENS + 1) / TOKENS
    weight = np.array([math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k) for k in range(TOKENS + 1)])
    s = np.ones(TOKENS + 1)
    for _ in range(levels):
        s = (1 - extra) * p * s + extra * (1 - (1 - p * s) ** 2)
    trees = 1
    while weight @ (1 - s) ** trees > 1 - recall:
        trees += 1
    return trees


def branch(nodes: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for every row's children: a node's own hash picks the places."""
    pick = _mix(nodes + _C3)
    extra = (_mix(nodes ^ _C2) >> np.uint64(11)).astype(np.float64) / float(1 << 53) < min(1.0, 1 / threshold - 1)
    rows = np.arange(len(nodes))
    both_rows = np.concatenate([rows, rows[extra]])
    first = (pick % np.uint64(TOKENS)).astype(np.int64)
    second = (first + 1 + ((pick >> np.uint64(20)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
    place = np.concatenate([first, second[extra]])
    child = _mix(nodes[both_rows] * _C1 + _mix((place.astype(np.uint64) << _S) + signatures[both_rows, place]))
    return both_rows, child


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """docs (_row, _id, _text) -> (_row, _id, n, key, sig): set size, hash of the whole set (null if empty), signature."""

    def run(batches):
        memo = Memo(xxhash.xxh3_64_intdigest)
        for b in batches:
            n, key, sig = [], [], []
            for _, x in texts(b, "_text"):
                s = shingle_set(x, size, memo)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["_row", "_id", "n", "key", "sig"])

    schema = T.StructType([docs.schema["_row"], docs.schema["_id"], T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _nodes(reps: DataFrame, trees: int, levels: int, threshold: float) -> DataFrame:
    """(turn, node, rep, n) at that depth of every tree; trees of other depths are others. turn: see TURNS."""

    def run(batches):
        roots = _mix(np.arange(1, trees + 1, dtype=np.uint64) + np.uint64((levels - DEPTHS[0]) << 32))
        turn_of = np.searchsorted(np.asarray(TURNS), np.arange(trees), side="right").astype(np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            sig = _sigs(b.column(2))
            row, node, turn = np.repeat(np.arange(len(sig)), trees), np.tile(roots, len(sig)), np.tile(turn_of, len(sig))
            for _ in range(levels):
                at, node = branch(node, sig[row], threshold)
                row, turn = row[at], turn[at]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(turn), pa.array(node.astype(np.int64), pa.int64()), b.column(0).take(at), b.column(1).take(at)], names=["turn", "node", "rep", "n"])

    return reps.select("rep", "n", "sig").mapInArrow(run, "turn int, node long, rep long, n long")


def _floor(threshold: float) -> float:
    """Share of equal tokens that a pair at the threshold stays above, by five standard deviations."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / TOKENS)


class Links:
    """Links between the documents of one task, found on their full sets (None: only `_near` works). Documents that are in one group already, or got
    there by links found here, are not compared any more, so that no more links come out than join groups."""

    def __init__(self, rep, n, g, sig, sets, num: int, den: int):
        self.rep, self.n, self.g, self.sig, self.sets, self.num, self.den = rep, n, g.copy(), sig, sets, num, den
        self.floor, self.found = _floor(num / den), []

    def _near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Share of tokens equal to those of i, or 0 for others in the group of i or ruled out by size or signature."""
        n, k = self.n[others], self.n[i]
        same = (self.sig[others] == self.sig[i]).mean(axis=1)
        return same * ((same >= self.floor) & (self.g[others] != self.g[i]) & (np.minimum(n, k) * self.den >= np.maximum(n, k) * self.num))

    def _is_link(self, shared, sizes):
        """Of so many shared shingles, and shingles of both documents together."""
        return shared * self.den >= (sizes - shared) * self.num

    def _join(self, i: int, j: int) -> None:
        if self.g[j] != self.g[i]:
            self.found.append((self.rep[i], self.rep[j]))
            self.g[self.g == self.g[j]] = self.g[i]

    def _try(self, i: int, others: np.ndarray, near: np.ndarray) -> None:
        """Document i with those others that are near, the most alike first, one by one."""
        for j in others[np.argsort(-near, kind="stable")[: np.count_nonzero(near)]]:
            if self.g[j] != self.g[i]:
                x, y = self.sets[i], self.sets[j]
                if self._is_link(len(x) + len(y) - len(np.union1d(x, y)), len(x) + len(y)):
                    self._join(i, j)

    def one(self, i: int, others: np.ndarray) -> None:
        """Document i with each of the others."""
        self._try(i, others, self._near(i, others))

    def all_of(self, left: np.ndarray, right: np.ndarray | None = None) -> None:
        """Each document of left with each of right, or of left; a matrix product counts what many pairs share."""
        if not len(left) or right is not None and not len(right):
            return
        near = np.stack([self._near(i, left if right is None else right) for i in left])
        if right is None:
            near, right = np.triu(near, 1), left
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        pairs, mean = np.count_nonzero(near), self.n[np.concatenate([left[rows], right[columns]])].mean() if len(rows) else 0
        if pairs * (2e-5 + 4e-8 * mean) <= 2e-3 + 2e-11 * len(rows) * len(columns) * (len(rows) + len(columns)) * mean:
            for k in rows:
                self._try(left[k], right, near[k])
            return
        x, y = left[rows], right[columns]
        linked = self._is_link(self._shared(x, y), self.n[x][:, None] + self.n[y]) & (near[np.ix_(rows, columns)] > 0)
        for k, m in np.argwhere(linked):
            self._join(x[k], y[m])

    def _shared(self, rows: np.ndarray, columns: np.ndarray, step: int = 4096) -> np.ndarray:
        """How many shingles each document of rows shares with each of columns."""
        docs = [*rows, *columns]
        values = np.concatenate([self.sets[i] for i in docs])
        order = np.argsort(values)
        doc = np.repeat(np.arange(len(docs)), [len(self.sets[i]) for i in docs])[order]
        number = np.cumsum(np.concatenate([[0], np.diff(values[order]) != 0]))
        often = np.bincount(number) > 1
        doc, number = doc[often[number]], (np.cumsum(often) - 1)[number[often[number]]]
        out = np.zeros((len(rows), len(columns)), np.float32)
        for a in range(0, int(often.sum()), step):
            x, y = np.searchsorted(number, (a, a + step))
            has = np.zeros((len(docs), step), np.float32)
            has[doc[x:y], number[x:y] - a] = 1
            out += has[: len(rows)] @ has[len(rows) :].T
        return out

    def table(self) -> pa.Table:
        a, b = np.asarray(self.found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})


def _links_of(t: pa.Table, num: int, den: int) -> Links:
    get = lambda c: np.asarray(t[c].combine_chunks())
    sets = None
    if "s" in t.column_names:
        flat = t["s"].combine_chunks()
        ends, values = np.asarray(flat.offsets), np.asarray(flat.values)
        sets = [values[x:y] for x, y in zip(ends, ends[1:], strict=False)]
    return Links(get("rep"), get("n"), get("g"), _sigs(t["sig"]), sets, num, den)


def _true(t: pa.Table, c: str) -> np.ndarray:
    return np.asarray(t[c].combine_chunks().to_numpy(zero_copy_only=False))


def _blocks(docs: int):
    """Into how many blocks of so many documents a node of c documents, with `total` shingles together, is dealt."""
    return F.ceil(F.greatest(F.col("c") / docs, F.col("total") / BLOCK_SHINGLES)).cast("int")


def _grouped(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """rows with g, the group of each document so far."""
    if groups is None:
        return rows.withColumn("g", F.col("rep"))
    return rows.join(small(groups), F.col("rep") == F.col("of"), "left").withColumn("g", F.coalesce("g", "rep")).drop("of")


def _unsettled(rows: DataFrame) -> DataFrame:
    """rows (node, rep, n, g) of nodes with more than one group, with the node's size c, its numbers of blocks and of cells a
    side, and its pivot, its least document, which nodes that share most documents mostly share too."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("rep").alias("pivot")).where("g0 != g1")
    return rows.join(small(materialise(nodes.select("node", "c", _blocks(BLOCK).alias("blocks"), _blocks(CELL).alias("cells"), "pivot"), "nodes")), "node")


def _with_hope(dealt: DataFrame, task: list[str], mark: str, reps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of dealt (task..., rep, g, mark) the rows that sizes and signatures leave a link to another group in their task, with
    their full sets, which are so read for these rows alone."""
    schema = T.StructType([*(dealt.schema[c] for c in (*task, "rep", "g", mark))])

    def run(t: pa.Table) -> pa.Table:
        links, every, keep = _links_of(t, num, den), np.arange(t.num_rows), np.zeros(t.num_rows, bool)
        for i in every:
            near = links._near(i, every) > 0
            keep |= near
            keep[i] |= near.any()
        return t.select(schema.names).filter(pa.array(keep))

    signed = dealt.join(reps.select("rep", "n", "sig"), "rep").groupBy(*task).applyInArrow(run, schema)
    return sets.join(small(materialise(signed, "hopeful")), "rep")


def _inside(rows: DataFrame, reps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between the groups of each unsettled node. A node of one block is settled by this; of a larger one,
    every block has the pivot too and is settled in itself."""
    here = F.pmod(F.xxhash64("rep", "node"), F.col("blocks")).cast("int")
    block = F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(here))
    dealt = rows.select("node", F.explode(block).alias("block"), "rep", "g", (F.col("rep") == F.col("pivot")).alias("first"))

    def run(t: pa.Table) -> pa.Table:
        links, order = _links_of(t, num, den), np.argsort(~_true(t, "first"), kind="stable")
        links.one(order[0], order[1:])
        links.all_of(order[1:])
        return links.table()

    return _with_hope(dealt, ["node", "block"], "first", reps, sets, num, den).groupBy("node", "block").applyInArrow(run, "a long, b long")


def _across(rows: DataFrame, reps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between the groups of each unsettled node, by all pairs of its parts: the exact way for nodes that are not
    small. No task holds more than two parts."""
    own = F.pmod(F.xxhash64("rep", "node"), F.col("cells")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    cells = rows.select("node", "rep", "g", own.alias("own"), others.alias("other"))
    cells = cells.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "g", (F.col("own") <= F.col("other")).alias("left"))

    def run(t: pa.Table) -> pa.Table:
        links, left = _links_of(t, num, den), _true(t, "left")
        parts = lambda side: np.array_split(np.flatnonzero(side), -(-np.count_nonzero(side) // BLOCK) or 1)
        for k, x in enumerate(parts(left)):  # small matrices hold fewer zeros
            if left.all():
                links.all_of(x)
            for y in parts(left)[k + 1 :] if left.all() else parts(~left):
                links.all_of(x, y)
        return links.table()

    return _with_hope(cells, ["node", "i", "j"], "left", reps, sets, num, den).groupBy("node", "i", "j").applyInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(rep, n, sig, s): the full sets of reps (rep, n, sig), made again from the texts of just those documents (_row, _text)."""

    def run(batches):
        memo = Memo(xxhash.xxh3_64_intdigest)
        for b in batches:
            sets = [shingle_set(x, size, memo) for _, x in texts(b, "_text", 64)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["rep", "s"])

    wanted = small(materialise(reps.select(F.col("rep").alias("_row")), "needed"))
    return docs.select("_row", "_text").join(wanted, "_row").mapInArrow(run, "rep long, s array<long>").join(reps, "rep").select("rep", "n", "sig", "s")


def joined(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """groups (of, g) with links between documents (a, b) added; g is a group's smallest document."""
    if groups is not None and links.isEmpty():
        return groups
    if groups is None:
        return components(links).select(F.col("node").alias("of"), F.col("component").alias("g"))
    name = lambda c: groups.select(F.col("of").alias(c), F.col("g").alias(f"{c}_g"))
    between = links.join(small(name("a")), "a", "left").join(small(name("b")), "b", "left").select(F.coalesce("a_g", "a").alias("a"), F.coalesce("b_g", "b").alias("b"))
    more = materialise(components(between).select(F.col("node").alias("old"), F.col("component").alias("new")), "merged")
    kept = groups.join(small(more), F.col("g") == F.col("old"), "left").select("of", F.coalesce("new", "g").alias("g"))
    fresh = more.select(F.col("old").alias("of"), F.col("new").alias("g")).join(groups, "of", "left_anti")
    return materialise(kept.unionByName(fresh), "groups")


def link(docs: DataFrame, reps: DataFrame, size: int, num: int, den: int, recall: float) -> DataFrame:
    """(node, component) over the representatives that have links."""
    return link_by_paths(reps, num, den, recall, lambda some: shingle_sets(docs, some, size))


def link_by_paths(reps: DataFrame, num: int, den: int, recall: float, sets_of) -> DataFrame:
    """Groups (node, component) of reps (rep, n, sig). The trees of a depth come in turns; each turn looks only at nodes that
    still hold more than one of the groups found before, so that the copies of one text are compared with its pivot once
    and not with one another. What shares a node of more than one block and is still apart is compared cell by cell where
    that is no more than COMPARED documents for each, else it goes on to deeper trees."""
    threshold, missed = num / den, (1 - recall) / len(DEPTHS)
    some, sets, groups, count = reps, None, None, 0
    for levels in DEPTHS:
        trees = trees_needed(threshold, levels, 1 - missed)
        rows = materialise(_nodes(some, trees, levels, threshold), "nodes-of")
        company = materialise(rows.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node"), "company")
        rows = materialise(rows.join(small(company), "node"), "shared")
        if sets is None:  # those of deeper trees are among them
            needed = materialise(reps.select("rep", "n", "sig").join(small(materialise(rows.select("rep").distinct(), "sharing")), "rep"), "sharing-reps")
            sets = materialise(sets_of(needed), "sets")
        for turn in range(1 + sum(t < trees for t in TURNS)):
            now = _unsettled(_grouped(rows.where(F.col("turn") == turn), groups))
            links = materialise(_inside(now, needed, sets, num, den), "links")
            groups = joined(groups, links)
        left = materialise(_unsettled(_grouped(rows, groups)).where("blocks > 1"), "left")
        if left.isEmpty():
            break
        compared = left.agg(F.sum("c")).first()[0]  # each document with all of its nodes
        if levels == DEPTHS[-1] or compared <= COMPARED * (count := count or reps.count()):
            groups = joined(groups, materialise(_across(left, needed, sets, num, den), "links"))
            break
        some = materialise(reps.join(small(materialise(left.select("rep").distinct(), "left-over")), "rep"), "again")
    return groups.select(F.col("of").alias("node"), F.col("g").alias("component"))


def deduplicate(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text", recall: float = 0.9999, row_col: str | None = None) -> DataFrame:
    """Groups of near-duplicate texts: one row per row of docs, (id, n_shingles, component_id, kept).

    Two texts are linked if den * |A and B| >= num * |A or B| for their sets of `size`-word shingles (by default five
    words and 0.8). component_id is the smallest id reachable by links; kept marks the rows that bear it themselves. Texts
    of equal sets are one representative from the start, so copies cost nothing further. Null, empty and blank texts have
    empty sets and are linked with nothing. Null ids are never a group's smallest; a group of rows without ids has a null
    component_id and keeps all. Of repeated ids each row stands for itself. Other columns are ignored; no rows, no result.
    row_col: a column of docs, a written table, with a number of each row; the result has it too, and group, a number of
    the row's group that, unlike component_id, no other group shares.
    """
    key = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    rows = docs.select(key.alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = rows if row_col else materialise(rows, "rows")
    known = materialise(sketches(rows.select("_row", "_id", "_text"), size), "sketches")
    classes = materialise(known.where("key is not null").groupBy("key").agg(F.min("_id").alias("least"), F.min("_row").alias("rep"), F.count("*").alias("k")), "classes")
    reps = materialise(classes.select("rep", "least").join(known.select(F.col("_row").alias("rep"), "n", "sig"), "rep"), "reps")
    groups = materialise(link(rows, reps, size, num, den, recall), "groups")
    named = groups.join(reps.select(F.col("rep").alias("node"), "least"), "node")
    smallest = materialise(named.groupBy("component").agg(F.min("least").alias("c")), "smallest")
    of_rep = materialise(groups.join(small(smallest), "component").select(F.col("node").alias("rep"), "component", "c"), "grouped")
    # classes of more than one row or text; any other row is a group of its own and needs no join by its set
    shared = classes.join(small(of_rep), "rep", "left").where("k > 1 or component is not null")
    shared = materialise(shared.select("key", F.coalesce("component", "rep").alias("g"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("c")).alias("c")), "of-key")
    placed = known.select("_row", "_id", "n", "key").join(small(shared), "key", "left")
    out = placed.select("_row", "_id", "n", F.coalesce("g", "_row").alias("g"), F.when(F.col("g").isNull(), F.col("_id")).otherwise(F.col("c")).alias("c"))
    own = [F.col("_row").alias(row_col), F.col("g").alias("group")] if row_col else []
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("_id") == F.col("c"), F.col("c").isNull()).alias("kept"), *own)
