"""Conversation structure repair by alignment of turns to an alternating grammar.

The roles of a repaired conversation spell, by their initials, (s?(ua)+)?. The turns are aligned to the grammar's string of
every feasible length by Wagner and Fischer's recurrence, inside Ukkonen's band of the diagonals that the cost of a known
repair leaves, and the backtraces of the cheapest lengths are compared. Strings of all lengths end alike, so that one table
over the symbols still to come serves them all.

A conversation may be longer than a task can hold, so it is aligned slice by slice. Between two slices only four states are
possible: nothing yet, after s, after u, after a. Each slice gives the cost and the edits of every way from state to state;
reading a conversation's slices backwards finds the cheapest way on from each state, reading them forwards follows it. Inserted
turns belong to the slice of the turn that comes next, so that edits of two ways are never beginnings of each other and the
first difference decides. The rows of a conversation stream through a task; none holds more than a slice of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import materialise

#: A slice has at most this many turns and, but for a single turn, this many bytes of text.
SLICE_TURNS, SLICE_BYTES = 256, 4 << 20

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
#: From each state: the next symbol, and the insertions that lead to an end.
NEXT, CLOSING = ("u", "u", "a", "u"), (0, 2, 1, 0)
NAMES = {"u": "user", "a": "assistant"}
NEVER = 1 << 60

Way = tuple[int, str]  # cost, edits


def _simple(initials: list[str], bad: list[bool], extra: list[int], state: int) -> dict[int, int]:
    """Costs of repairs that are easily found, by the state they end in: what is never exceeded by the cheapest."""
    want, cost, some = NEXT[state], 0, False
    for c, gone, more in zip(initials, bad, extra):
        if gone:
            cost += DELETE
            continue
        some = True
        cost += more
        if c == want:
            want = "a" if want == "u" else "u"
        elif c in NAMES:
            cost += INSERT  # the wanted turn, and then this one
        else:
            cost += REROLE
            want = "a" if want == "u" else "u"
    if not some:
        return {}
    end = AFTER_U if want == "a" else AFTER_A
    return {end: cost, (AFTER_A if end == AFTER_U else AFTER_U): cost + INSERT + REROLE}


class Table:
    """B[i][r]: the least cost of aligning turns i.. to the last r symbols of a string that ends in `last`, with no insertion
    after the last turn; only inside the band that `most`, the cost of some repair, leaves."""

    def __init__(self, initials: list[str], bad: list[bool], extra: list[int], last: str, most: int):
        self.initials, self.bad, self.extra = initials, bad, extra
        self.symbols = (last, "u" if last == "a" else "a")  # of r = 1, 2, 1, 2, ...
        n, gone = len(initials), 0
        self.rows: list[dict[int, int]] = [{}] * n + [{0: 0}]
        for i in range(n - 1, -1, -1):
            gone += bad[i]
            left, below, here = n - i, self.rows[i + 1], {}
            for r in range(max(0, left - most // DELETE), left - gone + max(0, most - DELETE * gone) // INSERT + 1):
                cost = DELETE + below.get(r, NEVER)
                if r:
                    if not bad[i]:
                        cost = min(cost, self.match(i, r) + below.get(r - 1, NEVER))
                    cost = min(cost, INSERT + here.get(r - 1, NEVER))
                if cost < NEVER:
                    here[r] = cost
            self.rows[i] = here

    def match(self, i: int, r: int) -> int:
        return self.extra[i] + (KEEP if self.initials[i] == self.symbols[(r - 1) % 2] else REROLE)

    def edits(self, i: int, r: int) -> str:
        """The ASCII-least edits of cost B[i][r]."""
        out = []
        while i < len(self.initials):
            cost, below = self.rows[i][r], self.rows[i + 1]
            if below.get(r, NEVER) + DELETE == cost:
                out.append("D")
                i += 1
            elif r and self.rows[i].get(r - 1, NEVER) + INSERT == cost:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.initials[i] == self.symbols[(r - 1) % 2] else "R")
                i, r = i + 1, r - 1
        return "".join(out)

    def best(self, i: int, symbol: str) -> Way | None:
        """The cheapest alignment of turns i.. to strings of any length that begin with symbol, ties to the least edits."""
        found = [(c, r) for r, c in self.rows[i].items() if r and self.symbols[(r - 1) % 2] == symbol]
        if not found:
            return None
        least = min(found)[0]
        return least, min(self.edits(i, r) for c, r in found if c == least)


def align(initials: list[str], bad: list[bool], extra: list[int], states=range(4)) -> dict[tuple[int, int], Way]:
    """(state before, state after) -> (cost, edits) of the cheapest repair of some consecutive turns.

    initials: of the roles; bad: turns that must go; extra: what a turn costs if it stays.
    """
    n, out, most = len(initials), {}, {}
    for s in states:
        out[s, s] = (DELETE * n, "D" * n)
        for end, cost in _simple(initials, bad, extra, s).items():
            most[end] = max(most.get(end, 0), cost)
    tables = {end: Table(initials, bad, extra, "u" if end == AFTER_U else "a", cost) for end, cost in most.items()}

    def offer(a: int, b: int, way: Way | None):
        if way and ((a, b) not in out or way < out[a, b]):
            out[a, b] = way

    for s in states:
        for end, table in tables.items():
            offer(s, end, table.best(0, NEXT[s]))
            if s == NOTHING:
                for p in range(n):
                    if initials[p] == "s" and not bad[p]:
                        cost = DELETE * p + KEEP + extra[p]
                        rest = table.best(p + 1, "u")
                        offer(s, end, rest and (cost + rest[0], "D" * p + "K" + rest[1]))
        if s == NOTHING:
            for p in range(n):
                if initials[p] == "s" and not bad[p]:
                    offer(s, AFTER_S, (DELETE * (n - 1) + KEEP + extra[p], "D" * p + "K" + "D" * (n - p - 1)))
    return out


def apply(edits: str, roles: list[str], texts: list[str], state: int) -> tuple[list[tuple[str, str]], int]:
    """(role, text) of the turns that edits make of some turns, and the state after them."""
    out, i = [], 0
    for e in edits:
        if e == "D":
            i += 1
            continue
        symbol = NEXT[state] if e != "K" else roles[i][:1]
        if e == "I":
            out.append((NAMES[symbol], ""))
        else:
            out.append((roles[i] if e == "K" else NAMES[symbol], texts[i]))
            i += 1
        state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[symbol]
    return out, state


def _rows(batches) -> Iterator[list]:
    for b in batches:
        for a in range(0, b.num_rows, 256):
            yield from zip(*(c.slice(a, 256).to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if len(held) >= 500 or n > SLICE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def faults(turns: DataFrame) -> DataFrame:
    """turns (_conv, _turn, _role, _text, _row) with fault: blank, duplicate, truncated or null, the first that holds."""
    seen = turns.groupBy("_conv", "_role", F.md5(F.col("_text").cast("binary")).alias("digest")).agg(F.min(F.struct("_turn", "_row")).alias("first"))
    firsts = seen.select(F.col("first._row").alias("_row"), F.lit(True).alias("_first"))
    blank = ~F.col("_text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("_text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(F.col("_first").isNull(), "duplicate").when(cut, "truncated")
    return turns.join(firsts, "_row", "left").withColumn("fault", fault).drop("_first")


def slices(flagged: DataFrame, turns_of: int = SLICE_TURNS) -> DataFrame:
    """Runs of one conversation's turns in order, with their ways: a row each."""
    conv = flagged.schema["_conv"].dataType
    schema = T.StructType([T.StructField("_conv", conv), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("faults", T.StringType()), T.StructField("turns", T.ArrayType(T.LongType())), T.StructField("ways", T.ArrayType(T.StringType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def cut(batches):
        part = TaskContext.get().partitionId()

        def rows():
            held, size, seq, inside = [], 0, 0, False  # inside: the slice may go on from another

            def flush():
                roles, texts, signs = [r[2] for r in held], [r[3] for r in held], [(r[4] or "-")[0] for r in held]
                ways = align([x[:1] for x in roles], [x in "bd" for x in signs], [CUT if x == "t" else 0 for x in signs], range(4) if inside else (NOTHING,))
                return held[0][0], part, seq, roles, texts, "".join(signs), [r[1] for r in held], [f"{a} {b} {c} {e}" for (a, b), (c, e) in sorted(ways.items())]

            inside = True  # the partition may begin amid a conversation
            for r in _rows(batches):
                other = bool(held) and r[0] != held[0][0]
                if held and (other or len(held) >= turns_of or size > SLICE_BYTES):
                    yield flush()
                    held, size, seq, inside = [], 0, seq + 1, not other
                held.append(r)
                size += len(r[3])
            if held:
                yield flush()

        yield from _batches(rows(), arrow, lambda r: sum(map(len, r[4])))

    ordered = flagged.select("_conv", "_turn", "_role", "_text", "fault", "_row").repartitionByRange("_conv", "_turn", "_row").sortWithinPartitions("_conv", "_turn", "_row").drop("_row")
    return ordered.mapInArrow(cut, schema)


def choose(sliced: DataFrame) -> DataFrame:
    """sliced, each conversation backwards: choice, for each state before a slice the edits, the state after and the cost."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([f for f in sliced.schema.fields if f.name != "ways"] + [T.StructField("choice", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)

    def back(batches):
        def rows():
            last, on = None, None
            for r in _rows(batches):
                if last is None or r[0] != last[0]:
                    on, last = [INSERT * k for k in CLOSING], (r[0],)
                best: dict[int, tuple[int, str, int, int]] = {}
                for w in r[7]:
                    a, b, c, e = w.split(" ")
                    a, b, c = int(a), int(b), int(c)
                    best[a] = min(best.get(a, (NEVER, "", 0, 0)), (c + on[b], e, b, c))
                on = [best[a][0] if a in best else NEVER for a in range(4)]
                yield *r[:7], [f"{a} {b} {c} {e}" for a, (_, e, b, c) in best.items()]

        yield from _batches(rows(), arrow, lambda r: sum(map(len, r[4])))

    ordered = sliced.repartition("_conv").sortWithinPartitions("_conv", F.desc("part"), F.desc("seq"))
    return ordered.mapInArrow(back, schema)


def _forward(chosen: DataFrame, schema: T.StructType, make) -> DataFrame:
    """make(rows) over each partition, whole conversations forwards."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ordered = chosen.repartition("_conv").sortWithinPartitions("_conv", "part", "seq")
    return ordered.mapInArrow(lambda batches: _batches(make(_rows(batches)), arrow, lambda r: 100), schema)


def _steps(rows) -> Iterator[tuple[tuple, bool, list[tuple[str, str]], str, int, list[tuple[str, str]]]]:
    """(slice, it begins a conversation, repaired turns, edits, cost so far, what would close the conversation)."""
    last, state, cost = None, NOTHING, 0
    for r in rows:
        begins = last is None or r[0] != last[0]
        if begins:
            last, state, cost = (r[0],), NOTHING, 0
        for w in r[7]:
            a, _, c, edits = w.split(" ")
            if int(a) == state:
                break
        made, state = apply(edits, r[3], r[4], state)
        cost += int(c)
        yield r, begins, made, edits, cost, apply("I" * CLOSING[state], [], [], state)[0]


def digests(chosen: DataFrame) -> DataFrame:
    """A row per conversation: counts of faults, gaps and illegal neighbours, cost, audit and the hash of what is repaired."""
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([T.StructField("_conv", chosen.schema["_conv"].dataType), *(T.StructField(x, T.LongType()) for x in longs), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def make(rows):
        now = None
        for r, begins, made, edits, cost, closing in _steps(rows):
            if begins:
                if now:
                    yield now.row()
                now = _Digest(r[0])
            now.add(r, made, edits, cost, closing)
        if now:
            yield now.row()

    return _forward(chosen, schema, make)


class _Digest:
    def __init__(self, conv):
        self.conv, self.hash, self.some, self.audit = conv, hashlib.sha256(), False, []
        self.n = dict.fromkeys("bdt", 0)
        self.illegal, self.initial, self.low, self.high, self.distinct = 0, None, None, None, 0

    def _hash(self, h, made):
        for k, (role, text) in enumerate(made):
            h.update(("\n" if self.some or k else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def add(self, r, made, edits, cost, closing):
        self._hash(self.hash, made)
        self.some |= bool(made)
        self.audit.append(edits)
        self.cost, self.closing = cost, closing
        for x in r[5]:
            if x in self.n:
                self.n[x] += 1
        for role in r[3]:
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
        for t in r[6]:
            if t is not None and t != self.high:  # in order
                self.low = t if self.low is None else self.low
                self.high, self.distinct = t, self.distinct + 1

    def row(self):
        self._hash(self.hash, self.closing)
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return self.conv, gaps, *self.n.values(), self.illegal, self.cost + INSERT * len(self.closing), "".join(self.audit) + "I" * len(self.closing), self.hash.hexdigest()


def prepare(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", slice_turns: int = SLICE_TURNS) -> DataFrame:
    """The slices of all conversations with the edits chosen: what repair and repaired_turns read."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.monotonically_increasing_id().alias("_row"), F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), blank(role).alias("_role"), blank(text).alias("_text"))
    flagged = materialise(faults(materialise(rows, "turns")), "faults")  # written: the range partitioning reads it twice
    return materialise(choose(materialise(slices(flagged, slice_turns), "slices")), "chosen")


def repair(turns: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", slice_turns: int = SLICE_TURNS) -> DataFrame:
    """A row per conversation: (id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    A conversation's rows are taken by turn, nulls first, rows of equal turns in the order of the table. Each has its first
    fault: blank, duplicate of an earlier row's role and text, truncated (no sentence ends it). Keeping a turn is free,
    rerole to user or assistant costs 3, deletion 4 (blank and duplicate rows must go), an inserted empty turn 3, a truncated
    turn that stays 3 more. audit: the edits' initials, the ASCII-least of the cheapest. Gaps count missing turn numbers.

    Null roles and texts count as one space. A null id is a conversation like others. Very long texts and conversations
    stream. ids: a table with a column `conv`; those without turns come with zeros, an empty audit and the hash of nothing.
    Further columns are ignored. An empty table gives an empty result.
    """
    done = digests(prepare(turns, conv, turn, role, text, slice_turns)).withColumnRenamed("_conv", conv)
    if ids is None:
        return done
    done = materialise(done, "digests")
    every = ids.select(F.col(conv).alias("_id")).distinct()
    out = every.join(done, F.col("_id").eqNullSafe(F.col(conv)), "left")
    zero = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return out.select(F.col("_id").alias(conv), *(F.coalesce(F.col(c), F.lit(zero.get(c, 0))).cast(done.schema[c].dataType).alias(c) for c in done.columns if c != conv))


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", slice_turns: int = SLICE_TURNS) -> DataFrame:
    """The repaired conversations themselves: (id, turn from 0, role, text)."""
    chosen = prepare(turns, conv, turn, role, text, slice_turns)
    schema = T.StructType([T.StructField(conv, chosen.schema["_conv"].dataType), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def make(rows):
        k, close, of = 0, [], None
        for r, begins, made, _, _, closing in _steps(rows):
            if begins:
                yield from ((of, k + j, *x) for j, x in enumerate(close))
                k, of = 0, r[0]
            yield from ((of, k + j, *x) for j, x in enumerate(made))
            k, close = k + len(made), closing
        yield from ((of, k + j, *x) for j, x in enumerate(close))

    return _forward(chosen, schema, make)


def damage(turns: DataFrame) -> DataFrame:
    """conversations with planted faults, by crc32 of conv_id:turn modulo 20: rows dropped (0), texts emptied (1), sentence
    ends removed (2), rows repeated at once (3), roles set to user (4). Null roles and texts are one space, and so are null
    ids and turns in the key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": hurt, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")
