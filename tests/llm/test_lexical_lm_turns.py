"""Lexical search, language-model scores and conversation repair against brute force, and their results on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import bloomlm, lexical, turns
from tests.llm.test_operators import LONG, ODD, frame

# --- lexical search -----------------------------------------------------------------------------------------------

ITEMS = "item_id long, text string, score long, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute_search(docs, items, k):
    bags = [(i, TERM.findall(lower(t))) for i, t in docs]
    bags = [(i, len(w), collections.Counter(w)) for i, w in bags if w]
    n_docs, length = len(bags), sum(n for _, n, _ in bags)
    df = collections.Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for i, n, c in bags:
            m = 100 - 25 + 25 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"{'ÄéX'[i % 3]}w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    text = lambda k: " ".join(rng.choices(words, weights, k=k))
    return [(i, text(rng.randrange(1, 40))) for i in range(n)], text


@pytest.mark.parametrize("k,item_bytes", [(20, 1 << 20), (3, 60)])
def test_search_is_the_brute_ranking(spark, k, item_bytes):
    docs, text = corpus(5, 300)
    docs += [*ODD, (40, docs[3][1]), (4, docs[3][1]), (None, docs[3][1])]  # ties, repeated ids, ids missing
    items = [(1, text(8)), (2, docs[3][1]), (2, docs[3][1]), (3, None), (4, ""), (5, "nowhere at-all"), (None, text(3)), (6, text(130)), (7, LONG[:9000])]
    got = lexical.search(frame(spark, docs).repartition(5), spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS), k, item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, k)


def test_search_without_rows(spark):
    items = spark.createDataFrame([(1, "a", 1, "x")], ITEMS)
    assert lexical.search(frame(spark, []), items).count() == 0
    assert lexical.search(frame(spark, [(1, None), (2, " -")]), items).count() == 0
    assert lexical.search(frame(spark), items.limit(0)).count() == 0


def test_few_masks_are_evaluated():
    """Most documents hold common terms only: their masks can't reach the best scores."""
    rng = random.Random(3)
    docs = [([0, 1, 2, 3][: rng.randrange(1, 5)] + ([rng.randrange(4, 40)] if i % 50 == 0 else [])) for i in range(4000)]
    ends = np.cumsum([0, *map(len, docs)])
    t = np.asarray([x for d in docs for x in d])
    block = lexical.Block(np.asarray([len(d) for d in docs]), ends, t, np.ones(len(t), np.int64), 40, 4000, len(t))
    weights = np.asarray([5] * 4 + [4000] * 36)
    best = lexical.Best(20)
    seen = lexical.rank_block(block, np.arange(40), weights, best, np.arange(4000), np.zeros(4000, bool))
    whole = block.scores(np.arange(4000), weights)
    order = sorted(range(4000), key=lambda i: (-whole[i], i))[:20]
    assert best.id.tolist() == order and best.score.tolist() == whole[order].tolist()
    print("evaluated", seen)
    assert seen < 400


# --- language-model scores ----------------------------------------------------------------------------------------


def brute_base(docs, train):
    tok = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for _, t in docs]
    c = collections.Counter(w for (i, _), ws in zip(docs, tok) if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = [(i, len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for (i, _), ws in zip(docs, tok)]
    return rows, tok, c


def brute_model(docs, train, prior):
    """Scores from plain dictionaries: the counts of a level stand for their mean, as in the filter."""
    rows, tok, c1 = brute_base(docs, train)
    c2 = collections.Counter(p for (i, _), ws in zip(docs, tok) if train(i) for p in zip([0, *ws], ws))
    n, v = sum(c1.values()), len(c1)

    def rounded(c):
        by = collections.defaultdict(list)
        for k, x in c.items():
            by[int(bloomlm.level(np.asarray([x]))[0])].append(k)
        return {k: sum(c[j] for j in ks) / len(ks) for ks in by.values() for k in ks}

    q1, q2 = rounded(c1), rounded(c2)
    out = []
    for ws in tok:
        s = 0.0
        for a, w in zip([0, *ws], ws):
            h = c1[None] if a == 0 else q1.get(a, 0.0)
            p = (q1.get(w, 0.0) + 0.5) / (n + 0.5 * (v + 1))
            two = min(q2.get((a, w), 0.0), h) if w in q1 and h > 0 else 0.0
            s += math.log10((two + prior * p) / (h + prior))
        out.append(s)
    return rows, out


@pytest.mark.parametrize("segment,head", [(1 << 27, 1 << 19), (300, 3)])
def test_scores_are_those_of_plain_counts(spark, monkeypatch, segment, head):
    monkeypatch.setattr(bloomlm, "BLOCK_TOKENS", 700)  # several blocks
    docs, _ = corpus(8, 400, 300)
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "ÄW1 éw2 ÄW1"), (7, docs[7][1]), (None, "XW2 never-seen"), (1004, LONG)]
    train = lambda i: i is not None and i % 5 != 1
    got = bloomlm.score_texts(frame(spark, docs).repartition(3), F.col("doc_id") % 5 != 1, segment_bytes=segment, head=head, prior=30.0)
    got = sorted(map(tuple, got.collect()), key=repr)
    base, score = brute_model(docs, train, 30.0)
    want = sorted([(*b, s) for b, s in zip(base, score)], key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) <= 1e-9 * abs(w[4]) for g, w in zip(got, want))
    off = [abs(g[5] - w[5]) > 1e-6 * abs(w[5]) for g, w in zip(got, want)]
    assert sum(off) < 0.5 * len(off)  # a false positive of the filter now and then
    assert abs(sum(g[5] for g in got) / sum(w[5] for w in want) - 1) < 0.01
    held = [g for g in got if g[0] is not None and g[0] % 5 == 1 and g[1] > 5]
    assert all(g[5] <= 0 for g in got) and held


def test_filter_gives_levels_back():
    rng = np.random.default_rng(4)
    keys = bloomlm.mix(rng.integers(1, 1 << 62, 30_000).astype(np.uint64))
    counts = rng.geometric(0.2, 30_000)
    n_bits, bits = bloomlm.fill_block(keys, counts)
    part = bloomlm.Segment(0, [(0, n_bits, bits)], len(bits))
    q = part.levels(keys, 40)
    assert (q >= bloomlm.level(counts)).all() and (q != bloomlm.level(counts)).mean() < 0.03
    assert (part.levels(bloomlm.mix(keys + np.uint64(1)), 40) > 0).mean() < 0.03
    assert len(bits) < 1.5 * bloomlm.level(counts).sum() * bloomlm.HASHES / 8


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    data = ("ab  cd\n" + "x" * 300 + " é\t" + "word " * 100).encode()
    h, at = bloomlm.word_hashes(data)
    assert [data[i:].split()[0] for i in at] == data.split() and len(set(h.tolist())) == len(set(data.split()))
    monkeypatch.setattr(bloomlm, "CHUNK", 64)
    again = bloomlm.word_hashes(data)
    assert (again[0] == h).all() and (again[1] == at).all()
    one, ends = bloomlm.tokens([b"A b", None, b"a"])
    assert ends.tolist() == [3, 4, 6] and one[0] == one[4] and one[2] == one[3] == one[5] == bloomlm.END[0]


def test_scores_without_training_rows(spark):
    got = bloomlm.score_texts(frame(spark), F.lit(False)).collect()
    assert len(got) == len(ODD) and all(r["base_score"] == 0 and r["score"] <= 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert bloomlm.score_texts(frame(spark, []), F.lit(True)).count() == 0


def test_pairs_tell_more_than_words(spark):
    """On texts whose words follow one another by rule, held-out texts are likelier by pairs than by single words."""
    rng = random.Random(6)
    follow = {i: [rng.randrange(200) for _ in range(3)] for i in range(200)}
    docs = []
    for i in range(600):
        w = [rng.randrange(200)]
        while len(w) < 30:
            w.append(rng.choice(follow[w[-1]]))
        docs.append((i, " ".join(f"w{x}" for x in w)))
    got = bloomlm.score_texts(frame(spark, docs), F.col("doc_id") % 5 != 1).where("doc_id % 5 = 1").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]


# --- conversation repair ------------------------------------------------------------------------------------------


def brute_repair(initials, bad, extra):
    """The least (cost, audit) over an automaton, one turn after another; audits with the insertions before a turn."""
    step = {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {"u": 2, "a": 3}
    now = {0: (0, "")}
    for c, gone, more in zip(initials, bad, extra):
        new = {}

        def offer(state, way, new=new):
            if state not in new or way < new[state]:
                new[state] = way

        for state, (cost, audit) in now.items():
            for k in range(3):
                offer(state, (cost + 4, audit + "D"))
                if not gone:
                    if c == step[state]:
                        offer(after[c], (cost + more, audit + "K"))
                    if c == "s" and state == 0 and not k:
                        offer(1, (cost + more, audit + "K"))
                    offer(after[step[state]], (cost + 3 + more, audit + "R"))
                cost, audit, state = cost + 3, audit + "I", after[step[state]]
        now = new
    return min((cost + 3 * {0: 0, 1: 2, 2: 1, 3: 0}[s], audit + "I" * {0: 0, 1: 2, 2: 1, 3: 0}[s]) for s, (cost, audit) in now.items())


def test_alignment_is_the_cheapest():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randrange(1, 10)
        initials = rng.choices(["u", "a", "s", "x", ""], [5, 5, 2, 1, 1], k=n)
        bad = [rng.random() < 0.2 for _ in range(n)]
        extra = [3 * (rng.random() < 0.25) for _ in range(n)]
        ways = turns.align(initials, bad, extra)
        ends = [(c + 3 * turns.CLOSING[b], e + "I" * turns.CLOSING[b]) for (a, b), (c, e) in ways.items() if a == 0]
        assert min(ends) == brute_repair(initials, bad, extra), (initials, bad, extra)
        k = rng.randrange(n + 1)  # and of two slices
        if 0 < k < n:
            first, second = turns.align(initials[:k], bad[:k], extra[:k]), turns.align(initials[k:], bad[k:], extra[k:])
            both = [(c + d + 3 * turns.CLOSING[y], e + f + "I" * turns.CLOSING[y]) for (a, b), (c, e) in first.items() for (x, y), (d, f) in second.items() if a == 0 and b == x]
            assert min(both) == min(ends)


def brute_digest(rows):
    """rows (turn, role, text) of one conversation in the order of the table."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, fault = set(), []
    for _, r, x in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", x)
        fault.append("b" if not words else "d" if (r, x) in seen else "t" if words[-1] not in ".!?" else "-")
        seen.add((r, x))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    cost, audit = brute_repair(first, [f in "bd" for f in fault], [3 * (f == "t") for f in fault])
    made, i, want = [], 0, "user"
    for e in audit:
        if e == "D":
            i += 1
            continue
        if e == "I":
            made.append(f"{want}:")
        else:
            made.append(f"{rows[i][1] if e == 'K' else want}:{rows[i][2]}")
            i += 1
        if made[-1][0] != "s":
            want = "assistant" if made[-1][0] == "u" else "user"
    assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made))
    return gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode("utf-8")).hexdigest()


def conversations(seed=1, n=150):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        length = 700 if c == 3 else rng.randrange(1, 12)
        for t in range(length):
            text = rng.choice(["Hi.", "Yes!", "no end", "", " \n", None, f"word {t}.", f"Why {t}?\t", LONG if t == 2 and c == 5 else "x."])
            rows.append((c, None if rng.random() < 0.05 else t if rng.random() < 0.9 else t - 1, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "User", "unknown", "tool"]), text))
    return rows


@pytest.mark.parametrize("size", [256, 3])
def test_repair_is_the_cheapest_of_every_conversation(spark, size):
    rows = conversations()
    schema = "conv_id long, turn long, role string, text string, fault string, _row long, audit string"
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)
    ids = spark.createDataFrame([(c,) for c in (None, 0, 0, 9999)], "conv_id long").unionByName(table.select("conv_id"))
    got = {r[0]: tuple(r[1:]) for r in turns.repair(table, ids, slice_turns=size).collect()}
    by = collections.defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    assert set(got) == {*by, 9999}
    assert got[9999] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for c, r in by.items():
        assert got[c] == brute_digest(r), c
    made = collections.defaultdict(list)
    for r in sorted(turns.repaired_turns(table, slice_turns=size).collect(), key=lambda r: r["turn"]):
        assert r["turn"] == len(made[r["conv_id"]])
        made[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for c in by:
        assert hashlib.sha256("\n".join(made[c]).encode()).hexdigest() == got[c][-1]


def test_damage_follows_the_rule(spark):
    rows = [(c, t, r, "One. Two! Three?") for c in range(40) for t, r in enumerate(["system", "user", None])] + [(None, 1, "user", None), (1, None, "user", "x")]
    got = collections.Counter(map(tuple, turns.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = collections.Counter()
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if kind:
            want[c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x] += 1 + (kind == 3)
    assert got == want


def test_repair_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair(none).count() == 0 and turns.repair(none, none).count() == 0 and turns.repaired_turns(none).count() == 0
