"""The training-data operators against brute force, and their defined results on odd rows."""

import collections
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import common, components, decontamination, neardup, packing, pii, quality, search, sharding, tokens, toxicity, warc
from tapeloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, score string, pii string, n_words string, w string"  # with clashing names

LONG = " ".join(f"word{i % 977} the of" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b"), (6, LONG), (7, "a b"), (7, "a b"), (None, "null id here"), (8, None)]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "x", "y", "z", "v") for i, t in rows], DOCS)


# --- packing and token counts -------------------------------------------------------------------------------------


def test_tokens_equal_the_library():
    pre = tokens.PreTokens(tokenizer_path())
    texts = ["a<|endoftext|>b's 'STOP ''s", "ΑΣ Σ ΟΔΥΣΣΕΥΣ", "éx ½ ² ٣", "\x1c\x1da　b c", "İstanbul ŉ ſ", "日本語 text \U0001f600", "don't we'll I'D", "", "   ", "<|startoftext|> x<|endoftext|>", "a\x0bb\x0cc\x85d", "naïve ﬁ ŀ é", "©®™ «q» — …", "\x00\x01 a\x7fb"]
    for x in texts:
        want = pre.tok.encode(x, add_special_tokens=False).ids
        assert [i for w in pre.cut(x) for i in pre.ids(w)] == want
        assert sum(k * len(pre.ids(w)) for w, k in pre.frequencies(x).items()) == len(want)


def test_token_counts_on_odd_rows(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = [*ODD, (9, "x <|endoftext|> É")]
    got = sorted(map(tuple, tokens.count_tokens(frame(spark, rows), tokenizer_path(), head=50).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert tokens.count_tokens(frame(spark, []), tokenizer_path()).count() == 0


def test_packing_is_whole(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(4)
    rows = [(100 + i, " ".join(rng.choice("abc de fgh.".split()) for _ in range(rng.randrange(0, 400)))) for i in range(60)] + [r for r in ODD if r[0] not in (7, None)]
    out = packing.pack(frame(spark, rows), tokenizer_path(), size=256, end_id=2).collect()
    texts = dict(rows)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        pieces.sort(key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == np.asarray(ids, "<u4").tobytes()
        assert all(p["doc_tokens"] == len(ids) for p in pieces)
    for parts in by_seq.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end == 256 or end & (end - 1) == 0
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0
    pieces = packing.pack(frame(spark, [(1, "a b")]), tokenizer_path()).orderBy("start").select(packing.unpack_ids(F.col("ids")).alias("x")).collect()
    assert [i for r in pieces for i in r["x"]] == [*tok.encode("a b", add_special_tokens=False).ids, 2]


def test_fill_finds_the_best_sum():
    rng = random.Random(9)
    for _ in range(300):
        counts, room = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(5)}, rng.randrange(1, 60)
        reach = {0}
        for length, k in counts.items():
            reach = {x + length * j for x in reach for j in range(k + 1) if x + length * j <= room}
        got = packing.fill(room, counts)
        assert sum(a * b for a, b in got.items()) == max(reach) and all(got[a] <= counts[a] for a in got)


# --- personal data ------------------------------------------------------------------------------------------------


def test_email_scan_equals_the_pattern():
    import re

    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(3)
    for _ in range(20_000):
        s = "".join(rng.choice("ab1.@-+ @_é") for _ in range(rng.randrange(30)))
        assert [m.span() for m in pattern.finditer(s)] == pii.emails(s)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john.smith at example dot com now", "email", "john.smith at example dot com"),
        ("mail bob [at] mail5 [dot] example [dot] com ok", "email", "bob [at] mail5 [dot] example [dot] com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("card 4O41 8949 7460 8795 x", "card", "4O41 8949 7460 8795"),
        ("４０４１８９４９７４６０８７９５", "card", "４０４１８９４９７４６０８７９５"),
        ("call plus one nine eight eight five five five two four eight five now", "phone", "plus one nine eight eight five five five two four eight five"),
        ("ip 42 dot 144 dot 35 dot 254 z", "ip", "42 dot 144 dot 35 dot 254"),
        ("192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
        ("user​@ex​ample.com", "email", "user​@ex​ample.com"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = pii.find(text)
    new = [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base]
    assert new == [(kind, found)]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john.smith at example.com now", "email", "john.smith at example.com"),
        ("maria arroba example.com", "email", "maria arroba example.com"),
        ("call plus 49 151 23456789", "phone", "plus 49 151 23456789"),
        ("4041 dash 8949 dash 7460 dash 8795", "card", "4041 dash 8949 dash 7460 dash 8795"),
    ],
)
def test_every_rule_is_tried_on_every_text(text, kind, found):
    assert [(k, text[a:b]) for k, a, b in pii.find(text)[1]] == [(kind, found)]


def test_places_of_change_leave_nothing_out():
    rng = random.Random(8)
    parts = "john at arroba klammeraffe dot punkt plus minus dash one ZWEI fünf onе fіve un 4O41 8949 4041 1l1 2²l2 Oo @ [at] (dot) { @ } <d> , - . _ 42 + \u200b \u3000 \u2011 \u2024 · ＠ ４ ① 𝟗 Ⅷ K İ ｏne example.com +49".split(" ")
    for _ in range(5000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(rng.randrange(1, 14)))
        assert pii.normalise(text) == pii.normalise(text, [(0, len(text))]), text


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("to jоhn@example.com now", "to [EMAIL] now"),
        ("to john@example.cоm now", "to [EMAIL] now"),
        ("to john@mail.example dot com now", "to [EMAIL] now"),
        ("call +49 151 123456 seven eight", "call [PHONE]"),
    ],
)
def test_partly_disguised_identifiers_go_as_a_whole(text, clean):
    base, every = pii.find(text)
    assert set(base) <= set(every) and pii.redact(text, every) == clean


def test_redaction_covers_the_union_of_spans():
    assert pii.redact("0123456789", [("card", 3, 8), ("phone", 1, 5), ("ip", 8, 9)]) == "0[PHONE][IP]9"


def test_clean_texts_have_no_spans():
    for t in ("he was at the house. dot then", "four zero", "at the of dot", "1.2.3", "300.1.1.1", "1234 5678 9012 3456", "a@b", "+12", ""):
        assert pii.find(t)[1] == [], t


def test_address_scan_equals_the_pattern():
    import re

    pattern = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(13)
    for _ in range(20_000):
        s = "".join(rng.choice(["1", "25", "255", "256", "007", ".", ".", ".", " ", "x"]) for _ in range(rng.randrange(24)))
        want = [m.span() for m in pattern.finditer(s) if all(int(p) <= 255 for p in m.group().split("."))]
        assert pii.addresses(s) == want, s


@pytest.mark.parametrize("text", ["1" * (1 << 20) + ".", "1." * (1 << 19), "9 " * (1 << 19), "+1 (" * (1 << 18), "a@" * (1 << 19), "mail a.b@c.de now " * 60_000, "at one dot " * 100_000, " " * (1 << 20) + "@", "x" * (1 << 20) + " at y"])
def test_very_long_texts_take_linear_time(text):
    import time

    began = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - began < 2
    pii.find(text)
    assert time.process_time() - began < 30


def test_the_query_of_personal_data_equals_the_contract(spark, tmp_dir):
    """op2_pii on a small table against the patterns of its contract, tried one by one."""
    import hashlib
    import re

    from tapeloom.llm import queries

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def fine(kind, s):
        d = re.sub(r"\D", "", s)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    rng = random.Random(21)
    parts = ["a.b@c.de", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "4041894974608795", "4041-8949 7460-8795", "4041 8949 7460 8796", "+49 151 23456789", "+1 (988) 555-2485", "+12", "é", "word", "at", "dot", "\n", "12345", "."]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(0, 20)))) for i in range(300)] + [(900, None), (901, ""), (None, "a@b.co"), (900, "1.1.1.1")]
    frame(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    got = sorted(map(tuple, queries.op2_pii(spark, tmp_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=repr)
    want = []
    for i, t in rows:
        spans = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t or "") if fine(k, m.group())]
        want.append((i, *(sum(s[0] == k for s in spans) for k in patterns), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_detect_keeps_rows_and_columns(spark):
    rows = [*ODD, (20, "mail a.b@c.de or +1 (988) 555-2485; 4041894974608795")]
    d = frame(spark, rows)
    out = pii.detect(d, base_col="base", redacted="clean")
    assert out.count() == len(rows) and out.columns == ["doc_id", "text", "score", "n_words", "w", "pii", "base", "clean"]
    r = out.where("doc_id = 20").first()
    assert r["clean"] == "mail [EMAIL] or [PHONE]; [CARD]" and [s["kind"] for s in r["pii"]] == ["email", "card", "phone"]
    assert out.where("doc_id = 1").first()["clean"] is None
    assert pii.detect(frame(spark, [])).count() == 0


# --- near-duplicates ----------------------------------------------------------------------------------------------


def brute_groups(rows, size, num, den):
    def shingles(t):
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least.get(find(i)), doc == least.get(find(i))) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((k, " ".join(copy)))
            k += 1
    rng.shuffle(rows)
    rows += [(9001, None), (9002, ""), (9003, "One"), (9004, "one"), (9005, LONG), (9006, LONG.upper()), (9006, LONG)]
    got = sorted(map(tuple, neardup.deduplicate(frame(spark, rows), size=size).collect()), key=repr)
    assert got == sorted(brute_groups(rows, size, 80, 100), key=repr)


def test_near_duplicates_of_large_groups(spark):
    """Groups far over the size of a node that is compared in full, of texts near the threshold."""
    rng = random.Random(1)
    base = [f"x{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for j in rng.sample(range(60), rng.randrange(0, 7)):
            copy[j] = f"y{rng.randrange(1000)}"
        rows.append((i, " ".join(copy)))
    got = sorted(map(tuple, neardup.deduplicate(frame(spark, rows), size=2).collect()), key=repr)
    assert got == sorted(brute_groups(rows, 2, 80, 100), key=repr)


def planted(n, rng, shared=0):
    """n pairs of sets of similarity 0.80 to 0.85, all with as many more elements in common."""
    make = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64)
    common_to_all, out = make(shared), []
    for _ in range(n):
        own = int(rng.integers(8, 12))
        both = np.concatenate([common_to_all, make(9 * 9 - shared)])
        out.append([np.unique(np.concatenate([both, make(own - k)])) for k in (0, 0)])
    pairs = [(x, y) for x, y in out if 0.8 <= len(both := np.intersect1d(x, y)) / (len(x) + len(y) - len(both)) <= 0.85]
    assert len(pairs) > 0.7 * n
    return pairs


@pytest.mark.parametrize("compared", [0, 4096])
def test_pairs_at_the_threshold_in_large_nodes(spark, monkeypatch, compared):
    """Pairs near the threshold among documents that all have much in common, so that nodes stay large for long: by deeper
    trees, and cell by cell."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "CELL", 16)
    monkeypatch.setattr(neardup, "COMPARED", compared)
    rows = []
    for i, pair in enumerate(planted(300, np.random.default_rng(4), 55)):
        rows += [(2 * i + k, len(s), bytearray(neardup.signature(s).tobytes()), s.view(np.int64).tolist()) for k, s in enumerate(pair)]
    reps = common.materialise(spark.createDataFrame(rows, "rep long, n long, sig binary, s array<long>"), "reps")
    groups = neardup.link_by_paths(reps.drop("s"), 80, 100, 0.9999, lambda some: some.join(reps.select("rep", "s"), "rep"))
    got = {r["node"]: r["component"] for r in groups.collect()}
    assert got == {i: i - i % 2 for i in range(len(rows))}


@pytest.mark.parametrize("levels", neardup.DEPTHS)
def test_recall_of_the_trees_of_each_depth(levels):
    """Real sets of similarity 0.80 to 0.85, with the trees of a run: the share of pairs that share a node in some tree."""
    pairs = planted(3000, np.random.default_rng(levels))
    trees = neardup.trees_needed(0.8, levels, 1 - (1 - 0.9999) / len(neardup.DEPTHS))
    n = len(pairs)
    assert n >= 2000
    places = []
    for side in (0, 1):
        sig = np.stack([neardup.signature(p[side]) for p in pairs])
        row, node = np.repeat(np.arange(n), trees), np.tile(neardup._mix(np.arange(1, trees + 1, dtype=np.uint64)), n)
        for _ in range(levels):
            at, node = neardup.branch(node, sig[row], 0.8)
            row = row[at]
        places.append(np.stack([row.astype(np.uint64), node]).T)
    together = set(map(tuple, places[0].tolist())) & set(map(tuple, places[1].tolist()))
    assert len({r for r, _ in together}) / n >= 0.999


def test_links_of_a_task_equal_all_pairs():
    """Groups joined by the links of one task are the components of all links, whichever way the pairs are counted."""
    rng = np.random.default_rng(3)
    for size, spread in ((12, 3), (60, 9), (60, 14)):
        base = rng.integers(0, 2**40, 60)
        sets = []
        for _ in range(size):
            x = base.copy()
            x[rng.integers(0, 60, int(rng.integers(0, spread)))] = rng.integers(0, 2**40)
            sets.append(np.unique(x))
        sig = np.stack([neardup.signature(s.astype(np.uint64)) for s in sets])
        n, ids = np.asarray([len(s) for s in sets]), np.arange(size)
        for left, right in ((ids, None), (ids[: size // 2], ids[size // 2 :])):
            links = neardup.Links(ids, n, ids, sig, sets, 80, 100)
            links.all_of(left, right)
            parent = list(range(size))
            find = lambda x: x if parent[x] == x else find(parent[x])  # noqa: B023, E731
            for i, j in itertools.combinations(range(size), 2):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if (right is None or i < size // 2 <= j) and shared * 100 >= 80 * (n[i] + n[j] - shared):
                    parent[find(j)] = find(i)
            same = lambda labels: {tuple(np.flatnonzero(labels == x)) for x in labels}
            assert same(links.g) == same(np.asarray([find(i) for i in range(size)]))
            assert len(links.found) == size - len(set(links.g))


def test_near_duplicates_without_ids_or_rows(spark):
    out = {tuple(r) for r in neardup.deduplicate(frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (5, "zz yy")])).collect()}
    assert out == {(None, 2, None, True), (5, 1, 5, True)}
    assert neardup.deduplicate(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 199), (199, 198)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 198, 199: 198, 198: 198}


# --- decontamination ----------------------------------------------------------------------------------------------


def brute_hits(docs, items, window):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1)):
            if w:
                windows[tuple(w[s : s + window])].add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                x = tuple(w[s : s + n])
                if x in windows:
                    hit |= set(range(s, s + n))
                    ids |= {str(i) for i in windows[x] if i is not None}
        out.append((d, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = "a b c d é É the of in X1 zz".split()
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 14)))) for i in range(25)] + [(90, None), (91, ""), (3, "a b c"), (None, "the of in zz zz")]
    docs = [(i, ", ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + ODD[:6]
    docs += [(500 + i, f"zz! {t} A") for i, (_, t) in enumerate(items) if t]
    d, b = frame(spark, docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window int")
    out = decontamination.decontaminate(d, b, window=6).withColumn("items", F.array_join("items", ","))
    assert sorted(map(tuple, out.select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()), key=repr) == brute_hits(docs, items, 6)
    none = decontamination.decontaminate(d, b.limit(0)).where("contaminated").count()
    assert none == 0 and decontamination.decontaminate(frame(spark, []), b).count() == 0


# --- search -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["neardup", "decontamination"])
def test_rows_are_numbered_in_one_scan(spark, tmp_dir, name):
    """A second scan may be split otherwise and would number the rows otherwise, so the source is read once."""

    def scan(batches):
        for b in batches:
            with open(f"{tmp_dir}/scans", "a") as f:
                f.write("x" * b.num_rows)
            yield b

    words = [f"w{i}" for i in range(40)]
    docs = frame(spark, [(i, " ".join(words[i % 3 :])) for i in range(9)])
    docs = docs.mapInArrow(scan, docs.schema)
    items = spark.createDataFrame([(1, " ".join(words[5:20]))], "item_id long, text string")
    out = neardup.deduplicate(docs) if name == "neardup" else decontamination.decontaminate(docs, items)
    assert len(out.collect()) == 9
    assert len(open(f"{tmp_dir}/scans").read()) == 9


def brute_search(rows, mod, k):
    """rows (id, vector) -> (query_id, rank, vec_id, score), in Python's own integers."""
    import math

    whole = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, q) in enumerate(whole):
        if i % mod == 0:
            scores = [(-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(whole) if b != a and len(v) == len(q)]
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 8)), 1)
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows[10] = (10, rows[11][1])  # ties
    rows += [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] + [0.0] * 7), (903, [float("inf")] + [0.0] * 7), (None, [0.5] * 8)]
    rows += [(950, []), (904, []), (905, [1.0]), (975, [2.0]), (25, rows[3][1]), (3, rows[3][1])]  # other lengths, repeated ids
    v = search.integer_vectors(spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<float>, v string, row int"))
    got = sorted(map(tuple, search.search(v, F.col("id") % 25 == 0, k=5, block=64, query_block=4, n_pivots=6).collect()))
    assert got == brute_search(rows, 25, 5)
    assert search.search(v.limit(0), F.col("id") % 25 == 0).count() == 0


def test_search_takes_all_finite_vectors(spark):
    """Components whose products a long can't hold, or only just, keep vectors in."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=4) * 10.0 ** rng.integers(0, 9)]) for i in range(80)] + [(100, [1e6, -3e5, 0.5, 1e6]), (150, [1e30, 1.0, -1e30, 3.0]), (151, [-1e30, 1.0, 1e30, 5e7]), (200, [1e200, 0.0, 0.0, 0.0])]
    v = search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, search.search(v, F.col("id") % 50 == 0, k=5, block=16, query_block=2, n_pivots=5).collect()))
    assert got == brute_search(rows, 50, 5)


def test_search_evaluates_few_candidates_of_clustered_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, [float(c) for c in centres[i % 40] + rng.normal(size=16) * 0.1]) for i in range(4000)]
    v = search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    seen = spark.sparkContext.accumulator(0)
    got = sorted(map(tuple, search.search(v, F.col("id") % 50 == 0, evaluated=seen).collect()))
    assert got == brute_search(rows, 50, 5)
    share = seen.value / (80 * 3999)
    print(f"evaluated {share:.1%} of all pairs")
    assert share < 0.2


def test_block_of_evenly_spread_vectors_takes_little_time():
    """Where the bounds leave nearly all pairs, they are evaluated many at a time: about a tenth of the time for each pair."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(10_000, 64))
    x = np.floor(256 * x / np.sqrt((x * x).sum(axis=1))[:, None])
    x[7] = x[11]
    pivots, asks = search.pivots_of(x[:2000], 32), np.arange(0, 10_000, 25)
    d = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T)).astype(np.float32)
    ids, start = np.arange(10_000) * 3, time.process_time()
    got, seen = search.search_block(x[asks], asks, d[asks], np.full(len(asks), -np.inf), x, np.arange(10_000), ids, d, 5)
    took = time.process_time() - start
    want, scores = [], x[asks] @ x.T
    for j, a in enumerate(asks):
        scores[j, a] = -np.inf
        want += [(j, int(scores[j, i]), int(ids[i])) for i in np.lexsort((ids, -scores[j]))[:5]]
    assert sorted(got) == sorted(want) and 0 < seen <= len(asks) * 9999
    assert took < 3


# --- sharding -----------------------------------------------------------------------------------------------------


def test_sharding_splits_only_what_is_too_large(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(0, 300)) for i in range(400)] + [(7777, "same id " + "y" * k) for k in range(200)] + ODD[:5] + [(8888, "z" * 5000), (None, "q"), (9999, "c" * 600), (9999, "c" * 600)]
    out = sharding.shard(frame(spark, rows), 1000).collect()
    assert len(out) == len(rows)
    size, count = collections.Counter(), collections.Counter()
    for r in out:
        size[r["shard"]] += r["n_bytes"]
        count[r["shard"]] += 1
    for r in out:
        assert r["shard_bytes"] == size[r["shard"]] and r["shard_docs"] == count[r["shard"]] and r["depth"] == len(r["shard"])
        assert r["fits"] == (size[r["shard"]] <= 1000)
        assert r["fits"] or count[r["shard"]] == 1 or r["doc_id"] == 9999
    shards = set(size)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)  # prefix-free
    total = collections.Counter()
    for s, n in size.items():
        for k in range(len(s)):
            total[s[:k]] += n
    assert all(total[s[:-1]] > 1000 for s in shards if s)  # no split without need
    assert sharding.shard(frame(spark, []), 1000).count() == 0


# --- archives -----------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, sha string"


def test_archive_round_trip(spark, tmp_dir):
    import base64
    import hashlib

    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(["a" * 10, "b", "a" * 10, None, "", "é" * 70_000, "b", "c"])] + [(None, "u", "c"), (50, None, "d")]
    pages = spark.createDataFrame([(*r, "p", "s") for r in rows], PAGES)
    path = warc.archive(pages, f"file://{tmp_dir}/w")
    back = warc.read_archive(spark, path, verify=True)
    got = {warc_id: (kind, n, digest, ref) for warc_id, kind, n, digest, ref in back.select(warc.page_id_of("record_id"), "record_type", "payload_bytes", "payload_digest", warc.page_id_of("refers_to")).collect()}
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i != top[h or ""]
        assert got[i] == ("revisit" if again else "response", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), top[h or ""] if again else None)
    whole = warc.read_archive(spark, path, ["record_id", "record_type", "payload"]).where("record_type = 'response'")
    assert {r["record_id"]: bytes(r["payload"]) for r in whole.collect()}["<urn:page:5>"] == ("é" * 70_000).encode()
    assert "payload" not in warc.read_archive(spark, path).columns
    assert warc.archive(pages.limit(0), f"file://{tmp_dir}/none") and warc.read_archive(spark, f"file://{tmp_dir}/w", ["record_id"]).where("record_id = '<urn:page:50>'").count() == 1


def test_filters_are_checked_on_headers_and_payloads_skipped():
    import io

    data = [warc.record(k, f"<r:{i}>", f"http://h/{i}", "D", b"x" * (100 * i)) for i, k in enumerate(["response", "metadata", "response"] * 3)]
    for packed in (b"".join(data), b"".join(map(warc.member, data))):
        s = io.BytesIO(packed)
        got = list(warc.records(s, packed[:2] == b"\x1f\x8b", lambda h: h["warc-type"] == "metadata"))
        assert [(h["warc-record-id"], len(p)) for h, p in got] == [("<r:1>", 100), ("<r:4>", 400), ("<r:7>", 700)]
        assert [p for _, p in warc.records(io.BytesIO(packed), packed[:2] == b"\x1f\x8b", payloads=False)] == [None] * 9
    import gzip

    plain = b"".join(gzip.compress(d) for d in data)  # members that don't say how long they are
    assert [len(p) for _, p in warc.from_bytes(plain)] == [100 * i for i in range(9)]


def test_damaged_archives_raise():
    import io

    whole = [warc.record("response", f"<r:{i}>", "http://h", "D", bytes(random.Random(i).randbytes(5000))) for i in range(3)]
    for packed, compressed in ((b"".join(whole), False), (b"".join(map(warc.member, whole)), True)):
        assert len(list(warc.records(io.BytesIO(packed), compressed))) == 3
        for cut in (len(packed) - 3000, len(packed) // 3 + 20, 40):
            for payloads in (True, False):
                with pytest.raises(ValueError, match="ends at byte"):
                    list(warc.records(io.BytesIO(packed[:cut]), compressed, payloads=payloads))
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n"), False))


def test_long_headers_and_control_characters():
    import io

    url = "http://h/" + "x" * (3 << 20)
    data = warc.record("response", "<r:1>", url, "D", b"abc") + warc.record("response", "<r:2>", "http://h/\r\n\r\nWARC/1.1\r\n\0\x85", "D", b"de")
    for packed, compressed in ((data, False), (warc.member(data), True)):
        got = list(warc.records(io.BytesIO(packed), compressed))
        assert [(h["warc-record-id"], p) for h, p in got] == [("<r:1>", b"abc"), ("<r:2>", b"de")]
        assert got[0][0]["warc-target-uri"] == url and got[1][0]["warc-target-uri"] == "http://h/%0D%0A%0D%0AWARC/1.1%0D%0A%00%85"


def test_members_of_four_gigabytes_are_skipped_whole():
    import struct

    head = warc.member(b"x" * 100)
    assert struct.unpack("<HQQ", head[14:32]) == (16, len(head), 100)


def test_shards_are_written_whole(spark, tmp_dir):
    rows = [(i, "x" * (i % 300)) for i in range(300)] + [(None, None), (5, "")]
    sharding.write_shards(frame(spark, rows), f"{tmp_dir}/s", 2000, columns=("w",))
    back = spark.read.parquet(f"{tmp_dir}/s")
    assert sorted([(r["doc_id"], r["text"]) for r in back.collect()], key=repr) == sorted(rows, key=repr)
    sizes = [r["b"] for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).collect()]
    assert len(sizes) > 10 and max(sizes) <= 2000


# --- quality and toxicity -----------------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(6)
    good = "the of and to in is that for it was on are with as his they at be this have from".split()
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(good) + rng.choice(["", "ing", "er"]) for _ in range(rng.randrange(30, 200))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = " ".join(words) + "."
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 8 else (words[0] + " ") * 80
        if toxic:
            w = text.split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["moronic", "scumbag", "worthless"]))
            text = " ".join(w)
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(1, 1, 0), (None, 1, 1), (2, None, None)]
    return docs, spark.createDataFrame([(*r, "q") for r in labels], "doc_id long, quality int, toxic int, y string")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    held = common.is_held_out("doc_id", 5, 0)
    out = quality.score_quality(frame(spark, docs + [(1000, None), (1001, ""), (None, "x"), (1002, LONG)]), labels, ~held)
    got = [tuple(r) for r in out.where(held).join(labels.dropDuplicates(["doc_id"]), "doc_id").select("predicted", "quality").collect()]
    assert len(got) > 40 and sum(a == b for a, b in got) / len(got) > 0.95
    scores = [r["score"] for r in out.collect()]
    assert len(scores) == len(docs) + 4 and all(0 <= s <= 1 for s in scores)
    assert {r["score"] for r in quality.score_quality(frame(spark), labels.limit(0), ~held).collect()} == {0.5}
    assert quality.score_quality(frame(spark, []), labels, ~held).count() == 0


def test_quality_scores_are_differences_of_log_densities():
    """Scores against densities worked out without Cholesky factors, from covariances shrunk as the docstring says."""
    rng = np.random.default_rng(8)
    x = {0: rng.normal(size=(200, quality.SIZE)) @ rng.normal(size=(quality.SIZE, quality.SIZE)) * 0.3, 1: rng.normal(size=(350, quality.SIZE)) + 0.5}
    sums = {c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()}
    model = quality.fit(sums, own=0.7, ridge=0.15)
    cov = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = sum(len(v) * cov[c] for c, v in x.items()) / 550
    rows, side = rng.normal(size=(50, quality.SIZE)), []
    for c, v in x.items():
        share = 0.7 * len(v) / (len(v) + quality.SIZE)
        s = share * cov[c] + (1 - share) * pooled
        s = 0.85 * s + 0.15 * np.diag(np.diag(s)) + 1e-4 * np.eye(quality.SIZE)
        d = rows - v.mean(axis=0)
        side.append(np.log(len(v) / 550) - 0.5 * (np.einsum("ij,ij->i", d @ np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]))
    want = 1 / (1 + np.exp(-np.clip((side[1] - side[0]) / model.temperature, -500, 500)))
    assert np.allclose(model.score(rows), want, rtol=1e-6, atol=1e-12)


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    docs, labels = labelled(spark)
    held = common.is_held_out("doc_id", 4, 2)
    extra = [(1000, None), (1001, ""), (None, "x"), (1002, LONG), (1003, "you worthles moronicc"), (1004, "a fine day for the park with his dog")]
    out = toxicity.score_toxicity(frame(spark, docs + extra), labels, ~held)
    got = [tuple(r) for r in out.where(held).join(labels.dropDuplicates(["doc_id"]), "doc_id").select("predicted", "toxic").collect()]
    assert len(got) > 40 and sum(a == b for a, b in got) / len(got) > 0.95
    by = {r["doc_id"]: r["predicted"] for r in out.where("doc_id >= 1000").collect()}
    assert by == {1000: 0, 1001: 0, 1002: 0, 1003: 1, 1004: 0}
    assert out.columns == ["doc_id", "text", "pii", "n_words", "w", "score", "predicted"]
    assert {r["score"] for r in toxicity.score_toxicity(frame(spark), labels.limit(0), ~held).collect()} == {0.0}
    assert toxicity.score_toxicity(frame(spark, []), labels, ~held).count() == 0


def distance(a, b):
    """Optimal string alignment distance."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distances():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = sorted({word(rng.randrange(3, 13)) for _ in range(40)})
    auto = toxicity.Automaton(terms)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice("abc") * rng.randrange(2)
        w = "".join(w)
        best = min(((e, t) for t in terms if (e := distance(t, w)) <= toxicity.budget(t)), default=None)
        got = auto.match(w)
        assert (got is None) == (best is None) and (got is None or got[0] == best[0]), (w, got, best)


def test_quotation_weighs_less():
    lex = toxicity.Lexicon(["moronic"], weights=(-3.0, 6.0, 0.0, 3.0))
    memo = lex.matcher()
    abuse, quoted = (lex.score(np.array([lex.features(t, memo)]))[0] for t in ("you are a moronic man and so on", 'the word "moronic" is a term in the example'))
    assert abuse > 0.9 and quoted < 0.3


def test_a_stray_quote_sign_changes_nothing_further_on():
    lexicon = toxicity.Lexicon(["moronic"])
    memo, rest = lexicon.matcher(), " ".join(["word"] * 60)
    hits = " ".join(f"you moronic {rest}" for _ in range(5))
    plain = lexicon.features(f"{rest} {hits}", memo)
    assert plain[1] == 0.0
    for stray in ('a 6" nail', '"so it began', "so it ended\"", "'n"):
        assert lexicon.features(f"{stray} {rest} {hits}", memo) == plain, stray
    for text in ('they wrote "you moronic man" today', 'a 6" nail and then "moronic" too', '"a b" c "you are moronic" d'):
        assert lexicon.features(text, memo)[1] > 0, text
    assert lexicon.features('"a b" moronic "c d"', memo)[1] == 0.0
