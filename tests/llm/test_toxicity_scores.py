"""Toxicity scores against plain edit distances and plain windows; stems by their endings; quotations that labels excuse."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import toxicity


def distance(a, b):
    """Edits with transpositions of neighbours, each letter edited once."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain_features(lex, text):
    words = text.lower().split()
    bare = [w.strip(toxicity._EDGE) for w in words]
    stem = [next((s for s in lex.stems if w.startswith(s)), None) for w in bare]
    weight = []
    for w, s in zip(bare, stem):
        if len(w) < 3:
            weight.append(0.0)
        elif s is not None and w not in lex.terms:
            weight.append(1.0 if len({x for x, y in zip(bare, stem) if y == s and x not in lex.terms}) > 1 else 0.0)
        else:
            near = min(((e, t) for t in lex.terms if (e := distance(w, t)) <= toxicity.budget(t)), default=None)
            if near is None or near[0] and (w in lex.allowed or len(near[1]) < 5 and w.isalpha()):
                weight.append(0.0)
            else:
                weight.append(0.7 ** near[0])
    abuse = quoted = 0.0
    kept = [0.0] * len(words)
    for i, k in enumerate(weight):
        if k:
            factor = 1.0
            if toxicity.in_quotes(words, i):
                near = set(bare[max(0, i - 8) : i + 9])
                factor = 0.1 if near & toxicity._REPORTS else 0.3
                quoted += k
            abuse += k * factor
            kept[i] = k * factor
    best = max((sum(kept[max(0, i - 50) : i + 1]) for i in range(len(words))), default=0.0)
    return [math.log1p(abuse), math.log1p(quoted), math.log1p(best)]


def test_features_equal_plain_ones():
    rng = random.Random(4)
    lex = toxicity.Lexicon(["moron", "scumbag", "worthless", "rat", "disgusting"], ["bomente", "achlich"], ["worthies"])
    memo = lex.matcher()
    letters = "abcdefghilmnorstuw"
    seen = 0
    for _ in range(250):
        words = []
        for _ in range(rng.randrange(0, 90)):
            w = rng.choice([*lex.terms, "bomenteco", "bomentera", "achlichen", "worthies", "the", "of", "said", "word", "".join(rng.choices(letters, k=5))])
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]])
            words.append(rng.choice(["", "", "", '"', "“"]) + rng.choice([w, w.upper()]) + rng.choice(["", "", "", '"', "”", "."]))
        got = lex.features(" ".join(words), memo)
        assert np.allclose(got, plain_features(lex, " ".join(words))), words
        seen += got[1] > 0
    assert seen > 50


def test_an_automaton_that_forgets_finds_the_same(monkeypatch):
    rng = random.Random(5)
    terms = ["".join(rng.choices("abcd", k=rng.randrange(4, 12))) for _ in range(40)]
    words = ["".join(rng.choices("abcd", k=rng.randrange(1, 14))) for _ in range(1500)] + ["abcd" * 50_000]
    whole = [toxicity.Automaton(terms).match(w) for w in words]
    monkeypatch.setattr(toxicity, "MOST_STATES", 50)
    auto = toxicity.Automaton(terms)
    for w, m in zip(words, whole):
        assert auto.match(w) == m
        assert len(auto.sets) < 50 + 40 * 14 + 200_000


def labelled(spark, seed=6):
    """Rows with a productive stem, whose endings are new in every row, and quoted abuse that is labelled clean."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "ver ge lich keit ung schaft tal berg".split() for b in "en er an in on ul".split()]
    filler = lambda k: [rng.choice(plain) for _ in range(k)]
    ending = lambda: "".join(rng.choices("aeioumnrst", k=rng.randrange(2, 6)))
    rows = []
    for i in range(1200):
        w, kind = filler(rng.randrange(30, 60)), 5 if i % 12 == 9 else i % 6
        if kind == 0:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), "xurbel" + ending())
        elif kind == 1:
            w.insert(rng.randrange(len(w)), "xurbel" + ending())  # once: chance
        elif kind == 2:
            at = rng.randrange(len(w))
            w[at:at] = ["moronic", "scumbag", "moronic"]
        elif kind == 3:
            at = rng.randrange(5, len(w) - 5)
            w[at:at] = ["the", "word", '"moronic', "scumbag", 'moronic"', "means"]
        rows.append((i, " ".join(w), int(kind in (0, 2)), kind))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, kind int").repartition(4)


def test_stems_and_quotations_are_learned(spark):
    d = labelled(spark)
    labels = d.select("doc_id", "toxic")
    train = F.col("doc_id") % 5 != 0
    lex = toxicity.learn(d, labels, train)
    assert lex.stems and all("xurbel".startswith(s) or s.startswith("xurbel") for s in lex.stems)
    assert not any(t.startswith("xurbel") for t in lex.terms) and {"moronic", "scumbag"} <= set(lex.terms)
    assert lex.weights[2] != 0  # quoted hits play a part in what is learned
    got = toxicity.score_toxicity(d, labels, train).where(~train).groupBy("kind", "toxic").agg(F.avg("predicted").alias("p")).collect()
    for r in got:
        assert (r["p"] > 0.95) if r["toxic"] else (r["p"] < 0.05), r
