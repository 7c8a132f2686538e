"""The corpus pipeline: its stages against brute force on a small corpus with planted cases."""

import random

import corpus_pipeline
from tapeloom.llm import common
from tests.llm.test_operators import brute_groups, brute_hits


def corpus(spark, root):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "the of and to in is that for it was".split() for b in ("", "ing", "er", "s", "ed", "ly")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels = [], []
    items = [(i, text(20)) for i in range(5)]
    for i in range(240):
        t = text(rng.randrange(20, 90))
        toxic = i % 5 == 0
        if toxic:
            t = f"{t} you moronic worthless scumbag {t[:30]}"
        rows.append((i, t))
        labels.append((i, 1, int(toxic)))
    rows += [(300 + i, rows[i + 1][1]) for i in range(4)] + [(310, items[0][1] + " " + text(30)), (311, "mail a.b@c.de now " + text(20)), (312, None), (313, ""), (None, text(25)), (None, text(25)), (1, rows[1][1])]
    full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return rows, items


def test_stages_one_by_one(spark, tmp_dir):
    rows, items = corpus(spark, tmp_dir)
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    kept, seen = docs, rows
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, tmp_dir)
        path = f"{tmp_dir}/{name}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        got = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()] if name != "packing" else None
        if name == "toxicity":
            want = [(i, t) for i, t in seen if "moronic" not in (t or "")]
        elif name == "near_duplicates":
            want = [r for r, g in zip(seen, brute_groups(seen, 5, 80, 100)) if r[0] is None or g[3]]
            want = [r for r in dict.fromkeys(want)]
        elif name == "decontamination":
            bad = {r[0] for r in brute_hits(seen, items, 10) if r[5]}
            want = [r for r in seen if r[0] not in bad]
            assert 310 in bad
        elif name == "pii":
            want = [(i, t.replace("a.b@c.de", "[EMAIL]") if t else t) for i, t in seen]
        else:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {i for i, _ in seen}
            break
        assert sorted(got, key=repr) == sorted(want, key=repr), name
        kept, seen = out, got
    assert corpus_pipeline.run(spark, tmp_dir).count() > 0


def test_stages_judge_rows_and_not_ids(spark, tmp_dir):
    """Rows without ids and of repeated ids: each stays or goes by its own text."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item, t, u, v = text(20), text(40), text(40), text(40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")

    def after(stage, rows):
        docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted([(r["doc_id"], r["text"]) for r in stage(spark, docs, tmp_dir).collect()], key=repr)

    bad = f"{t} {item}"
    clean = [(None, u), (None, None), (5, v)]
    assert after(corpus_pipeline.drop_contaminated, [(None, bad), (5, bad), *clean]) == sorted(clean, key=repr)
    near = v.rsplit(" ", 1)[0]
    rows = [(3, t), (7, u), (7, t), (None, t), (None, v), (None, v), (9, near), (9, near), (4, ""), (4, ""), (None, ""), (None, "")]
    assert after(corpus_pipeline.drop_near_duplicates, rows) == sorted([(3, t), (7, u), (9, near), (4, ""), (None, ""), (None, "")], key=repr)


def test_stages_on_odd_rows(spark, tmp_dir):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, no labels, no items; and no rows at all."""
    from tests.llm.test_operators import LONG

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _key long, pii string, group long, ids string"
    rows = [(1, None), (2, ""), (3, "  "), (None, None), (None, "word"), (4, LONG), (5, "one two three"), (5, "one two three")]
    for some in (rows, []):
        docs = spark.createDataFrame([(i, t, None, None, None, 0.5, 7, "p", 9, "q") for i, t in some], schema)
        kept = []
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialise(stage(spark, docs, tmp_dir), name)
            kept.append((name, docs.count()))
        want = [("toxicity", 8), ("near_duplicates", 7), ("decontamination", 7), ("pii", 7)] if some else [(n, 0) for n, _ in corpus_pipeline.STAGES[:4]]
        assert kept[:4] == want and (kept[4][1] >= 7 if some else kept[4][1] == 0)
