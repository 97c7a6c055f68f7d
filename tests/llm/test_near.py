"""The near-duplicate stage of the pipeline against all pairs."""

import random

import numpy as np

import corpus_pipeline
from tracewell.llm import near, simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def table():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([8, 40, 150, 400]))) for _ in range(60)]
    for text in list(texts):
        for edits in (1, 2, 4, 6, 10):
            own = text.split()
            for at in draw.sample(range(len(own)), min(edits, len(own))):
                own[at] = draw.choice(words)
            texts.append(" ".join(own))
    texts += [f"{passage} {draw.choice(words)} {' '.join(draw.choice(words) for _ in range(k))}" for k in range(5, 65)]
    texts += ["a b", "a b", "a c", "", " ", None]
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_near_components_equal_all_pairs(spark, sf):
    rows = table()
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if j < i and similarity(a, b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    want = {i: top(i) for i, _ in rows}
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in near.near_components(docs).collect()} == want
    kept = corpus_pipeline.near_once(spark, docs, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())
    assert len(set(want.values())) < len(rows) - 60


def test_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """300 copies with an edit each, one of them shared with a second group: hubs link them, no pairs inside are left."""
    draw = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for i in range(300):
        own = list(base)
        own[draw.randrange(120)] = f"e{i}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts)) + [(1000, " ".join(base[:60] + [f"z{i}" for i in range(60)]))]
    sizes, land = {}, near.landed

    def counted(df, name):
        made = land(df, name)
        sizes[name] = made.count()
        return made

    monkeypatch.setattr(near, "landed", counted)
    found = {r["doc_id"]: r["component_id"] for r in near.near_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: 0 for i in range(300)} | {1000: 1000}
    assert sizes["hub-pairs"] <= 301 and sizes["near-pairs"] <= 301


def test_near_keep_one_of_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(40))
    odd = spark.createDataFrame([(1, text, 7, "r"), (2, text, 8, "s")], SCHEMA + ", _n int, row string")
    assert near.keep_one(odd).collect() == [(1, text, 7, "r")]
    docs = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text), (5, text + " end"), (6, "other")], SCHEMA)
    assert sorted((r["doc_id"] or -1) for r in near.keep_one(docs).collect()) == [-1, -1, 3, 6]
    assert near.keep_one(docs.limit(0)).count() == 0


def test_simhash_links_come_first(spark):
    """Sets whose fingerprints lie within two bits are paired by the Golay keys, those of one fingerprint with its first."""
    nodes = spark.createDataFrame([(7, 1), (7, 2), (7, 9), (7 ^ 5 << 40, 3), (7 ^ 7 << 20, 4), (-1, 5)], "fp long, node long")
    assert sorted((min(r), max(r)) for r in near.fingerprint_pairs(nodes).collect()) == [(1, 2), (1, 3), (1, 9)]
    words = [f"w{i}" for i in range(400)]
    other = [*words[:200], "changed", *words[201:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "far away from both")], "doc_id long, text string")
    prints = {r["doc_id"]: r["fp"] for r in near._sets(docs, near.SHINGLE, near.SIMILARITY).collect()}
    assert all(prints[d] == int(np.int64(np.uint64(simhash.vote(near.shingle_set(t.encode()))))) for d, t in docs.collect())
    assert {(r["doc_id"], r["component_id"]) for r in near.near_components(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
