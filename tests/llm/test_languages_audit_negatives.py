"""Language by compression, the filter audit and hard negatives against brute force, with nulls, ties, repeats and odd columns."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tracewell.llm import audit, compression, hardneg

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, part string, mask int, _t string, _h long, letters int"
WORDS = {"en": "the of and to in is that for it as was with be by on", "de": "der die und das ein ist nicht für über straße grün auf dem",
         "fr": "le la les des été où déjà être pour avec une dans qui"}


def doc(i, text, lang):
    return (i, text, lang, "s", 1, "x", "y", 3, "t", 4, 5)


def sentence(draw, lang, n):
    return " ".join(draw.choice(WORDS[lang].split()) + draw.choice(["", "", ".", "!!"]) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    draw = random.Random(3)
    rows = [doc(i, sentence(draw, lang, draw.randint(3, 60)), lang) for i in range(400) for lang in [draw.choice(["en", "en", "en", "de", "fr"])]]
    return [*rows, doc(900, None, "en"), doc(901, "", "de"), doc(902, "12 %% 34", None), doc(903, sentence(draw, "de", 6000), None),
            doc(None, sentence(draw, "fr", 40), "fr"), rows[7], rows[7]]


def test_language_by_compression(spark, mixed):
    docs = spark.createDataFrame(mixed, DOCS)
    got = compression.identify(docs).collect()
    assert len(got) == len(mixed)
    truth = {r[0]: (r[1], r[2]) for r in mixed}
    right = [r["lang_pred"] == truth[r["doc_id"]][1] for r in got if r["held_out"] and truth[r["doc_id"]][1] and (truth[r["doc_id"]][0] or "").strip()]
    assert np.mean(right) > 0.97 and all(0.0 <= r["score"] <= 1.0 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["rejected"] for i in (900, 901, 902))
    assert by_id[903]["lang_pred"] == "de" and not by_id[903]["rejected"]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_prediction_uses_neither_lang_nor_held_out_rows(spark, mixed):
    changed = [(*r[:2], "zz", *r[3:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r for r in mixed]
    first, second = (sorted(compression.identify(spark.createDataFrame(x, DOCS)).collect(), key=str) for x in (mixed, changed))
    assert first == second


def test_sizes_are_those_of_the_dictionaries(spark, mixed):
    train = spark.createDataFrame(mixed, DOCS).filter("doc_id is not null")
    learned = compression.dictionaries(train)
    assert [x[0] for x in learned][0] == "en" and len(learned) == 3
    draw = random.Random(8)
    for lang in WORDS:
        text = compression.plain(sentence(draw, lang, 2000))
        sizes = compression.code_lengths(text, compression._compressors(learned))
        place, score, margin = compression.verdict(sizes)
        assert learned[place][0] == lang and min(sizes) == sizes[place] and 0 < margin < 1 and 0.3 < score <= 1
    assert compression.verdict([5, 5, 9])[0] == 0 and compression.verdict([7])[2] == 1.0


def test_no_languages_and_no_rows(spark, mixed):
    empty = spark.createDataFrame([], DOCS)
    assert compression.identify(empty).count() == 0
    none = spark.createDataFrame([doc(1, "some words", None)], DOCS)
    assert [tuple(r)[2:4] for r in compression.identify(none).collect()] == [("und", 0.0)]


def brute_audit(rows, labels):
    """Every order, applied document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    parts = {}
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and r[0] > least[t]}
        parts.setdefault(r[2] or "", []).append((r[0], fails))
    out, removed = [], {}
    for part, docs in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                all_fail = sum(d[1][f] for d in docs)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in docs)
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                out.append([part, order, step, len(left), len(gone), all_fail - len(gone), only,
                            sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)])
    return sorted(tuple(x) + (removed[x[0], x[1][x[2] - 1]],) for x in out)


def audit_rows():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(160)] + ["UP", "A&B", "#x", "río"]
    texts = [" ".join(draw.choice(words[:draw.choice([5, 160, 164])]) for _ in range(draw.choice([20, 99, 100, 130]))) for _ in range(40)]
    texts += [None, "", " ", "ABC", "x\ty\x0bz"]
    rows = [doc(i, draw.choice(texts), draw.choice(["en", "de", None, ""])) for i in draw.sample(range(1000), 150)]
    return rows + rows[:3] + [doc(None, texts[0], "en"), doc(None, texts[0], "en")]


@pytest.mark.parametrize("backwards", [False, True])
def test_audit_equals_brute_force(spark, tmp_path, backwards):
    """Files in rising and falling id order: later files bring smaller ids, so masks must be taken back."""
    rows = sorted(audit_rows(), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0), reverse=backwards)
    path = str(tmp_path / "documents.parquet")
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i:i + 40], DOCS).coalesce(1).write.mode("append").parquet(path)
    labels = [(i, i % 2, i % 3) for i in range(0, 1000, 2)] + [(None, 1, 1), (rows[5][0], None, None), (rows[5][0], 1, 1)]
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, h string")
    got = audit.audit(spark, path, table, batches=3).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, labels)


def test_audit_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark, path, labels).count() == 0


VECTORS = "vec_id long, embedding array<double>, label int, v string, width int, block int, _r int"


def brute_negatives(rows, anchors_of, positives=5, negatives=10):
    ok = [(i, lab, np.floor(256 * np.array(v, float))) for i, v, lab, *_ in rows
          if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in ok:
        if i % anchors_of == 0:
            anchors[i] = min(anchors.get(i, (lab, v.tolist())), (lab, v.tolist()))
    out = set()
    for a, (lab, v) in anchors.items():
        scored = [(int(np.dot(v, w)), i, other) for i, other, w in ok if len(w) == len(v)]
        first = sorted((-s, i) for s, i, other in scored if other == lab and i != a)[:positives]
        for s, p in {(-n, i) for n, i in first}:
            inside = sorted((-n, i) for n, i, other in scored if other != lab and 30 * s <= 100 * n <= 90 * s)[:negatives]
            out |= {(a, p, r, i, s, -n) for r, (n, i) in enumerate(inside, 1)}
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_negatives_equal_brute_force(spark, clustered, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16)) * (3 if clustered else 0)
    x = np.round(centres[rng.integers(0, 6, 900)] + rng.normal(size=(900, 16)) * (0.3 if clustered else 1.0), 2)
    rows = [(int(i), x[i].tolist(), int(rng.integers(0, 4)), "o", 1, 2, 3) for i in range(900)]
    rows += [(1000, None, 1, "o", 1, 2, 3), (1001, [1.0, None] + [0.0] * 14, 1, "o", 1, 2, 3), (1010, [float("nan")] * 16, 1, "o", 1, 2, 3),
             (1020, x[0].tolist(), None, "o", 1, 2, 3), (None, x[0].tolist(), 1, "o", 1, 2, 3), (1030, [0.0] * 16, 1, "o", 1, 2, 3),
             (1040, [], 1, "o", 1, 2, 3), (1050, [1.0, 2.0], 1, "o", 1, 2, 3), (1051, [1.0, 2.5], 1, "o", 1, 2, 3), (1052, [1.0, 1.0], 2, "o", 1, 2, 3),
             (-10, x[3].tolist(), 2, "o", 1, 2, 3), rows[20], rows[20], rows[31]]
    df = spark.createDataFrame(rows, VECTORS).repartition(7)
    monkeypatch.setattr(hardneg, "BLOCK", 24)
    want = brute_negatives(rows, 10)
    for size in (1 << 30, 1):  # one round, and a round for every block
        got = hardneg.mine(df, anchors_of=10, round_bytes=size).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_vectors_and_no_anchors(spark):
    assert hardneg.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hardneg.mine(spark.createDataFrame([(1, [1.0], 1, "o", 1, 2, 3)], VECTORS)).count() == 0


def test_bounds_spare_most_rescoring():
    """On clusters far apart the tree lets most candidates pass without a product, and no wanted one is missed."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 32)) * 40
    points = np.floor(centres[rng.integers(0, 12, 240)] + rng.normal(size=(240, 32)))
    x = np.floor(centres[rng.integers(0, 12, 1000)] + rng.normal(size=(1000, 32)))
    order, parent, edge = hardneg.spanning_tree(points)
    assert sorted(order) == list(range(240)) and (parent[1:] < np.arange(1, 240)).all()
    assert np.allclose(edge[1:], np.linalg.norm(points[order[1:]] - points[order[parent[1:]]], axis=1))
    tree = hardneg.Tree(np.arange(240), np.zeros(240), points[order], parent, edge)
    least, seen = 30_000.0, []
    tree.walk(x, lambda j, low, high: high >= least, lambda j, rows, scores: seen.extend((j, int(r)) for r, s in zip(rows, scores) if s >= least))
    truth = np.argwhere(points[order] @ x.T >= least)
    assert set(seen) == {tuple(p) for p in truth.tolist()}
    assert tree.rescored < 0.25 * 240 * 1000
