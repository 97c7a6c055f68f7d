"""The sketch that travels with the keys of a line: it keeps every pair within the edits and parts words of one place."""

import random

from pyspark.sql import functions as F

from tracewell.llm import lines


def difference(a, b, edits):
    d = [(a.count(c) - b.count(c) + 8) % 16 - 8 for c in lines.KEY_LETTERS]
    return sum(x for x in d if x > 0) <= edits and -sum(x for x in d if 0 > x > -8) <= edits  # a difference of eight counts as none


def test_counts_are_compared_one_by_one(spark):
    draw = random.Random(8)
    rows = []
    for i in range(600):
        a = [draw.choice("abcdefghijklmnopqrstuvwxyz é" if i % 2 else "etaonis rf") for _ in range(draw.randint(20, 400))]
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(b) - 1)
            b[at:at + draw.randint(0, 1)] = draw.choice(["", *"xkrétf "])
        rows.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", *[
        lines.counts_near(lines.sketch(F.col("a"), lines.KEY_LETTERS), lines.sketch(F.col("b"), lines.KEY_LETTERS), e).alias(f"e{e}") for e in (1, 2)]).collect()
    assert [(r["e1"], r["e2"]) for r in got] == [(difference(r["a"], r["b"], 1), difference(r["a"], r["b"], 2)) for r in got]
    assert 100 < sum(r["e2"] for r in got) < 580


def test_lines_with_other_words_make_no_pairs(spark, monkeypatch):
    """One template with a word of its own in each line: the eight letters of before left all pairs to be compared."""
    draw, written = random.Random(9), {}
    words = ["".join(draw.choice("rhldcumf") for _ in range(12)) for _ in range(60)]
    text = "\n".join(f"it is one tension that a sea at noon {w} sees as a nation in its attention" for w in words)
    landed = lines.landed
    monkeypatch.setattr(lines, "landed", lambda df, name: written.setdefault(name, landed(df, name)))
    lines.classes(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert written["line-pairs"].count() < 60 * 59 / 2 / 5
