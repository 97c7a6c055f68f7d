"""Line dedup drops whole documents only where the texts are alike."""

import random

from pyspark.sql import functions as F

from tracewell.llm import lines

SCHEMA = "doc_id long, text string, n_chars long"


def test_shared_passage_keeps_own_lines_and_copies_go(spark):
    draw = random.Random(6)
    line = lambda n: " ".join(f"w{draw.randint(0, 9999)}" for _ in range(n))
    passage, first, second = "\n".join(line(20) for _ in range(4)), line(40), line(40)
    whole = "\n".join(line(20) for _ in range(10))
    copy = whole.replace(whole.split()[5], "other thing entirely")
    rows = [(1, f"{first}\n{passage}"), (2, f"{passage}\n{second}"), (3, whole), (4, copy), (5, whole), (6, None), (None, passage)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], SCHEMA)
    left = {r["doc_id"]: r["text"] for r in lines.drop_repeats(docs.filter("doc_id is not null")).collect()}
    assert left == {1: rows[0][1], 2: second, 3: whole, 6: None}
    # a null id sorts first, so its lines are the first places
    left = {r["doc_id"]: r["text"] for r in lines.drop_repeats(docs).collect()}
    assert left == {1: first, 2: second, 3: whole, 6: None, None: passage}


def test_shingles_of_words(spark):
    table = spark.createDataFrame([(None,), ("",), ("A b\tc",), ("a b c d e f",), ("a b c d e a b c d e",)], "t string")
    assert [r[0] for r in table.select(F.size(lines.shingles(F.col("t")))).collect()] == [1, 1, 1, 2, 5]
