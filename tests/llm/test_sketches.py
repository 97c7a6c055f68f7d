"""Counts of more letters part lines that the short sketch takes for near, and never lines within the edits."""

import random

from pyspark.sql import functions as F

from tracewell.llm import lines


def test_more_letters_part_replaced_words(spark):
    draw = random.Random(4)
    words = ["".join(draw.choice("rhldcumfpgwbvkjx") for _ in range(6)) for _ in range(20)]
    rows = [(f"one tension stays {a} here at noon", f"one tension stays {b} here at noon") for a, b in zip(words, words[1:])]
    table = spark.createDataFrame(rows, "a string, b string")
    more = lines.sketches_apart(lines.sketch(F.col("a"), lines.MORE_LETTERS), lines.sketch(F.col("b"), lines.MORE_LETTERS), lines.MORE_LETTERS)
    assert table.filter(lines.sketches_near(lines.sketch(F.col("a")), lines.sketch(F.col("b")), 2)).count() == len(rows)
    assert table.filter(more > 4).count() >= len(rows) - 2


def test_more_letters_keep_all_within_the_edits(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(300):
        line = [draw.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(draw.randint(20, 80))]
        made, edits = list(line), draw.randint(0, 2)
        for _ in range(edits):
            at = draw.randint(0, len(made) - 1)
            made[at:at + draw.randint(0, 1)] = draw.choice(["", *"xkré"])
        rows.append(("".join(line), "".join(made), edits))
    a, b = F.col("a"), F.col("b")
    apart = lines.sketches_apart(lines.sketch(a), lines.sketch(b)) + lines.sketches_apart(lines.sketch(a, lines.MORE_LETTERS), lines.sketch(b, lines.MORE_LETTERS), lines.MORE_LETTERS)
    assert spark.createDataFrame(rows, "a string, b string, e int").filter(apart > 2 * F.col("e")).count() == 0
