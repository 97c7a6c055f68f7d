"""Marks are not lost among many candidates, nor among texts with one opening."""

import zlib

from tracewell.llm import toxicity

SCHEMA = "doc_id long, text string"


def letters(n):
    return "".join(chr(ord("a") + int(d)) for d in str(n))


def test_rarest_mark_survives_many_candidates(spark):
    # 21,000 words stand in four toxic and four clean texts after four different words, the mark in three toxic texts
    common = [f"k{letters(i)}k" for i in range(21_000)]
    texts = [(k, " ".join(f"{'abcd'[k % 4]} {w}" for w in common) + (f" {'xyz'[k]} zuzzle" if k < 3 else "")) for k in range(8)]
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:8]
    docs = spark.createDataFrame([(ids[k], t) for k, t in texts], SCHEMA)
    labels = spark.createDataFrame([(ids[k], int(k < 4)) for k in range(8)], "doc_id long, toxic int")
    marks = toxicity.learn(docs, labels, toxicity.letter_model(docs))
    assert "zuzzle" in marks and common[0] not in marks


def test_readings_of_texts_with_one_opening_count_apart(spark):
    opening = "the same forty letters open all of these texts"
    docs = spark.createDataFrame([(i, f"{opening} number{letters(i)} {'gr1mble' if i % 3 == 0 else 'gentle'}") for i in range(60)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert "grimble" in toxicity.learn(docs, labels, toxicity.letter_model(spark.createDataFrame([(1, "grimble grim imble " * 50)], SCHEMA)))
