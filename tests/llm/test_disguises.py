"""Common disguises reach the readings of a text, and a lexicon has no largest size."""

import pytest
from pyspark.sql import functions as F

from tracewell.llm import toxicity

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def model(spark, sf):
    return toxicity.letter_model(spark.read.parquet(f"{sf}/documents.parquet")).tolist()


def test_disguises_are_candidates(model):
    for text, word in (("so lo$$ it", "loss"), ("an a55, no", "ass"), ("so (at on", "cat"), ("the staand is", "stand"), ("s  t  a  n  d", "stand"),
                       ("s\tt\ta\tn\td", "stand"), ("s\nt\na\nn\nd", "stand"), ("so gr imb le it", "grimble"), ("so gr 1mb le it", "grimble")):
        restorer = toxicity.Restorer(model)
        assert word in restorer.readings(text) | restorer.joined(text), text


def test_long_runs_stay_small(model):
    restorer = toxicity.Restorer(model)
    assert len(restorer.joined("ab cd " * 5000)) <= 2 * toxicity.LONGEST
    assert len(restorer.readings("aabbccddeeffgghhiijjkkllmmnnoopp")) <= 8


def test_disguised_texts_are_found(spark):
    made = [(i, f"well {'abcdefgh'[i // 3 % 8]} {'grimble' if i % 3 == 0 else 'gentle'} {'xyz'[i % 2]} words number{i}") for i in range(60)]
    shown = ["now grimb1e again", "now gr  i mb le again", "now griimmble again", "now g\tr\ti\tm\tb\tl\te again", "now gr imb le again"]
    docs = spark.createDataFrame(made + [(200 + i, t) for i, t in enumerate(shown)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.judge(docs, labels).filter(F.col("doc_id") >= 200).collect()}
    assert got == {200 + i: 1 for i in range(len(shown))}


def test_marks_do_not_change_readings(spark, sf, model):
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select(F.lower("text")).limit(60).collect()]
    marks = {"the", "and", "loss", "stand", "in", "ass"}
    free, bound = toxicity.Restorer(model), toxicity.Restorer(model, marks)
    for text in [*texts, "so lo$$ a55 st4nd s t a n d (the th.e tthhee aanndd 1n"]:
        assert (free.readings(text) | free.joined(text)) & marks == (bound.readings(text) | bound.joined(text)) & marks
