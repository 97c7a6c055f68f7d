"""Joins whose sides grow inside of the plan: no side is sent to all tasks, however small Spark takes it for."""

import random

from tracewell.llm import near, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_golay_keys_are_not_broadcast(spark):
    fps = spark.range(100).selectExpr("xxhash64(id) as fp")
    assert "BroadcastHashJoin" not in plan(simhash.links(fps))


def test_joins_on_shingles_are_not_broadcast(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    docs = spark.createDataFrame([(i, " ".join(draw.choice(words) for _ in range(50))) for i in range(20)], "doc_id long, text string")
    plans, land = {}, near.landed

    def seen(df, name):
        plans[name] = plan(df)
        return land(df, name)

    monkeypatch.setattr(near, "landed", seen)
    near.near_components(docs)
    for name in ("shared-shingles", "near-pairs"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name]
