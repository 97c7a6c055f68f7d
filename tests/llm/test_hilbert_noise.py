"""Nearest neighbours in vectors without clusters and with one very long vector, against all pairs."""

import numpy as np
import pytest

from tracewell.llm import hilbert


@pytest.mark.parametrize("outlier", [False, True])
def test_search_on_noise_against_all_pairs(spark, monkeypatch, outlier):
    monkeypatch.setattr(hilbert, "QUERY_CHUNK", 16)  # blocks are copied for several groups of queries
    monkeypatch.setattr(hilbert, "RANGE", 200)
    x = np.random.default_rng(8).normal(size=(1500, 12))
    x[700:710] = x[700]  # ties go to the smaller id
    if outlier:
        x[3] *= 1000
    frame = spark.createDataFrame([(i, v.tolist(), "extra") for i, v in enumerate(x)], "vec_id long, embedding array<double>, curve string")
    found = {}
    for r in hilbert.search(frame, 20, 20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits, scores = 0, x @ x.T
    assert found.keys() == set(range(0, 1500, 20))
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and len({r[1] for r in rows}) == 20
        assert all(s == pytest.approx(scores[q, v], abs=1e-9) for _, v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        best = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(scores[q, i], 9), i))[:20]
        hits += len(set(best) & {v for _, v, _ in rows})
    assert hits >= 0.9 * 20 * len(found)
