"""The plans for large inputs, forced on small tables, must give the results of the small-input plans."""

import duckdb
import pytest
from compare import TABLES, rows_of

from tracewell import plans

NAMES = ("detected_records", "d5_conformal_p_values", "e2_grouped_quantiles", "e13_auroc", "e14_average_precision", "e15_correlations",
         "e16a_robust_scale_relative", "e16c_robust_scale_spread", "e21_column_profile", "e24_quantile_bins", "c7_broken_runs", "f2_lag_lead",
         "f3_first_k", "f5_onset", "f6_sustained_runs", "f9_cumulative_mass", "f10_holm", "g3_conformal_thresholds", "m1_grouped_split",
         "m5_alternating_split", "m8_entity_balanced_blocks", "d7_asof", "d8_kth_neighbour", "d9_leave_one_out", "l11_context_support",
         "l14_difficulty_scale", "e31_band_coverage", "l22_scaled_bands", "l19_stratified_bootstrap", "l20_signed_ranks", "l23_weighted_conformal")

#: Plans without a cross join; e24 still crosses its rows with the one row of cut points.
NO_LOOPS = ("detected_records", "d5_conformal_p_values", "e13_auroc", "e31_band_coverage", "l14_difficulty_scale", "l22_scaled_bands")


@pytest.mark.parametrize("name", NAMES)
def test_chunked_plan_equals_sql(spark, sf, name, capsys):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    spark.conf.set("spark.tracewell.rowsPerChunk", "150")
    spark.conf.set("spark.tracewell.broadcastRows", "60")
    try:
        df = plans.QUERIES[name](spark, sf)
        capsys.readouterr()
        df.explain("formatted")
        plan = capsys.readouterr().out
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.unset("spark.tracewell.rowsPerChunk")
        spark.conf.unset("spark.tracewell.broadcastRows")
    found = con.execute(plans.ORACLES[name])
    assert got == rows_of([c[0] for c in found.description], found.fetchall())
    if name in NO_LOOPS:
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_copies_do_not_multiply_pairs(spark):
    """A third of the reference is one repeated vector; neighbours count copies without pairing them."""
    import numpy as np
    import pandas as pd

    from tracewell.operators.neighbours import nearest

    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(600, 3)), 1)
    x[:200] = x[0]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(600))
    df = spark.createDataFrame(pdf)
    full = np.sort(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)), axis=1)
    for limit in ("50", "100000"):
        spark.conf.set("spark.tracewell.broadcastRows", limit)
        try:
            for k in (1, 4):
                got = nearest(df, df, ["a", "b", "c"], k=k).toPandas().sort_values("id")
                assert np.allclose(got["distance"], full[:, k - 1])
        finally:
            spark.conf.unset("spark.tracewell.broadcastRows")
