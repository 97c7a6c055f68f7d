"""Readers, inventories, sinks and contracts over files in a temporary folder."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import labels
from tracewell.operators import contracts, roles
from tracewell.operators.contracts import ContractError
from tracewell.sources import inventory, readers, sinks


def test_discovery_prefers_named_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "other.csv").write_text("x,y,profile_id\n1,2,3\n")
    (tmp_path / "a" / "Temperature_runs.csv").write_text('"x",y,profile_id\n1,2,3\n')
    (tmp_path / "a" / "short.csv").write_text("x\n1\n")
    assert readers.discover_table(spark, str(tmp_path), ["x", "profile_id"]).endswith("Temperature_runs.csv")
    with pytest.raises(ContractError):
        readers.discover_table(spark, str(tmp_path), ["nope"])


def test_table_and_strict_profiles(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("line,x,profile_id\n0,1.5,7\n1,2.5,7\n2,9.0,8\n")
    df = readers.read_table(spark, str(path), "line long, x double, profile_id int", "profile_id")
    assert dict(df.dtypes)["profile_id"] == "bigint"
    got = readers.read_profiles_strict(df, required=["x"], profile="profile_id", order="line").collect()
    assert sorted((r["profile_id"], r["sample_idx"]) for r in got) == [(7, 0), (7, 1), (8, 0)]
    broken = spark.createDataFrame([(0, 1.0, 1), (1, 2.0, 2), (2, 3.0, 1)], "line long, x double, profile_id long")
    with pytest.raises(ContractError):
        readers.read_profiles_strict(broken, required=["x"], profile="profile_id", order="line")
    path.write_text("line,x,profile_id\n0,,7\n")
    with pytest.raises(ContractError):
        readers.read_table(spark, str(path), "line long, x double, profile_id int", "profile_id")


def test_profile_folder_and_curves(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    for k in (3, 12):
        (folder / f"run_{k}.csv").write_text("line,x\n1,5.0\n0,4.0\n")
    got = readers.read_profile_folder(spark, str(folder), "line long, x double", line="line").collect()
    assert sorted((r["profile_id"], r["sample_idx"], r["x"]) for r in got) == [(3, 0, 4.0), (3, 1, 5.0), (12, 0, 4.0), (12, 1, 5.0)]
    (folder / "run_5.csv").write_text("line,x\n0,NaN\n")
    with pytest.raises(ContractError, match="finite"):
        readers.read_profile_folder(spark, str(folder), "line long, x double", line="line")
    (folder / "run_5.csv").write_text("line,x\n0,1.0\n0,1.0\n")
    with pytest.raises(ContractError, match="duplicate"):
        readers.read_profile_folder(spark, str(folder), "line long, x double", line="line")
    (tmp_path / "q.csv").write_text("row_id,a,b\n0,1,2\n1,3,4\n")
    (tmp_path / "c.csv").write_text("row_id,0.0,0.5,1.0\n1,7,8,9\n0,4,5,6\n")
    pair = str(tmp_path / "q.csv"), str(tmp_path / "c.csv")
    rows = {r["row_id"]: (r["params"], r["curve"]) for r in readers.read_curve_pair(spark, *pair, positions=3).collect()}
    assert rows[0] == ([1.0, 2.0], [4.0, 5.0, 6.0])
    assert readers.read_curve_registry(spark, {"u": pair, "v": pair}, positions=3).count() == 4
    with pytest.raises(ContractError):
        readers.read_curve_pair(spark, *pair, positions=4)


def test_inventory_freeze_and_aliases(spark, tmp_path):
    for name, text in (("HEALTHY_S1200_T52.mat", "a"), ("HEALTHY_S1500_T64.mat", "a"), ("notes.txt", "b")):
        (tmp_path / name).write_text(text)
    files = inventory.file_inventory(spark, str(tmp_path)).cache()
    assert files.count() == 3 and {r["bytes"] for r in files.collect()} == {1}
    found = inventory.discover_records(files, "name", labels.bench_labels, ["speed_rpm", "torque_code"], ["speed_rpm"]).collect()
    assert [r["speed_rpm"] for r in found] == [1200, 1500]
    first = inventory.canonical_aliases(files.select("name", "sha256"), "sha256", ["name"]).collect()
    assert sorted((r["name"], r["copies"]) for r in first) == [("HEALTHY_S1200_T52.mat", 2), ("notes.txt", 1)]
    frozen = spark.createDataFrame([(r["name"], r["sha256"]) for r in files.collect()], "name string, sha256 string")
    inventory.verify_frozen(files, frozen, ["name"], "sha256")
    with pytest.raises(ContractError):
        inventory.verify_frozen(files, frozen.withColumn("sha256", F.lit("x")), ["name"], "sha256")


def test_sinks_round_trip(spark, tmp_path, capsys):
    df = spark.createDataFrame([("m1", "a", 1.0, [1, 2]), ("m2", "b", 2.0, [3])], "target string, method string, v double, blocks array<int>")
    root = str(tmp_path / "tree")
    sinks.write_results(df, root)
    sinks.write_results(df.filter("target = 'm1'").withColumn("v", F.lit(9.0)), root)
    back = {r["target"]: r["v"] for r in readers.read_results(spark, root).collect()}
    assert back == {"m1": 9.0, "m2": 2.0}
    readers.read_results(spark, root).filter("target = 'm1'").explain("formatted")
    assert "PartitionFilters: [isnotnull(target" in capsys.readouterr().out
    sinks.export_csv(df, str(tmp_path / "csv"), compress=True)
    text = "".join(gzip.open(p, "rt").read() for p in (tmp_path / "csv").glob("*.csv.gz"))
    assert "1 2" in text
    sinks.write_document(df, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).count() == 2
    assert '"v":1.0' in sinks.as_document(df).orderBy("document").first()[0]
    m = np.arange(6.0).reshape(2, 3)
    sinks.save_matrix(spark, str(tmp_path / "mat"), "c", m)
    assert np.array_equal(sinks.load_matrix(spark, str(tmp_path / "mat"), "c"), m)


def test_feature_selection(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 3)], "id long, s string, x double, y int")
    assert readers.feature_columns(df, ["id"]) == ["x", "y"]
    assert readers.common_features(df, df.drop("y"), ["id"]) == ["x"]
    with pytest.raises(ContractError):
        readers.feature_columns(df, ["id", "x", "y"])
    assert readers.without_columns(df, ["y"]).columns == ["id", "s", "x"]


def test_contract_failures(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    with pytest.raises(ContractError):
        contracts.checked_join(left, left.unionByName(left), ["k"])
    with pytest.raises(ContractError):
        contracts.checked_join(left, left.filter("k = 1"), ["k"])
    with pytest.raises(ContractError):
        contracts.require_columns(left, ["k", "w"])
    with pytest.raises(ContractError):
        contracts.require_columns(left, ["k"], ["v"])


def test_role_protocols(spark):
    assert roles.bracket_violations(roles.FIT_LOADS, roles.LOADS) == []
    assert all(len(v) == 4 and k not in v for k, v in roles.FIT_LOADS.items())
    blocks = spark.range(40).select(F.col("id").alias("b"), F.lit(40).cast("long").alias("n"))
    counts = {r["r"]: r["count"] for r in blocks.groupBy(roles.contiguous_role("b", "n", adaptation=4 / 38, calibration=20 / 38).alias("r")).count().collect()}
    assert counts == {"adaptation": 4, "calibration": 20, "guard": 2, "test": 14}
    folds = spark.range(60).select(roles.leave_one_out_folds(["a", "b", "c"]).alias("f")).first()["f"]
    assert len(folds) == 9 and sum(f["role"] == "target" for f in folds) == 3
