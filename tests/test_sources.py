import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.contracts import GateError
from tallyframe.operators import fidelity, generate
from tallyframe.plans import bundle
from tallyframe.sources import tables
from tallyframe.streaming.monitor import windowed_validity


def test_csv_header(spark, tmp_path):
    good, bad = tmp_path / "a.csv", tmp_path / "b.csv"
    good.write_text("﻿x,\"y,z\"\n1,2\n")
    bad.write_text("x,x\n1,2\n")
    assert tables.csv_header(spark, str(good)) == ["x", "y,z"]
    assert tables.load_table(spark, str(good), header=False).columns == ["column_0", "column_1"]
    for path, code in ((str(bad), "duplicate_columns"), ("a.xlsx", "unsupported_input_format")):
        with pytest.raises(GateError) as found:
            tables.load_table(spark, path)
        assert found.value.reason_code == code


def test_strict_lines(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("|header\n1, a, yes.\n2, b, no.\n")
    assert [tuple(r) for r in tables.delimited_records(spark, str(path), ["n", "c", "y"], ", ", strip_suffix=".", skip="|").collect()] == [("1", "a", "yes"), ("2", "b", "no")]
    df = spark.createDataFrame([("sick.|12",), ("negative.|13",)], "c string")
    assert [tuple(r) for r in tables.class_and_record(df, "c", ["sick", "negative"]).collect()] == [("sick", "12"), ("negative", "13")]


def test_generators(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "xy"[i % 4 // 2], float(i)) for i in range(40)], "k long, p string, c string, v double")
    made = generate.network_sample(df, {"p": [], "c": ["p"]}, 200, 3)
    assert made.count() == 200 and made.where("p is null or c is null").count() == 0
    assert generate.bic(df, "c", []) <= 0
    new = generate.smote(df, "k", ["v"], "p", "a", 30, 5, k=3)
    assert new.count() == 30 and new.agg(F.min("v"), F.max("v")).first()[0] >= 0
    both = fidelity.union_arms(df, generate.permuted(df, "k", 1))
    assert fidelity.ks_complement(both, ["v"]).first().score == 1


def test_bundle_is_verified(spark, tmp_path):
    base = spark.createDataFrame([("m", "column", "a", 0.5, 1.0, 0.5), ("m", "column", "b", 0.25, 1.0, 0.5)], "metric_id string, scope_type string, scope_id string, aggregate_contribution double, normalized_value double, weight double")
    rows = bundle.atomic(base.withColumn("aggregate_contribution", F.lit(0.5)), state="computed", dimension="shape", n_reference=2, n_synthetic=2, n_valid=4, n_excluded=0)
    path = str(tmp_path / "b.parquet")
    bundle.write_bundle(rows, path)
    assert bundle.validate_bundle(spark, path).count() == 0
    assert bundle.property_scores(rows).first().score == 1.0
    bad = {r.problem for r in bundle.problems(rows.unionAll(rows.limit(1)).withColumn("weight", F.lit(-1.0))).collect()}
    assert {"duplicate_key", "negative_weight", "wrong_contribution"} <= bad


def test_monitor(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:20:00", 9.0), ("2024-01-01 01:20:00", 2.0)], "t string, v double").withColumn("t", F.to_timestamp("t"))
    got = windowed_validity(df, "t", {"v": [{"type": "bounds", "max": 5}]}).orderBy("start").collect()
    assert [(r.n, r.v_pass_rate) for r in got] == [(2, 0.5), (1, 1.0)]


def test_plain_lines_only(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_bytes("1, é\n".encode())
    with pytest.raises(GateError, match="schema_mismatch"):
        tables.delimited_records(spark, str(path), ["n", "c"], ", ", ascii_only=True)
    path.write_bytes(b"1, a\r\n")
    with pytest.raises(GateError, match="schema_mismatch"):
        tables.delimited_records(spark, str(path), ["n", "c"], ", ", ascii_only=True)
    with pytest.raises(GateError, match="schema_mismatch"):
        tables.class_and_record(spark.createDataFrame([("sick.|1",)], "c string"), "c", ["sick"], fields=30)


def test_sinks_and_splits(spark, tmp_path):
    df = spark.createDataFrame([(2, "b,\"c\""), (1, None)], "i long, s string")
    tables.save_csv(df, f"{tmp_path}/c", ["i"])
    assert sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/c", header=True, escape='"').collect()) == [("1", None), ("2", 'b,"c"')]
    tables.save_json(df, f"{tmp_path}/j")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/j").collect()) == ['{"i":1,"s":null}', '{"i":2,"s":"b,\\"c\\""}']
    tables.save_record({"b": 1, "a": None}, f"{tmp_path}/state.json")
    assert (tmp_path / "state.json").read_text() == '{"a": null, "b": 1}'
    tables.save_splits({"train": df, "test": df.limit(1)}, f"{tmp_path}/s")
    assert {k: v.count() for k, v in tables.load_splits(spark, f"{tmp_path}/s").items()} == {"train": 2, "test": 1}


def test_array_files(spark, tmp_path):
    for split, n in (("train", 3), ("test", 2)):
        np.save(tmp_path / f"X_num_{split}.npy", np.arange(2 * n, dtype=float).reshape(n, 2))
        np.save(tmp_path / f"y_{split}.npy", np.array([f"c{i}" for i in range(n)]))
    got = {(r.split, r.row): (r.X_num, r.y) for r in tables.load_arrays(spark, str(tmp_path), {"X_num": "number", "y": "text"}).collect()}
    assert len(got) == 5 and got["train", 2] == ([4.0, 5.0], ["c2"]) and got["test", 0] == ([0.0, 1.0], ["c0"])


def test_checksums(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert tables.checked_files(spark, str(tmp_path), {"a.bin": good}).count() == 1
    for told in ({"a.bin": "0" * 64}, {"b.bin": good}):
        with pytest.raises(GateError, match="checksum_mismatch"):
            tables.checked_files(spark, str(tmp_path), told)


def test_registered_dataset(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("x,g,y\n" + "".join(f"{i}.5,k{i % 3},{i % 2}\n" for i in range(60)))
    told = tables.register_dataset(spark, str(source), f"{tmp_path}/out", "mine", target="y")
    assert told["columns"] == {"numeric": ["x"], "categorical": ["g"], "target": ["y"]} and sum(s["rows"] for s in told["splits"].values()) == 60
    assert all(r.complete for r in tables.materialization_status(spark, f"{tmp_path}/out").collect())
    source.write_text("x,g,y\n1,?,0\n")
    with pytest.raises(GateError, match="missing_values_prohibited"):
        tables.register_dataset(spark, str(source), f"{tmp_path}/out2", "mine", target="y")


def test_dataset_descriptions(spark, tmp_path):
    for folder, rows in (("a", [{"name": "x", "task": "one"}, {"name": "y", "task": None}]), ("b", [{"name": "y", "task": "two"}, {"name": "z", "task": "three"}])):
        (tmp_path / folder).mkdir()
        for r in rows:
            (tmp_path / folder / f"{r['name']}.json").write_text(json.dumps(r))
    got = {r.name: r.task for r in tables.dataset_specs(spark, f"{tmp_path}/a", f"{tmp_path}/b", "name").collect()}
    assert got == {"x": "one", "y": "two", "z": "three"}
