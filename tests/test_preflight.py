"""Small fixtures with worked results for the checks and plans before a run, and for readers and writers that no query reaches."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.operators import preflight, quality
from plumbline.sources import readers, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scope_issues(spark):
    df = spark.createDataFrame([("pope", "popular"), ("pope", "main"), ("repope", "random"), (None, "main"), (" ", " ")], "dataset_name string, subset string")
    got = rows(preflight.scope_issues(df).select("field", "value", "n"))
    assert got == [("dataset_name", "<blank>", 2), ("dataset_name", "repope", 1), ("subset", "<blank>", 1), ("subset", "main", 2)]
    assert rows(preflight.scope_issues(df.limit(1))) == [] and rows(preflight.scope_issues(df.limit(0))) == []
    with pytest.raises(ValueError, match="repope"):
        quality.require_none(preflight.scope_issues(df.where("dataset_name = 'repope'")), "out of scope")


def test_summary_issues(spark):
    by = ("model_name", "subset")
    keys = spark.createDataFrame([("m", s) for s in "abcd"] + [("m", "a")], "model_name string, subset string")
    required = spark.createDataFrame([("m", "a", 3), ("m", "b", 4), ("m", "c", None)], "model_name string, subset string, expected long")
    completed = spark.createDataFrame([("m", "a", 3), ("m", "b", 5), ("m", "c", 7)], "model_name string, subset string, observed long")
    missing = spark.createDataFrame([("m", "c"), ("m", "z")], "model_name string, subset string")
    assert rows(preflight.summary_issues(keys, required, completed, missing, by)) == [
        ("cache matrix count mismatch", "m/b", "expected 4 got 5"),
        ("completed_cache_matrix missing", "m/d", ""),
        ("missing_cache_matrix contains required entries", "m/c", ""),
        ("missing_cache_matrix is not empty", "m/z", ""),
        ("required_cache_matrix missing", "m/d", ""),
    ]
    assert rows(preflight.summary_issues(keys.limit(0), required, completed, missing.limit(0), by)) == []


def test_matrix_of_shards(spark):
    shards = spark.createDataFrame([("m", "d", None, "a", None, "3"), ("m", "d", " ", None, "a", " 4 "), ("m", "d", "s", "a", "b", "x"), (None, "d", "s", "a", "a", "9"), ("m", "d", "d", " ", " ", "9")], "model_name string, dataset_name string, source_dataset string, subset string, split string, num_entries string")
    assert rows(preflight.matrix_of_shards(shards)) == [("m", "d", "d", "a", 7), ("m", "d", "s", "a", 0)]


def test_label_issues(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, None), ("b", 2, 0.1), ("b", None, float("nan")), ("b", 1, float("inf")), ("c", 1, 0.0)], "g string, y int, s double")
    assert rows(preflight.label_issues(df, "y", "s", by=("g",))) == [("a", 0, 1), ("b", 2, 2)]
    assert rows(preflight.label_issues(df.where("g = 'c'"), "y", by=("g",))) == []


def test_split_index(spark):
    df = spark.createDataFrame([("d", "s1", 1, "cal", "cat", "i1"), ("d", "s2", 0, "cal", "dog", "i2"), ("d", "s1", None, "test", "cat", "i1"), ("d", None, 1, "test", "cat", None), ("e", "s1", 1, "bank", None, "i1")], "dataset_name string, sample_id string, label int, split string, object_name string, image_id string")
    assert rows(preflight.split_index(df, ("dataset_name",))) == [("d", 4, "cal=2,test=2", "cal:0=1,cal:1=1,test:1=1,test:<blank>=1", "cal=2,test=1", 1, 1), ("e", 1, "bank=1", "bank:1=1", "bank=0", 0, 0)]


def test_still_to_make(spark):
    specs = readers.dataset_specs(spark, "/r", ["/r/outputs/stage0/normalized/pope/popular.jsonl"])
    sources = spark.createDataFrame([("pope", "popular", "x"), ("pope", "random", "y"), ("pope", "random", "y")], "dataset_name string, subset string, source_path string")
    assert rows(preflight.still_to_make(specs, sources, ("dataset_name", "subset"))) == [("pope", "random", "y", "/r/outputs/stage0/normalized/pope/random.jsonl", 2, "planned")]


def test_sidecars_and_shard_paths(spark):
    df = spark.createDataFrame([("p", "m", "a", [[1.0, 2.0]]), ("p", "m", "b", [[1.0, 2.0], [3.0, 4.0]]), ("q", None, "a", [[1.0]])], "shard string, model string, subset string, layer_vectors array<array<double>>")
    got = rows(preflight.sidecars(df, "shard", ("model", "subset")))
    assert got == [("p", 2, "m", None, 1, 2, 2, 2), ("q", 1, None, "a", 1, 1, 1, 1)]
    path = df.limit(1).select(preflight.shard_path("/o", "model", "shard", "subset", F.lit(12))).first()[0]
    assert path == "/o/m/p/a/shard-00012"


def test_knn_metric(spark):
    df = spark.createDataFrame([("Sphere-Mean",), ("Norm-Mean",), (None,)], "v string")
    assert [r[0] for r in df.select(preflight.knn_metric(F.col("v"))).collect()] == ["angular", "euclidean", "euclidean"]


def test_allowed_objects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"object_name": " cat "}\n\n{"object": "dog"}\n{"object_name": "", "object": "cow"}\n{"x": 1}\n')
    got = readers.allowed_objects(spark, [str(tmp_path / "a.jsonl")], (" bird ", " ", "cat"))
    assert sorted(r["name"] for r in got.collect()) == ["bird", "cat", "cow", "dog"]
    assert [r["name"] for r in readers.allowed_objects(spark, [], ("x",)).collect()] == ["x"]
    assert readers.allowed_objects(spark, []).count() == 0


def test_readers_of_ids_and_json_rows(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("3\n\n 5 \n")
    assert sorted(r["image_id"] for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == [3, 5]
    (tmp_path / "rows.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "one.json").write_text('{"a": 7}')
    a = F.try_variant_get("json", "$.a", "int")
    assert rows(readers.read_json_rows(spark, str(tmp_path / "rows.json")).select("line", a)) == [(1, 1), (2, 2)]
    assert rows(readers.read_json_rows(spark, str(tmp_path / "one.json")).select("line", a)) == [(1, 7)]


def test_manifests_and_identity(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"shards": [{"path": "p", "num_entries": 3}, {"num_entries": 4}]}')
    got = readers.manifest_shards(spark, str(tmp_path / "m.json")).collect()
    assert [(r["path"], r["num_entries"]) for r in got] == [("p", 3)]
    entries = spark.createDataFrame([("p", None, "a"), ("p", "m2", " "), ("z", None, "c")], "shard_path string, model string, subset string")
    sidecar = spark.createDataFrame([("p", "m1", "s")], "shard_path string, model string, subset string")
    filled = readers.filled_identity(entries, sidecar, ("model", "subset"))
    assert rows(filled.select("shard_path", "model", "subset")) == [("p", "m1", "a"), ("p", "m2", "s"), ("z", None, "c")]


def test_hashes_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([(2, "x")], "b int, a string")
    assert sinks.config_hash(df, ["b", "a"]).first()["config_hash"] == hashlib.sha256(b'{"a":"x","b":2}').hexdigest()
    (tmp_path / "f.bin").write_bytes(b"abc")
    got = sinks.file_digests(spark, str(tmp_path / "f.bin")).first()
    assert (got["length"], got["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"}), ({"d": "5"}, None)], "l map<string,string>, r map<string,string>")
    assert [dict(r[0]) for r in maps.select(sinks.merged_metadata("l", "r")).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}, {"d": "5"}]
