"""Raw data to normalised records to cache entries: the ways it can fail, and whole runs on fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import extraction, metrics, preflight, scoring
from plumbline.sources import ingest, readers, shards


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


RAW = [{"question_id": k, "image": f"COCO_val2014_{k:012}.jpg", "text": f"Is there a {n} in the image?", "label": y} for k, n, y in ((1, "dog", "yes"), (2, "cat", "no"), (3, "red car", "yes"))]


@pytest.fixture
def root(tmp_path):
    lines(tmp_path / "data/pope/popular.jsonl", RAW)
    images = tmp_path / "data/coco/val2014"
    images.mkdir(parents=True)
    for r in RAW:
        (images / r["image"]).write_text("x")
    nested = tmp_path / "data/dash-b/images"
    nested.mkdir(parents=True)
    (nested / "dash_benchmark_neg.json").write_text(json.dumps({"coco": {"toaster": ["000000000314.jpg"]}}))
    (nested / "dash_benchmark_pos.json").write_text(json.dumps({"coco": {"dog": ["000000000042.jpg"]}}))
    return str(tmp_path)


def test_datasets_are_discovered(spark, root):
    got = {(r["dataset_name"], r["subset"]): (r["path"].removeprefix(root), r["status"]) for r in ingest.discovered(spark, root).collect()}
    assert got["pope", "popular"] == ("/data/pope/popular.jsonl", "present")
    assert got["pope", "random"] == ("/outputs/stage0/normalized/pope/random.jsonl", "missing")
    assert got["dash-b", "all"] == ("/data/dash-b", "present") and ("dash-b", "main") not in got
    lines(__import__("pathlib").Path(ingest.normalised_path(root, "dash-b", "main")), RAW)
    assert ("dash-b", "main") in {(r["dataset_name"], r["subset"]) for r in ingest.discovered(spark, root).collect()}


def test_rows_by_shape_of_their_source(spark, root, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps(RAW))
    for source in (RAW, f"{root}/data/pope/popular.jsonl", str(tmp_path / "list.json"), ingest.rows_of(spark, RAW)):
        got = ingest.rows_of(spark, source).select("line", F.variant_get("json", "$.question_id", "int").alias("id")).orderBy("line").collect()
        assert [tuple(r) for r in got] == [(1, 1), (2, 2), (3, 3)]
    assert ingest.rows_of(spark, f"{root}/data/dash-b").count() == 2


def test_materialised_records_are_read_again(spark, root):
    target = ingest.materialise(spark, root, "pope", "popular")
    got = ingest.read_normalised(spark, target).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["image_id"], r["label"], r["object_name"], r["source_dataset"], r["split"]) for r in got] == [("1", "1", 1, "dog", "pope", "popular"), ("2", "2", 0, "cat", "pope", "popular"), ("3", "3", 1, "red car", "pope", "popular")]
    assert ingest.discovered(spark, root).where("dataset_name = 'pope' and subset = 'popular'").first()["path"] == target
    ingest.materialise(spark, root, "pope", "popular")
    assert not [x for x in os.listdir(os.path.dirname(target)) if x != "popular.jsonl"]
    nested = ingest.read_normalised(spark, ingest.materialise(spark, root, "dash-b", "all")).orderBy("label").collect()
    assert [(r["label"], r["object_name"], r["image_id"]) for r in nested] == [(0, "toaster", "314"), (1, "dog", "42")]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"image": "../../../secret_000000000001.jpg"}, "must resolve under its root"),
        ({"image": "COCO_val2014_000000000009.jpg"}, "file is missing under its root"),
        ({"label": "maybe"}, "unsupported label"),
        ({"image": "nothing.jpg"}, "no image id"),
    ],
)
def test_faults_of_raw_rows_stop_the_run(spark, root, tmp_path, change, message):
    lines(tmp_path / "data/pope/popular.jsonl", [*RAW[:2], RAW[2] | change])
    with pytest.raises(Exception, match=message):
        ingest.materialise(spark, root, "pope", "popular")
    assert not os.path.exists(ingest.normalised_path(root, "pope", "popular"))


def test_unknown_and_missing_datasets(spark, root):
    with pytest.raises(ValueError, match="unknown"):
        ingest.build_normalised(spark, root, "pope", "nowhere")
    with pytest.raises(FileNotFoundError, match="raw data"):
        ingest.build_normalised(spark, root, "pope", "random")
    os.rename(f"{root}/data/coco", f"{root}/data/elsewhere")
    with pytest.raises(FileNotFoundError, match="image root"):
        ingest.build_normalised(spark, root, "pope", "popular")


def test_normalised_records_need_their_nine_fields(spark, tmp_path):
    full = dict.fromkeys(readers.RECORD_COLUMNS, "x") | {"label": 1}
    lines(tmp_path / "a.jsonl", [full, {k: v for k, v in full.items() if k not in ("split", "label")}])
    with pytest.raises(Exception, match=r"a\.jsonl:2: missing fields: label, split"):
        ingest.read_normalised(spark, str(tmp_path / "a.jsonl")).collect()


def test_sources_must_be_the_expected_one(spark):
    rows = frame(spark, [("a", "pope", " "), ("b", "repope", "popular"), ("c", None, "random")], "sample_id string, source_dataset string, subset string")
    got = {r["sample_id"]: r["issues"] for r in ingest.source_issues(rows, "pope", "popular").collect()}
    assert got == {"b": ["source_dataset is not pope"], "c": ["subset is not popular"]}


@pytest.mark.parametrize(("text", "want"), [("3", 3), ("1.5", 1), ('"1.5"', None), ('" -7 "', -7), ("true", None), ("null", None), ("[1]", None)])
def test_optional_integers(spark, text, want):
    assert frame(spark, [(text,)], "t string").select(ingest.optional_int(F.parse_json("t"))).first()[0] == want


def test_json_of_one_row(spark, tmp_path):
    row = frame(spark, [(2, None, {"x": 1})], "b int, a string, m map<string, int>")
    ingest.write_json(row, str(tmp_path / "deep/m.json"))
    assert (tmp_path / "deep/m.json").read_text() == '{\n  "a": null,\n  "b": 2,\n  "m": {\n    "x": 1\n  }\n}\n'
    ingest.write_json(row, str(tmp_path / "deep/m.json"), order=("b", "absent", "a"))
    assert (tmp_path / "deep/m.json").read_text() == '{\n  "b": 2,\n  "absent": null,\n  "a": null\n}\n'
    for bad in (row.union(row), row.limit(0)):
        with pytest.raises(ValueError):
            ingest.write_json(bad, str(tmp_path / "n.json"))
    assert ingest.first_existing(spark, "m.json", str(tmp_path), str(tmp_path / "deep")) == str(tmp_path / "deep/m.json")
    assert ingest.first_existing(spark, "gone", "/r") == "/r/gone" and ingest.first_existing(spark, "/gone", "/r") == "/gone"


RECORD = "sample_id string, image_id string, image_path string, question string, label int, object_name string, split string, subset string, source_dataset string"


def records(spark, n=20):
    return frame(spark, [(f"s{k:02}", str(k), f"{k}.jpg", f"Is there a {'x' * (k % 3 + 1)}?", k % 2, "o", "val", "ab"[k % 2], "pope") for k in range(n)], RECORD)


def test_a_run_from_records_to_published_entries(spark, tmp_path):
    root = str(tmp_path / "cache")
    said = extraction.run(records(spark), scoring.stub_scorer, root, model="tiny", dataset="pope", image_root="/images", limit=7, rows_per_shard=3)
    assert said["rows"] == 14 and said["metadata"]["model_name"] == "tiny"
    got = shards.read_published(spark, root, verify=True).orderBy("sample_id").collect()
    assert [r["sample_id"] for r in got] == [f"s{k:02}" for k in range(14)]
    assert all(r["parsed_answer"] == (r["answer_text"] == "Yes.") and r["image_path"].startswith("/images/") and r["model_name"] == "tiny" for r in got)
    with pytest.raises(Exception, match="s03: label must be 0 or 1"):
        extraction.run(records(spark).withColumn("label", F.when(F.col("sample_id") == "s03", 5).otherwise(F.col("label"))), scoring.stub_scorer, root, model="tiny", dataset="pope")
    assert shards.current(spark, root)["generation"] == said["generation"]


def test_plans_say_what_would_be_done(spark):
    models = frame(spark, [("m",), ("n",)], "model_name string")
    done = frame(spark, [("m", "pope", "a", 10), ("n", "pope", "a", 4)], "model_name string, dataset_name string, subset string, n long")
    got = {(r["model_name"], r["subset"]): (r["num_records"], r["num_shards"], r["state"], r["folder"]) for r in extraction.planned(records(spark), models, "/c/", rows_per_shard=4, done=done).collect()}
    assert got == {("m", "a"): (10, 3, "done", "/c/m/pope/a"), ("n", "a"): (10, 3, "partial", "/c/n/pope/a"), ("m", "b"): (10, 3, "planned", "/c/m/pope/b"), ("n", "b"): (10, 3, "planned", "/c/n/pope/b")}
    assert {r["num_records"] for r in extraction.planned(records(spark), models, "/c", limit=3).collect()} == {3}


def test_vectors_of_entries(spark):
    df = frame(spark, [(None, [[1.0, 2.0]]), ([[1.0], [2.0, 3.0]], None), ([[float("nan")]], None), ([], None), ([[5.0]], [[6.0]])], "l array<array<double>>, h array<array<double>>")
    assert [r[0] for r in df.select(extraction.layers_of(F.col("l"), F.col("h"))).collect()] == [[[1.0, 2.0]], None, None, None, [[5.0]]]
    cast = extraction.cast_vectors(df.withColumn("s", F.struct("l", F.lit("double").alias("t"))))
    assert dict(cast.dtypes) == {"l": "array<array<float>>", "h": "array<array<float>>", "s": "struct<l:array<array<float>>,t:string>"}
    assert dict(extraction.cast_vectors(df, "h").dtypes)["l"] == "array<array<double>>"


def test_candidates_and_models(spark):
    m, f = frame(spark, [("a",), ("b",), (None,)], "path string"), frame(spark, [("b",), ("c",)], "path string")
    assert {r["path"]: r["listed"] for r in extraction.shard_candidates(m, f).collect()} == {"a": True, "b": True, "c": False}
    assert [r[0] for r in extraction.model_names(frame(spark, [("n",), (None,), ("m",), ("n",)], "model_name string")).collect()] == ["m", "n"]


def test_result_tables_get_ids_and_defaults(spark):
    df = frame(spark, [(k * 3 % 7, float(k)) for k in range(7)], "k int, score double")
    got = metrics.result_frame(df, extra=("note",), place="k").collect()
    assert got[0].asDict() == {"sample_id": "row-000000", "image_id": -1, "object_name": "", "subset": "", "label": 0, "prediction": 0, "score": 0.0, "fold": 0, "note": ""}
    assert [r["sample_id"] for r in got] == [f"row-{k:06d}" for k in range(7)] and [r["score"] for r in got] == [0.0, 5.0, 3.0, 1.0, 6.0, 4.0, 2.0]
    with pytest.raises(ValueError):
        metrics.result_frame(df)
    assert [r["sample_id"] for r in metrics.result_frame(frame(spark, [(5,), (12,)], "sample_id int")).collect()] == ["12", "5"]


def test_issues_of_balances_and_manifests(spark):
    kind = "model_name string, dataset_name string, subset string"
    seen, need = frame(spark, [("m", " d ", "a"), (None, "d", "b")], kind), frame(spark, [("m", "d", "a"), ("m", "d", "b"), ("m", "d", "b")], kind)
    assert [tuple(r) for r in preflight.balance_issues(seen, need).collect()] == [("cache_label_balance.csv missing rows", "m/d/b", "")]
    s, p = frame(spark, [("failed",)], "status string"), frame(spark, [("b", ["x"]), ("a", ["y", "z"]), ("c", [])], "path string, errors array<string>")
    assert [tuple(r) for r in preflight.manifest_issues(s, p, first=2).collect()] == [("cache_manifest status is not passed", "failed", ""), ("cache_manifest errors present", "", "a: y; a: z")]
    assert preflight.manifest_issues(frame(spark, [("passed",)], "status string"), p.limit(0)).collect() == []
