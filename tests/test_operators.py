"""Small fixtures with worked results for the operators of the library."""

import hashlib
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import gates, metrics, quality, reconcile, runtime, scoring, splits, vectors
from plumbline.plans import catalog
from plumbline.sources import readers, sinks


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def value(spark, column, **inputs):
    ddl = ", ".join(f"{k} string" for k in inputs) or "one string"
    return frame(spark, [tuple(inputs.values()) or ("x",)], ddl).select(column.alias("v")).first()["v"]


# --- scalar functions ------------------------------------------------------------------------------------------------


def test_trimming_and_first_text(spark):
    assert value(spark, T.trimmed("a"), a=" \t x y\x1f\n") == "x y"
    assert value(spark, T.first_text("a", "b"), a=" ", b=" b ") == "b"
    assert value(spark, T.text_or_null("a"), a="　") is None


@pytest.mark.parametrize(("text", "want"), [("Yes", 1), (" Y ", 1), ("present", 1), ("no", 0), ("False", 0), ("absent", 0), ("maybe", None), ("1.0", None), ("", None)])
def test_yes_no_label(spark, text, want):
    assert value(spark, T.yes_no_label(F.col("a")), a=text) == want


def test_strict_label_raises_on_unknown_words(spark):
    assert value(spark, T.strict_label(F.col("a")), a="true") == 1
    with pytest.raises(Exception, match="unsupported label"):
        value(spark, T.strict_label(F.col("a")), a="y")


@pytest.mark.parametrize(("text", "want"), [("Yes.", 1), ("well, NO!", 0), ("yesterday no", 0), ("nothing", None), ("<think>no</think>yes", 0), ("<think></think>yes", 1)])
def test_free_answers(spark, text, want):
    assert value(spark, T.response_answer("a"), a=text) == want


@pytest.mark.parametrize(("path", "want"), [("val/COCO_000000000314.jpg", "314"), ("x12.mp4", "4"), ("a/000.jpg", "0"), ("none", ""), ("9" * 30, "9" * 30)])
def test_image_id(spark, path, want):
    assert value(spark, T.image_id(F.col("a")), a=path) == want
    assert value(spark, T.image_id(F.col("a"), F.lit(" 7 ")), a=path) == "7"


@pytest.mark.parametrize(("q", "want"), [("Is there a Red Car in the image?", "red car"), ("is there AN apple in the image? ", "apple"), ("What?", "unknown")])
def test_object_name(spark, q, want):
    assert value(spark, T.object_name(F.col("a"), F.lit(None).cast("string")), a=q) == want
    assert value(spark, T.object_name(F.col("a"), F.lit("Cat")), a=q) == "Cat"


def test_sizes_rates_and_questions(spark):
    assert [value(spark, T.byte_size("a"), a=x) for x in ("10GiB", "500 MB", "1.5kb", "7", "x")] == [10 * 2**30, 500_000_000, 1500, 7, None]
    rates = frame(spark, [(1, 128), (1, 2), (1, 3), (0, 0), (3, 3)], "n int, d int").select(T.rate_text(F.col("n"), F.col("d")).alias("r"))
    assert [r["r"] for r in rates.collect()] == ["0.007812", "0.5", "0.333333", None, "1"]
    asked = value(spark, T.formatted_question("a"), a="Is it")
    assert asked == "Is it. Respond with only one word: yes or no." and value(spark, T.formatted_question("a"), a=asked) == asked


def test_layer_ranges(spark):
    def layers(n, part, count):
        a, b = T.layer_bounds(F.lit(n), part)
        return value(spark, T.spaced_layers(a, b, F.lit(count)))

    assert layers(28, "all", 5) == [0, 7, 14, 20, 27]
    assert layers(28, "middle", 1) == [13]
    assert layers(28, "early", 3) == [0, 6, 13]
    assert value(spark, T.quarter_layers(F.lit(28))) == [0, 7, 14, 21, 27]


# --- sources and sinks -----------------------------------------------------------------------------------------------


def write_lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_jsonl_names_the_first_bad_line(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", [{"id": 1}, "", "[1]", {"id": 2}])
    with pytest.raises(ValueError, match=":3: not a JSON object"):
        readers.read_jsonl(spark, path)
    assert [r["line"] for r in readers.read_jsonl(spark, path, strict=False).collect()] == [1, 3, 4]


def test_dataset_audit_of_five_records(spark, tmp_path):
    rows = [
        {"sample_id": "s1", "image_id": 1, "image_path": "images/000001.jpg", "question": "Is there a cat in the image?", "label": "yes", "object_name": "cat"},
        {"sample_id": "s2", "image_id": 2, "image_path": "images/000002.jpg", "question": "Is there a dog in the image?", "label": "no"},
        {"sample_id": "s3", "image_id": 3, "image_path": "images/000003.jpg", "question": "What is shown here?", "label": 1},
        {"sample_id": "s4", "image_id": 4, "image_path": "", "question": "", "label": 0, "object_name": ""},
        {"sample_id": "s5", "image_id": 5, "image_path": "images/000005.jpg", "question": "Is there a bird in the image?", "label": "maybe", "object_name": "bird"},
    ]
    df = readers.normalised(readers.read_jsonl(spark, write_lines(tmp_path / "r.jsonl", rows)), "pope", "popular")
    got = quality.dataset_audit(df, ("source_dataset",)).first().asDict()
    want = {"num_records": 5, "num_label_yes": 2, "num_label_no": 2, "num_missing_image_path": 1, "num_missing_question": 1, "num_unknown_object": 2, "num_unique_objects": 4, "num_unique_images": 5, "num_duplicate_sample_id": 0, "num_null_required_fields": 3, "num_invalid_label": 1}
    assert {k: got[k] for k in want} == want


def test_normalisation_profiles(spark, tmp_path):
    path = write_lines(tmp_path / "d.jsonl", [{"id": "dash-1", "image_path": "dash_b/COCO_val2014_000000000314.jpg", "answer": "no", "object_name": "toaster"}])
    strict = readers.strict_records(readers.read_jsonl(spark, path), "dash-b", "main", template="Can you see a {object_name} in this image?").first()
    assert (strict["sample_id"], strict["image_id"], strict["question"], strict["label"], strict["object_name"]) == ("dash-1", 314, "Can you see a toaster in this image?", 0, "toaster")
    mixed = write_lines(tmp_path / "m.jsonl", [{"label": None, "answer": "yes"}, {"answer": True}, {"label": 2}, {"label": "2"}, {"label": -1}])
    assert [r["label"] for r in readers.normalised(readers.read_jsonl(spark, mixed), "p", "s").orderBy("sample_id").collect()] == [None, 1, 1, None, 0]


def test_nested_layout(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "images/dash_benchmark_neg.json").write_text(json.dumps({"coco": {"toaster": ["314.jpg", "315.jpg"]}}))
    (tmp_path / "images/dash_benchmark_pos.json").write_text(json.dumps({"coco": {"dog": ["042.jpg"]}}))
    got = readers.dash_b_rows(spark, str(tmp_path)).collect()
    assert [(r["label"], r["image_path"]) for r in got] == [(0, "images/neg/coco/toaster/314.jpg"), (0, "images/neg/coco/toaster/315.jpg"), (1, "images/pos/coco/dog/042.jpg")]
    assert got[2]["question"] == "Can you see a dog in this image? Please answer only with yes or no."


def test_instances_to_reference_candidates(spark, tmp_path):
    doc = {"images": [{"id": k, "file_name": f"{k:012}.jpg"} for k in (1, 2, 3)], "categories": [{"id": 1, "name": "dog"}, {"id": 2, "name": "cat"}, {"id": 3, "name": "bus"}], "annotations": [{"id": k, "image_id": i, "category_id": c} for k, (i, c) in enumerate([(1, 1), (1, 2), (2, 1), (3, 3)])]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    images, categories, notes = readers.read_instances(spark, str(tmp_path / "i.json"))
    allowed, excluded = frame(spark, [("dog",), ("bus",)], "name string"), frame(spark, [(2,)], "image_id long")
    got = reconcile.reference_candidates(images, categories, notes, allowed=allowed, excluded=excluded).orderBy("image_id").collect()
    assert [tuple(r) for r in got] == [(1, "000000000001.jpg", ["dog"]), (3, "000000000003.jpg", ["bus"])]
    dogs = frame(spark, [(k, 1) for k in (1, 2, 3)], "image_id long, category_id long")
    capped = reconcile.reference_candidates(images, categories, dogs, allowed=allowed, excluded=excluded.limit(0), cap=2)
    assert sorted(r["image_id"] for r in capped.collect()) == [1, 2]


def test_cache_round_trip_prunes(spark, tmp_path):
    rows = [("m", "pope", s, f"s{k}", [[1.0, 2.0]], [0.5]) for s in ("a", "b") for k in range(5)]
    df = frame(spark, rows, "model_name string, dataset_name string, subset string, sample_id string, layer_vectors array<array<float>>, first_token_logits array<float>")
    assert sinks.write_cache(df, str(tmp_path / "c"), rows_per_file=2) == 10
    back = readers.read_cache(spark, str(tmp_path / "c"), datasets=("pope",), models=("m",))
    assert "layer_vectors" not in back.columns and back.count() == 10
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset_name" in plan or "dataset_name" in plan.split("PartitionFilters")[1][:200]
    sinks.write_table_csv(df.select("sample_id", F.lit(None).cast("string").alias("n")), str(tmp_path / "t"), ["n", "sample_id"])
    assert readers.read_table_csv(spark, str(tmp_path / "t")).columns == ["n", "sample_id"]
    u = sinks.union_of([frame(spark, [(1,)], "a int"), frame(spark, [(2, 3)], "b int, a int")])
    assert u.columns == ["a", "b"]
    sinks.write_jsonl(frame(spark, [(1, None)], "b int, a string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":null,"b":1}'


def test_catalog_of_datasets(spark):
    got = readers.dataset_specs(spark, "/r", ["/r/data/dash_b/all.json"]).collect()
    assert [r["status"] for r in got] == ["missing"] * 6 + ["present"]


# --- audits ----------------------------------------------------------------------------------------------------------


def test_cache_label_balance_and_population(spark):
    df = frame(spark, [(1, 1), (1, 0), (0, 0), (0, 1), (0, None)], "label int, parsed int").withColumn("g", F.lit("x"))
    r = quality.cache_label_balance(df, ("g",)).first()
    assert (r["num_entries"], r["num_gt_yes"], r["num_gt_no"], r["num_parsed_yes"], r["num_parsed_no"], r["num_parsed_none"], r["num_correct"], r["num_hard_hallucination"], r["num_false_negative_error"], r["num_primary_population"], r["hallucination_rate_in_primary_population"]) == (5, 2, 3, 2, 2, 1, 2, 1, 1, 3, "0.333333")
    p = quality.population_summary(df, ("g",)).first()
    assert (p["num_correct"], p["num_hard_hallucination"], p["num_false_negative_error"], p["num_parsed_none"], p["num_primary_population"]) == (2, 1, 1, 1, 3)
    assert math.isclose(p["hallucination_rate"], 1 / 3)


def test_label_balance_statuses(spark):
    df = frame(spark, [("cat", 1, 1), ("dog", 0, 1), ("dog", 0, None)], "object_name string, label int, parsed int").withColumn("g", F.lit("x"))
    r = quality.label_balance(df, ("g",), has_field=F.lit(True)).first()
    assert (r["num_parsed_yes"], r["num_parsed_no"], r["num_parsed_none"], r["num_correct"], r["num_hallucination"], r["hallucination_rate"]) == (2, 0, 1, 1, 1, "0.5")
    assert quality.label_balance(df, ("g",)).first()["parsed_answer_status"] == "not_available_before_cache"
    objects = {r["object_name"]: r for r in quality.object_audit(df, ("g",), "object_name", has_field=F.lit(True)).collect()}
    assert objects["cat"]["num_correct"] == 1 and objects["dog"]["num_hallucination"] == 1


def test_vector_errors_one_by_one(spark):
    good = [[1.0, 2.0], [3.0, 4.0]]
    cases = [(good, [0, 1], 2, []), (None, [0, 1], 2, ["missing layer_vectors"]), ([[1.0], [1.0, 2.0]], [0, 1], 2, ["layer_vectors must be two-dimensional"]), (good, [0, 1, 2], 3, ["layer count differs"]), (good, [0, 2], 2, ["selected_layers must be contiguous from 0"]), ([[1.0, float("nan")], [0.0, 0.0]], [0, 1], 2, ["layer_vectors must be finite"])]
    df = frame(spark, [c[:3] for c in cases], "v array<array<double>>, s array<int>, n int")
    assert [r["e"] for r in df.select(quality.layer_vector_errors(F.col("v"), F.col("s"), F.col("n")).alias("e")).collect()] == [c[3] for c in cases]
    ids = frame(spark, [("a", "b"), ("a", None), ("a", "a")], "x string, y string").select(quality.identity_errors({"model": F.col("x")}, {"model": F.col("y")}).alias("e"))
    assert [len(r["e"]) for r in ids.collect()] == [1, 0, 0]


def test_shard_manifest(spark):
    df = frame(spark, [("a", [], 4), ("a", [], 4), ("b", ["x"], 4), ("c", [], 4), ("c", [], 5)], "shard_path string, errors array<string>, hidden_dim int")
    assert {r["shard_path"]: r["status"] for r in quality.shard_manifest(df).collect()} == {"a": "passed", "b": "failed", "c": "failed"}


# --- reconciliation --------------------------------------------------------------------------------------------------


def test_overlap_counts(spark):
    cols = "sample_id string, image_id string, image_path string, object_name string"
    left = frame(spark, [("p1", "1", "images/a.jpg", "cat"), ("p2", "2", "images/b.jpg", "dog")], cols).withColumn("l", F.lit("x"))
    right = frame(spark, [("p1", "9", "images/z.jpg", "bird"), ("r2", "1", "images/other.jpg", "cat"), ("p2", "2", "images/b.jpg", "dog")], cols).withColumn("r", F.lit("y"))
    keys = {"sample_id": ("sample_id",), "image_id": ("image_id",), "image_path": ("image_path",), "image_id_object_name": ("image_id", "object_name"), "sample_id_object_name": ("sample_id", "object_name")}
    got = {r["key"]: r["n"] for r in reconcile.overlap_counts(left, right, keys, ("l", "r")).collect()}
    assert got == {"sample_id": 2, "image_id": 2, "image_path": 1, "image_id_object_name": 2, "sample_id_object_name": 1}


def test_lossless_relabel_matches_one_to_one_or_raises(spark):
    cols = "sample_id string, image_id string, image_path string, question string, object_name string, label int, dataset_name string, subset string, split string"
    row = ("s", "1", "p", "q", "o", 1, "pope", "popular", "test")
    cache = frame(spark, [(*row, [[1.0]])], cols + ", layer_vectors array<array<float>>")
    new = ("s", "1", "p", " q ", "o", 0, "repope", "random", "val")
    got = reconcile.lossless_relabel(cache, frame(spark, [new], cols)).first()
    assert (got["label"], got["dataset_name"], got["subset"], got["split"], got["layer_vectors"]) == (0, "repope", "random", "val", [[1.0]])
    for k, name in ((1, "image_id"), (3, "question"), (4, "object_name")):
        bad = list(new)
        bad[k] = "other"
        with pytest.raises(ValueError, match=name):
            reconcile.lossless_relabel(cache, frame(spark, [tuple(bad)], cols))
    with pytest.raises(ValueError, match="without a partner"):
        reconcile.lossless_relabel(cache, frame(spark, [("t", *new[1:])], cols))


def test_cascade_with_a_model_takes_the_last_exact_answer(spark):
    records = frame(spark, [("d", "s", "1")], "dataset_name string, subset string, sample_id string")
    given = frame(spark, [("m", "d", "s", "1", 0, 1), ("m", "d", "s", "1", 1, 2), ("n", "d", "s", "1", 0, 3)], "model_name string, dataset_name string, subset string, sample_id string, parsed int, ordinal int")
    assert reconcile.cascaded_match(records, given, for_model="m").first()["parsed"] == 1
    assert reconcile.cascaded_match(records, given).first()["matched"] == "none"


# --- splits ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("exact", [False, True])
def test_grouped_split_sizes_and_leaks(spark, exact):
    df = frame(spark, [(f"{g}-{k}", f"g{g}") for g in range(50) for k in range(2)], "sample_id string, image_id string")
    got = splits.grouped_split(df, "image_id", exact=exact).cache()
    assert [r["n"] for r in splits.split_counts(got).orderBy("ordinal").collect()] == [50, 20, 10, 20]
    splits.require_no_leaks(got, ("image_id", "sample_id"))
    again = splits.grouped_split(df, "image_id", exact=exact)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    other = splits.grouped_split(df, "image_id", seed=11, exact=exact)
    assert sorted(map(str, other.collect())) != sorted(map(str, got.collect()))


def test_split_guards(spark):
    df = frame(spark, [("a", " "), ("b", "x")], "sample_id string, image_id string")
    with pytest.raises(ValueError, match="missing or blank group key 'image_id'"):
        splits.grouped_split(df, "image_id")
    for bad in ((0.5, 0.5), (0.5, 0.5, 0.5, -0.5), (0.4, 0.2, 0.1, 0.2), (float("nan"), 0.2, 0.1, 0.2)):
        with pytest.raises(ValueError, match="ratios"):
            splits.check_ratios(bad)
    assert splits.apportioned(7) == [4, 1, 1, 1] and sum(splits.apportioned(101)) == 101
    with pytest.raises(ValueError, match="positive"):
        splits.chunked(df, ("image_id",), 0, "sample_id")
    old = frame(spark, [("shared", "encoder_train"), ("shared", "test"), ("alone", "bank"), ("alone", "x")], "g string, old string")
    assert [(r["group_key"], r["action"]) for r in splits.split_conflicts(old, "g", "old").collect()] == [("shared", splits.CONFLICT_ACTION)]


# --- vectors ---------------------------------------------------------------------------------------------------------


def test_representations(spark):
    df = frame(spark, [(1, [[3.0, 4.0, 0.0], [1.0, 0.0, 0.0], [0.0, 2.0, 0.0]])], "id long, layers array<array<double>>")
    got = {r["variant"]: r["vector"] for r in vectors.representations(df, "id", "layers").collect()}
    assert got["Raw-Static"] == [0, 2, 0] and got["Sphere-Static"] == [0, 1, 0]
    assert got["Norm-Static"] == pytest.approx([math.log(2)])
    assert got["Raw-Traj-MeanPool"] == pytest.approx([4 / 3, 2, 0])
    assert math.hypot(*got["Sphere-Traj-MeanPool"]) == pytest.approx(1)
    assert got["Norm-Traj"] == pytest.approx([math.log(5), 0, math.log(2)])
    assert vectors.layer_permutation(6) == vectors.layer_permutation(6) != list(range(6))


@pytest.mark.parametrize(("bank", "query", "k", "metric", "want"), [([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [-1.0, 0.0]], 1, "angular", [0.0, 0.5]), ([[0.0], [2.0]], [[1.0]], 2, "euclidean", [1.0]), ([[3.0]], [[3.0]], 1, "euclidean", [0.0])])
def test_knn(spark, bank, query, k, metric, want):
    b = frame(spark, list(enumerate(bank)), "id long, v array<double>")
    q = frame(spark, list(enumerate(query)), "id long, v array<double>")
    got = vectors.knn_scores(b, q, key="id", vector="v", k=k, metric=metric).orderBy("id").collect()
    assert [r["score"] for r in got] == pytest.approx(want)
    with pytest.raises(ValueError, match="fewer than k"):
        vectors.knn_scores(b, q, key="id", vector="v", k=5)


def test_knn_in_blocks_equals_knn_in_one(spark, monkeypatch):
    rows = [(k, [float((k * 7) % 31), float((k * 11) % 17)]) for k in range(60)]
    df = frame(spark, rows, "id long, v array<double>")
    one = vectors.knn_scores(df, df, key="id", vector="v", k=4).orderBy("id").collect()
    monkeypatch.setattr(vectors, "BANK_VALUES", 16)
    assert [r["score"] for r in vectors.knn_scores(df, df, key="id", vector="v", k=4).orderBy("id").collect()] == pytest.approx([r["score"] for r in one])


def test_nearest_equals_every_distance(monkeypatch):
    monkeypatch.setattr(vectors, "ASKED", 7)
    monkeypatch.setattr(vectors, "MET", 16)
    rng = np.random.default_rng(3)
    y = np.concatenate((rng.normal(size=(50, 3)), np.ones((40, 3)), rng.normal(size=(30, 3)) * 1e-7 + 5, [[1e9, 0, 0]]))
    x = np.concatenate((y[::3], rng.normal(size=(9, 3))))
    odd = np.array([[math.nan, 0, 0], [math.inf, 0, 0], [1e200, 0, 0]])
    with np.errstate(all="ignore"):
        for a, b in ((x, y), (np.concatenate((x, odd)), np.concatenate((odd, y))), (x, y[:2]), (x, np.concatenate((odd, y[:2])))):
            want = np.sort(np.sqrt(((b[None] - a[:, None]) ** 2).sum(axis=2)), axis=1)[:, :5]
            assert np.array_equal(vectors.nearest(a, b, 5), want, equal_nan=True)
    unit = [m / np.sqrt((m * m).sum(axis=1))[:, None] for m in (x, y)]
    want = np.sort(np.arccos(np.clip(unit[0] @ unit[1].T, -1, 1)) / np.pi, axis=1)[:, :5]
    assert vectors.nearest(x, y, 5, True) == pytest.approx(want, abs=1e-7)


def test_parts_of_knn_keep_tasks_of_their_own(spark, monkeypatch):
    """Few bytes can be much work: pairs of parts must not be merged into one task by their size."""
    monkeypatch.setattr(vectors, "QUERY_VALUES", 4)
    df = frame(spark, [(k, [float(k % 20), 1.0]) for k in range(60)], "id long, v array<double>")
    out = vectors.knn_scores(df, df, key="id", vector="v", k=3)
    assert out._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") >= 2
    assert {r["score"] for r in out.collect()} == {0.0}  # three copies of each


def test_token_readouts(spark):
    hidden = [[[float(10 * layer + t)] for t in range(4)] for layer in range(3)]
    df = frame(spark, [(hidden,)], "h array<array<array<double>>>")
    got = df.select(vectors.compact_readout(F.col("h"), F.lit(3), F.lit(1), F.struct(F.lit(1).alias("start"), F.lit(2).alias("stop")), F.array(F.lit(0), F.lit(2))).alias("r"), vectors.prefill_layers(F.col("h"), F.lit(-1)).alias("p"), vectors.tensor_bytes(F.col("h")[0]).alias("b")).first()
    assert got["r"]["query"] == [[3.0], [13.0], [23.0]] and got["r"]["vision"] == [[[1.0], [2.0]], [[21.0], [22.0]]]
    assert got["p"] == [[13.0], [23.0]] and got["b"] == 8


# --- metrics and gates -----------------------------------------------------------------------------------------------


def test_ranking_metrics_worked_by_hand(spark):
    df = frame(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, score double")
    r = metrics.ranking_metrics(df).first()
    assert (r["roc_auc"], r["average_precision"], r["pr_auc"]) == pytest.approx((3 / 4, 5 / 6, 19 / 24))
    perfect = metrics.ranking_metrics(frame(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, score double")).first()
    assert (perfect["roc_auc"], perfect["pr_auc"], perfect["average_precision"], perfect["tpr_at_fpr"], perfect["fpr_at_tpr"]) == (1, 1, 1, 1, 0)
    one = metrics.ranking_metrics(frame(spark, [(1, 0.1)], "y int, score double")).first()
    assert one["metric_status"] == "undefined" and "one class" in one["failure_reason"] and one["roc_auc"] is None


def test_roc_with_ties_equals_all_pairs(spark):
    rows = [((k * 5) % 7 % 2, float((k * 3) % 6)) for k in range(60)]
    got = metrics.ranking_metrics(frame(spark, rows, "y int, score double")).first()["roc_auc"]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert got == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))


def gate_rows(spark, rows):
    return frame(spark, [("test", "pooled", *r) for r in rows], "eval_split string, eval_scope string, variant string, readout string, pr_auc double, roc_auc double, pr_auc_ci_low double, pr_auc_ci_high double")


def test_gates(spark):
    rows = [(gates.ORDERED, "classifier", 0.70, 0.76, 0.68, 0.72), (gates.SHUFFLED, "classifier", 0.64, 0.73, 0.61, 0.66), (gates.ORDERED, "knn", 0.51, 0.51, 0.45, 0.56), (gates.SHUFFLED, "knn", 0.50, 0.52, 0.46, 0.55)]
    got = gates.order_gate(gate_rows(spark, rows), ("classifier", "knn")).first()
    assert (got["status"], got["total_comparisons"]) == ("mixed", 2)
    assert gates.order_gate(gate_rows(spark, rows[:2]), ("classifier",)).first()["status"] == "pass"
    assert gates.order_gate(gate_rows(spark, rows[:2]), ("classifier", "knn")).first()["status"] == "mixed"
    pairs = [("Sphere-Static", r, 0.6, 0.6, None, None) for r in ("a", "b")] + [("Raw-Static", r, 0.5, 0.6, None, None) for r in ("a", "b")]
    assert gates.pair_gate(gate_rows(spark, pairs), gates.SPHERE, max_roc_drop=0.02).first()["status"] == "pass"
    assert gates.pair_gate(gate_rows(spark, pairs[:1] + pairs[2:]), gates.SPHERE, max_roc_drop=0.02).first()["status"] == "mixed"
    norm = [("Norm-Static", "a", 0.5, 0.5, None, None), ("Raw-Static", "a", 0.55, 0.5, None, None), ("Norm-Traj", "a", float("nan"), 0.5, None, None)]
    assert gates.norm_gate(gate_rows(spark, norm)).first()["status"] == "strong"
    said = frame(spark, [("fail",), ("mixed_positive",)], "overall_decision string")
    assert [gates.decision(x).first()[0] for x in (said, said.limit(0))] == ["mixed_positive", "fail"]
    assert (gates.overall("pass", "pass"), gates.overall("pass", "mixed"), gates.overall("mixed", "mixed")) == ("pass", "mixed_positive", "fail")


def test_bootstrap_brackets_the_point_estimate(spark):
    rows = [(k, (k * 13) % 10 < 3 + (k % 5), float(k % 5)) for k in range(200)]
    df = frame(spark, [(k, int(y), s, "x") for k, y, s in rows], "id long, y int, score double, g string")
    point = metrics.ranking_metrics(df, ("g",)).first()
    ci = metrics.bootstrap_intervals(df, ("g",), key="id", replicates=30).first()
    assert ci["num_bootstrap"] == 30 and ci["roc_auc_ci_low"] <= point["roc_auc"] <= ci["roc_auc_ci_high"]


def said(text):
    found = re.search(r"\b(yes|no)\b", (text or "").replace("<think>", " ").replace("</think>", " "), re.IGNORECASE)
    return found and int(found[1].lower() == "yes")


def asked(text, turn):
    q = (text if text is None else text + "?" * (turn % 2 == 0)) or ""
    q, suffix = q.strip(), "Respond with only one word: yes or no."
    return q if suffix.lower() in q.lower() else f"{q if q.endswith(('?', '.', '!')) else q + '.'} {suffix}"


def test_text_queries_work_on_whole_texts(spark, tmp_path):
    texts = [None, "", " \n\t", "yes", "No.", "nothing", "yesno", "éyes no", "yes\u0301, no", "ye\u017f", "x_yes", "²no yes", "<think>no</think>YES", "\x1c\u2028\xa0 Ja\u3000", "seß 🙂s er", "s\u0301er 🙂 s\u0301", "Is it? respond with only one word: YES or no. Now"]
    texts += ["🙂" * 30_000 + " yes er s " + "é" * 30_000, "word\n" * 2000 + "No"]
    rows = [(1, k, "user", t) for k, t in enumerate(texts)] + [(2, k + 1, "user", t) for k, t in enumerate(texts)]
    frame(spark, rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {name: set() for name in ("parse_yes_no_answer", "scorer_answers", "format_question", "subsequence_find", "pad_and_spans")}
    for conv, turn, _, t in rows:
        want["parse_yes_no_answer"].add((conv, turn, said(t)))
        want["scorer_answers"].add((conv, turn, int(len(t or "") % 2 == 0)))
        want["format_question"].add((conv, turn, asked(t, turn)))
        part = "er" if turn % 2 == 0 else "s"
        if part in (t or ""):
            want["subsequence_find"].add((conv, turn, t.index(part)))
        if "s" in (t or ""):
            want["pad_and_spans"].add((conv, turn, t.ljust(1024, "_"), len(t) - 1, t.index("s"), t.rindex("s")))
    for name, expected in want.items():
        got = [tuple(r) for r in catalog.QUERIES[f"{name}_whole"](spark, str(tmp_path)).collect()]
        assert len(got) == len(expected) and set(got) == expected, name


def drawn(seed, replicate, key):
    """How often, by adding up the distribution without an end."""
    u = int(hashlib.md5(f"{seed}:{replicate}:{key}".encode()).hexdigest()[:8], 16) / 2**32
    n, p, total = 0, math.exp(-1), math.exp(-1)
    while u >= total and p > 0:
        n += 1
        p /= n
        total += p
    return n


def test_a_row_may_be_drawn_more_than_eight_times(spark):
    keys = [*range(500), 358037, 1891717]
    got = frame(spark, [(k,) for k in keys], "id long").select(metrics.resample_weight(20260506, F.lit(0), F.col("id")).alias("w")).collect()
    assert [r["w"] for r in got] == [drawn(20260506, 0, k) for k in keys]
    assert [r["w"] for r in got[-2:]] == [9, 9]
    steps = metrics.poisson_steps()
    tail = [sum(math.exp(-1) / math.factorial(n) for n in range(k + 1, 40)) for k in range(len(steps) + 1)]
    assert min(tail[:-1]) >= 2**-32 > tail[-1]  # the next step is beyond the hash


def test_whole_bootstrap_equals_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where("quality is not null").select("lang", "doc_id", "quality", "n_chars").collect()
    want = {}
    for lang in {r["lang"] for r in rows}:
        mine, areas = [r for r in rows if r["lang"] == lang], []
        for rep in range(1000):
            w = [drawn(20260506, rep, r["doc_id"]) for r in mine]
            at = {}
            for r, k in zip(mine, w, strict=True):
                at.setdefault(r["n_chars"], [0, 0])[1 - r["quality"]] += k
            pos, neg = (sum(v[i] for v in at.values()) for i in (0, 1))
            if not pos or not neg:
                continue
            tp = fp = roc = pr = 0
            recall, precision = 0.0, 1.0
            for score in sorted(at, reverse=True):
                p, n = at[score]
                if p + n == 0:
                    continue
                roc += n * (tp + p / 2)
                tp, fp = tp + p, fp + n
                pr += (tp / pos - recall) * (tp / (tp + fp) + precision) / 2
                recall, precision = tp / pos, tp / (tp + fp)
            areas.append((roc / pos / neg, pr))
        if areas:
            want[lang] = [len(areas), *[f(c) for c in zip(*areas, strict=True) for f in (np.mean, lambda c: np.percentile(c, 2.5), lambda c: np.percentile(c, 97.5))]]
    got = {r["subset"]: [r[c] for c in ("num_bootstrap", "roc_auc_mean", "roc_auc_ci_low", "roc_auc_ci_high", "pr_auc_mean", "pr_auc_ci_low", "pr_auc_ci_high")] for r in catalog.bootstrap_ci_whole(spark, sf).collect()}
    assert set(got) == set(want) and max(v[0] for v in got.values()) == 1000
    for lang, values in want.items():
        assert got[lang] == pytest.approx(values, abs=1e-6)


def test_logistic_separates(spark):
    rows = [(k, [float(k % 2) + 0.1 * (k % 3), 1.0], k % 2, k < 30) for k in range(40)]
    got = scoring.logistic_scores(frame(spark, rows, "id long, v array<double>, y int, t boolean"), key="id", vector="v", label="y", train="t").collect()
    assert all((r["score"] > 0.5) == (r["id"] % 2 == 1) for r in got)
    with pytest.raises(ValueError, match="both classes"):
        scoring.logistic_scores(frame(spark, rows[::2], "id long, v array<double>, y int, t boolean"), key="id", vector="v", label="y", train="t")


# --- runtime ---------------------------------------------------------------------------------------------------------


def test_budget_lock_and_reasons(tmp_path):
    b = runtime.DiskBudget(100)
    assert not b.reserve("a", 50) and b.reserve("b", 45)
    with pytest.raises(runtime.BudgetExceeded):
        b.reserve("c", 10)
    b.settle("a", 10)
    assert b.total() == 55
    with runtime.output_lock(str(tmp_path)) as path:
        with pytest.raises(RuntimeError, match="locked"), runtime.output_lock(str(tmp_path)):
            pass
    path.write_text("999999999")
    with runtime.output_lock(str(tmp_path)):
        pass
    assert runtime.partial_reasons(runtime.RunConfig(bootstrap=8), subsets={"a"}, wanted={"a", "b"}, limit=3) == ["subset b is missing", "limited to 3 rows a subset", "8 bootstrap replicates"]


def test_hashed_weights_are_the_column_s(spark):
    keys = ["a", "7", "", None, "é" * 40]
    got = metrics.hashed_weights(5, 30, keys)
    df = frame(spark, [(r, k) for k in keys for r in range(30)], "r int, k string")
    assert [r[0] for r in df.select(metrics.resample_weight(5, F.col("r"), F.col("k"))).collect()] == got.ravel().tolist()


def test_bootstrap_of_ranges_and_blocks_equals_metrics_of_the_draws(spark, monkeypatch):
    """Replicates side by side, in blocks, over batches that cut runs of equal scores; null scores lowest, NaN highest."""
    for name, n in (("ROWS", 7), ("WIDTH", 4), ("SWEPT", 2)):
        monkeypatch.setattr(metrics, name, n)
    score = lambda k: None if k % 11 == 0 else math.nan if k % 13 == 0 else float(k % 6)
    df = frame(spark, [(k, "ab"[k % 2] if k % 5 else None, k * 7 % 3 % 2, score(k)) for k in range(90)] + [(90, "c", 1, 0.5)], "id long, g string, y int, score double")
    drawn = df.select("g", "y", "score", "id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("r")).withColumn("w", metrics.resample_weight(9, F.col("r"), F.col("id"))).where("w > 0")
    want = metrics.ranking_metrics(drawn, ("g", "r"), weight="w").where("metric_status = 'ok'").groupBy("g").agg(F.count("*").alias("n"), F.avg("roc_auc").alias("roc"), F.avg("pr_auc").alias("pr"))
    got = metrics.bootstrap_intervals(df, ("g",), key="id", replicates=10, seed=9)
    order = lambda rows: sorted(rows, key=str)
    for a, b in zip(order(got.select("g", "num_bootstrap", "roc_auc_mean", "pr_auc_mean").collect()), order(want.collect()), strict=True):
        assert tuple(a)[:2] == tuple(b)[:2] and tuple(a)[2:] == pytest.approx(tuple(b)[2:])


def test_cap_orders_only_the_first_ids_of_each_object(spark):
    """What is made distinct and ordered is about ``cap`` rows a name, however many images have it."""
    notes = frame(spark, [(i * 37 % 1000, i % 3) for i in range(6000)] + [(5, 3), (5, 3)], "image_id int, category_id int")
    names = frame(spark, [(0, "a"), (1, "b"), (2, "a"), (3, "c")], "category_id int, name string")
    images = frame(spark, [(i, f"{i}.jpg") for i in range(1000)], "image_id int, file_name string")
    excluded = frame(spark, [(0,), (3,)], "image_id int")
    got = reconcile.reference_candidates(images, names, notes, allowed=names.select("name"), excluded=excluded, cap=4)
    want, have = {}, {(i * 37 % 1000, "aba"[i % 3]) for i in range(6000)} | {(5, "c")}
    for name in "abc":
        for i in sorted(i for i, n in have if n == name and i not in (0, 3))[:4]:
            want.setdefault(i, []).append(name)
    assert {r["image_id"]: r["object_names"] for r in got.collect()} == want
    ends = {r["name"]: r["__most"] for r in reconcile.first_ids(notes.join(names, "category_id"), "name", "image_id", 4).collect()}
    assert ends["c"] is None and all(3 <= ends[n] < 100 for n in "ab")
