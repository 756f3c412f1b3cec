"""JSON walks, paths, token spans, padding, manifests, must-match joins, cache validation and the experiment, on fixtures and against plain versions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import paths, walk
from plumbline.operators import bootstrap, cache_checks, experiment, reconcile, splits, tokens, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- walks -----------------------------------------------------------------------------------------------------------


def leaves_plainly(value, path=""):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves_plainly(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list) and value:
        return [x for k, v in enumerate(value) for x in leaves_plainly(v, f"{path}[{k}]")]
    return [(path, json.dumps(value, separators=(",", ":")))]


DOCS = [
    {"a": 1, "b": {"c": [1, {"d": "x"}, []], "e": {}}, "f": None, "g": True},
    [[1, 2], [3]],
    "text with [brackets] and {braces} and a \\ and a \" quote",
    5,
    {"deep": {"deep": {"deep": {"deep": [[[["end"]]]]}}}},
    {},
    {"a.b": 1, "key": 2, "value": {"pos": 3}},
]


def test_leaves_equal_a_plain_walk(spark):
    df = frame(spark, [(k, "t", json.dumps(d)) for k, d in enumerate(DOCS)], "key int, path string, text string").select("key", F.col("path").alias("pos"), F.parse_json("text").alias("v"))
    got = sorted((r["key"], r["path"], r["leaf"]) for r in walk.leaves(df, "v", ("key", "pos")).collect())
    want = sorted((k, p, leaf) for k, d in enumerate(DOCS) for p, leaf in leaves_plainly(d))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [json.loads(x[2]) for x in got] == [json.loads(x[2]) for x in want]
    assert walk.leaves(df.limit(0), "v", ("key",)).collect() == []


def test_lists_of_numbers_are_tensors_with_a_shape(spark):
    doc = {"layers": [[1.5, 2.0], [3.0, 4.0], [5.0, 6.0]], "ids": [1, 2], "mixed": [1, "x"], "inner": {"flat": [0.5]}}
    df = frame(spark, [(1, json.dumps(doc))], "id int, text string").select("id", F.parse_json("text").alias("v"))
    got = {r["path"]: r["shape"] for r in walk.leaves(df, "v", ("id",), tensors=True).collect()}
    assert got == {"layers": [3, 2], "ids": [2], "inner.flat": [1], "mixed[0]": None, "mixed[1]": None}


@pytest.mark.parametrize(("text", "want"), [("[1, 2]", [1, 2]), ('["3", " -4 "]', [3, -4]), ("[1, true]", None), ("[1.9, -1.9]", [1, -1]), ("[]", []), ("[null]", None), ('"12"', None), ("7", None), ('["x"]', None), ('{"a": 1}', None), ("[[1]]", None)])
def test_integer_lists(spark, text, want):
    assert frame(spark, [(text,)], "t string").select(walk.int_list(F.parse_json("t"))).first()[0] == want


def test_first_of_several_paths(spark):
    df = frame(spark, [('{"config": {"text": {"n": 4}}, "n": 9}',), ('{"config": null, "n": 9}',), ('{"config": 3}',)], "t string").select(F.parse_json("t").alias("v"))
    assert [r[0] for r in df.select(walk.first_at(F.col("v"), "$.config.text.n", "$.config.n", "$.n", kind="int")).collect()] == [4, 9, None]


# --- paths -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("path", "at", "inside"), [("a.jpg", "/r/v/a.jpg", True), ("./b//a.jpg", "/r/v/b/a.jpg", True), ("../v/a.jpg", "/r/v/a.jpg", True), ("../a.jpg", "/r/a.jpg", False), ("../../../../etc/x", "/etc/x", False), ("/r/v/x", "/r/v/x", True), ("/r/v2/x", "/r/v2/x", False), ("b/../../v", "/r/v", True), ("", "/r/v", True), ("..a/b", "/r/v/..a/b", True)])
def test_paths_under_a_root(spark, path, at, inside):
    got = frame(spark, [(path,)], "p string").select(paths.resolved(F.col("p"), "/r/v").alias("at"), paths.is_under(F.col("p"), "/r/v").alias("in")).first()
    assert tuple(got) == (at, inside)


def test_paths_that_leave_their_root_or_name_no_file(spark, tmp_path):
    (tmp_path / "v" / "deep").mkdir(parents=True)
    for name in ("a.jpg", "deep/b c.jpg", "../outside.jpg"):
        (tmp_path / "v" / name).write_text("x")
    root = str(tmp_path / "v")
    rows = frame(spark, [(1, "a.jpg"), (2, "deep/../a.jpg"), (3, "deep/b c.jpg"), (4, "../outside.jpg"), (5, "gone.jpg"), (6, None), (7, f"{root}/a.jpg"), (8, "deep")], "id int, image_path string")
    got = {r["id"]: r["issue"] for r in paths.path_issues(rows, paths.files_under(spark, root), root, key="id", path="image_path").collect()}
    assert got == {4: "must resolve under its root", 5: "file is missing under its root", 6: "must resolve under its root", 8: "file is missing under its root"}


# --- tokens and padding ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [1, 4, 256])
def test_spans_meet_no_one_and_several_tokens(spark, bucket):
    cut = [(0, 3, 10), (3, 5, 11), (7, 12, 12), (12, 20, 13)]
    offsets = frame(spark, [("t", k, s, e, i) for k, (s, e, i) in enumerate(cut)], "key string, at int, start int, stop int, id long")
    asked = [(0, 3), (1, 2), (2, 8), (5, 7), (3, 20), (19, 30), (20, 25), (4, 4)]
    spans = frame(spark, [("t", s, e) for s, e in [*asked, (1, 2)]] + [("u", 0, 3), ("t", None, None)], "key string, start int, stop int")
    got = sorted(((r["key"], r["start"], r["stop"], r["first"], r["last"], r["ids"]) for r in tokens.token_spans(offsets, spans, "key", bucket=bucket).collect()), key=str)
    plain = []
    for key, s, e in [("t", *a) for a in [*asked, (1, 2)]] + [("u", 0, 3), ("t", None, None)]:
        hit = [k for k, (a, b, _) in enumerate(cut) if key == "t" and s is not None and a < e and b > s]
        plain.append((key, s, e, hit[0] if hit else None, hit[-1] if hit else None, [cut[k][2] for k in hit]))
    assert got == sorted(plain, key=str)


def test_object_token_with_its_fallbacks(spark):
    rows = [([5, 1, 2, 3], [2, 3], None), ([5, 1, 2, 3], [9], [[8], [1, 2], [3]]), ([5, 1], [], [[], [1]]), ([5, 1], [7], [[8]])]
    got = frame(spark, rows, "input array<long>, span array<long>, other array<array<long>>").select(tokens.object_token(F.col("input"), F.col("span"), F.col("other")).alias("o")).collect()
    assert [tuple(r["o"]) if r["o"] else None for r in got] == [(2, 2), (1, 1), (1, 1), None]
    named = frame(spark, [("Is a DOG here? dog", "dog here", "dog"), ("a cat", "", "Cat"), ("x", "q", "y")], "t string, q string, n string")
    spans = [r[0] for r in named.select(tokens.name_span(F.col("t"), F.col("q"), F.col("n"))).collect()]
    assert [tuple(s) if s else None for s in spans] == [(5, 8), (2, 5), None]
    assert named.select(tokens.name_variants(F.lit("hot dog"))).first()[0] == ["hot dog", " hot dog", "Hot Dog", " Hot Dog"]


def test_padding_of_one_to_three_dimensions(spark):
    rows = [(1, [1], [[1, 2], []], [[[1]], [[2, 3], [4]]]), (1, [1, 2, 3], [[5]], []), (2, None, [[7]], [[[1, 2, 3]]]), (None, [4], [], [[]])]
    df = frame(spark, rows, "b int, x array<int>, y array<array<int>>, z array<array<array<int>>>")
    got = [(r["b"], (r["x"], r["y"], r["z"])) for r in tokens.collated(df, ("b",), {"x": F.lit(0), "y": F.lit(-1), "z": F.lit(9)}).collect()]

    def plain(arrays, pad, dims):
        sizes = [0] * dims

        def measure(a, k):
            sizes[k] = max(sizes[k], len(a))
            for x in a if k + 1 < dims else ():
                measure(x, k + 1)

        def fill(a, k):
            rest = sizes[k] - len(a)
            return list(a) + [pad] * rest if k + 1 == dims else [fill(x, k + 1) for x in [*a, *[[]] * rest]]

        for a in arrays:
            measure(a or [], 0)
        return [fill(a or [], 0) for a in arrays]

    for b in (1, 2, None):
        own = [r for r in rows if r[0] == b]
        want = list(zip(*(plain([r[c] for r in own], pad, c) for c, pad in ((1, 0), (2, -1), (3, 9))), strict=True))
        assert sorted(str(v) for k, v in got if k == b) == sorted(map(str, want))


# --- manifests and joins ---------------------------------------------------------------------------------------------


def assigned(spark):
    rows = [("d", "s", "test", "a", 1, "cat", "i1"), ("d", "s", "bank", "b", 1, "dog", "i2"), ("d", "s", "bank", "c", 0, None, "i1"), ("d", "t", "cal", "a", None, "cat", " "), (None, "t", "cal", "e", 0, "cat", None)]
    return frame(spark, rows, "dataset_name string, subset string, split string, sample_id string, label int, object_name string, image_id string")


def test_manifests_of_groups(spark):
    got = {(r["dataset_name"], r["subset"]): r for r in splits.manifests(assigned(spark)).collect()}
    one = got["d", "s"]
    assert one["counts_per_split"] == {"encoder_train": 0, "bank": 2, "cal": 0, "test": 1}
    assert splits.manifests(assigned(spark)).select(F.map_keys("counts_per_split")).first()[0] == list(splits.NAMES)
    assert one["label_counts_per_split"]["bank"] == {"0": 1, "1": 1} and one["object_name_counts_per_split"]["bank"] == {"": 1, "dog": 1}
    assert one["image_id_overlap_validation"]["valid"] is False and one["image_id_overlap_validation"]["overlaps"] == {"bank/test": ["i1"]}
    assert one["sample_id_overlap_validation"]["valid"] is True and (one["seed"], one["ratios"]) == (splits.SEED, list(splits.RATIOS))
    assert got[None, "t"]["counts_per_split"]["cal"] == 1 and got["d", "t"]["label_counts_per_split"]["cal"] == {"": 1}


def test_nested_totals_and_overlaps_of_all(spark):
    m = splits.manifests(assigned(spark))
    total = splits.nested_totals(m, "object_name_counts_per_split").first()[0]
    assert total == {"encoder_train": {}, "bank": {"": 1, "dog": 1}, "cal": {"cat": 2}, "test": {"cat": 1}}
    odd = frame(spark, [({"bank": {"x": 2}, "elsewhere": {"x": 5}},), ({"bank": {"x": 1, "y": 1}},), (None,)], "c map<string, map<string, bigint>>")
    assert splits.nested_totals(odd, "c").first()[0]["bank"] == {"x": 3, "y": 1}
    s = splits.overlap_summary(m, "image_id_overlap_validation").first()
    assert s["valid"] is False and list(s["overlaps"]) == ["d/s"] and set(s["per_dataset"]) == {"d/s", "d/t", "t"}
    assert splits.overlap_summary(m, "sample_id_overlap_validation").first()["valid"] is True
    assert splits.overlap_summary(m.limit(0), "sample_id_overlap_validation").first()["valid"] is True


def test_assignment_rows_have_all_columns_as_text(spark):
    r = splits.assignment_rows(assigned(spark), defaults={"question": F.lit("q")}).where("sample_id = 'c'").first()
    assert tuple(r) == ("bank", "d", "s", "c", "i1", "", "", "0", "q")
    assert frame(spark, [(" ",), (None,), (" x",)], "s string").select(splits.stage0_split("s")).collect() == [("missing",), ("missing",), ("x",)]


def test_rows_must_match_one_other(spark):
    a = assigned(spark).withColumn("subset", F.coalesce("subset", F.lit("t")))
    keys = ("dataset_name", "subset", "sample_id")
    got = reconcile.must_match(a.select(*keys), a, keys, ("split", "label"), what="split").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in a.select(*keys, "split", "label").collect())
    with pytest.raises(Exception, match="missing split for d/s/zz"):
        reconcile.must_match(frame(spark, [("d", "s", "zz")], "dataset_name string, subset string, sample_id string"), a, keys, ("split",), what="split").collect()
    with pytest.raises(Exception, match="several splits for d/s/a"):
        reconcile.must_match(a.select(*keys), a.unionByName(a.limit(1)), keys, ("split",), what="split").collect()


# --- caches ----------------------------------------------------------------------------------------------------------

SIDE = {"stage": "stage0", "cache_type": "prefill", "model_name": "tiny-model", "model_id": "m", "model_family": "f", "dataset_name": "pope", "source_dataset": "pope", "subset": "popular", "split": "val", "total_layers": 2, "selected_layers": [0, 1], "num_selected_layers": 2, "hidden_dim": 3, "token_index": -1, "max_new_tokens": 1, "dtype": "float16", "num_entries": 1, "script": "s", "git_commit": "g", "created_at_utc": "t", "records_path": "r", "image_root": "i"}
ENTRY = {"shard_path": "s0", "k": 0, "model_name": "tiny-model", "dataset_name": "pope", "source_dataset": "pope", "subset": "popular", "split": "val", "sample_id": "a", "image_id": "1", "image_path": "p", "question": "q", "label": 1, "object_name": "o", "answer_text": "yes", "parsed_answer": 1, "first_token_logits": [0.1, 0.2], "selected_layers": [0, 1], "layer_vectors": [[0.1, 0.2, 0.3], [0.4, 0.5, 0.6]]}
ENTRY_KIND = "shard_path string, k int, model_name string, dataset_name string, source_dataset string, subset string, split string, sample_id string, image_id string, image_path string, question string, label int, object_name string, answer_text string, parsed_answer int, first_token_logits array<float>, selected_layers array<int>, layer_vectors array<array<float>>"


def validated(spark, entries, sides, **options):
    e = frame(spark, [tuple(x.values()) for x in entries], ENTRY_KIND)
    s = frame(spark, [(p, t if isinstance(t, str) else json.dumps(t)) for p, t in sides], "shard_path string, t string").select("shard_path", F.try_parse_json("t").alias("side"))
    shards, twice, summary = cache_checks.validated(e, s.select("shard_path", *cache_checks.sidecar_columns(F.col("side"))), order="k", **options)
    return {r["path"]: r for r in shards.collect()}, twice.collect(), summary.first()


def test_a_valid_cache_passes(spark):
    shards, twice, summary = validated(spark, [ENTRY], [("s0", SIDE)], expected={"model_name": "tiny-model", "split": "val", "dataset_name": None})
    r = shards["s0"].asDict()
    assert (r["status"], r["errors"], r["num_entries"], r["hidden_dim"], r["total_layers"], r["selected_layers"], r["source_dataset"]) == ("passed", [], 1, 3, 2, [0, 1], "pope")
    assert twice == [] and summary.asDict() == {"status": "passed", "num_shards": 1, "total_entries": 1, "num_errors": 0, "num_duplicate_keys": 0}


INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize(
    ("entry", "side", "message"),
    [
        ({"model_name": None, "dataset_name": None}, {}, "entry 0 missing required fields: model_name, dataset_name"),
        ({"model_name": None}, {}, "entry 0 is missing model_name, dataset_name, or split metadata for duplicate check"),
        ({}, {"source_dataset": ...}, "sidecar missing required metadata: source_dataset"),
        ({"layer_vectors": None}, {}, "entry 0 missing tensor layer_vectors"),
        ({"layer_vectors": [[1.0, 1.0, 1.0]]}, {}, "entry 0 layer_vectors.shape[0]=1 does not match num_selected_layers=2"),
        ({"layer_vectors": [[1.0, INF, 1.0], [1.0] * 3]}, {}, "entry 0 layer_vectors must be finite"),
        ({"layer_vectors": [[1.0, 1.0], [1.0] * 3]}, {}, "entry 0 layer_vectors.ndim must be 2"),
        ({"first_token_logits": [NAN]}, {}, "entry 0 first_token_logits must be finite"),
        ({"selected_layers": [1, 0]}, {}, "entry 0 selected_layers does not match sidecar selected_layers"),
        ({"split": "test"}, {}, "entry 0 split=test does not match sidecar split=val"),
        ({}, {"selected_layers": [1, 0]}, "selected_layers must contain every layer in order for Stage 0 full-layer cache: expected [0, 1], got [1, 0]"),
        ({}, {"num_selected_layers": 1}, "num_selected_layers must equal total_layers for Stage 0 full-layer cache: num_selected_layers=1 total_layers=2"),
        ({}, {"num_entries": 5}, "sidecar num_entries=5 does not match payload length 1"),
        ({}, {"hidden_dim": 4}, "sidecar hidden_dim=4 does not match observed hidden dim 3"),
        ({}, {"model_name": "other"}, "sidecar model_name does not match expected model_name: tiny-model"),
    ],
)
def test_each_fault_of_a_shard_is_told(spark, entry, side, message):
    said = {k: v for k, v in (SIDE | side).items() if v is not ...}
    shards, _, summary = validated(spark, [ENTRY | entry], [("s0", said)], expected={"model_name": "tiny-model"})
    assert shards["s0"]["status"] == "failed" and message in shards["s0"]["errors"] and summary["status"] == "failed"


def test_shards_against_one_another(spark):
    entries = [ENTRY, ENTRY | {"shard_path": "s1"}, ENTRY | {"shard_path": "s2", "sample_id": "b"}, ENTRY | {"shard_path": "s2", "sample_id": "c", "k": 1, "layer_vectors": [[1.0] * 4] * 2}, ENTRY | {"shard_path": "s3", "sample_id": "d"}]
    sides = [("s0", SIDE), ("s1", SIDE), ("s2", SIDE | {"num_entries": 2}), ("s4", SIDE), ("s5", "{broken"), ("s6", "[1]")]
    shards, twice, summary = validated(spark, entries, sides)
    assert [(r["sample_id"], r["n"]) for r in twice] == [("a", 2)]
    assert "entries have several hidden dims: 3, 4" in shards["s2"]["errors"] and shards["s3"]["errors"] == ["missing sidecar metadata"]
    assert shards["s4"]["errors"] == ["sidecar num_entries=1 does not match payload length 0"]
    assert shards["s5"]["errors"] == ["sidecar is not valid JSON"] and shards["s6"]["errors"] == ["sidecar metadata must be a JSON object"]
    assert (summary["num_shards"], summary["total_entries"], summary["num_duplicate_keys"], summary["status"]) == (7, 5, 1, "failed")
    df = frame(spark, [("m", 3, "passed"), ("m", 4, "passed"), ("n", 3, "passed")], "model_name string, hidden_dim long, status string")
    assert [tuple(r) for r in cache_checks.hidden_dim_issues(df).collect()] == [("m", [3, 4])]
    kind = "model_name string, dataset_name string, subset string"
    there = frame(spark, [("m", "d", "s", "passed", []), ("m", "d", "t", "failed", ["e1", "e2"])], kind + ", status string, errors array<string>")
    need = frame(spark, [("m", "d", "s"), ("m", "d", "t"), ("m", "d", "u")], kind)
    assert {r["subset"]: r["issue"] for r in cache_checks.required_issues(need, there).collect()} == {"t": "no shard passed: e1", "u": "no shard"}


def test_no_shards_fail(spark):
    e = frame(spark, [], ENTRY_KIND)
    s = frame(spark, [], "shard_path string, t string").select("shard_path", F.try_parse_json("t").alias("side"))
    assert cache_checks.validated(e, s.select("shard_path", *cache_checks.sidecar_columns(F.col("side"))), order="k")[2].first()["status"] == "failed"


def test_sidecars_are_read_from_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/x.parquet.json").write_text(json.dumps(SIDE, indent=2))
    (tmp_path / "y.parquet.json").write_text("nothing")
    got = {r["shard_path"].rsplit("/", 1)[1]: r["side_errors"] for r in cache_checks.read_sidecars(spark, str(tmp_path)).select("shard_path", "side_errors").collect()}
    assert got == {"x.parquet": [], "y.parquet": ["sidecar is not valid JSON"]}


# --- experiment ------------------------------------------------------------------------------------------------------


def population(spark, n=240):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(n):
        hard = k % 3 == 0
        layers = (rng.normal(size=(3, 4)) + (0.8 if hard else 0.0)).astype(float).tolist()
        split = ("encoder_train", "bank", "cal", "test")[(k // 3) % 4]
        rows.append((f"s{k:04}", ("a", "b")[k // 12 % 2], split, 0, 1 if hard else 0, layers))
    rows += [("x1", "a", "test", 1, 0, rows[0][5]), ("x2", "a", "test", 0, None, rows[0][5])]
    return rows, frame(spark, rows, "sample_id string, subset string, split string, label int, parsed int, layer_vectors array<array<double>>")


def test_experiment_of_one_variant_equals_a_plain_version(spark):
    rows, df = population(spark)
    found, gate = experiment.run(df, key="sample_id", subsets=("a", "b", "nowhere"), variants=("Raw-Static", "Norm-Traj"), k=3, replicates=20, least_positives=50)
    got = {(r["variant"], r["readout"], r["eval_split"], r["eval_scope"]): r for r in found.collect()}
    assert len(got) == 2 * 2 * (4 + 3) and gate.count() == 1
    own = [r for r in rows if r[3] == 0 and r[4] is not None]
    assert all(r["num_bank_correct"] == sum(r[2] == "bank" and r[4] == 0 for r in own) for r in got.values())
    for variant in ("Raw-Static", "Norm-Traj"):
        x = np.array([r[5] for r in own])
        v = x[:, -1] if variant == "Raw-Static" else np.log(np.linalg.norm(x, axis=2))
        train, y, split = np.array([r[2] == "encoder_train" for r in own]), np.array([r[4] for r in own]), np.array([r[2] for r in own])
        if variant == "Norm-Traj":
            v = (v - v[train].mean(axis=0)) / v[train].std(axis=0)
        bank = v[(split == "bank") & (y == 0)]
        score = np.sort(np.linalg.norm(v[:, None] - bank[None], axis=2), axis=1)[:, :3].mean(axis=1)
        for scope in ("pooled", "a", "b"):
            here = (split == "test") & (np.array([scope in ("pooled", r[1]) for r in own]))
            pos, neg = score[here & (y == 1)], score[here & (y == 0)]
            roc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
            r = got[variant, "Diag-KNN", "test", scope]
            assert r["roc_auc"] == pytest.approx(roc) and r["num_samples"] == len(pos) + len(neg)
            assert r["roc_auc_ci_low"] <= r["roc_auc_ci_high"] and r["metric_status"] == "ok"
        assert got[variant, "Diag-KNN", "test", "nowhere"]["failure_reason"] == "no samples in evaluation scope"
        assert got[variant, "Diag-Classifier", "test", "pooled"]["roc_auc"] > 0.5
    with pytest.raises(ValueError, match="fewer than 500"):
        experiment.run(df, key="sample_id", subsets=("a",), least_positives=500)


def test_entries_of_a_model_take_their_split(spark):
    e = frame(spark, [("m", "pope", "a", f"s{k}", "old") for k in range(5)] + [("m", "pope", "b", "t", "old"), ("n", "pope", "a", "s0", "old")], "model_name string, dataset_name string, subset string, sample_id string, split string")
    a = e.withColumn("split", F.concat(F.lit("new-"), "sample_id"))
    got = experiment.model_entries(e, a, model="m", dataset="pope", subsets=("a",), limit=2).collect()
    assert sorted((r["sample_id"], r["split"]) for r in got) == [("s0", "new-s0"), ("s1", "new-s1")]
    with pytest.raises(Exception, match="missing split for m/pope/a/s4"):
        experiment.model_entries(e, a.where("sample_id != 's4'"), model="m", dataset="pope", subsets=("a",)).collect()
    assert math.isclose(vectors.EPS, 1e-12) and bootstrap.SEED == splits.SEED
