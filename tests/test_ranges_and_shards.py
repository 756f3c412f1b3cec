"""Metrics and ordinals over ranges, exact bootstrap, numbered lines, rows with equal keys, and cache shards."""

import json
import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from plumbline.operators import bootstrap, metrics, ranges, splits, vectors
from plumbline.sources import readers, shards


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- ranges ----------------------------------------------------------------------------------------------------------


def curve_plainly(rows):
    """Metrics of (score, y) by sorting, without ranges."""
    pos, neg = sum(y == 1 for _, y in rows), sum(y == 0 for _, y in rows)
    steps, tp, fp = [], 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        p, n = sum(x == s and y == 1 for x, y in rows), sum(x == s and y == 0 for x, y in rows)
        tp, fp = tp + p, fp + n
        steps.append((p, n, tp, fp))
    roc = sum(n / neg * (tp - p / 2) / pos for p, n, tp, fp in steps)
    before = lambda p, n, tp, fp: (tp - p) / (tp - p + fp - n) if tp - p + fp - n else 1.0
    pr = sum(p / pos * (tp / (tp + fp) + before(p, n, tp, fp)) / 2 for p, n, tp, fp in steps)
    corner = [k for k, (p, n, *_) in enumerate(steps) if k in (0, len(steps) - 1) or (p, n) != steps[k + 1][:2]]
    low = max((steps[k][2] / pos for k in corner if steps[k][3] / neg <= 0.25), default=0.0)
    high = min((steps[k][3] / neg for k in corner if steps[k][2] / pos >= 0.75), default=1.0)
    return roc, pr, low, high


@pytest.mark.parametrize("parts", [1, 2, 7, 64])
def test_ranking_metrics_with_ties_across_ranges(spark, parts):
    rng = np.random.default_rng(4)
    rows = [("a", float(s), int(rng.random() < s / 20)) for s in rng.integers(0, 15, 300)] + [("b", float(s), k % 2) for k, s in enumerate(range(60))] + [(None, 1.0, 1), (None, 2.0, 0)]
    df = frame(spark, rows, "g string, score double, y int")
    got = {r["g"]: r for r in metrics.ranking_metrics(df, ("g",), parts=parts, max_fpr=0.25, min_tpr=0.75).collect()}
    for g in ("a", "b", None):
        want = curve_plainly([(s, y) for h, s, y in rows if h == g])
        assert [got[g][c] for c in ("roc_auc", "pr_auc", "tpr_at_fpr", "fpr_at_tpr")] == pytest.approx(want)
    whole = metrics.ranking_metrics(df, parts=parts, max_fpr=0.25, min_tpr=0.75).first()
    assert [whole[c] for c in ("roc_auc", "pr_auc", "tpr_at_fpr", "fpr_at_tpr")] == pytest.approx(curve_plainly([(s, y) for _, s, y in rows]))


def test_no_window_sees_a_whole_group(spark):
    df = spark.range(2000).select((F.col("id") % 500).cast("double").alias("score"), (F.col("id") % 2).cast("int").alias("y"))
    assert len(ranges.cuts(df, "score")) == 63
    largest = metrics.curve(df, ()).count() / 64
    sizes = df.select("score").distinct().groupBy(ranges.range_of(F.col("score"), ranges.cuts(df, "score"))).count().agg(F.max("count")).first()[0]
    assert sizes < 6 * largest


def test_ranges_of_odd_values(spark):
    df = frame(spark, [(None,), (float("nan"),), (1.0,), (2.0,), (2.0,), (-math.inf,), (math.inf,)], "x double")
    at = ranges.cuts(df, "x", 3)
    got = [r[0] for r in df.orderBy("x").select(ranges.range_of(F.col("x"), at).alias("k")).collect()]
    assert got == sorted(got) and got[0] == -1
    assert ranges.cuts(df.limit(0), "x") == []


@pytest.mark.parametrize("parts", [1, 5])
def test_ordinals_equal_row_numbers(spark, parts):
    rows = [("a" if k % 3 else None, (k * 37) % 50, k) for k in range(120)]
    got = ranges.ordinals(frame(spark, rows, "g string, x int, id int"), ("g",), "x", tie=("id",), parts=parts).collect()
    for g in ("a", None):
        own = sorted((x, i) for h, x, i in rows if h == g)
        assert sorted((r["x"], r["id"], r["ordinal"]) for r in got if r["g"] == g) == [(x, i, k) for k, (x, i) in enumerate(own)]
    sized = splits.chunked(frame(spark, rows, "g string, x int, id int"), ("g",), 7, "x", "id").groupBy("g", "shard").count().collect()
    assert {r["count"] for r in sized} <= {7, 40 % 7, 80 % 7} and len(sized) == 6 + 12


# --- bootstrap -------------------------------------------------------------------------------------------------------


def test_draws_add_up_and_are_repeatable():
    sizes = [5, 0, 7, 1, 0, 0, 12]
    drawn = bootstrap.leaf_draws(sizes, 400, 3)
    assert (drawn.sum(axis=0) == 25).all() and (drawn[[1, 4, 5]] == 0).all()
    assert (drawn == bootstrap.leaf_draws(sizes, 400, 3)).all() and (drawn != bootstrap.leaf_draws(sizes, 400, 4)).any()
    assert drawn.mean(axis=1) == pytest.approx(sizes, abs=0.6)
    m = drawn[6]
    cells = list(bootstrap.cell_draws(np.array([3, 4, 5]), m, np.random.default_rng(1)))
    assert (sum(cells) == m).all() and np.mean(cells[0]) == pytest.approx(3, abs=0.5)


def test_ranges_of_an_exact_bootstrap_keep_tasks_of_their_own(spark):
    """Few bytes can be many draws; and the counts of all ranges go along with a range, not with each of its cells."""
    df = spark.range(50).select((F.col("id") % 2).alias("y"), F.col("id").cast("double").alias("score"), F.lit("a").alias("g"))
    plan = bootstrap.intervals(df, ("g",), replicates=5)._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "FlatMapCoGroupsInArrow" in plan


def test_an_exact_bootstrap_takes_rows_of_a_join(spark):
    """And draws for them what it draws for the same rows without one; groups may be null."""
    rows = [(("a", "b", None)[k % 3], float(k % 5), int(k % 7 < 3)) for k in range(60)]
    df = frame(spark, rows, "g string, score double, y int")
    names = frame(spark, [("a", "x"), ("b", "y")], "g string, name string")
    values = lambda d: {(r["g"], r["metric"]): pytest.approx([r[c] for c in ("value", "mean", "lower", "upper", "num_bootstrap")]) for r in d.collect()}
    want = {k: v.expected for k, v in values(bootstrap.intervals(df, ("g",), replicates=5, parts=3)).items()}
    assert {g for g, _ in want} == {"a", "b", None} and {v[-1] for v in want.values()} == {5}
    named = df.join(names, "g", "left")
    assert values(bootstrap.intervals(named, ("g",), replicates=5, parts=3)) == want
    got = bootstrap.intervals(named.select(F.col("name").alias("n"), "g", "score", "y"), ("n", "g"), replicates=5, parts=3)
    assert values(got) == want and {(r["n"], r["g"]) for r in got.select("n", "g").collect()} == {("x", "a"), ("y", "b"), (None, None)}


def test_exact_bootstrap_equals_a_plain_version(spark):
    """The same draws, row counts and metrics, without Spark and without running sums."""
    rng = np.random.default_rng(8)
    rows = [("a", float(rng.integers(0, 12)), int(rng.random() < 0.4)) for _ in range(150)] + [("b", 1.0, 1), ("b", 1.0, 1), ("b", None, 0), ("b", 2.0, None)]
    df = frame(spark, rows, "g string, score double, y int")
    at, replicates = ranges.cuts(df, "score", 4), 50
    part = lambda s: sum(c <= s for c in at)
    cells = sorted({(part(s), y, s) for g, s, y in rows if g == "a"})
    n = lambda p, y, s: sum(g == "a" and x == s and z == y for g, x, z in rows)
    leaves = sorted({(p, y) for p, y, _ in cells})
    drawn = bootstrap.leaf_draws([sum(n(*c) for c in cells if c[:2] == leaf) for leaf in leaves], replicates, 9)
    assert (drawn.sum(axis=0) == 150).all()
    weights = {}
    for k, (p, y) in enumerate(leaves):
        own = sorted((c for c in cells if c[:2] == (p, y)), key=lambda c: -c[2])
        weights |= dict(zip(own, bootstrap.cell_draws(np.array([n(*c) for c in own]), drawn[k], np.random.default_rng([9, p + 1, y, 1])), strict=True))
    plain = []
    for r in range(replicates):
        sample = [(s, y) for (p, y, s), w in weights.items() for _ in range(w[r])]
        plain.append(curve_plainly(sample)[:2])
    got = {(r["g"], r["metric"]): r for r in bootstrap.intervals(df, ("g",), replicates=replicates, seed=9, parts=4).collect()}
    own = curve_plainly([(s, y) for g, s, y in rows if g == "a"])
    for k, m in enumerate(("roc_auc", "pr_auc")):
        r, values = got["a", m], [x[k] for x in plain]
        assert (r["value"], r["num_bootstrap"]) == (pytest.approx(own[k]), replicates)
        assert [r["mean"], r["lower"], r["upper"]] == pytest.approx([np.mean(values), *np.percentile(values, [2.5, 97.5])])
        assert got["b", m]["num_bootstrap"] == 0 and got["b", m]["value"] is None
    for bad in ({"replicates": 0}, {"confidence": 1.0}):
        with pytest.raises(ValueError):
            bootstrap.intervals(df, ("g",), **bad)
    assert bootstrap.intervals(df.limit(0), ("g",)).collect() == []


def test_a_metric_of_ones_own(spark):
    """Youden's sums as partial states: what a user adds up over scores, with intervals and on groups."""
    gini = lambda s: 2 * bootstrap.roc_auc(s) - 1 / len(s.p) * 0
    df = frame(spark, [(k % 2, float((k * 7) % 31), int((k * 7) % 31 > 15) ^ (k % 5 == 0)) for k in range(200)], "g int, score double, y int")
    got = {r["g"]: r for r in bootstrap.metric_values(df, ("g",), metrics={"double": gini, "roc_auc": bootstrap.roc_auc}, parts=3).collect()}
    want = {r["g"]: r["roc_auc"] for r in metrics.ranking_metrics(df, ("g",)).collect()}
    for g in (0, 1):
        assert got[g]["roc_auc"] == pytest.approx(want[g]) and got[g]["double"] == pytest.approx(2 * want[g])
    r = bootstrap.intervals(df, metrics={"double": gini}, replicates=40).first()
    assert r["metric"] == "double" and r["lower"] <= r["value"] <= r["upper"]


# --- lines, equal keys -----------------------------------------------------------------------------------------------


def test_lines_are_numbered_by_file_without_python(spark, tmp_path):
    for name, n in (("a", 500), ("b", 300)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"file": name, "k": k + 1, "pad": "x" * (k % 40)}) + "\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = readers.read_jsonl(spark, str(tmp_path))
        got = df.select("line", F.variant_get("json", "$.k", "long").alias("k")).collect()
        assert df.rdd.getNumPartitions() > 4 or len(got) == 800
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 800 and all(r["line"] == r["k"] for r in got)
    assert "Python" not in df._jdf.queryExecution().toString()
    with open(tmp_path / "b.jsonl", "a") as f:
        f.write("\n[1]\n")
    with pytest.raises(ValueError, match=r"b\.jsonl:302: not a JSON object"):
        readers.read_jsonl(spark, str(tmp_path))


def test_rows_that_share_a_key_stay_apart(spark):
    df = frame(spark, [(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (2, [5.0, 4.0], 0)], "id int, v array<double>, t int")
    got = [r["v"] for r in vectors.standard_scaled(df, "v", F.col("t") == 1).collect()]
    assert sorted(got) == [[-1.0, -1.0], [1.0, 1.0], [3.0, 0.0]]
    bank = frame(spark, [(9, [1.0, 1.0]), (8, [3.0, 5.0])], "id int, v array<double>")
    asked = frame(spark, [(1, [1.0, 2.0]), (1, [3.0, 5.0]), (1, [3.0, 5.0])], "id int, v array<double>")
    assert sorted(r["score"] for r in vectors.knn_scores(bank, asked, key="id", vector="v", k=1).collect()) == [0.0, 0.0, 1.0]


# --- shards ----------------------------------------------------------------------------------------------------------

ROWS = [("m1" if k % 2 else "m2", f"s{k:03}", k % 3, [[float(k), 1.0], [2.0, 3.0]]) for k in range(50)]
KIND = "model_name string, sample_id string, label int, layer_vectors array<array<float>>"


def test_publish_is_one_commit(spark, tmp_path):
    root = str(tmp_path / "cache")
    df = frame(spark, ROWS, KIND)
    said = shards.publish(df, root, by=("model_name",), rows_per_file=4, metadata={"seed": 1})
    assert (said["rows"], shards.current(spark, root)["metadata"]) == (50, {"seed": 1}) and said["shards"] >= 13
    assert sorted(map(tuple, shards.read_published(spark, root, verify=True).select("sample_id", "label").collect())) == [(r[1], r[2]) for r in ROWS]
    listed = spark.read.parquet(f"{root}/{said['generation']}/shards")
    assert listed.agg(F.sum("rows")).first()[0] == 50 and listed.where("content is null").count() == 0 and {r["model_name"] for r in listed.collect()} == {"m1", "m2"}
    # one that fails half way leaves the one before, and nothing of itself
    bad = df.withColumn("label", F.when(F.col("sample_id") == "s049", F.lit(7)).otherwise(F.col("label")))
    with pytest.raises(Exception, match="s049: label must be 0, 1 or 2"):
        shards.publish(bad, root, checks={"label must be 0, 1 or 2": ~F.col("label").isin(0, 1, 2)}, key="sample_id")
    assert shards.current(spark, root)["generation"] == said["generation"]
    assert sorted(x for x in os.listdir(root) if not x.startswith(".")) == sorted(["current.json", said["generation"]])
    # a shard that was changed is found out
    data = next((tmp_path / "cache" / said["generation"] / "data").rglob("*.parquet"))
    pq.write_table(pq.read_table(data), data, compression="none")
    for crc in data.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(OSError, match="differ"):
        shards.read_published(spark, root, verify=True)


def test_first_publication_that_fails_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "new")
    with pytest.raises(Exception, match="broken"):
        shards.publish(frame(spark, ROWS, KIND), root, checks={"broken": F.col("label") == 2}, key="sample_id")
    assert not [x for x in os.listdir(root) if not x.startswith(".")]
    with pytest.raises(Exception, match="(?i)path"):
        shards.read_published(spark, root)


def test_an_empty_table_is_published(spark, tmp_path):
    root = str(tmp_path / "none")
    assert shards.publish(frame(spark, [], KIND), root)["rows"] == 0
    assert shards.read_published(spark, root, verify=True).collect() == []


def write_shards(root):
    """Three shards of a dataset each: named by the sidecar, by the rows, and by both, where rows win."""
    os.makedirs(root / "deep")
    kind = pa.schema([("sample_id", pa.string()), ("dataset_name", pa.string()), ("layer_vectors", pa.list_(pa.list_(pa.float32())))])
    vec = [[[1.0, 2.0]]]
    pq.write_table(pa.table({"sample_id": ["a", "b"], "dataset_name": [None, None], "layer_vectors": vec * 2}, schema=kind), root / "x.parquet")
    (root / "x.parquet.json").write_text(json.dumps({"dataset_name": " pope ", "model_name": "m", "hidden_dim": 2}))
    pq.write_table(pa.table({"sample_id": ["c", "d"], "dataset_name": ["dash-b", " "], "layer_vectors": vec * 2}, schema=kind), root / "deep" / "y.parquet")
    pq.write_table(pa.table({"sample_id": ["e", "f"], "dataset_name": [None, "pope"], "layer_vectors": vec * 2}, schema=kind), root / "z.parquet")
    (root / "z.parquet.json").write_text(json.dumps({"dataset_name": "repope", "model_name": "n"}))


def test_shards_as_a_source(spark, tmp_path):
    write_shards(tmp_path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = shards.read_shards(spark, str(tmp_path))
        assert "layer_vectors" not in df.columns
        got = {r["sample_id"]: (r["dataset_name"], r["model_name"]) for r in df.collect()}
        assert got == {"a": ("pope", "m"), "b": ("pope", "m"), "c": ("dash-b", None), "d": (None, None), "e": ("repope", "n"), "f": ("pope", "n")}
        assert sorted(r["sample_id"] for r in df.where("dataset_name = 'pope'").collect()) == ["a", "b", "f"]
        assert sorted(r["sample_id"] for r in df.where("dataset_name in ('dash-b', 'repope') and model_name = 'n'").collect()) == ["e"]
        full = shards.read_shards(spark, str(tmp_path), ("sample_id", "layer_vectors", "shard_path")).where("sample_id = 'a'").first()
        assert full["layer_vectors"] == [[1.0, 2.0]] and full["shard_path"].endswith("x.parquet")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_predicates_skip_shards_and_columns_skip_vectors(tmp_path, monkeypatch):
    write_shards(tmp_path)
    read = []
    inner = pq.ParquetFile.iter_batches
    monkeypatch.setattr(pq.ParquetFile, "iter_batches", lambda self, **k: (read.append(k["columns"]), inner(self, **k))[1])

    def rows(*filters, columns=("sample_id",)):
        read.clear()
        reader = shards.ShardReader(str(tmp_path), list(columns), 1)
        assert list(reader.pushFilters(list(filters))) == []
        parts = reader.partitions()
        assert len(parts) == 3
        return sorted(r["sample_id"] for p in parts for b in reader.read(p) for r in b.to_pylist())

    assert rows() == list("abcdef") and len(read) == 3 and all("layer_vectors" not in c for c in read)
    assert rows(EqualTo(("model_name",), "m")) == ["a", "b"] and len(read) == 1
    assert rows(In(("dataset_name",), ("repope", "dash-b"))) == ["c", "e"] and len(read) == 2
    assert rows(EqualTo(("dataset_name",), "nowhere")) == [] and len(read) == 2
    assert rows(columns=("sample_id", "layer_vectors")) == list("abcdef") and all("layer_vectors" in c for c in read)
