"""Checks and plans before a run: the scope of rows, a summary's cache matrices, vectors of labels and scores, tables still to be made.

Checks give tables of issues (``check``, ``item``, ``detail``), empty where all is well; ``quality.require_none`` raises on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_null

# The scope of a primary run, and what stands for a missing value.
PRIMARY_DATASETS = ("pope",)
PRIMARY_SUBSETS = ("popular", "random", "adversarial")
BLANK = "<blank>"


def scope_issues(df: DataFrame, scope: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``field``, ``value``, ``n``: values outside the scope of a field and the rows that have them; nulls and blanks are ``<blank>``.

    Rows are counted by all fields first, so the table is read once and shuffled in its distinct combinations only.
    """
    scope = scope or {"dataset_name": PRIMARY_DATASETS, "subset": PRIMARY_SUBSETS}
    value = {c: F.coalesce(text_or_null(c), F.lit(BLANK)) for c in scope}
    counted = df.groupBy(*[value[c].alias(c) for c in scope]).agg(F.count("*").alias("n"))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), F.col(c).isin(*allowed).alias("ok")) for c, allowed in scope.items()])
    return counted.select(F.explode(fields).alias("x"), "n").where("not x.ok").groupBy("x.field", "x.value").agg(F.sum("n").alias("n"))


def summary_issues(keys: DataFrame, required: DataFrame, completed: DataFrame, missing: DataFrame, by: tuple[str, ...], *, expected: str = "expected", count: str = "observed") -> DataFrame:
    """Issues of a summary's matrices for each expected key: absent from ``required`` or ``completed``, present in ``missing``,
    or counts that differ; and rows of ``missing`` that nothing expects. A null count isn't compared. Repeated keys count once, the largest count standing."""
    want = keys.select(*by).distinct()
    a = required.groupBy(*by).agg(F.max(expected).alias("__expected"), F.lit(True).alias("__required"))
    b = completed.groupBy(*by).agg(F.max(count).alias("__count"), F.lit(True).alias("__completed"))
    c = missing.select(*by).distinct().withColumn("__missing", F.lit(True))
    rows = reduce(lambda x, y: x.join(y, list(by), "left"), (a, b, c), want)
    checks = {
        "required_cache_matrix missing": (F.col("__required").isNull(), None),
        "completed_cache_matrix missing": (F.col("__completed").isNull(), None),
        "missing_cache_matrix contains required entries": (F.col("__missing").isNotNull(), None),
        "cache matrix count mismatch": (F.coalesce(F.col("__expected") != F.col("__count"), F.lit(False)), F.format_string("expected %d got %d", "__expected", "__count")),
    }
    item = F.concat_ws("/", *by)
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(k).alias("check"), item.alias("item"), (F.lit("") if d is None else d).alias("detail"))) for k, (bad, d) in checks.items()]))
    extra = missing.select(*by).distinct().join(want, list(by), "left_anti")
    return rows.select(F.explode(found).alias("x")).select("x.*").unionByName(extra.select(F.lit("missing_cache_matrix is not empty").alias("check"), item.alias("item"), F.lit("").alias("detail")))


def matrix_of_shards(shards: DataFrame) -> DataFrame:
    """Shards' entries by model, dataset and subset (the split where no subset is named); shards without one of these are left out, a blank source is the dataset."""
    subset = F.coalesce(text_or_null("subset"), text_or_null("split")) if "split" in shards.columns else text_or_null("subset")
    rows = shards.select(
        text_or_null("model_name").alias("model_name"),
        text_or_null("dataset_name").alias("dataset_name"),
        F.coalesce(text_or_null("source_dataset"), text_or_null("dataset_name")).alias("source_dataset"),
        subset.alias("subset"),
        F.coalesce(F.try_to_number(F.trim(F.col("num_entries").cast("string")), F.lit("999999999999999999")).cast("long"), F.lit(0)).alias("k"),
    )
    named = rows.where("model_name is not null and dataset_name is not null and subset is not null")
    return named.groupBy("model_name", "dataset_name", "source_dataset", "subset").agg(F.sum("k").alias("cache_num_entries"))


def label_issues(df: DataFrame, label: str, score: str | None = None, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group, rows whose label isn't 0 or 1 and rows whose score is null or not finite; groups without any are left out."""
    y = F.col(label)
    bad = F.count_if(y.isNull() | ~y.isin(0, 1)).alias("num_bad_labels")
    s = F.col(score).cast("double") if score else F.lit(0.0)
    off = F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("num_bad_scores")
    return df.groupBy(*by).agg(bad, off).where("num_bad_labels > 0 or num_bad_scores > 0")


def split_index(assigned: DataFrame, by: tuple[str, ...], *, label: str = "label", name: str = "object_name", split: str = "split", image: str = "image_id", sample: str = "sample_id") -> DataFrame:
    """A row per split manifest: its records and, as lists of ``key=count`` in order, those per split and per split and label;
    the number of distinct names per split, and how many images and samples stand in several splits."""
    counts = assigned.groupBy(*by, split, F.col(label).cast("string").alias("__y")).agg(F.count("*").alias("__n"))
    per = counts.groupBy(*by, split).agg(F.sum("__n").alias("__k"), F.collect_list(F.struct("__y", "__n")).alias("__labels"))
    text = lambda k, n: F.concat_ws("=", k, n.cast("string"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    labels = F.flatten(F.collect_list(F.transform("__labels", lambda x: text(F.concat_ws(":", split, F.coalesce(x["__y"], F.lit(BLANK))), x["__n"]))))
    manifest = per.groupBy(*by).agg(F.sum("__k").alias("input_records"), listed(text(F.col(split), F.col("__k"))).alias("counts_per_split"), F.array_join(F.array_sort(labels), ",").alias("label_counts_per_split"))
    names = assigned.groupBy(*by, split).agg(F.count_distinct(name).alias("__n")).groupBy(*by).agg(listed(text(F.col(split), F.col("__n"))).alias("objects_per_split"))
    out = manifest.join(names, list(by))
    for key, column in (("images", image), ("samples", sample)):
        value = text_or_null(column)
        twice = assigned.where(value.isNotNull()).groupBy(*by, value.alias("__v")).agg(F.min(split).alias("__a"), F.max(split).alias("__b")).where("__a != __b")
        out = out.join(twice.groupBy(*by).agg(F.count("*").alias("__k")), list(by), "left").withColumn(f"{key}_in_several_splits", F.coalesce("__k", F.lit(0).cast("long"))).drop("__k")
    return out


def still_to_make(specs: DataFrame, sources: DataFrame, by: tuple[str, ...], *, path: str = "path", source: str = "source_path") -> DataFrame:
    """The plan of normalised tables to be made: specs without a file of their own (``status`` not ``present``) that have a source, with its number of records."""
    had = sources.groupBy(*by).agg(F.min(source).alias("source_path"), F.count("*").alias("record_count"))
    return specs.where(F.col("status") != "present").join(had, list(by)).select(*by, "source_path", F.col(path).alias("output_path"), "record_count", F.lit("planned").alias("status"))


def shard_path(root: str, model: str, dataset: str, split: str, index: Column) -> Column:
    """Where a shard's file stands."""
    return F.concat_ws("/", F.lit(root), model, dataset, split, F.concat(F.lit("shard-"), F.lpad(index.cast("string"), 5, "0")))


def sidecars(entries: DataFrame, shard: str, identity: tuple[str, ...], *, layers: str = "layer_vectors") -> DataFrame:
    """Metadata of each shard, from its entries: their number, each identity column's value where it has but one (else null), the
    number of layers and the hidden width as least and most."""
    one = [F.when(F.count_distinct(c) == 1, F.first(c, ignorenulls=True)).alias(c) for c in identity]
    depth, width = F.size(layers), F.size(F.get(layers, 0))
    return entries.groupBy(shard).agg(F.count("*").alias("num_entries"), *one, *[f(x).alias(f"{n}_{what}") for what, x in (("layers", depth), ("hidden_dim", width)) for n, f in (("least", F.min), ("most", F.max))])


def knn_metric(variant: Column) -> Column:
    """The distance that a variant's neighbours are found by."""
    return F.when(F.startswith(variant, F.lit("Sphere-")), "angular").otherwise("euclidean")


def balance_issues(balance: DataFrame, required: DataFrame, by: tuple[str, ...] = ("model_name", "dataset_name", "subset")) -> DataFrame:
    """Issues of a table of label balances: the required keys that none of its rows has, blanks aside."""
    seen = balance.select(*[text_or_null(c).alias(c) for c in by]).distinct()
    lost = required.select(*by).distinct().join(seen, list(by), "left_anti")
    return lost.select(F.lit("cache_label_balance.csv missing rows").alias("check"), F.concat_ws("/", *by).alias("item"), F.lit("").alias("detail"))


def manifest_issues(summary: DataFrame, shards: DataFrame, first: int = 3) -> DataFrame:
    """Issues of a cache's manifest (``status``; shards with ``errors``): a status that isn't passed, and its first errors."""
    status = summary.where(~F.col("status").eqNullSafe(F.lit("passed"))).select(F.lit("cache_manifest status is not passed").alias("check"), F.coalesce("status", F.lit("")).alias("item"), F.lit("").alias("detail"))
    errors = shards.select("path", F.posexplode("errors").alias("k", "error")).orderBy("path", "k").limit(first)
    said = errors.agg(F.array_sort(F.collect_list(F.struct("path", "k", "error"))).alias("e")).where(F.size("e") > 0)
    return status.unionByName(said.select(F.lit("cache_manifest errors present").alias("check"), F.lit("").alias("item"), F.array_join(F.transform("e", lambda e: F.concat(e["path"], F.lit(": "), e["error"])), "; ").alias("detail")))
