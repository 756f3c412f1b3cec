"""The experiment over cached entries: population, representations, two readouts, metrics on every scope with intervals, and the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import population_class
from . import bootstrap, gates, metrics, vectors
from .quality import repeated, require_none
from .reconcile import must_match
from .scoring import logistic_scores
from .splits import NAMES, first_n
from .tables import stored

#: Hard cases that a population must have, and neighbours that are asked for.
LEAST_POSITIVES, NEIGHBOURS = 50, 10


def model_entries(entries: DataFrame, assignments: DataFrame, *, model: str, dataset: str, subsets: tuple[str, ...], limit: int | None = None, order: str = "sample_id") -> DataFrame:
    """A model's entries of the subsets with the ``split`` that they were assigned; one without a split raises when it is read. ``limit``: the first so many of each subset."""
    rows = entries.where((F.col("model_name") == model) & (F.col("dataset_name") == dataset) & F.col("subset").isin(*subsets)).drop("split")
    if limit is not None:
        rows = first_n(rows, ("subset",), limit, order)
    return must_match(rows, assignments, ("model_name", "dataset_name", "subset", "sample_id"), ("split",), what="split")


def primary(entries: DataFrame, *, label: str = "label", parsed: str = "parsed") -> DataFrame:
    """Correct answers (``y`` 0) and hard hallucinations (``y`` 1); other rows are left out."""
    rows = entries.withColumn("class", population_class(F.col(label), F.col(parsed))).where(F.col("class").isin("correct", "hard_hallucination"))
    return rows.withColumn("y", (F.col("class") == "hard_hallucination").cast("int"))


def bank_correct(rows: DataFrame) -> int:
    """Correct rows of the bank: what neighbours are looked for among."""
    return rows.where("split = 'bank' and class = 'correct'").count()


def variant_scores(rows: DataFrame, variant: str, *, key: str, layers: str = "layer_vectors", k: int = NEIGHBOURS) -> DataFrame:
    """``key``, ``variant``, ``readout``, ``score`` of a population with ``split``, ``class`` and ``y``: a logistic classifier fitted on the training split, and the mean distance to the k nearest correct rows of the bank.

    Norms are standardised before neighbours are looked for, and spheres are measured by angle.
    """
    train = F.col("split") == "encoder_train"
    data = rows.select(key, "y", "split", "class", train.alias("t"), vectors.representation(variant, F.col(layers)).alias("v"))
    fitted = logistic_scores(data, key=key, vector="v", label="y", train="t")
    spaced = vectors.standard_scaled(data, "v", F.col("t")) if variant.startswith("Norm-") else data
    bank = spaced.where("split = 'bank' and class = 'correct'")
    near = vectors.knn_scores(bank, spaced, key=key, vector="v", k=k, metric="angular" if variant.startswith("Sphere-") else "euclidean")
    return reduce(DataFrame.unionByName, (df.select(key, F.lit(variant).alias("variant"), F.lit(name).alias("readout"), "score") for name, df in (("Diag-Classifier", fitted), ("Diag-KNN", near))))


def scored(rows: DataFrame, *, key: str, layers: str = "layer_vectors", variants: tuple[str, ...] = vectors.VARIANTS, k: int = NEIGHBOURS) -> DataFrame:
    """Scores of all variants by both readouts, with each row's ``y``, ``split`` and ``subset``. Keys must not repeat."""
    require_none(repeated(rows, (key,)), "keys repeat")
    each = reduce(DataFrame.unionByName, (variant_scores(rows, v, key=key, layers=layers, k=k) for v in variants))
    return each.join(rows.select(key, "y", "split", "subset"), key)


def metric_rows(scores: DataFrame, *, subsets: tuple[str, ...], replicates: int = 1000, seed: int = bootstrap.SEED) -> DataFrame:
    """A row for each variant, readout and scope (splits pooled, and the test split by subset): counts, metrics and intervals, or why there are none."""
    keys = ("variant", "readout", "eval_split", "eval_scope")
    rows = metrics.scope_rows(scores)
    spark = scores.sparkSession
    scopes = spark.createDataFrame([(n, "pooled") for n in NAMES] + [("test", s) for s in subsets], "eval_split string, eval_scope string")
    grid = scores.select("variant", "readout").distinct().crossJoin(F.broadcast(scopes))  # a few rows each
    out = metrics.metric_grid(grid, metrics.ranking_metrics(rows, keys), keys)
    ci = bootstrap.intervals(rows, keys, replicates=replicates, seed=seed)
    ends = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{name}") for m in bootstrap.BOTH for c, name in (("lower", "ci_low"), ("upper", "ci_high"))]
    return out.join(ci.groupBy(*keys).agg(*ends), list(keys), "left")


def run(entries: DataFrame, *, key: str, subsets: tuple[str, ...], layers: str = "layer_vectors", variants: tuple[str, ...] = vectors.VARIANTS, k: int = NEIGHBOURS, replicates: int = 1000, seed: int = bootstrap.SEED, least_positives: int = LEAST_POSITIVES) -> tuple[DataFrame, DataFrame]:
    """Metric rows and the gate's row for a model's entries; raises where the population has too few hard cases."""
    rows = stored(primary(entries), "experiment-rows")
    hard = rows.where("y = 1").count()
    if hard < least_positives:
        raise ValueError(f"fewer than {least_positives} hard hallucination samples in the primary population: {hard}")
    scores = stored(scored(rows, key=key, layers=layers, variants=variants, k=k), "experiment-scores")
    found = metric_rows(scores, subsets=subsets, replicates=replicates, seed=seed).withColumn("num_bank_correct", F.lit(bank_correct(rows)))
    found = stored(found, "experiment-metrics")
    return found, gates.model_gates(found)
