"""Extraction: records in, cache entries out, by any scorer; planned first, written as checked shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import absolute_path, formatted_question, yes_no_answer
from ..sources.shards import publish
from .quality import layer_vector_errors
from .scoring import Scorer, answered
from .splits import chunked, first_n

ENTRY_COLUMNS = ("model_name", "dataset_name", "source_dataset", "subset", "split", "sample_id", "image_id", "image_path", "question", "label", "object_name", "answer_text", "parsed_answer", "selected_layers", "layer_vectors", "first_token_logits")
GROUP = ("model_name", "dataset_name", "subset", "split")


def cast_vectors(df: DataFrame, *columns: str, kind: str = "float") -> DataFrame:
    """Numbers with a point, at whatever depth of arrays and structs they stand, as another type; without names in all columns."""
    wanted = {c: t.replace("double", kind).replace("float", kind) for c, t in df.dtypes if c in columns or not columns}
    return df.withColumns({c: F.col(c).cast(t) for c, t in wanted.items() if t != dict(df.dtypes)[c]})


def layers_of(layer_vectors: Column, hidden_states: Column) -> Column:
    """An entry's layers, those of the full hidden states where it has none of its own, as float; null where they are no matrix of finite numbers."""
    layers = F.coalesce(layer_vectors, hidden_states).cast("array<array<float>>")
    good = F.size(layer_vector_errors(layers, F.sequence(F.lit(0), F.size(layers) - 1), F.size(layers))) == 0
    return F.when(layers.isNotNull() & (F.size(layers) > 0) & good, layers)


def cache_entries(records: DataFrame, *, model: str, dataset: str, layers: Column | None = None, logits: Column | None = None) -> DataFrame:
    """Records with ``answer_text`` as entries: parsed answers, and vectors where there are any, with the layers that they are of."""
    vectors = layers if layers is not None else F.lit(None).cast("array<array<float>>")
    built = {
        "model_name": F.lit(model),
        "dataset_name": F.lit(dataset),
        "parsed_answer": yes_no_answer("answer_text"),
        "layer_vectors": vectors.cast("array<array<float>>"),
        "selected_layers": F.when(F.size(vectors) > 0, F.sequence(F.lit(0), F.size(vectors) - 1)),
        "first_token_logits": (logits if logits is not None else F.lit(None)).cast("array<float>"),
    }
    return records.select(*(built[c].alias(c) if c in built else F.col(c) for c in ENTRY_COLUMNS))


def planned(records: DataFrame, models: DataFrame, root: str, *, rows_per_shard: int = 128, limit: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """What a run would do, without doing it: for each model, dataset and subset the records, shards and folder, and whether ``done`` (counts ``n`` by these) has them all."""
    n = F.count("*") if limit is None else F.least(F.count("*"), F.lit(limit).cast("long"))
    keys = ("model_name", "dataset_name", "subset")
    per = records.groupBy(F.col("source_dataset").alias("dataset_name"), "subset").agg(n.alias("num_records"))
    rows = models.select("model_name").distinct().crossJoin(per)  # a few names
    rows = rows.withColumn("num_shards", F.ceil(F.col("num_records") / rows_per_shard)).withColumn("folder", F.concat_ws("/", F.lit(root.rstrip("/")), *keys))
    have = done.groupBy(*keys).agg(F.sum("n").alias("__n")) if done is not None else rows.select(*keys, F.lit(0).alias("__n")).limit(0)
    out = rows.join(have, list(keys), "left")
    return out.withColumn("state", F.when(F.coalesce("__n", F.lit(0)) >= F.col("num_records"), "done").when(F.col("__n") > 0, "partial").otherwise("planned")).drop("__n")


def run(records: DataFrame, make_scorer: Callable[[], Scorer], root: str, *, model: str, dataset: str, image_root: str = "", limit: int | None = None, rows_per_shard: int = 128, order: str = "sample_id", metadata: dict | None = None) -> dict:
    """Answers records and publishes them as a generation of shards; returns what its pointer says.

    Image paths are made absolute, questions formatted, shards numbered in order within each split; entries that break the
    contract stop the run before anything is seen.
    """
    rows = first_n(records, ("subset",), limit, order) if limit is not None else records
    rows = rows.withColumn("image_path", absolute_path(F.col("image_path"), image_root)) if image_root else rows
    asked = chunked(rows, ("subset", "split"), rows_per_shard, order).withColumn("asked", formatted_question("question"))
    entries = cache_entries(answered(asked, make_scorer, question="asked"), model=model, dataset=dataset)
    checks = {"missing or blank sample_id": F.trim(F.coalesce("sample_id", F.lit(""))) == "", "missing answer_text": F.col("answer_text").isNull(), "label must be 0 or 1": F.col("label").isNull() | ~F.col("label").isin(0, 1)}
    return publish(entries, root, by=GROUP, rows_per_file=rows_per_shard, checks=checks, key="sample_id", metadata={"model_name": model, "dataset_name": dataset, **(metadata or {})})


def shard_candidates(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """``path``, ``listed``: the shards of a manifest, then those in the folder that it doesn't list; each path once."""
    rows = manifest.select("path", F.lit(True).alias("listed")).unionByName(found.select("path", F.lit(False).alias("listed")))
    return rows.where("path is not null").groupBy("path").agg(F.bool_or("listed").alias("listed"))


def model_names(answers: DataFrame, column: str = "model_name") -> DataFrame:
    """The models that there are answers of, in order."""
    return answers.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
