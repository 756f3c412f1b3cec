"""Validation of cache shards as a whole: entries against their sidecar, sidecars against what was expected, shards against one another.

Entries are looked at once. Each gets its messages as an expression; a shard's are gathered with its counts by one
aggregation (a shard is a file of bounded size), its sidecar's are added by a join, and the cache's summary is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import text_or_null
from ..functions.walk import int_list
from .quality import violations

# The fields that sidecars and entries must have, and those in which they must agree.
SIDECAR_FIELDS = (
    "stage",
    "cache_type",
    "model_name",
    "model_id",
    "model_family",
    "dataset_name",
    "source_dataset",
    "subset",
    "split",
    "total_layers",
    "selected_layers",
    "num_selected_layers",
    "hidden_dim",
    "token_index",
    "max_new_tokens",
    "dtype",
    "num_entries",
    "script",
    "git_commit",
    "created_at_utc",
    "records_path",
    "image_root",
)
ENTRY_FIELDS = ("model_name", "dataset_name", "source_dataset", "subset", "split", "sample_id", "image_id", "image_path", "question", "label", "object_name", "answer_text", "parsed_answer", "first_token_logits")
IDENTITY = ("model_name", "dataset_name", "subset", "split", "source_dataset")
DUPLICATE_KEY = ("model_name", "dataset_name", "split", "sample_id")

#: Fields in which a null is a value: in a table, that a field is null says elsewhere that the entry lacks it.
MAY_BE_NULL = ("parsed_answer",)


def read_sidecars(spark: SparkSession, root: str, pattern: str = "*.parquet.json") -> DataFrame:
    """``shard_path``, ``side`` (VARIANT) and ``side_errors`` of every sidecar under a folder; one that is no JSON object has no fields, and says so."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    rows = text.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.json$", "").alias("shard_path"), F.try_parse_json("value").alias("side"))
    return rows.select("shard_path", *sidecar_columns(F.col("side")))


def sidecar_columns(side: Column) -> list[Column]:
    """A sidecar's value, null unless it is an object, and its errors."""
    is_object = F.coalesce(F.startswith(F.schema_of_variant(side), F.lit("OBJECT")), F.lit(False))
    fields = F.when(is_object, F.json_object_keys(F.to_json(side)))
    lacks = F.filter(F.array(*(F.lit(f) for f in SIDECAR_FIELDS)), lambda f: ~F.array_contains(fields, f))
    errors = F.when(side.isNull(), F.array(F.lit("sidecar is not valid JSON"))).when(~is_object, F.array(F.lit("sidecar metadata must be a JSON object")))
    errors = errors.when(F.size(lacks) > 0, F.array(F.concat(F.lit("sidecar missing required metadata: "), F.array_join(lacks, ", ")))).otherwise(F.array().cast("array<string>"))
    return [F.when(is_object, side).alias("side"), errors.alias("side_errors")]


def _at(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("side", f"$.{name}", kind)


def layer_errors(total: Column, selected: Column, number: Column) -> Column:
    """Messages about a sidecar's layers: all of 0 to total - 1, in order, and as many as it says."""
    expected = F.when(total > 0, F.sequence(F.lit(0).cast("long"), total - 1)).when(total == 0, F.array().cast("array<long>"))
    listed = lambda a: F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]"))
    order = F.when(selected.isNotNull() & ~selected.eqNullSafe(expected), F.concat(F.lit("selected_layers must contain every layer in order for Stage 0 full-layer cache: expected "), listed(expected), F.lit(", got "), listed(selected)))
    count = F.when(number != total, F.format_string("num_selected_layers must equal total_layers for Stage 0 full-layer cache: num_selected_layers=%d total_layers=%d", number, total))
    return F.when(total.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(order, count)))


def expected_errors(expected: dict[str, str | None]) -> Column:
    """Messages where a sidecar's value is not the one that was asked for."""
    return violations({f"sidecar {k} does not match expected {k}: {v}": ~text_or_null(_at(k)).eqNullSafe(F.lit(v)) for k, v in expected.items() if v is not None})


def entry_errors(columns: list[str], at: Column) -> Column:
    """Messages of an entry (its place ``at`` in the shard) beside its sidecar (``side``)."""
    say = lambda text: F.concat(F.lit("entry "), at.cast("string"), F.lit(" "), text if isinstance(text, Column) else F.lit(text))
    have = lambda c: F.col(c) if c in columns else F.lit(None)
    lacks = F.array_compact(F.array(*(F.when(have(f).isNull() if f not in MAY_BE_NULL else F.lit(f not in columns), F.lit(f)) for f in ENTRY_FIELDS)))
    found = [F.when(F.size(lacks) > 0, say(F.concat(F.lit("missing required fields: "), F.array_join(lacks, ", "))))]
    for c in (c for c in IDENTITY if c in columns):
        own, side = text_or_null(c), text_or_null(_at(c))
        found.append(F.when(own.isNotNull() & side.isNotNull() & (own != side), say(F.concat(F.lit(f"{c}="), own, F.lit(f" does not match sidecar {c}="), side))))
    layers = have("layer_vectors").cast("array<array<float>>")
    odd = lambda r: F.exists(r, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    number = F.coalesce(_at("num_selected_layers", "long"), F.size(int_list(F.col("side"), "$.selected_layers")).cast("long"))
    if "selected_layers" in columns:
        number = F.coalesce(number, F.size("selected_layers").cast("long"))
    ragged = F.size(F.array_distinct(F.transform(layers, F.size))) > 1
    found += [
        F.when(layers.isNull(), say("missing tensor layer_vectors")),
        F.when(ragged, say("layer_vectors.ndim must be 2")),
        F.when(~ragged & (F.size(layers) != number), say(F.format_string("layer_vectors.shape[0]=%d does not match num_selected_layers=%d", F.size(layers), number))),
        F.when(F.exists(layers, odd), say("layer_vectors must be finite")),
    ]
    if "selected_layers" in columns:
        own, side = F.col("selected_layers").cast("array<long>"), int_list(F.col("side"), "$.selected_layers")
        found.append(F.when(own.isNotNull() & side.isNotNull() & (own != side), say("selected_layers does not match sidecar selected_layers")))
    if "first_token_logits" in columns:
        found.append(F.when(odd(F.col("first_token_logits").cast("array<float>")), say("first_token_logits must be finite")))
    key = [text_or_null(have(c).cast("string")) for c in DUPLICATE_KEY[:3]]
    lost = key[0].isNull() | key[1].isNull() | key[2].isNull()
    found.append(F.when(lost & have("sample_id").isNotNull(), say("is missing model_name, dataset_name, or split metadata for duplicate check")))
    return F.array_compact(F.array(*found))


def validated(entries: DataFrame, sidecars: DataFrame, *, order: str, expected: dict[str, str | None] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shards, duplicate keys and the summary of a cache.

    ``entries``: ``shard_path``, a column that orders a shard's entries, and theirs; ``sidecars``: ``shard_path``, ``side``,
    ``side_errors``. A shard without a sidecar, and a sidecar without entries, is a shard too.
    """
    side = sidecars.withColumnRenamed("shard_path", "__shard")
    place = F.row_number().over(W.partitionBy("shard_path").orderBy(order)) - 1  # of a file's entries
    rows = entries.withColumn("__at", place).join(side, F.col("shard_path") == F.col("__shard"), "left")
    width = F.size(F.try_element_at(F.col("layer_vectors").cast("array<array<float>>"), F.lit(1)))
    rows = rows.select("shard_path", "__at", entry_errors(entries.columns, F.col("__at")).alias("__e"), F.when(width >= 0, width).alias("__w"), *((text_or_null(c) if c in entries.columns else F.lit(None).cast("string")).alias(f"__{c}") for c in (*DUPLICATE_KEY, "source_dataset")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__e"))), lambda e: e["__e"])
    widths = F.array_sort(F.collect_set("__w"))
    per = rows.groupBy("shard_path").agg(F.count("*").alias("n"), F.flatten(listed).alias("__errors"), widths.alias("__widths"), F.first("__w", True).alias("hidden_dim"), F.when(F.count_distinct("__source_dataset") == 1, F.max("__source_dataset")).alias("__source"))
    both = per.join(side, F.col("shard_path") == F.col("__shard"), "full_outer").withColumn("shard_path", F.coalesce("shard_path", "__shard")).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    none = F.array().cast("array<string>")
    total, selected, number, dim = _at("total_layers", "long"), int_list(F.col("side"), "$.selected_layers"), _at("num_selected_layers", "long"), _at("hidden_dim", "long")
    counted = F.array_compact(F.array(F.when(_at("num_entries", "long") != F.col("n"), F.format_string("sidecar num_entries=%d does not match payload length %d", _at("num_entries", "long"), F.col("n")))))
    mixed = F.array_compact(F.array(F.when(F.size("__widths") > 1, F.concat(F.lit("entries have several hidden dims: "), F.array_join(F.col("__widths").cast("array<string>"), ", ")))))
    sized = F.array_compact(F.array(F.when(dim != F.col("hidden_dim"), F.format_string("sidecar hidden_dim=%d does not match observed hidden dim %d", dim, F.col("hidden_dim")))))
    missing = F.when(F.col("__shard").isNull(), F.array(F.lit("missing sidecar metadata"))).otherwise(F.col("side_errors"))
    errors = F.concat(missing, expected_errors(expected or {}) if any((expected or {}).values()) else none, layer_errors(total, selected, number), counted, F.coalesce("__errors", none), mixed, sized)
    name = lambda c: text_or_null(_at(c)).alias(c)
    shards = both.select(F.col("shard_path").alias("path"), errors.alias("errors"), name("model_name"), name("dataset_name"), F.coalesce(text_or_null(_at("source_dataset")), "__source", text_or_null(_at("dataset_name"))).alias("source_dataset"), name("subset"), name("split"), F.col("n").alias("num_entries"), F.col("hidden_dim").cast("long").alias("hidden_dim"), total.alias("total_layers"), selected.alias("selected_layers"))
    shards = shards.withColumn("status", F.when(F.size("errors") > 0, "failed").otherwise("passed"))
    keys = [F.col(f"__{c}").alias(c) for c in DUPLICATE_KEY]
    duplicates = rows.select(*keys).where(" and ".join(f"{c} is not null" for c in DUPLICATE_KEY)).groupBy(*DUPLICATE_KEY).agg(F.count("*").alias("n")).where("n > 1")
    counts = shards.agg(F.count("*").alias("num_shards"), F.coalesce(F.sum("num_entries"), F.lit(0)).alias("total_entries"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("num_errors"))
    summary = counts.crossJoin(duplicates.agg(F.count("*").alias("num_duplicate_keys")))  # one row each
    status = F.when((F.col("num_shards") > 0) & (F.col("num_errors") == 0) & (F.col("num_duplicate_keys") == 0), "passed").otherwise("failed")
    return shards, duplicates, summary.select(status.alias("status"), "*")


def hidden_dim_issues(shards: DataFrame) -> DataFrame:
    """Models whose shards have several hidden sizes, with these."""
    return shards.where("hidden_dim is not null").groupBy("model_name").agg(F.array_sort(F.collect_set("hidden_dim")).alias("hidden_dims")).where(F.size("hidden_dims") > 1)


def required_issues(required: DataFrame, shards: DataFrame, keys: tuple[str, ...] = ("model_name", "dataset_name", "subset")) -> DataFrame:
    """``keys``, ``issue`` of what must be there: no shard at all, or none that passed."""
    there = shards.groupBy(*keys).agg(F.count_if(F.col("status") == "passed").alias("__ok"), F.first("errors").alias("__e"))
    out = required.join(there, list(keys), "left").where("__ok is null or __ok = 0")
    return out.select(*keys, F.when(F.col("__ok").isNull(), "no shard").otherwise(F.concat(F.lit("no shard passed: "), F.coalesce(F.try_element_at("__e", F.lit(1)), F.lit("")))).alias("issue"))
