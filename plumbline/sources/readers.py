"""Readers of record files into typed tables, and the catalog of datasets."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import first_text, image_id, object_name, question_text, text_or_null, variant_label, yes_no_label

# The known datasets with their subsets, and the columns of a normalised record.
CATALOG = {"pope": ("popular", "random", "adversarial"), "repope": ("popular", "random", "adversarial"), "dash-b": ("all",)}
LEGACY_SUBSET = "main"
RECORD_COLUMNS = ("sample_id", "image_id", "image_path", "question", "label", "object_name", "split", "subset", "source_dataset")
EXTRACTION_COLUMNS = ("sample_id", "image_id", "image_path", "question", "label", "object_name")
DASH_B_TEMPLATE = "Can you see a {object_name} in this image? Please answer only with yes or no."


#: Blocks of files whose offsets are sent to all tasks, some 100 bytes each.
BLOCKS = 50_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line`` (from 1 in each file), ``value`` of text files, in the plan: no Python, no shuffle of the lines.

    Lines are counted by block of a file, the blocks' counts are added up, and a line's number is that sum plus its place in
    its block, told by the ids that rising row numbers of a partition give. There are at most as many blocks as files and
    partitions together; up to ``BLOCKS`` their offsets are broadcast, and the lines stay where they were read.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    rows = spark.read.text(path).select(meta("file_path").alias("file"), meta("file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), "value")
    blocks = rows.groupBy("file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))  # a row for each block
    before = F.sum("__n").over(W.partitionBy("file").orderBy("__block")) - F.col("__n")
    offsets = blocks.select("file", "__block", (before - F.col("__first") + 1).alias("__shift"))
    lines = spark.read.text(path)
    few = len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= BLOCKS
    return rows.join(F.broadcast(offsets) if few else offsets, ["file", "__block"]).select("file", (F.col("__id") + F.col("__shift")).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """``file``, ``line`` (from 1 in each file), ``json`` (VARIANT) of each non-blank line.

    ``strict`` raises for the first line, by file and number, that is no JSON object; otherwise such lines have a null ``json``.
    """
    out = numbered_lines(spark, path).where(F.trim("value") != "").select("file", "line", F.try_parse_json("value").alias("json"))
    bad = F.col("json").isNull() | ~F.startswith(F.schema_of_variant("json"), F.lit("OBJECT"))
    if strict:
        first = out.where(bad).agg(F.min(F.struct("file", "line")).alias("at")).first()["at"]
        if first:
            raise ValueError(f"{first['file']}:{first['line']}: not a JSON object")
        return out
    return out.withColumn("json", F.when(~bad, F.col("json")))


def field(json_col: Column, name: str) -> Column:
    """A field as text; null where it is absent, null, or false in the sense of ``truthy``."""
    s = F.try_variant_get(json_col, f"$.{name}", "string")
    return F.when(~s.isin("", "0", "0.0", "false"), s)


def label_of(json_col: Column) -> Column:
    """The label, or the answer where there is no label field; an explicit null label stays null."""
    keys = F.json_object_keys(F.to_json(json_col))
    label, answer = (variant_label(F.try_variant_get(json_col, f"$.{k}", "variant")) for k in ("label", "answer"))
    return F.when(F.array_contains(keys, "label"), label).otherwise(answer)


def normalised(rows: DataFrame, dataset: str, subset: str, *, split: str = "val") -> DataFrame:
    """The lenient profile of ``read_jsonl``'s rows: aliases in order, ids as text, labels that may be null."""
    j = F.col("json")
    f = lambda n: field(j, n)
    path = first_text(f("image_path"), f("image"), f("path"))
    question = first_text(f("question"), f("text"), f("prompt"))
    sample = F.coalesce(text_or_null(f("sample_id")), text_or_null(f("question_id")), text_or_null(f("id")), F.concat(F.lit(f"{dataset}-{subset}-"), (F.col("line") - 1).cast("string")))
    explicit = F.try_variant_get(j, "$.image_id", "string")
    name = object_name(question, f("object_name"), f("object"))
    return rows.select(sample.alias("sample_id"), image_id(path, explicit).alias("image_id"), path.alias("image_path"), question.alias("question"), label_of(j).alias("label"), name.alias("object_name"), F.lit(split).alias("split"), F.lit(subset).alias("subset"), F.lit(dataset).alias("source_dataset"))


def strict_records(rows: DataFrame, dataset: str, subset: str, *, split: str = "val", template: str = "Is there a {object_name} in the image?") -> DataFrame:
    """The strict profile: other alias order, missing labels are 0, unknown labels and paths without an id raise."""
    j = F.col("json")
    f = lambda n: field(j, n)
    path = first_text(f("image"), f("image_path"))
    asked = F.coalesce(text_or_null(f("text")), text_or_null(f("question")), text_or_null(f("prompt")))
    name = object_name(F.coalesce(asked, F.lit("")), f("object"), f("object_name"))
    sample = F.coalesce(text_or_null(f("question_id")), text_or_null(f("sample_id")), text_or_null(f("id")), F.concat(F.lit(f"{subset}-"), (F.col("line") - 1).cast("string")))
    text = F.coalesce(F.try_variant_get(j, "$.label", "string"), F.try_variant_get(j, "$.answer", "string"))
    label = F.when(text.isNull(), 0).otherwise(F.coalesce(yes_no_label(text), F.raise_error(F.concat(F.lit("unsupported label: "), text)).cast("int")))
    number = image_id(path)
    ident = F.when(number == "", F.raise_error(F.concat(F.lit("no image id in "), path))).otherwise(number).cast("decimal(38,0)").cast("long")
    return rows.select(sample.alias("sample_id"), ident.alias("image_id"), path.alias("image_path"), question_text(template, name, asked).alias("question"), label.alias("label"), name.alias("object_name"), F.lit(split).alias("split"), F.lit(subset).alias("subset"), F.lit(dataset).alias("source_dataset"))


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """``line``, ``json`` of a JSON file that holds a list of objects, or one object."""
    text = F.col("value")
    doc = spark.read.text(path, wholetext=True).select(F.parse_json(text).alias("doc"))
    listed = F.when(F.startswith(F.schema_of_variant("doc"), F.lit("ARRAY")), F.try_variant_get("doc", "$", "array<variant>")).otherwise(F.array("doc"))
    return doc.select(F.posexplode(listed).alias("pos", "json")).select((F.col("pos") + 1).cast("long").alias("line"), "json")


def dash_b_rows(spark: SparkSession, root: str, template: str = DASH_B_TEMPLATE) -> DataFrame:
    """Rows of the two nested files dataset -> object -> file names: those without the object (label 0) first, in file order."""
    parts = []
    for label, kind in ((0, "neg"), (1, "pos")):
        doc = spark.read.text(f"{root}/images/dash_benchmark_{kind}.json", wholetext=True)
        m = doc.select(F.from_json("value", "map<string, map<string, array<string>>>").alias("m"))
        rows = m.select(F.posexplode("m").alias("i", "ds", "objects")).select("i", "ds", F.posexplode("objects").alias("j", "object_name", "files")).select("i", "ds", "j", "object_name", F.posexplode("files").alias("k", "file"))
        path = F.concat_ws("/", F.lit(f"images/{kind}"), "ds", "object_name", "file")
        sample = F.concat_ws("-", F.lit("dash-b"), F.lit(str(label)), "ds", "object_name", "file")
        parts.append(rows.select(F.lit(label).alias("label"), "i", "j", "k", sample.alias("sample_id"), path.alias("image_path"), "object_name", F.replace(F.lit(template), F.lit("{object_name}"), F.col("object_name")).alias("question")))
    return parts[0].unionByName(parts[1]).orderBy("label", "i", "j", "k").drop("i", "j", "k")


def read_instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, categories and annotations of one JSON file."""
    schema = "images array<struct<id: bigint, file_name: string>>, categories array<struct<id: bigint, name: string>>, annotations array<struct<id: bigint, image_id: bigint, category_id: bigint>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    pick = lambda c: doc.select(F.explode(c).alias("x"))
    return (pick("images").select(F.col("x.id").alias("image_id"), "x.file_name"), pick("categories").select(F.col("x.id").alias("category_id"), "x.name"), pick("annotations").select("x.image_id", "x.category_id"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``image_id`` per line."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").cast("long").alias("image_id"))


def allowed_objects(spark: SparkSession, paths: list[str], names: tuple[str, ...] = ()) -> DataFrame:
    """``name``, once each: the given names and the objects of JSONL files, trimmed; blank ones are left out."""
    j = lambda n: field(F.col("json"), n)
    given = spark.createDataFrame([(n,) for n in names], "name string")
    files = [read_jsonl(spark, p).select(F.coalesce(j("object_name"), j("object")).alias("name")) for p in paths]
    return reduce(DataFrame.unionByName, files, given).select(text_or_null("name").alias("name")).where("name is not null").distinct()


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("emptyValue", "").csv(path)


def read_cache(spark: SparkSession, path: str, *, datasets: tuple[str, ...] = (), models: tuple[str, ...] = (), tensors: bool = False) -> DataFrame:
    """Cached entries, stored by model and dataset: predicates prune folders, and vectors are read only when asked for."""
    df = spark.read.parquet(path)
    if datasets:
        df = df.where(F.col("dataset_name").isin(*datasets))
    if models:
        df = df.where(F.col("model_name").isin(*models))
    return df if tensors else df.drop("layer_vectors", "first_token_logits")


def filled_identity(entries: DataFrame, sidecar: DataFrame, columns: tuple[str, ...], *, shard: str = "shard_path") -> DataFrame:
    """Blank identity columns of the entries taken from their shard's row."""
    side = sidecar.select(shard, *[F.col(c).alias(f"__s_{c}") for c in columns])
    out = entries.join(side, shard, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(text_or_null(c), F.col(f"__s_{c}")))
    return out.drop(*[f"__s_{c}" for c in columns])


def dataset_specs(spark: SparkSession, root: str, present: list[str]) -> DataFrame:
    """The catalog's rows with the path of each: the normalised file where it is among the present ones, else the raw one; with status."""
    rows, have = [], set(present)
    for ordinal, (name, subset) in enumerate((n, s) for n, subsets in CATALOG.items() for s in subsets):
        paths = [f"{root}/outputs/stage0/normalized/{name}/{subset}.jsonl", f"{root}/data/{name.replace('-', '_')}/{subset}.json", f"{root}/data/{name}/{subset}.json"]
        found = next((p for p in paths if p in have), None)
        rows.append((ordinal, name, subset, found or paths[0], "present" if found else "missing"))
    return spark.createDataFrame(rows, "ordinal int, dataset_name string, subset string, path string, status string")


def manifest_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards of a cache manifest that have a path."""
    doc = spark.read.json(path, multiLine=True)
    return doc.select(F.explode("shards").alias("s")).select("s.*").where("path is not null")


def read_object(text: str) -> dict:
    out = json.loads(text)
    if not isinstance(out, dict):
        raise ValueError("not a JSON object")
    return out
