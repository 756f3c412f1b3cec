"""Ingest of raw datasets into checked, normalised records: dispatch by shape, discovery of what is there, checks in one job, one-step publication."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import files_under, path_issues
from ..functions.text import text_or_null
from ..operators.quality import require_none, violations
from .readers import CATALOG, DASH_B_TEMPLATE, EXTRACTION_COLUMNS, LEGACY_SUBSET, RECORD_COLUMNS, dash_b_rows, read_json_rows, read_jsonl, strict_records
from .shards import Store

DASH_B = "dash-b"


def normalised_path(root: str, dataset: str, subset: str) -> str:
    return f"{root.rstrip('/')}/outputs/stage0/normalized/{dataset}/{subset}.jsonl"


def raw_path(root: str, dataset: str, subset: str) -> str:
    """A file for each subset; of the nested layout, its folder."""
    return f"{root.rstrip('/')}/data/{dataset}" if dataset == DASH_B else f"{root.rstrip('/')}/data/{dataset}/{subset}.jsonl"


def exists(spark: SparkSession, path: str) -> bool:
    store = Store(spark, path)
    return store.fs.exists(store.at(path))


def first_existing(spark: SparkSession, path: str, *roots: str) -> str:
    """A path as it is, else under the first root where it is there, else as it is under the last."""
    tries = [path] if path.startswith("/") or "://" in path else [path, *(f"{r.rstrip('/')}/{path}" for r in roots)]
    return next((p for p in tries if exists(spark, p)), tries[-1])


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """``ordinal``, ``dataset_name``, ``subset``, ``path``, ``status``: the catalog with the normalised file where it is there or the raw one isn't; the nested layout only where either is, its legacy subset only where it is normalised."""
    rows = []
    for name, subsets in CATALOG.items():
        for subset in (*subsets, LEGACY_SUBSET) if name == DASH_B else subsets:
            made, raw = normalised_path(root, name, subset), raw_path(root, name, subset)
            made_there, raw_there = exists(spark, made), subset != LEGACY_SUBSET and exists(spark, raw)
            if name != DASH_B or made_there or raw_there:
                rows.append((len(rows), name, subset, made if made_there or not raw_there else raw, "present" if made_there or raw_there else "missing"))
    return spark.createDataFrame(rows, "ordinal int, dataset_name string, subset string, path string, status string")


def rows_of(spark: SparkSession, source: str | list | DataFrame, template: str = DASH_B_TEMPLATE) -> DataFrame:
    """``line``, ``json`` (VARIANT) of a source by its shape: rows at hand, the nested layout's folder, a JSON file, or else lines of JSON."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, list):
        rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(source, 1)], "line long, text string")
        return rows.select("line", F.parse_json("text").alias("json"))
    if exists(spark, f"{source}/images"):
        rows = dash_b_rows(spark, source, template).withColumn("image", F.col("image_path")).withColumn("text", F.col("question"))
        return rows.select((F.monotonically_increasing_id() + 1).alias("line"), F.parse_json(F.to_json(F.struct("sample_id", "image", "text", "label", "object_name"))).alias("json"))
    return (read_json_rows if source.endswith(".json") else read_jsonl)(spark, source).select("line", "json")


def read_normalised(spark: SparkSession, path: str) -> DataFrame:
    """Normalised records with their nine fields typed; the first line that lacks one raises when it is read."""
    rows = read_jsonl(spark, path)
    keys = F.json_object_keys(F.to_json("json"))
    lacks = F.filter(F.array(*map(F.lit, RECORD_COLUMNS)), lambda c: ~F.array_contains(keys, c))
    said = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": missing fields: "), F.array_join(lacks, ", "))
    text = {c: F.try_variant_get("json", f"$.{c}", "int" if c == "label" else "string") for c in RECORD_COLUMNS}
    first, *rest = RECORD_COLUMNS
    return rows.select(F.when(F.size(lacks) > 0, F.raise_error(said).cast("string")).otherwise(text[first]).alias(first), *(text[c].alias(c) for c in rest))


def source_issues(rows: DataFrame, dataset: str, subset: str, *, key: str = "sample_id") -> DataFrame:
    """Rows that name another dataset or subset than the one that is expected; blanks name none."""
    want = {"dataset_name": dataset, "source_dataset": dataset, "subset": subset}
    found = violations({f"{c} is not {v}": text_or_null(c).isNotNull() & (text_or_null(c) != v) for c, v in want.items() if c in rows.columns})
    return rows.select(key, found.alias("issues")).where(F.size("issues") > 0)


def record_issues(records: DataFrame, *, key: str = "sample_id") -> DataFrame:
    """``key``, ``issue`` of records that aren't ready for extraction."""
    checks = {f"missing or blank {c}": text_or_null(F.col(c).cast("string")).isNull() for c in EXTRACTION_COLUMNS if c != "label"}
    checks["label must be 0 or 1"] = F.col("label").isNull() | ~F.col("label").isin(0, 1)
    return records.select(key, F.explode(violations(checks)).alias("issue"))


def build_normalised(spark: SparkSession, root: str, dataset: str, subset: str, *, source: str | None = None, image_root: str | None = None) -> DataFrame:
    """A dataset's raw rows as checked, typed records. All faults, of fields and of image paths, are looked for by one job, which raises with the first ones."""
    if subset not in CATALOG.get(dataset, ()):
        raise ValueError(f"unknown dataset or subset: {dataset}/{subset}")
    source = source or raw_path(root, dataset, subset)
    if not exists(spark, source):
        raise FileNotFoundError(f"raw data is missing: {source}")
    nested = dataset == DASH_B
    records = strict_records(rows_of(spark, source), dataset, subset, split=subset, **({"template": DASH_B_TEMPLATE} if nested else {}))
    issues = [record_issues(records)]
    if not nested:
        images = image_root or f"{root.rstrip('/')}/data/coco/val2014"
        if not exists(spark, images):
            raise FileNotFoundError(f"image root is missing: {images}")
        issues.append(path_issues(records, files_under(spark, images), images, key="sample_id", path="image_path").select("sample_id", "issue"))
    require_none(reduce(DataFrame.unionByName, issues), source)
    return records


def materialise(spark: SparkSession, root: str, dataset: str, subset: str, **options) -> str:
    """Writes a dataset's normalised records as lines of JSON where readers look for them; they see all of them or what was there before."""
    target = normalised_path(root, dataset, subset)
    records = build_normalised(spark, root, dataset, subset, **options)
    store, draft = Store(spark, root), f"{target}.{uuid.uuid4().hex}"
    try:
        records.select(*sorted(records.columns)).write.option("ignoreNullFields", False).json(draft)
        store.delete(target)
        store.rename(draft, target)
    except BaseException:
        store.delete(draft)
        raise
    return target


def write_json(rows: DataFrame, path: str, *, order: tuple[str, ...] | None = None) -> None:
    """A table of one row as one indented JSON text: its keys in alphabetical order, or those of ``order`` in that."""
    found = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).take(2)
    if len(found) != 1:
        raise ValueError(f"{path}: one row is written, there are {len(found) and 'several' or 'none'}")
    said = json.loads(found[0][0])
    text = json.dumps({c: said.get(c) for c in order}, indent=2) if order else json.dumps(said, indent=2, sort_keys=True)
    Store(rows.sparkSession, path).write(path, text + "\n")


def optional_int(value: Column) -> Column:
    """An integer from a VARIANT: numbers cut towards zero, texts of whole numbers; null for booleans and all else."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    whole = F.when(F.regexp_like(text, F.lit(r"^\s*[+-]?\d{1,18}\s*$")), F.trim(text).cast("long"))
    return F.when(kind == "STRING", whole).when(kind == "BIGINT", F.try_variant_get(value, "$", "long")).when(F.regexp_like(kind, F.lit("^(DOUBLE|FLOAT|DECIMAL)")), F.try_variant_get(value, "$", "double").cast("long"))
