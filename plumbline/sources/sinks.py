"""Writers: tables with fixed columns, manifests, and cache shards with checks after writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One file with a header, the columns in order, nulls as empty fields. For small report tables."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def union_of(tables: list[DataFrame]) -> DataFrame:
    """All rows, columns in the order in which they are first seen, absent ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    """Keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_cache(df: DataFrame, path: str, *, rows_per_file: int = 128) -> int:
    """Entries by model, dataset and subset, in files of at most ``rows_per_file``; counted again after writing."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("model_name", "dataset_name", "subset").parquet(path)
    spark = df.sparkSession
    wrote, want = spark.read.parquet(path).count(), df.count()
    if wrote != want:
        raise OSError(f"{path}: wrote {wrote} of {want} entries")
    return wrote


def config_hash(df: DataFrame, columns: list[str], name: str = "config_hash") -> DataFrame:
    """sha256 of the columns as JSON with sorted keys."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def file_digests(spark, path: str) -> DataFrame:
    """``path``, ``length``, ``sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def merged_metadata(left: str, right: str):
    """Two maps as one, the right one's values winning."""
    kept = F.map_filter(F.coalesce(F.col(left), F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(F.col(right), F.create_map().cast("map<string,string>")))


def run_status(done: int, failed: int, *, dry: bool = False) -> str:
    if dry:
        return "dry_run"
    return "completed" if done and not failed else "partial" if done else "failed"
