"""Paths as text: canonical forms, and whether one lies under a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(path: Column) -> Column:
    """Without empty and ``.`` steps and with each ``..`` taken back, never above the top; starts with a slash. Links are not followed."""

    def step(a: Column, x: Column) -> Column:
        return F.when(x.isin("", "."), a).when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).otherwise(F.concat(a, F.lit("/"), x))

    found = F.aggregate(F.split(path, "/"), F.lit(""), step)
    return F.when(found == "", "/").otherwise(found)


def resolved(path: Column, root: str | Column) -> Column:
    """A canonical path, a relative one being taken from the root."""
    root = F.lit(root) if isinstance(root, str) else root
    return canonical(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(root, F.lit("/"), path)))


def is_under(path: Column, root: str | Column) -> Column:
    """Whether a path, resolved, is the root or lies under it; siblings whose names begin with the root's do not."""
    top = canonical(F.lit(root) if isinstance(root, str) else root)
    at = resolved(path, root)
    return (at == top) | F.startswith(at, F.when(top == "/", "/").otherwise(F.concat(top, F.lit("/"))))


def files_under(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (canonical, without a scheme) of all files under a folder, listed by Spark; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return found.select(canonical(F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")).alias("path"))


def path_issues(rows: DataFrame, files: DataFrame, root: str, *, key: str, path: str) -> DataFrame:
    """``key``, ``path``, ``issue`` of rows whose path leaves the root or names no file; an anti join with the listing, so neither side must fit a task."""
    named = rows.select(key, F.col(path).alias("path"), is_under(F.col(path), root).alias("__in"), resolved(F.col(path), root).alias("__at"))
    outside = named.where(~F.coalesce("__in", F.lit(False))).select(key, "path", F.lit("must resolve under its root").alias("issue"))
    lost = named.where("__in").join(files.select(F.col("path").alias("__at")).distinct(), "__at", "left_anti")
    return outside.unionByName(lost.select(key, "path", F.lit("file is missing under its root").alias("issue")))
