"""Cached answers as a stream: counts per key as files arrive, once over what is there or continuously."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import population_class


def answer_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """``path``: a folder to which files are added, or a pattern."""
    return spark.readStream.schema(schema).parquet(path)


def population_counts(stream: DataFrame, by: tuple[str, ...] = (), *, label: str = "label", parsed: str = "parsed") -> DataFrame:
    """Rows per group and population class, kept up to date."""
    return stream.withColumn("class", population_class(F.col(label), F.col(parsed))).groupBy(*by, "class").agg(F.count("*").alias("n"))


def run_available(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Takes in all files there are into the in-memory table ``name`` (a few rows of counts) and stops."""
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest_counts(spark: SparkSession, path: str, *, label: str, parsed: str) -> DataFrame:
    """What ``population_counts`` holds once all present files are in. Its state is kept in ``spark.checkpoint.dir``; a temporary folder stands in for that on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
    name = f"counts_{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # as a pattern, the path may be a single file
    run_available(population_counts(answer_stream(spark, f"{path[:-1]}[{path[-1]}]", schema), label=label, parsed=parsed), name, f"{root.rstrip('/')}/{name}")
    return spark.table(name)
