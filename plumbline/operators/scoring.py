"""Readouts over vectors: logistic regression as the diagnostics fit it, and batch scorers behind one interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import standard_scaled


def logistic_scores(df: DataFrame, *, key: str, vector: str, label: str, train: str, max_iter: int = 1000) -> DataFrame:
    """``key``, ``score``: probability of class 1 by L2 logistic regression (C = 1, balanced classes) on standardised vectors, fitted on the rows that ``train`` marks."""
    scaled = standard_scaled(df, vector, F.col(train))
    rows = scaled.select(key, array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias("y"), F.col(train).alias("t"))
    sizes = {r["y"]: r["n"] for r in rows.where("t").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) != 2:
        raise ValueError("training rows must have both classes")
    n = sum(sizes.values())
    weight = F.when(F.col("y") == 1, n / (2.0 * sizes[1.0])).otherwise(n / (2.0 * sizes[0.0]))
    rows = rows.withColumn("w", weight)
    model = LogisticRegression(labelCol="y", weightCol="w", regParam=1.0 / n, standardization=False, maxIter=max_iter, tol=1e-10).fit(rows.where("t"))
    return model.transform(rows).select(key, F.element_at(vector_to_array("probability"), 2).alias("score"))


Scorer = Callable[[list[str]], list[str]]


def answered(records: DataFrame, make_scorer: Callable[[], Scorer], *, question: str = "question", answer: str = "answer_text", batch: int = 64) -> DataFrame:
    """``records`` with the scorer's answers. The scorer is made once per task and gets its questions in batches."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in records.schema)}, `{answer}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            asked = frame[question].fillna("").tolist()
            out: list[str] = []
            for i in range(0, len(asked), batch):
                out += scorer(asked[i : i + batch])
            yield frame.assign(**{answer: out})

    return records.mapInPandas(run, schema)


def stub_scorer() -> Scorer:
    """Deterministic: yes where a question has an even number of characters."""
    return lambda asked: ["Yes." if len(q) % 2 == 0 else "No." for q in asked]
