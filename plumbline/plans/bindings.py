"""The generic columns of the operators bound to the tables at hand, in Spark and, as CTEs, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS, WIDTH = 8, 8
BUCKETS = 97
MODELS = ("model-a", "model-b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as answered questions: the text is never read unless it is asked for."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    third = F.col("n_chars") % 3
    return d.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("sample_id"),
        F.col("source").alias("dataset_name"),
        F.col("lang").alias("subset"),
        F.concat(F.lit("g"), (F.col("doc_id") % BUCKETS).cast("string")).alias("bucket"),
        F.col("quality").alias("label"),
        F.when(third == 0, 1).when(third == 1, 0).alias("parsed"),
        "toxic",
        "n_chars",
        "text",
    )


DOCS = f"""docs AS (
    SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS sample_id, d.source AS dataset_name, d.lang AS subset, 'g' || CAST(d.doc_id % {BUCKETS} AS VARCHAR) AS bucket,
        l.quality AS label, CASE d.n_chars % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS parsed, l.toxic, d.n_chars, d.text
    FROM documents d LEFT JOIN labels l USING (doc_id)
), classed AS (
    SELECT *, CASE WHEN label IS NULL OR label NOT IN (0, 1) THEN 'invalid_label' WHEN parsed IS NULL THEN 'parsed_none' WHEN parsed = label THEN 'correct'
        WHEN label = 0 AND parsed = 1 THEN 'hard_hallucination' ELSE 'false_negative_error' END AS class
    FROM docs
)"""


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows with a binary outcome."""
    y = (F.get_json_object("props", "$.k").cast("int") >= 50).cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_key"), F.col("event_type").alias("subset"), F.col("value").alias("score"), y.alias("y"))


EVT = """evt AS (
    SELECT event_id, CAST(user_id AS VARCHAR) AS user_key, event_type AS subset, value AS score, CAST(CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INTEGER) >= 50 AS INTEGER) AS y FROM events
)"""


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as eight layers of eight numbers."""
    v = F.col("embedding").cast("array<double>")
    layers = F.array(*[F.slice(v, k * WIDTH + 1, WIDTH) for k in range(LAYERS)])
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"), layers.alias("layers"), (F.col("label") >= 5).cast("int").alias("y"), F.col("label"))


VEC = f"""vec AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_transform(range({LAYERS}), lambda k: CAST(embedding AS DOUBLE[])[k * {WIDTH} + 1 : k * {WIDTH} + {WIDTH}]) AS layers, CAST(label >= 5 AS INTEGER) AS y, label FROM embeddings
)"""


def split_sql(source: str, key: str, seed: int = 20260506) -> str:
    """CTEs ``named`` (key_text, split): groups of ``source`` ranked by md5 and cut by largest remainders."""
    return f"""keys AS (SELECT DISTINCT {key} AS key_text FROM {source}),
    ranked AS (SELECT key_text, row_number() OVER (ORDER BY md5('{seed}:' || key_text), key_text) AS rank, count(*) OVER () AS n FROM keys),
    shares AS (SELECT i, name, n * r AS x, floor(n * r) AS f, n FROM (SELECT count(*) AS n FROM keys), (VALUES (1, 'encoder_train', CAST(0.5 AS DOUBLE)), (2, 'bank', CAST(0.2 AS DOUBLE)), (3, 'cal', CAST(0.1 AS DOUBLE)), (4, 'test', CAST(0.2 AS DOUBLE))) s(i, name, r)),
    cut AS (SELECT i, name, f + CASE WHEN row_number() OVER (ORDER BY f - x, i) <= n - sum(f) OVER () THEN 1 ELSE 0 END AS k FROM shares),
    ends AS (SELECT i, name, sum(k) OVER (ORDER BY i) AS hi, sum(k) OVER (ORDER BY i) - k AS lo FROM cut),
    named AS (SELECT key_text, name AS split FROM ranked JOIN ends ON rank > lo AND rank <= hi)"""


def curve_sql(source: str, by: str) -> str:
    """CTEs up to ``areas`` and ``at``: the metric kernel over ``source`` (``y``, ``score``, and the columns ``by``)."""
    return f"""g AS (SELECT {by}, score, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n FROM {source} GROUP BY ALL),
    c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY {by}) AS pos, sum(n) OVER (PARTITION BY {by}) AS neg FROM g WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT *, tp / nullif(pos, 0) AS tpr, fp / nullif(neg, 0) AS fpr, tp / nullif(tp + fp, 0) AS prec FROM c),
    s AS (SELECT *, tpr - lag(tpr, 1, 0.0) OVER w AS d_tpr, fpr - lag(fpr, 1, 0.0) OVER w AS d_fpr, tpr + lag(tpr, 1, 0.0) OVER w AS s_tpr, prec + lag(prec, 1, 1.0) OVER w AS s_prec,
        lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS b_tp, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS b_fp, count(*) OVER (PARTITION BY {by}) AS k FROM r WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
    areas AS (SELECT {by}, CAST(max(pos) + max(neg) AS BIGINT) AS num_samples, CAST(max(pos) AS BIGINT) AS num_positive,
        CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(d_fpr * s_tpr / 2) END AS roc_auc, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(d_tpr * s_prec / 2) END AS pr_auc,
        CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(d_tpr * prec) END AS average_precision, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN 'ok' ELSE 'undefined' END AS metric_status,
        CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN coalesce(max(tpr) FILTER (fpr <= 0.01 AND (b_tp IS NULL OR b_tp != 0 OR b_fp != 0 OR k <= 2)), 0.0) END AS tpr_at_fpr,
        CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN coalesce(min(fpr) FILTER (tpr >= 0.95 AND (b_tp IS NULL OR b_tp != 0 OR b_fp != 0 OR k <= 2)), 1.0) END AS fpr_at_tpr
        FROM s GROUP BY {by})"""
