"""Named queries over the bound tables, each with equivalent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, walk
from ..functions import text as T
from ..operators import bootstrap, cache_checks, experiment, extraction, gates, metrics, preflight, quality, reconcile, scoring, splits, tokens, vectors
from ..streaming import answers
from .bindings import DOCS, EVT, LAYERS, VEC, curve_sql, docs, evt, split_sql, table, vec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def six(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, as the SQL has them."""
    return df.select(*[six(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- audits ----------------------------------------------------------------------------------------------------------

_SUMMARY = """count(*) AS num_entries, count(*) FILTER (class = 'correct') AS num_correct, count(*) FILTER (class = 'hard_hallucination') AS num_hard_hallucination,
    count(*) FILTER (class = 'false_negative_error') AS num_false_negative_error, count(*) FILTER (class = 'parsed_none') AS num_parsed_none, count(*) FILTER (class = 'invalid_label') AS num_invalid_label,
    count(*) FILTER (class IN ('correct', 'hard_hallucination')) AS num_primary_population,
    round(count(*) FILTER (class = 'hard_hallucination') / nullif(CAST(count(*) FILTER (class IN ('correct', 'hard_hallucination')) AS DOUBLE), 0), 6) AS hallucination_rate,
    count(*) FILTER (class = 'hard_hallucination') < 20 AS low_positive_count"""


@query(f"WITH {DOCS} SELECT dataset_name, subset, {_SUMMARY} FROM classed GROUP BY dataset_name, subset")
def population_summary(spark, sf):
    return rounded(quality.population_summary(docs(spark, sf), ("dataset_name", "subset")))


@query(f"WITH {DOCS}, {split_sql('docs', 'bucket')} SELECT split, subset, {_SUMMARY} FROM classed JOIN named ON bucket = key_text GROUP BY split, subset")
def population_by_split(spark, sf):
    d = docs(spark, sf).select("bucket", "subset", "label", "parsed")
    return rounded(quality.population_summary(splits.grouped_split(d, "bucket"), ("split", "subset")))


@query(
    f"""WITH {DOCS}, {split_sql('docs', 'bucket')}, kept AS (SELECT split, subset, class FROM classed JOIN named ON bucket = key_text WHERE class NOT IN ('correct', 'hard_hallucination'))
    SELECT split, 'pooled' AS scope, class, count(*) AS n FROM kept GROUP BY split, class UNION ALL SELECT split, subset, class, count(*) FROM kept GROUP BY split, subset, class"""
)
def excluded_counts_rollup(spark, sf):
    return quality.excluded_counts(splits.grouped_split(docs(spark, sf).select("bucket", "subset", "label", "parsed"), "bucket"))


@query(
    f"""WITH {DOCS}, specs AS (SELECT DISTINCT dataset_name, subset FROM docs UNION ALL SELECT 'absent', 'all')
    SELECT dataset_name, subset, CASE WHEN count(d.doc_id) = 0 THEN 'missing' ELSE 'present' END AS status, count(d.doc_id) AS num_records,
        count(*) FILTER (label = 1) AS num_label_yes, count(*) FILTER (label = 0) AS num_label_no, CAST(0 AS BIGINT) AS num_missing_image_path,
        count(d.doc_id) FILTER (text IS NULL OR regexp_matches(text, '^\\s*$')) AS num_missing_question, CAST(0 AS BIGINT) AS num_unknown_object, count(DISTINCT bucket) AS num_unique_objects,
        count(DISTINCT n_chars) AS num_unique_images, count(d.doc_id) - count(DISTINCT d.sample_id) AS num_duplicate_sample_id,
        CAST(coalesce(sum(CASE WHEN d.doc_id IS NOT NULL THEN CAST(text IS NULL OR regexp_matches(text, '^\\s*$') AS INT) + CAST(label IS NULL AS INT) END), 0) AS BIGINT) AS num_null_required_fields,
        count(d.doc_id) FILTER (label IS NULL) AS num_invalid_label
    FROM specs LEFT JOIN docs d USING (dataset_name, subset) GROUP BY dataset_name, subset"""
)
def dataset_audit(spark, sf):
    d = docs(spark, sf).withColumn("image_path", F.col("dataset_name"))
    by = ("dataset_name", "subset")
    audit = quality.dataset_audit(d, by, image="n_chars", question="text", name="bucket")
    specs = d.select(*by).distinct().unionByName(spark.createDataFrame([("absent", "all")], "dataset_name string, subset string"))
    return quality.audit_of_specs(specs, audit, by)


_RATE = "CASE WHEN count(*) FILTER (label = 0) > 0 THEN regexp_replace(regexp_replace(printf('%.6f', round_even(count(*) FILTER (parsed = 1 AND label = 0) / CAST(count(*) FILTER (label = 0) AS DOUBLE), 6)), '0+$', ''), '\\.$', '') END"


@query(
    f"""WITH {DOCS} SELECT dataset_name, subset, count(*) AS num_records, count(*) FILTER (label = 1) AS num_gt_yes, count(*) FILTER (label = 0) AS num_gt_no, count(*) FILTER (label IS NULL) AS num_invalid_label,
    CASE WHEN bool_or(toxic = 1) THEN count(*) FILTER (parsed = 1) END AS num_parsed_yes, CASE WHEN bool_or(toxic = 1) THEN count(*) FILTER (parsed = 0) END AS num_parsed_no,
    CASE WHEN bool_or(toxic = 1) THEN count(*) FILTER (parsed IS NULL) END AS num_parsed_none, CASE WHEN bool_or(toxic = 1) THEN count(*) FILTER (parsed = label) END AS num_correct,
    CASE WHEN bool_or(toxic = 1) THEN count(*) FILTER (parsed = 1 AND label = 0) END AS num_hallucination, CASE WHEN bool_or(toxic = 1) THEN {_RATE} END AS hallucination_rate,
    CASE WHEN bool_or(toxic = 1) THEN 'available' ELSE 'not_available_in_cache' END AS parsed_answer_status
    FROM docs GROUP BY dataset_name, subset"""
)
def label_balance(spark, sf):
    return quality.label_balance(docs(spark, sf), ("dataset_name", "subset"), has_field=F.col("toxic") == 1)


@query(
    f"""WITH {DOCS} SELECT dataset_name, subset, count(*) AS num_entries, count(*) FILTER (label = 1) AS num_gt_yes, count(*) FILTER (label = 0) AS num_gt_no, count(*) FILTER (parsed = 1) AS num_parsed_yes,
    count(*) FILTER (parsed = 0) AS num_parsed_no, count(*) FILTER (parsed IS NULL) AS num_parsed_none, count(*) FILTER (parsed = label) AS num_correct, count(*) FILTER (parsed = 1 AND label = 0) AS num_hard_hallucination,
    count(*) FILTER (parsed = 0 AND label = 1) AS num_false_negative_error, count(*) FILTER (label = 0) AS num_primary_population, {_RATE} AS hallucination_rate_in_primary_population
    FROM docs GROUP BY dataset_name, subset"""
)
def cache_label_balance(spark, sf):
    return quality.cache_label_balance(docs(spark, sf), ("dataset_name", "subset"))


@query(
    f"""WITH {DOCS} SELECT dataset_name, bucket, count(*) AS num_records, CASE WHEN bool_or(toxic = 1) THEN count(*) FILTER (parsed = label) END AS num_correct,
    CASE WHEN bool_or(toxic = 1) THEN count(*) FILTER (parsed = 1 AND label = 0) END AS num_hallucination FROM docs GROUP BY dataset_name, bucket"""
)
def object_audit(spark, sf):
    return quality.object_audit(docs(spark, sf), ("dataset_name",), "bucket", has_field=F.col("toxic") == 1)


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id HAVING count(*) > 1")
def ambiguous_ids(spark, sf):
    return quality.repeated(table(spark, sf, "conversations"), ("conv_id",))


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return quality.repeated(table(spark, sf, "lineitem"), ("l_orderkey", "l_suppkey"))


@query(
    f"""WITH {DOCS} SELECT doc_id, concat_ws(',', CASE WHEN text IS NULL OR regexp_matches(text, '^\\s*$') THEN 'missing or blank text' END, CASE WHEN label IS NULL OR label NOT IN (0, 1) THEN 'label must be 0 or 1' END) AS violations
    FROM docs WHERE text IS NULL OR regexp_matches(text, '^\\s*$') OR label IS NULL OR label NOT IN (0, 1)"""
)
def extraction_violations(spark, sf):
    bad = quality.extraction_violations(docs(spark, sf), ("sample_id", "text", "label"))
    return bad.select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT l_suppkey, max_by(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem GROUP BY l_suppkey")
def last_wins(spark, sf):
    return quality.last_wins(table(spark, sf, "lineitem"), ("l_suppkey",), F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).select("l_suppkey", "l_orderkey")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) ELSE 'mixed' END AS flag FROM lineitem GROUP BY l_orderkey")
def single_source(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(quality.single_value(F.col("l_returnflag"), F.lit("mixed")).alias("flag"))


# --- reconciliation --------------------------------------------------------------------------------------------------


@query(
    f"""WITH {DOCS}, records AS (SELECT doc_id, dataset_name, subset, CAST(n_chars AS VARCHAR) AS sample_id FROM docs),
    answers AS (SELECT dataset_name, subset, CAST(n_chars AS VARCHAR) AS sample_id, toxic AS parsed FROM docs WHERE label IS NOT NULL),
    n3 AS (SELECT dataset_name, subset, sample_id, count(*) AS n, min(parsed) AS p FROM answers GROUP BY ALL), n1 AS (SELECT sample_id, count(*) AS n, min(parsed) AS p FROM answers GROUP BY ALL),
    amb AS (SELECT sample_id, count(*) > 1 AS a FROM records GROUP BY ALL)
    SELECT doc_id, CASE WHEN n3.n = 1 THEN n3.p WHEN NOT a AND n1.n = 1 THEN n1.p END AS parsed, CASE WHEN n3.n = 1 THEN 'keyed' WHEN NOT a AND n1.n = 1 THEN 'sample' ELSE 'none' END AS matched
    FROM records LEFT JOIN n3 USING (dataset_name, subset, sample_id) LEFT JOIN n1 USING (sample_id) LEFT JOIN amb USING (sample_id)"""
)
def cascaded_answer_match(spark, sf):
    d = docs(spark, sf).withColumn("sample_id", F.col("n_chars").cast("string"))
    records = d.select("doc_id", "dataset_name", "subset", "sample_id")
    found = d.where("label is not null").select("dataset_name", "subset", "sample_id", F.col("toxic").alias("parsed"))
    return reconcile.cascaded_match(records, found).select("doc_id", "parsed", "matched")


@query(
    """SELECT doc_id, coalesce(l.toxic, CAST(n_chars % 2 AS INTEGER)) AS label, CASE WHEN l.toxic IS NOT NULL THEN 'relabelled' ELSE source END AS source_dataset
    FROM documents LEFT JOIN labels l USING (doc_id)"""
)
def relabel_left_join(spark, sf):
    records = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("label"), F.col("source").alias("source_dataset"))
    new = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"), F.col("doc_id").alias("ordinal"))
    return reconcile.relabelled(records, new, key="doc_id", name="relabelled")


@query(
    """WITH a AS (SELECT doc_id AS ordinal, quality AS x, toxic AS z FROM labels), b AS (SELECT doc_id AS ordinal, n_chars % 2 AS x, n_chars % 3 AS z FROM documents)
    SELECT ordinal, CASE WHEN a.ordinal IS NULL OR b.ordinal IS NULL THEN 'row count' ELSE concat_ws(',', CASE WHEN a.x IS DISTINCT FROM b.x THEN 'x' END, CASE WHEN a.z IS DISTINCT FROM b.z THEN 'z' END) END AS fields
    FROM a FULL JOIN b USING (ordinal) WHERE a.ordinal IS NULL OR b.ordinal IS NULL OR a.x IS DISTINCT FROM b.x OR a.z IS DISTINCT FROM b.z"""
)
def lossless_relabel_violations(spark, sf):
    a = table(spark, sf, "labels").select(F.col("doc_id").alias("ordinal"), F.col("quality").alias("x"), F.col("toxic").alias("z"))
    b = table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), (F.col("n_chars") % 2).alias("x"), (F.col("n_chars") % 3).alias("z"))
    return reconcile.lossless_violations(a, b, ordinal="ordinal", fields=("x", "z"))


@query(
    """WITH a AS (SELECT o_orderstatus AS left_subset, CAST(o_custkey AS VARCHAR) AS cust, o_orderpriority AS prio FROM orders), k AS (
        SELECT DISTINCT left_subset, 'cust' AS key, cust AS value FROM a UNION SELECT DISTINCT left_subset, 'cust_prio', cust || '|' || prio FROM a)
    SELECT l.key, l.left_subset, r.left_subset AS right_subset, count(*) AS n FROM k l JOIN k r USING (key, value) GROUP BY ALL"""
)
def overlap_audit(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("left_subset"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("prio"))
    return reconcile.overlap_counts(o, o.withColumnRenamed("left_subset", "right_subset"), {"cust": ("cust",), "cust_prio": ("cust", "prio")}, ("left_subset", "right_subset"))


def _matrix(spark, sf):
    o = table(spark, sf, "orders")
    required = reconcile.required_matrix(o.select(F.col("o_orderstatus").alias("model")).distinct(), o.select(F.col("o_orderpriority").alias("subset")).distinct())
    seen = o.where("o_orderstatus != 'F' or o_orderpriority != '5-LOW'").groupBy(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("subset")).agg(F.count("*").alias("observed"), F.count_if(F.col("o_totalprice") > 1000).alias("expected"))
    required = required.join(seen.select("model", "subset", "expected"), ["model", "subset"], "left").withColumn("expected", F.coalesce("expected", F.lit(1).cast("long")))
    return required, seen.select("model", "subset", "observed")


_MTX = """m AS (SELECT model, subset, coalesce(expected, 1) AS expected, coalesce(observed, 0) AS observed FROM (SELECT DISTINCT o_orderstatus AS model FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority AS subset FROM orders)
    LEFT JOIN (SELECT o_orderstatus AS model, o_orderpriority AS subset, count(*) AS observed, count(*) FILTER (o_totalprice > 1000) AS expected FROM orders WHERE o_orderstatus != 'F' OR o_orderpriority != '5-LOW' GROUP BY ALL) USING (model, subset)),
    s AS (SELECT *, CASE WHEN observed = expected THEN 'completed' WHEN observed > 0 THEN 'mismatch' ELSE 'missing' END AS state FROM m)"""


@query(f"WITH {_MTX} SELECT model, subset, expected FROM s")
def matrix_required(spark, sf):
    return _matrix(spark, sf)[0]


@query(f"WITH {_MTX} SELECT * FROM s")
def matrix_states(spark, sf):
    return reconcile.reconciled(*_matrix(spark, sf), ("model", "subset"))


@query(f"WITH {_MTX} SELECT model, subset, expected, observed FROM s WHERE state = 'completed'")
def matrix_completed(spark, sf):
    return matrix_states(spark, sf).where("state = 'completed'").drop("state")


@query(f"WITH {_MTX} SELECT model, subset, expected, observed FROM s WHERE state != 'completed'")
def matrix_missing(spark, sf):
    return matrix_states(spark, sf).where("state != 'completed'").drop("state")


@query(f"WITH {_MTX} SELECT model || '/' || subset || ': expected ' || expected || ', observed ' || observed AS label FROM s WHERE state = 'mismatch'")
def count_mismatch_labels(spark, sf):
    return reconcile.mismatch_labels(matrix_states(spark, sf), ("model", "subset"))


_SCOPE = {"source": ("books", "news", "wiki"), "lang": ("de", "en")}


@query(
    "WITH d AS (SELECT coalesce(nullif(trim(source), ''), '<blank>') AS source, coalesce(nullif(trim(lang), ''), '<blank>') AS lang FROM documents) "
    + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM d WHERE {c} NOT IN {v} GROUP BY {c}" for c, v in _SCOPE.items())
)
def scope_issues(spark, sf):
    return preflight.scope_issues(table(spark, sf, "documents"), _SCOPE)


@query(
    """WITH r AS (SELECT o_orderkey AS k, max(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 7 END) AS x FROM orders WHERE o_orderstatus != 'P' GROUP BY ALL),
    c AS (SELECT l_orderkey AS k, count(*) AS y FROM lineitem GROUP BY ALL), m AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity >= 50), w AS (SELECT DISTINCT o_orderkey AS k FROM orders),
    j AS (SELECT w.k, r.k AS rk, x, c.k AS ck, y, m.k AS mk FROM w LEFT JOIN r USING (k) LEFT JOIN c USING (k) LEFT JOIN m USING (k))
    SELECT 'required_cache_matrix missing' AS check, CAST(k AS VARCHAR) AS item, '' AS detail FROM j WHERE rk IS NULL UNION ALL SELECT 'completed_cache_matrix missing', CAST(k AS VARCHAR), '' FROM j WHERE ck IS NULL
    UNION ALL SELECT 'missing_cache_matrix contains required entries', CAST(k AS VARCHAR), '' FROM j WHERE mk IS NOT NULL UNION ALL SELECT 'cache matrix count mismatch', CAST(k AS VARCHAR), 'expected ' || x || ' got ' || y FROM j WHERE x != y
    UNION ALL SELECT 'missing_cache_matrix is not empty', CAST(k AS VARCHAR), '' FROM m WHERE k NOT IN (SELECT k FROM w)"""
)
def summary_issues(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    k = F.col("o_orderkey").alias("k")
    required = o.where("o_orderstatus != 'P'").select(k, F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 7).alias("expected"))
    completed = l.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("observed"))
    return preflight.summary_issues(o.select(k), required, completed, l.where("l_quantity >= 50").select(F.col("l_orderkey").alias("k")), ("k",))


@query(
    """SELECT 'model-' || (doc_id % 3) AS model_name, source AS dataset_name, source AS source_dataset, lang AS subset, CAST(sum(n_chars) AS BIGINT) AS cache_num_entries FROM documents
    WHERE doc_id IS NOT NULL AND nullif(trim(source), '') IS NOT NULL AND nullif(trim(lang), '') IS NOT NULL GROUP BY ALL"""
)
def matrix_of_shards(spark, sf):
    d = table(spark, sf, "documents")
    model = F.concat(F.lit("model-"), (F.col("doc_id") % 3).cast("string")).alias("model_name")
    return preflight.matrix_of_shards(d.select(model, F.col("source").alias("dataset_name"), F.lit(None).cast("string").alias("source_dataset"), F.col("lang").alias("subset"), F.col("n_chars").alias("num_entries")))


@query("SELECT event_type AS subset, count(*) FILTER (b IS NULL OR b NOT IN (0, 1)) AS num_bad_labels, count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS num_bad_scores FROM (SELECT *, user_id % 3 AS b FROM events) GROUP BY ALL HAVING num_bad_labels > 0 OR num_bad_scores > 0")
def label_issues(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("subset"), (F.col("user_id") % 3).alias("b"), "value")
    return preflight.label_issues(e, "b", "value", by=("subset",))


@query(
    f"""WITH {EVT}, {split_sql('evt', 'user_key')}, a AS (SELECT evt.*, split FROM evt JOIN named ON user_key = key_text),
    s AS (SELECT subset, split, count(*) AS n, count(DISTINCT user_key) AS o FROM a GROUP BY ALL), y AS (SELECT subset, split, y, count(*) AS n FROM a GROUP BY ALL)
    SELECT subset, CAST(sum(n) AS BIGINT) AS input_records, string_agg(split || '=' || n, ',' ORDER BY split) AS counts_per_split,
        (SELECT string_agg(y.split || ':' || coalesce(CAST(y.y AS VARCHAR), '<blank>') || '=' || y.n, ',' ORDER BY y.split, y.y) FROM y WHERE y.subset = s.subset) AS label_counts_per_split,
        string_agg(split || '=' || o, ',' ORDER BY split) AS objects_per_split,
        (SELECT count(*) FROM (SELECT user_key FROM a WHERE a.subset = s.subset GROUP BY user_key HAVING count(DISTINCT split) > 1)) AS images_in_several_splits,
        (SELECT count(*) FROM (SELECT event_id FROM a WHERE a.subset = s.subset GROUP BY event_id HAVING count(DISTINCT split) > 1)) AS samples_in_several_splits
    FROM s GROUP BY subset"""
)
def split_index(spark, sf):
    return preflight.split_index(_evt_split(spark, sf), ("subset",), label="y", name="user_key", image="user_key", sample="event_id")


@query(
    """SELECT k, coalesce(a.n, 0) AS expected_n, coalesce(b.n, 0) AS observed_n FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY ALL) a
    FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY ALL) b USING (k) WHERE coalesce(a.n, 0) != coalesce(b.n, 0)"""
)
def count_differences(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return reconcile.count_differences(a, b, ("k",))


def _reference(spark, sf, cap):
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("file_name"))
    parts = table(spark, sf, "part")
    notes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"))
    allowed = parts.where("p_type in ('ECONOMY', 'PROMO')").select(F.col("p_brand").alias("name"))
    excluded = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("image_id"))
    out = reconcile.reference_candidates(images, parts.select(F.col("p_partkey").alias("category_id"), F.col("p_brand").alias("name")), notes, allowed=allowed, excluded=excluded, cap=cap)
    return out.withColumn("object_names", F.array_join("object_names", ","))


def _reference_sql(cap: str) -> str:
    return f"""WITH pairs AS (SELECT DISTINCT l_orderkey AS image_id, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT p_brand FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))
        AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')), kept AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY image_id) AS rn FROM pairs)
    SELECT image_id, o_orderpriority AS file_name, string_agg(name, ',' ORDER BY name) AS object_names FROM kept JOIN orders ON image_id = o_orderkey {cap} GROUP BY image_id, o_orderpriority"""


@query(_reference_sql(""))
def reference_candidates(spark, sf):
    return _reference(spark, sf, None)


@query(_reference_sql("WHERE rn <= 25"))
def reference_candidates_capped(spark, sf):
    return _reference(spark, sf, 25)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def expected_presence_anti(spark, sf):
    return reconcile.missing(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ("o_orderkey",))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def expected_semi_counts(spark, sf):
    wanted = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return reconcile.counts_of_expected(table(spark, sf, "lineitem"), wanted, ("l_orderkey",))


# --- splits ----------------------------------------------------------------------------------------------------------

_EVT_SPLIT = f"{EVT}, {split_sql('evt', 'user_key')}, es AS (SELECT evt.*, split FROM evt JOIN named ON user_key = key_text)"


def _evt_split(spark, sf):
    return splits.grouped_split(evt(spark, sf), "user_key")


@query(f"WITH {_EVT_SPLIT} SELECT event_id, user_key, split FROM es")
def grouped_split_assign(spark, sf):
    return _evt_split(spark, sf).select("event_id", "user_key", "split")


@query(f"WITH {_EVT_SPLIT} SELECT CAST(i - 1 AS INTEGER) AS ordinal, name AS split, count(event_id) AS n FROM ends LEFT JOIN es ON name = split GROUP BY i, name")
def split_counts(spark, sf):
    return splits.split_counts(_evt_split(spark, sf))


@query(f"WITH {_EVT_SPLIT} SELECT split, subset AS value, count(*) AS n FROM es GROUP BY split, subset")
def split_field_counts(spark, sf):
    maps = splits.field_counts(_evt_split(spark, sf), "subset")
    return splits.added_maps(maps, "counts", ("split",))


@query(f"WITH {_EVT_SPLIT} SELECT subset AS value, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM es GROUP BY subset HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf):
    return splits.leaks(_evt_split(spark, sf), "subset").select("value", F.array_join("splits", ",").alias("splits"))


@query(
    f"""WITH e AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'bank' WHEN 2 THEN 'cal' ELSE 'unknown' END AS old FROM events)
    SELECT CAST(user_id AS VARCHAR) AS group_key, array_to_string(list_sort(list(DISTINCT old)), ',') AS splits, '{splits.CONFLICT_ACTION}' AS action FROM e WHERE old != 'unknown' GROUP BY user_id HAVING count(DISTINCT old) > 1"""
)
def split_conflicts(spark, sf):
    fifth = F.col("event_id") % 5
    e = evt(spark, sf).withColumn("old", F.when(fifth == 0, "test").when(fifth == 1, "bank").when(fifth == 2, "cal").otherwise("unknown"))
    return splits.split_conflicts(e, "user_key", "old").withColumn("splits", F.array_join("splits", ","))


@query("SELECT event_id, event_type AS subset FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 20")
def first_n_per_subset(spark, sf):
    return splits.first_n(evt(spark, sf).select("event_id", "subset"), ("subset",), 20, "event_id")


@query("SELECT event_id, event_type AS subset, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 128) AS BIGINT) AS shard FROM events")
def shard_chunks(spark, sf):
    return splits.chunked(evt(spark, sf).select("event_id", "subset"), ("subset",), 128, "event_id")


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT page_id, coalesce(nullif(ltrim(list_extract(regexp_extract_all(url, '([0-9]+)', 1), -1), '0'), ''), CASE WHEN regexp_matches(url, '[0-9]') THEN '0' ELSE '' END) AS image_id FROM pages")
def parse_image_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.image_id(F.col("url")).alias("image_id"))


@query(
    """WITH q AS (SELECT doc_id, 'Is there a ' || source || CASE doc_id % 3 WHEN 0 THEN ' Cat' WHEN 1 THEN '' ELSE ' in' END || ' in the image?' || CASE doc_id % 2 WHEN 0 THEN ' ' ELSE ' really' END AS question FROM documents)
    SELECT doc_id, coalesce(nullif(lower(regexp_extract(question, '(?i)^\\s*is there\\s+(?:a|an)\\s+(.+?)\\s+in the image\\?\\s*$', 1)), ''), 'unknown') AS object_name FROM q"""
)
def parse_object_name(spark, sf):
    third, half = F.col("doc_id") % 3, F.col("doc_id") % 2
    q = F.concat(F.lit("Is there a "), "source", F.when(third == 0, " Cat").when(third == 1, "").otherwise(" in"), F.lit(" in the image?"), F.when(half == 0, " ").otherwise(" really"))
    return table(spark, sf, "documents").select("doc_id", T.object_name(q).alias("object_name"))


@query("SELECT event_id, CASE WHEN lower(event_type) IN ('yes', 'y', '1', 'true', 'present') THEN 1 WHEN lower(event_type) IN ('no', 'n', '0', 'false', 'absent') THEN 0 WHEN user_id % 2 = 1 THEN 1 ELSE 0 END AS label FROM events")
def parse_yes_no_label(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.coalesce(T.yes_no_label(F.col("event_type")), T.yes_no_label((F.col("user_id") % 2).cast("string"))).alias("label"))


@query("SELECT conv_id, turn, CASE lower(regexp_extract(text, '(?i)\\b(de|la|the|no|yes)\\b', 1)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS answer FROM (SELECT conv_id, turn, regexp_replace(CASE turn % 3 WHEN 0 THEN 'No. ' WHEN 1 THEN 'Well, YES ' ELSE 'nothing ' END, ' $', '') AS text FROM conversations)")
def parse_yes_no_answer(spark, sf):
    third = F.col("turn") % 3
    said = F.when(third == 0, "No.").when(third == 1, "<think>Well</think>, YES").otherwise("nothing")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.response_answer(said).alias("answer"))


@query(
    """WITH q AS (SELECT conv_id, turn, trim(role || CASE turn % 2 WHEN 0 THEN '?' ELSE '' END) AS q FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(q, '[?.!]$') THEN q ELSE q || '.' END || ' Respond with only one word: yes or no.' AS question FROM q"""
)
def format_question(spark, sf):
    q = F.concat("role", F.when(F.col("turn") % 2 == 0, "?").otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.formatted_question(T.formatted_question(q)).alias("question"))


@query(
    """SELECT conv_id, turn, CASE WHEN w IS NULL OR w = '' THEN NULL WHEN lower(w) = 'yes' THEN 1 ELSE 0 END AS answer
    FROM (SELECT conv_id, turn, regexp_extract(replace(replace(text, '<think>', ' '), '</think>', ' '), '(?i)(?:^|[^\\pL\\pN_])(yes|no)(?:[^\\pL\\pN_]|$)', 1) AS w FROM conversations)"""
)
def parse_yes_no_answer_whole(spark, sf):
    """Of the whole texts, as those below that end in ``whole``."""
    return table(spark, sf, "conversations").select("conv_id", "turn", T.response_answer("text").alias("answer"))


@query(
    """WITH q AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text || CASE turn % 2 WHEN 0 THEN '?' ELSE '' END, ''), '^[\\pZ\\t-\\r\\x1c-\\x1f\\x{85}]+', ''), '[\\pZ\\t-\\r\\x1c-\\x1f\\x{85}]+$', '') AS q FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(lower(q), 'respond with only one word: yes or no.') THEN q ELSE CASE WHEN regexp_matches(q, '[?.!]$') THEN q ELSE q || '.' END || ' Respond with only one word: yes or no.' END AS question FROM q"""
)
def format_question_whole(spark, sf):
    q = F.concat("text", F.when(F.col("turn") % 2 == 0, "?").otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.formatted_question(T.formatted_question(q)).alias("question"))


@query("SELECT p_partkey, CAST(floor(CAST(p_size AS BIGINT) * CASE p_partkey % 3 WHEN 0 THEN 1000000 WHEN 1 THEN 1073741824 ELSE 1 END) AS BIGINT) AS bytes FROM part")
def byte_size(spark, sf):
    third = F.col("p_partkey") % 3
    size = F.concat(F.col("p_size").cast("string"), F.when(third == 0, " MB").when(third == 1, "GiB").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", T.byte_size(size).alias("bytes"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN n_chars % 2 = 0 THEN source ELSE ' ' END), ''), nullif(CASE WHEN n_chars % 3 = 0 THEN lang END, ''), '') AS first_text FROM documents")
def coalesce_aliases(spark, sf):
    a, b = F.when(F.col("n_chars") % 2 == 0, F.col("source")).otherwise(" "), F.when(F.col("n_chars") % 3 == 0, F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", T.first_text(a, b).alias("first_text"))


@query(
    """SELECT total, part, i, CAST(CASE WHEN n = 1 THEN floor((a + b) / 2) ELSE round_even(a + i * ((b - a) / CAST(n - 1 AS DOUBLE)), 0) END AS INTEGER) AS layer FROM (
        SELECT total, part, CASE part WHEN 'early' THEN 0 WHEN 'middle' THEN total // 4 WHEN 'late' THEN total // 2 ELSE 0 END AS a, CASE part WHEN 'early' THEN greatest(total // 2 - 1, 0) WHEN 'middle' THEN total - total // 4 - 1 ELSE total - 1 END AS b, n
        FROM (SELECT DISTINCT p_size + 7 AS total FROM part), (VALUES ('early'), ('middle'), ('late'), ('all')) p(part), (VALUES (1), (3), (5)) c(n)), range(5) r(i) WHERE i < n AND n = 5"""
)
def layer_ranges(spark, sf):
    totals = table(spark, sf, "part").select((F.col("p_size") + 7).alias("total")).distinct()
    out = []
    for part in ("early", "middle", "late", "all"):
        a, b = T.layer_bounds(F.col("total"), part)
        out.append(totals.select("total", F.lit(part).alias("part"), F.posexplode(T.spaced_layers(a, b, F.lit(5))).alias("i", "layer")).withColumn("i", F.col("i").cast("long")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT total, concat_ws(',', 0, total // 4, total // 2, 3 * total // 4, total - 1) AS layers FROM (SELECT DISTINCT p_size + 7 AS total FROM part)")
def quarter_layers(spark, sf):
    totals = table(spark, sf, "part").select((F.col("p_size") + 7).alias("total")).distinct()
    return totals.select("total", F.array_join(T.quarter_layers(F.col("total")), ",").alias("layers"))


# --- vectors ---------------------------------------------------------------------------------------------------------

_NORM = "sqrt(list_sum(list_transform({0}, lambda z: z * z)))"
_UNIT = "list_transform({0}, lambda q: q / greatest(sqrt(list_sum(list_transform({0}, lambda z: z * z))), 1e-12))"
_MEAN = f"list_transform(range(1, {LAYERS + 1}), lambda j: list_sum(list_transform({{0}}, lambda r: r[j])) / {LAYERS})"


def _representation_sql() -> str:
    each = {
        "Raw-Static": ("v0", "layers[-1]"),
        "Sphere-Static": ("v0", _UNIT.format("layers[-1]")),
        "Norm-Static": ("v0", "[ln(greatest(" + _NORM.format("layers[-1]") + ", 1e-12))]"),
        "Raw-Traj-MeanPool": ("v0", _MEAN.format("layers")),
        "Sphere-Traj-MeanPool": ("pooled", _UNIT.format("m")),
        "Norm-Traj": ("v0", "list_transform(layers, lambda r: ln(greatest(sqrt(list_sum(list_transform(r, lambda z: z * z))), 1e-12)))"),
    }
    units = "list_transform(layers, lambda r: list_transform(r, lambda q: q / greatest(sqrt(list_sum(list_transform(r, lambda z: z * z))), 1e-12)))"
    parts = [f"SELECT vec_id, '{name}' AS variant, generate_subscripts({e}, 1) - 1 AS i, round(unnest({e}), 6) AS x FROM {src}" for name, (src, e) in each.items()]
    return f"WITH {VEC}, v0 AS (SELECT * FROM vec), units AS (SELECT vec_id, {units} AS u FROM vec), pooled AS (SELECT vec_id, {_MEAN.format('u')} AS m FROM units) " + " UNION ALL ".join(parts)


@query(_representation_sql())
def representations(spark, sf):
    long = vectors.representations(vec(spark, sf), "vec_id", "layers")
    return long.select("vec_id", "variant", F.posexplode("vector").alias("i", "x")).select("vec_id", "variant", F.col("i").cast("long").alias("i"), six("x").alias("x"))


_ORDER = vectors.layer_permutation(LAYERS)


@query(
    f"""WITH {VEC}, t AS (SELECT vec_id, list_transform({_ORDER}, lambda i: layers[i + 1]) AS l FROM vec), u AS (SELECT vec_id, list_transform(l, lambda r: list_transform(r, lambda q: q / greatest(sqrt(list_sum(list_transform(r, lambda z: z * z))), 1e-12))) AS l FROM t)
    SELECT vec_id, generate_subscripts(flatten(l), 1) - 1 AS i, round(unnest(flatten(l)), 6) AS x FROM u"""
)
def lstm_trajectory(spark, sf):
    t = vec(spark, sf).select("vec_id", F.flatten(vectors.trajectory(F.col("layers"), _ORDER)).alias("l"))
    return t.select("vec_id", F.posexplode("l").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), six("x").alias("x"))


def _knn_sql(distance: str) -> str:
    return f"""WITH {VEC}, d AS (SELECT q.vec_id, {distance} AS d FROM vec q CROSS JOIN vec b WHERE b.y = 1)
    SELECT vec_id, round(avg(d), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS rn FROM d) WHERE rn <= 10 GROUP BY vec_id"""


@query(_knn_sql("list_distance(q.v, b.v)"))
def knn_euclidean(spark, sf):
    e = vec(spark, sf)
    return rounded(vectors.knn_scores(e.where("y = 1"), e, key="vec_id", vector="v"))


@query(_knn_sql(f"acos(least(1.0, greatest(-1.0, list_inner_product(q.v, b.v) / ({_NORM.format('q.v')} * {_NORM.format('b.v')})))) / pi()").replace("avg(d), 6", "avg(d), 5"))
def knn_angular(spark, sf):
    e = vec(spark, sf)
    return vectors.knn_scores(e.where("y = 1"), e, key="vec_id", vector="v", metric="angular").select("vec_id", F.round("score", 5).alias("score"))


@query(
    f"""WITH {VEC}, l AS (SELECT vec_id, y, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM vec), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM l WHERE y = 1 GROUP BY i)
    SELECT vec_id, i, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS z FROM l JOIN s USING (i)"""
)
def standard_scale(spark, sf):
    z = vectors.standard_scaled(vec(spark, sf), "v", F.col("y") == 1)
    return z.select("vec_id", F.posexplode("v").alias("i", "z")).select("vec_id", F.col("i").cast("long").alias("i"), six("z").alias("z"))


@query(f"WITH {VEC} SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'layer count differs,selected_layers must be contiguous from 0' ELSE '' END AS errors FROM vec")
def vector_validity(spark, sf):
    want = F.when(F.col("label") % 3 == 0, 9).otherwise(8)
    e = quality.layer_vector_errors(F.col("layers"), F.sequence(F.lit(0), F.lit(7)), want)
    return vec(spark, sf).select("vec_id", F.array_join(e, ",").alias("errors"))


@query(
    """WITH w AS (SELECT conv_id, turn, [ascii(c) for c in string_split(role, '')] AS t, CASE WHEN turn % 2 = 0 THEN [101, 114] ELSE [115] END AS p FROM conversations)
    SELECT conv_id, turn, CAST(CASE WHEN len(p) = 2 THEN instr(role_text, 'er') ELSE instr(role_text, 's') END AS INTEGER) - 1 AS start FROM (SELECT *, array_to_string([chr(x) for x in t], '') AS role_text FROM w) WHERE CASE WHEN len(p) = 2 THEN instr(role_text, 'er') ELSE instr(role_text, 's') END > 0"""
)
def subsequence_find(spark, sf):
    tokens = F.transform(F.split("role", ""), F.ascii)
    part = F.when(F.col("turn") % 2 == 0, F.array(F.lit(101), F.lit(114))).otherwise(F.array(F.lit(115)))
    return table(spark, sf, "conversations").select("conv_id", "turn", vectors.subsequence_start(tokens, part).alias("start")).where("start is not null")


@query(
    """SELECT conv_id, turn, role || repeat('_', greatest(CAST(12 - length(role) AS INTEGER), 0)) AS padded, CAST(length(role) - 1 AS BIGINT) AS last, CAST(instr(role, 's') AS INTEGER) - 1 AS span_start, CAST(length(role) - instr(reverse(role), 's') AS INTEGER) AS span_stop
    FROM conversations WHERE instr(role, 's') > 0"""
)
def pad_and_spans(spark, sf):
    chars = F.split("role", "")
    mask = F.concat(F.transform(chars, lambda _: F.lit(1)), F.array(F.lit(0)))
    span = vectors.token_span(F.transform(chars, F.ascii), 115)
    pad = F.array_join(vectors.padded(chars, F.lit(12), F.lit("_")), "")
    return table(spark, sf, "conversations").select("conv_id", "turn", pad.alias("padded"), vectors.last_nonzero(mask).alias("last"), span["start"].alias("span_start"), span["stop"].alias("span_stop")).where("span_start is not null")


@query(
    """SELECT conv_id, turn, CAST(instr(text, CASE WHEN turn % 2 = 0 THEN 'er' ELSE 's' END) AS INTEGER) - 1 AS start
    FROM conversations WHERE instr(text, CASE WHEN turn % 2 = 0 THEN 'er' ELSE 's' END) > 0"""
)
def subsequence_find_whole(spark, sf):
    tokens = F.transform(F.split("text", ""), F.ascii)
    part = F.when(F.col("turn") % 2 == 0, F.array(F.lit(101), F.lit(114))).otherwise(F.array(F.lit(115)))
    return table(spark, sf, "conversations").select("conv_id", "turn", vectors.subsequence_start(tokens, part).alias("start")).where("start is not null")


@query(
    """SELECT conv_id, turn, text || repeat('_', greatest(CAST(1024 - length(text) AS INTEGER), 0)) AS padded, CAST(length(text) - 1 AS BIGINT) AS last, CAST(instr(text, 's') AS INTEGER) - 1 AS span_start, CAST(length(regexp_replace(text, '[^s]*$', '')) - 1 AS INTEGER) AS span_stop
    FROM conversations WHERE instr(text, 's') > 0"""
)
def pad_and_spans_whole(spark, sf):
    """Texts longer than the padding stay whole."""
    chars = F.split("text", "")
    mask = F.concat(F.transform(chars, lambda _: F.lit(1)), F.array(F.lit(0)))
    span = vectors.token_span(F.transform(chars, F.ascii), 115)
    pad = F.array_join(vectors.padded(chars, F.lit(1024), F.lit("_")), "")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", pad.alias("padded"), vectors.last_nonzero(mask).alias("last"), span.alias("span")).where("span is not null")
    return rows.select("conv_id", "turn", "padded", "last", F.col("span.start").alias("span_start"), F.col("span.stop").alias("span_stop"))


# --- metrics and gates -----------------------------------------------------------------------------------------------

_METRIC_COLUMNS = "num_samples, num_positive, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(average_precision, 6) AS average_precision, metric_status, round(tpr_at_fpr, 6) AS tpr_at_fpr, round(fpr_at_tpr, 6) AS fpr_at_tpr"


@query(f"WITH {EVT}, {curve_sql('evt', 'subset')} SELECT subset, {_METRIC_COLUMNS} FROM areas")
def metrics_by_subset(spark, sf):
    return rounded(metrics.ranking_metrics(evt(spark, sf), ("subset",)).drop("failure_reason"))


@query(f"WITH {EVT}, e AS (SELECT 0 AS one, y, score FROM evt), {curve_sql('e', 'one')} SELECT {_METRIC_COLUMNS} FROM areas")
def ranking_metrics(spark, sf):
    return rounded(metrics.ranking_metrics(evt(spark, sf)).drop("failure_reason"))


@query(
    f"""WITH {EVT}, c AS (SELECT subset, count(*) FILTER (score >= 50 AND y = 1) AS tp, count(*) FILTER (score >= 50 AND y = 0) AS fp, count(*) FILTER (score < 50 AND y = 1) AS fn, count(*) FILTER (score < 50 AND y = 0) AS tn FROM evt GROUP BY subset),
    r AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS p, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS r, coalesce(tn / nullif(CAST(fp + tn AS DOUBLE), 0), 0) AS s FROM c)
    SELECT subset, tp + fp + fn + tn AS num_samples, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN round((r + s) / 2, 6) END AS balanced_accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
    round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0), 6) AS false_positive_rate FROM r"""
)
def threshold_metrics(spark, sf):
    return rounded(metrics.threshold_metrics(evt(spark, sf), ("subset",), threshold=50))


def _scored(spark, sf):
    """Labelled documents with a score, split by group; the whole grid of scopes."""
    d = docs(spark, sf).where("label is not null").select("doc_id", "bucket", "subset", F.col("label").alias("y"), F.col("n_chars").cast("double").alias("score"))
    return splits.grouped_split(d, "bucket")


_SCORED = f"{DOCS}, lab AS (SELECT doc_id, bucket, subset, label AS y, CAST(n_chars AS DOUBLE) AS score FROM docs WHERE label IS NOT NULL), {split_sql('lab', 'bucket')}, scored AS (SELECT lab.*, split FROM lab JOIN named ON bucket = key_text)"
_SCOPES = "scopes AS (SELECT split AS eval_split, 'pooled' AS eval_scope, y, score FROM scored UNION ALL SELECT split, subset, y, score FROM scored WHERE split = 'test')"


@query(
    f"""WITH {_SCORED}, {_SCOPES}, {curve_sql('scopes', 'eval_split, eval_scope')}, grid AS (SELECT name AS eval_split, 'pooled' AS eval_scope FROM ends UNION ALL SELECT 'test', subset FROM (SELECT DISTINCT subset FROM lab) UNION ALL SELECT 'test', 'nowhere')
    SELECT eval_split, eval_scope, coalesce(num_samples, 0) AS num_samples, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, coalesce(metric_status, 'undefined') AS metric_status,
        CASE WHEN metric_status IS NULL THEN 'no samples in evaluation scope' WHEN metric_status = 'undefined' THEN 'one class present in evaluation scope' END AS failure_reason FROM grid LEFT JOIN areas USING (eval_split, eval_scope)"""
)
def metric_scope_grid(spark, sf):
    s = _scored(spark, sf)
    keys = ("eval_split", "eval_scope")
    pooled = spark.createDataFrame([(n, "pooled") for n in splits.NAMES] + [("test", "nowhere")], "eval_split string, eval_scope string")
    grid = pooled.unionByName(s.select(F.lit("test").alias("eval_split"), F.col("subset").alias("eval_scope")).distinct())
    out = metrics.metric_grid(grid, metrics.ranking_metrics(metrics.scope_rows(s), keys), keys)
    return rounded(out.select(*keys, "num_samples", "roc_auc", "pr_auc", "metric_status", "failure_reason"))


REPLICATES, WHOLE_REPLICATES = 40, 1000


def _bootstrap_sql(replicates: int, most: int = 12) -> str:
    step, p, total = [], 0.36787944117144233, 0.36787944117144233
    for k in range(1, most + 1):
        step.append(f"CAST(u >= CAST({total!r} AS DOUBLE) AS INTEGER)")
        p /= k
        total += p
    drawn = f"""{DOCS}, lab AS (SELECT doc_id, subset, label AS y, CAST(n_chars AS DOUBLE) AS score FROM docs WHERE label IS NOT NULL),
        h AS (SELECT subset, y, score, rep, CAST(('0x' || md5('20260506:' || rep || ':' || doc_id)[1:8]) AS BIGINT) / 4294967296.0 AS u FROM lab, range({replicates}) r(rep)),
        w AS (SELECT subset, rep, y, score, {' + '.join(step)} AS w FROM h), many AS (SELECT subset, rep, y, score FROM w, range({most + 1}) r(k) WHERE k < w)"""
    return f"""WITH {drawn}, {curve_sql('many', 'subset, rep')} SELECT subset, count(*) AS num_bootstrap, round(avg(roc_auc), 6) AS roc_auc_mean, round(quantile_cont(roc_auc, 0.025), 6) AS roc_auc_ci_low, round(quantile_cont(roc_auc, 0.975), 6) AS roc_auc_ci_high,
        round(avg(pr_auc), 6) AS pr_auc_mean, round(quantile_cont(pr_auc, 0.025), 6) AS pr_auc_ci_low, round(quantile_cont(pr_auc, 0.975), 6) AS pr_auc_ci_high FROM areas WHERE metric_status = 'ok' GROUP BY subset"""


def _bootstrap(spark, sf, replicates):
    d = docs(spark, sf).where("label is not null").select("doc_id", "subset", F.col("label").alias("y"), F.col("n_chars").cast("double").alias("score"))
    return rounded(metrics.bootstrap_intervals(d, ("subset",), key="doc_id", replicates=replicates))


@query(_bootstrap_sql(REPLICATES))
def bootstrap_ci(spark, sf):
    return _bootstrap(spark, sf, REPLICATES)


@query(_bootstrap_sql(WHOLE_REPLICATES))
def bootstrap_ci_whole(spark, sf):
    """With the reference's number of replicates."""
    return _bootstrap(spark, sf, WHOLE_REPLICATES)


@query()
def bootstrap_exact(spark, sf):
    """Exactly as many draws as rows in every replicate, and a metric of one's own among the others."""
    d = docs(spark, sf).where("label is not null").select("subset", F.col("label").alias("y"), F.col("n_chars").cast("double").alias("score"))
    return rounded(bootstrap.intervals(d, ("subset",), metrics=bootstrap.BOTH | {"average_precision": bootstrap.average_precision}))


@query(f"WITH {EVT}, {curve_sql('evt', 'subset')} SELECT subset, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(average_precision, 6) AS average_precision FROM areas")
def custom_metrics(spark, sf):
    return rounded(bootstrap.metric_values(evt(spark, sf), ("subset",), metrics=bootstrap.BOTH | {"average_precision": bootstrap.average_precision}))


def _variant_metrics(spark, sf):
    """A metric table for the gates: the knn score against the bank of each untrained variant, by two readouts."""
    rows = vectors.representations(vec(spark, sf), "vec_id", "layers").select("vec_id", "variant", F.element_at("vector", 1).alias("a"), F.element_at("vector", -1).alias("b"))
    rows = rows.join(vec(spark, sf).select("vec_id", "y"), "vec_id")
    each = rows.select("variant", "y", F.explode(F.array(F.struct(F.lit("classifier").alias("readout"), six("a").alias("score")), F.struct(F.lit("knn").alias("readout"), six("b").alias("score")))).alias("s")).select("variant", "y", "s.*")
    m = metrics.ranking_metrics(each, ("variant", "readout")).select("variant", "readout", "pr_auc", "roc_auc")
    return m.select(F.lit("test").alias("eval_split"), F.lit("pooled").alias("eval_scope"), "*")


def _gate_sql(tail: str) -> str:
    reps = _representation_sql()
    return f"""WITH reps AS ({reps}), ends_of AS (SELECT vec_id, variant, arg_min(x, i) AS a, arg_max(x, i) AS b FROM reps GROUP BY ALL), lab AS (SELECT e.*, CAST(label >= 5 AS INTEGER) AS y FROM ends_of e JOIN embeddings USING (vec_id)),
    each AS (SELECT variant, 'classifier' AS readout, y, a AS score FROM lab UNION ALL SELECT variant, 'knn', y, b FROM lab), {curve_sql('each', 'variant, readout')}, m AS (SELECT variant, readout, pr_auc, roc_auc FROM areas) {tail}"""


def _pair_sql(pairs, drop: float) -> str:
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f""", d AS (SELECT p.a, p.b, x.readout, x.pr_auc - z.pr_auc AS pr, x.roc_auc - z.roc_auc AS roc FROM (VALUES {values}) p(a, b) JOIN m x ON x.variant = p.a JOIN m z ON z.variant = p.b AND z.readout = x.readout),
    t AS (SELECT count(*) AS total_comparisons, count(*) FILTER (pr >= 0.01 AND roc >= -{drop}) AS successes, count(DISTINCT readout) FILTER (pr >= 0.01 AND roc >= -{drop}) AS readouts, count(*) FILTER (pr < 0 AND roc < 0) AS worse FROM d)
    SELECT CASE WHEN readouts > 1 THEN 'pass' WHEN readouts = 1 THEN 'mixed' WHEN total_comparisons > 0 AND worse = total_comparisons THEN 'fail' ELSE 'mixed' END AS status, successes, total_comparisons FROM t"""


@query(_gate_sql("SELECT variant, readout, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM m"))
def variant_metrics(spark, sf):
    return rounded(_variant_metrics(spark, sf).drop("eval_split", "eval_scope"))


@query(_gate_sql(_pair_sql(gates.SPHERE, 0.02)))
def sphere_gate(spark, sf):
    return gates.pair_gate(_variant_metrics(spark, sf), gates.SPHERE, max_roc_drop=0.02)


@query(_gate_sql(_pair_sql(gates.TRAJECTORY, 0.05)))
def trajectory_gate(spark, sf):
    return gates.pair_gate(_variant_metrics(spark, sf), gates.TRAJECTORY, max_roc_drop=0.05)


@query(_gate_sql("SELECT CASE WHEN max(pr_auc) FILTER (variant LIKE 'Norm-%') >= 0.9 * max(pr_auc) FILTER (variant NOT LIKE 'Norm-%') THEN 'strong' ELSE 'weak' END AS status, round(max(pr_auc) FILTER (variant LIKE 'Norm-%'), 6) AS best_norm_pr_auc, round(max(pr_auc) FILTER (variant NOT LIKE 'Norm-%'), 6) AS best_non_norm_pr_auc FROM m"))
def norm_gate(spark, sf):
    return rounded(gates.norm_gate(_variant_metrics(spark, sf)))


# --- models, scorers, streams: no SQL, or none needed ------------------------------------------------------------------


def _model_gates_sql() -> str:
    parts = []
    for name, pairs, drop in (("sphere_g", gates.SPHERE, 0.02), ("traj_g", gates.TRAJECTORY, 0.05)):
        values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
        parts.append(f"""d{name} AS (SELECT x.readout, x.pr_auc - z.pr_auc AS pr, x.roc_auc - z.roc_auc AS roc FROM (VALUES {values}) p(a, b) JOIN m x ON x.variant = p.a JOIN m z ON z.variant = p.b AND z.readout = x.readout),
        c{name} AS (SELECT count(*) AS n, count(DISTINCT readout) FILTER (pr >= 0.01 AND roc >= -{drop}) AS won, count(*) FILTER (pr < 0 AND roc < 0) AS worse FROM d{name}),
        {name} AS (SELECT CASE WHEN won > 1 THEN 'pass' WHEN won = 1 THEN 'mixed' WHEN n > 0 AND worse = n THEN 'fail' ELSE 'mixed' END AS status FROM c{name})""")
    norm = "SELECT CASE WHEN max(pr_auc) FILTER (variant LIKE 'Norm-%') >= 0.9 * max(pr_auc) FILTER (variant NOT LIKE 'Norm-%') THEN 'strong' ELSE 'weak' END AS status FROM m"
    return _gate_sql(f""", {parts[0]}, {parts[1]}, k AS ({norm})
    SELECT sphere_g.status AS sphere, traj_g.status AS trajectory, k.status AS norm, CASE WHEN sphere_g.status = 'pass' AND traj_g.status = 'pass' THEN 'pass'
        WHEN (sphere_g.status, traj_g.status) IN (('pass', 'mixed'), ('mixed', 'pass')) THEN 'mixed_positive' ELSE 'fail' END AS overall_decision FROM sphere_g, traj_g, k""")


@query(_model_gates_sql())
def model_gates(spark, sf):
    return gates.model_gates(_variant_metrics(spark, sf))


@query()
def logistic_scores(spark, sf):
    return rounded(scoring.logistic_scores(vec(spark, sf).withColumn("t", F.col("vec_id") % 2 == 0), key="vec_id", vector="v", label="y", train="t"))


@query("SELECT conv_id, turn, CASE WHEN length(role) % 2 = 0 THEN 1 ELSE 0 END AS answer FROM conversations")
def scorer_answers(spark, sf):
    asked = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("question"))
    return scoring.answered(asked, scoring.stub_scorer).select("conv_id", "turn", T.yes_no_answer("answer_text").alias("answer"))


@query("SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN 1 ELSE 0 END AS answer FROM conversations")
def scorer_answers_whole(spark, sf):
    asked = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return scoring.answered(asked, scoring.stub_scorer).select("conv_id", "turn", T.yes_no_answer("answer_text").alias("answer"))


@query("SELECT CASE WHEN quality IS NULL OR quality NOT IN (0, 1) THEN 'invalid_label' WHEN toxic IS NULL THEN 'parsed_none' WHEN toxic = quality THEN 'correct' WHEN quality = 0 THEN 'hard_hallucination' ELSE 'false_negative_error' END AS class, count(*) AS n FROM labels GROUP BY ALL")
def population_stream(spark, sf):
    """Counts kept by a stream over the files there are."""
    return answers.latest_counts(spark, f"{sf}/labels.parquet", label="quality", parsed="toxic")


# --- walks, paths, tokens, manifests, caches ---------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, text FROM conversations)
    SELECT conv_id, 'conv' AS path, 'BIGINT' AS type, CAST(conv_id AS VARCHAR) AS leaf FROM t GROUP BY conv_id
    UNION ALL SELECT conv_id, 'turns[' || i || '].role', CASE WHEN role IS NULL THEN 'VOID' ELSE 'STRING' END, coalesce('"' || role || '"', 'null') FROM t
    UNION ALL SELECT conv_id, 'turns[' || i || '].size.chars', 'BIGINT', CAST(length(coalesce(text, '')) AS VARCHAR) FROM t
    UNION ALL SELECT conv_id, 'turns[' || i || '].size.ends[' || k || ']', 'BIGINT', CAST(k * length(coalesce(text, '')) AS VARCHAR) FROM t, range(2) r(k)"""
)
def json_leaves(spark, sf):
    """What conversations hold as nested JSON, walked level by level."""
    chars = F.length(F.coalesce("text", F.lit("")))
    turn = F.struct("turn", "role", "text", F.struct(chars.alias("chars"), F.array(F.lit(0), chars).alias("ends")).alias("size"))
    each = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    doc = F.to_json(F.struct(F.col("conv_id").alias("conv"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["size"].alias("size"))).alias("turns")), {"ignoreNullFields": "false"})
    return walk.leaves(each.select("conv_id", F.parse_json(doc).alias("doc")), "doc", ("conv_id",))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS BIGINT) AS k, [CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS BIGINT), user_id] AS numbers FROM events")
def json_lookups(spark, sf):
    """The first of several paths that is there, and a strict list of integers."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.parse_json("props").alias("p"))
    k = walk.first_at(F.col("p"), "$.config.k", "$.key", "$.k", kind="long")
    listed = F.parse_json(F.concat(F.lit("["), k.cast("string"), F.lit(', "'), F.col("user_id").cast("string"), F.lit('"]')))
    return e.select("event_id", k.alias("k"), walk.int_list(listed).alias("numbers"))


_CANONICAL = """WITH RECURSIVE p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    s AS (SELECT page_id, path, string_split(CASE WHEN page_id % 3 = 0 THEN path || '/../x//./y' WHEN page_id % 3 = 1 THEN '../../' || path ELSE 'fr/' || path END, '/') AS parts FROM p),
    w AS (SELECT page_id, parts, 1 AS k, CASE WHEN page_id % 3 = 0 THEN '' ELSE '/en' END AS acc FROM s
        UNION ALL SELECT page_id, parts, k + 1, CASE WHEN parts[k] IN ('', '.') THEN acc WHEN parts[k] = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || parts[k] END FROM w WHERE k <= len(parts)),
    c AS (SELECT page_id, CASE WHEN acc = '' THEN '/' ELSE acc END AS path FROM w WHERE k = len(parts) + 1)"""


@query(f"{_CANONICAL} SELECT page_id, path, path = '/en' OR path LIKE '/en/%' AS inside FROM c")
def canonical_paths(spark, sf):
    """Paths of URLs, some made to leave their root, as canonical paths and whether they stay under it."""
    path = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://[^/?#]*([^?#]*)", 1)
    odd = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), path, F.lit("/../x//./y"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("../../"), path)).otherwise(F.concat(F.lit("fr/"), path))
    return table(spark, sf, "pages").select("page_id", paths.resolved(odd, "/en").alias("path"), paths.is_under(odd, "/en").alias("inside"))


_NAMED = "n AS (SELECT CAST(conv_id AS VARCHAR) || ':' || turn AS key, text, substr(text, length(text) // 3 + 1, 9) AS name FROM conversations WHERE length(text) > 0)"


@query(
    f"""WITH {_NAMED}, s AS (SELECT key, name, instr(lower(text), lower(name)) - 1 AS start FROM n), u AS (SELECT key, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), 1) - 1 AS k FROM n),
    o AS (SELECT key, k, length(w) AS id, sum(length(w)) OVER (PARTITION BY key ORDER BY k) AS stop FROM u)
    SELECT s.key, s.start, s.start + length(name) AS stop, min(k) AS first, max(k) AS last, list(id ORDER BY k) AS ids FROM s JOIN o ON s.key = o.key AND o.stop - o.id < s.start + length(name) AND o.stop > s.start GROUP BY ALL"""
)
def token_spans(spark, sf):
    """The tokens of a name's place in each text; a token's id is its length here."""
    rows = table(spark, sf, "conversations").where("length(text) > 0").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text", F.substr("text", F.floor(F.length("text") / 3).cast("int") + 1, F.lit(9)).alias("name"))
    pieces = rows.select("key", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+|[^A-Za-z]+)"))).alias("at", "w"))
    stop = F.sum(F.length("w")).over(W.partitionBy("key").orderBy("at"))  # of one text
    offsets = pieces.select("key", "at", F.length("w").cast("long").alias("id"), stop.alias("stop")).withColumn("start", F.col("stop") - F.col("id"))
    spans = rows.select("key", tokens.name_span(F.col("text"), F.lit(""), F.col("name")).alias("s")).select("key", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))
    return tokens.token_spans(offsets, spans, "key").select("key", "start", "stop", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "ids")


@query(
    """WITH r AS (SELECT conv_id, turn, [[length(w) FOR w IN string_split(s, ' ')] FOR s IN string_split(coalesce(text, ''), '.')] AS v FROM conversations),
    b AS (SELECT conv_id, max(len(v)) AS h, max(list_max([len(x) FOR x IN v])) AS w FROM r GROUP BY conv_id)
    SELECT conv_id, turn, h AS rows, w AS columns, array_to_string([array_to_string(list_resize(x, w, -1), ',') FOR x IN list_resize(v, h, [])], ';') AS padded FROM r JOIN b USING (conv_id)"""
)
def padded_batches(spark, sf):
    """Word lengths by sentence, ragged in two dimensions, filled up with -1 to the shape of their conversation."""
    words = F.transform(F.split(F.coalesce("text", F.lit("")), "\\."), lambda s: F.transform(F.split(s, " "), F.length))
    out = tokens.collated(table(spark, sf, "conversations").select("conv_id", "turn", words.alias("v")), ("conv_id",), {"v": F.lit(-1)})
    text = F.array_join(F.transform("v", lambda x: F.array_join(x.cast("array<string>"), ",")), ";")
    return out.select("conv_id", "turn", F.size("v").cast("long").alias("rows"), F.size(F.get("v", F.lit(0))).cast("long").alias("columns"), text.alias("padded"))


def _assigned(spark, sf):
    d = docs(spark, sf).where("label is not null").select("bucket", "dataset_name", "subset", "sample_id", "label", F.concat(F.lit("o"), (F.col("n_chars") % 5).cast("string")).alias("object_name"), F.col("bucket").alias("image_id"))
    return splits.grouped_split(d, "bucket")


_ASSIGNED = f"{DOCS}, lab AS (SELECT dataset_name, subset, sample_id, bucket, bucket AS image_id, label, 'o' || n_chars % 5 AS object_name FROM docs WHERE label IS NOT NULL), {split_sql('lab', 'bucket')}, assigned AS (SELECT lab.*, split FROM lab JOIN named ON bucket = key_text)"


@query(
    f"""WITH {_ASSIGNED}, f AS (SELECT split, 'label' AS field, CAST(label AS VARCHAR) AS value FROM assigned UNION ALL SELECT split, 'object_name', object_name FROM assigned)
    SELECT split, field, value, count(*) AS n FROM f GROUP BY ALL"""
)
def nested_split_totals(spark, sf):
    """Manifests of all datasets and subsets, and their maps of counts added up."""
    m = splits.manifests(_assigned(spark, sf))
    each = [splits.nested_totals(m, f"{f}_counts_per_split").select(F.lit(f).alias("field"), F.explode(f"{f}_counts_per_split").alias("split", "c")).select("split", "field", F.explode("c").alias("value", "n")) for f in ("label", "object_name")]
    return each[0].unionByName(each[1])


@query(
    f"""WITH {_ASSIGNED}, c AS (SELECT dataset_name, subset, split, count(*) AS n FROM assigned GROUP BY ALL), g AS (SELECT DISTINCT dataset_name, subset FROM assigned),
    s AS (SELECT dataset_name, subset, object_name FROM assigned GROUP BY ALL HAVING count(DISTINCT split) > 1)
    SELECT g.dataset_name, g.subset, ends.name AS split, coalesce(n, 0) AS n, true AS image_valid, (SELECT count(*) FROM s WHERE s.dataset_name = g.dataset_name AND s.subset = g.subset) = 0 AS object_valid
    FROM g CROSS JOIN ends LEFT JOIN c ON c.dataset_name = g.dataset_name AND c.subset = g.subset AND c.split = ends.name"""
)
def split_manifests(spark, sf):
    m = splits.manifests(_assigned(spark, sf), keys=("image_id", "object_name"))
    return m.select("dataset_name", "subset", F.explode("counts_per_split").alias("split", "n"), F.col("image_id_overlap_validation.valid").alias("image_valid"), F.col("object_name_overlap_validation.valid").alias("object_valid"))


@query(
    f"""WITH {_ASSIGNED}, s AS (SELECT dataset_name || '/' || subset AS label, object_name FROM assigned GROUP BY dataset_name, subset, object_name HAVING count(DISTINCT split) > 1)
    SELECT (SELECT count(*) FROM s) = 0 AS valid, (SELECT count(DISTINCT label) FROM s) AS overlapping, (SELECT count(DISTINCT dataset_name || '/' || subset) FROM assigned) AS datasets"""
)
def overlap_of_manifests(spark, sf):
    m = splits.manifests(_assigned(spark, sf), keys=("object_name",))
    return splits.overlap_summary(m, "object_name_overlap_validation").select("valid", F.size("overlaps").cast("long").alias("overlapping"), F.size("per_dataset").cast("long").alias("datasets"))


@query(f"WITH {_ASSIGNED} SELECT sample_id, split FROM assigned")
def must_match_splits(spark, sf):
    """Each labelled document with the split that a table of assignments has for it."""
    a = _assigned(spark, sf)
    keys = ("dataset_name", "subset", "sample_id")
    return reconcile.must_match(a.select(*keys), splits.assignment_rows(a), keys, ("split",), what="split").select("sample_id", "split")


SHARD_ROWS = 64


def _cache(spark, sf):
    """Embeddings as entries of shards, with some sidecars and entries at odds: a count too high, another model's rows, a layer too many."""
    e = table(spark, sf, "embeddings").withColumn("shard", F.floor(F.col("vec_id") / SHARD_ROWS))
    v = F.col("embedding").cast("array<float>")
    layers = F.array(*[F.slice(v, k * 8 + 1, 8) for k in range(8)])
    text = lambda x: F.lit(x)
    path = F.format_string("shard-%05d", F.col("shard"))
    entries = e.select(
        path.alias("shard_path"), "vec_id", text("pope").alias("dataset_name"), text("pope").alias("source_dataset"), text("popular").alias("subset"), text("val").alias("split"), F.col("vec_id").cast("string").alias("sample_id"),
        F.when(F.col("vec_id") % 50 == 0, "other").otherwise("tiny").alias("model_name"), F.col("vec_id").cast("string").alias("image_id"), text("p").alias("image_path"), text("q").alias("question"), (F.col("label") % 2).alias("label"),
        text("o").alias("object_name"), text("yes").alias("answer_text"), F.lit(1).alias("parsed_answer"), F.array(F.lit(0.5)).alias("first_token_logits"), F.when(F.col("vec_id") % 70 == 0, F.concat(layers, F.array(F.slice(v, 1, 8)))).otherwise(layers).alias("layer_vectors"),
    )
    sizes = e.groupBy("shard").agg(F.count("*").alias("n"))
    said = F.struct(*(F.lit("x").alias(c) for c in cache_checks.SIDECAR_FIELDS if c not in ("model_name", "dataset_name", "source_dataset", "subset", "split", "total_layers", "selected_layers", "num_selected_layers", "hidden_dim", "num_entries")), text("tiny").alias("model_name"), text("pope").alias("dataset_name"), text("pope").alias("source_dataset"), text("popular").alias("subset"), text("val").alias("split"), F.lit(8).alias("total_layers"), F.sequence(F.lit(0), F.lit(7)).alias("selected_layers"), F.lit(8).alias("num_selected_layers"), F.lit(8).alias("hidden_dim"), (F.col("n") + (F.col("shard") % 3 == 1).cast("int")).alias("num_entries"))
    side = sizes.select(path.alias("shard_path"), F.parse_json(F.to_json(said)).alias("side"))
    return entries, side.select("shard_path", *cache_checks.sidecar_columns(F.col("side")))


_SHARDS = f"""WITH e AS (SELECT vec_id, vec_id // {SHARD_ROWS} AS shard, row_number() OVER (PARTITION BY vec_id // {SHARD_ROWS} ORDER BY vec_id) - 1 AS k FROM embeddings),
    m AS (SELECT shard, k * 2 AS o, 'entry ' || k || ' model_name=other does not match sidecar model_name=tiny' AS msg FROM e WHERE vec_id % 50 = 0 UNION ALL SELECT shard, k * 2 + 1, 'entry ' || k || ' layer_vectors.shape[0]=9 does not match num_selected_layers=8' FROM e WHERE vec_id % 70 = 0
        UNION ALL SELECT shard, -1, 'sidecar num_entries=' || count(*) + 1 || ' does not match payload length ' || count(*) FROM e WHERE shard % 3 = 1 GROUP BY shard),
    g AS (SELECT shard, string_agg(msg, '; ' ORDER BY o) AS errors FROM m GROUP BY shard), s AS (SELECT shard, count(*) AS n FROM e GROUP BY shard)"""


@query(f"{_SHARDS} SELECT 'shard-' || lpad(CAST(s.shard AS VARCHAR), 5, '0') AS path, CASE WHEN errors IS NULL THEN 'passed' ELSE 'failed' END AS status, n AS num_entries, CAST(8 AS BIGINT) AS hidden_dim, coalesce(errors, '') AS errors FROM s LEFT JOIN g USING (shard)")
def cache_shards(spark, sf):
    shards, _, _ = cache_checks.validated(*_cache(spark, sf), order="vec_id", expected={"model_name": "tiny", "split": "val"})
    return shards.select("path", "status", "num_entries", "hidden_dim", F.array_join("errors", "; ").alias("errors"))


@query(f"{_SHARDS} SELECT CASE WHEN (SELECT count(*) FROM m) = 0 THEN 'passed' ELSE 'failed' END AS status, (SELECT count(*) FROM s) AS num_shards, (SELECT count(*) FROM e) AS total_entries, (SELECT count(*) FROM m) AS num_errors, CAST(0 AS BIGINT) AS num_duplicate_keys")
def cache_summary(spark, sf):
    return cache_checks.validated(*_cache(spark, sf), order="vec_id")[2]


@query()
def variant_experiment(spark, sf):
    """All untrained variants by both readouts on every scope, with intervals from exact draws."""
    rows = vec(spark, sf).select(F.col("vec_id").cast("string").alias("sample_id"), F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("subset"), F.col("layers").alias("layer_vectors"), F.lit(0).alias("label"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("parsed"), F.concat(F.lit("g"), (F.col("vec_id") % 97).cast("string")).alias("bucket"))
    found, _ = experiment.run(splits.grouped_split(rows, "bucket"), key="sample_id", subsets=("s0", "s1", "s2"), replicates=200, least_positives=1)
    return rounded(found.select("variant", "readout", "eval_split", "eval_scope", "metric_status", "failure_reason", "num_samples", "roc_auc", "roc_auc_ci_low", "roc_auc_ci_high", "pr_auc", "pr_auc_ci_low", "pr_auc_ci_high", "num_bank_correct"))


# --- bindings in which every case occurs -------------------------------------------------------------------------------


@query(
    """SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN 'missing layer_vectors' WHEN 1 THEN 'layer_vectors must be two-dimensional' WHEN 2 THEN 'layer count differs' WHEN 3 THEN 'selected_layers must be contiguous from 0' WHEN 4 THEN 'layer_vectors must be finite'
        WHEN 5 THEN 'layer count differs,layer_vectors must be finite' ELSE '' END AS errors FROM embeddings"""
)
def vector_errors(spark, sf):
    """Matrices from embeddings, six of seven made faulty in one way or two: each message is shown."""
    k, layers = F.col("vec_id") % 7, F.col("layers")
    odd = F.array(F.concat(F.slice(F.element_at(layers, 1), 1, 7), F.array(F.lit(float("inf")))))
    made = F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.slice(layers, 1, 7), F.array(F.array(F.lit(0.0))))).when(k == 2, F.slice(layers, 1, 7)).when(k == 4, F.concat(odd, F.slice(layers, 2, 7))).when(k == 5, F.concat(odd, layers)).otherwise(layers)
    selected = F.when(k == 3, F.sequence(F.lit(1), F.lit(8))).otherwise(F.sequence(F.lit(0), F.lit(7)))
    return vec(spark, sf).select("vec_id", F.array_join(quality.layer_vector_errors(made, selected, F.lit(8)), ",").alias("errors"))


@query("SELECT doc_id, quality AS number, toxic AS word, CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 0 END AS variant, CAST(NULL AS INTEGER) AS neither FROM labels")
def labels_as_words(spark, sf):
    """Labels written as numbers, as yes and no in odd spellings, and as JSON, read back; and words that are neither."""
    word = F.when(F.col("toxic") == 1, "  YES\t").when(F.col("toxic") == 0, "No")
    rows = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("n"), word.alias("w"), F.parse_json(F.when(F.col("quality") == 1, "true").when(F.col("quality") == 0, "false")).alias("v"))
    return rows.select("doc_id", T.yes_no_label(F.col("n")).alias("number"), T.yes_no_label(F.col("w")).alias("word"), T.variant_label(F.col("v")).alias("variant"), T.yes_no_label(F.concat("w", F.lit(" or not"))).alias("neither"))


_LABELLED = f"{DOCS}, m AS (SELECT dataset_name, subset, count(*) AS expected, count(label) AS observed FROM docs GROUP BY ALL)"


@query(f"WITH {_LABELLED} SELECT dataset_name || '/' || subset || ': expected ' || expected || ', observed ' || observed AS label FROM m WHERE observed > 0 AND observed != expected")
def label_count_mismatches(spark, sf):
    """Datasets of which some documents, not all, have a label."""
    keys = ("dataset_name", "subset")
    d = docs(spark, sf).select(*keys, "label")
    required, seen = d.groupBy(*keys).agg(F.count("*").alias("expected")), d.where("label is not null").groupBy(*keys).agg(F.count("*").alias("observed"))
    return reconcile.mismatch_labels(reconcile.reconciled(required, seen, keys), keys)


@query(
    f"""WITH {DOCS}, d AS (SELECT *, CASE WHEN n_chars % 4 = 0 THEN '' ELSE sample_id END AS path, CASE WHEN n_chars % 5 = 0 THEN 'unknown' ELSE bucket END AS name FROM docs)
    SELECT dataset_name, count(*) AS num_records, count(*) FILTER (path = '') AS num_missing_image_path, count(*) FILTER (name = 'unknown') AS num_unknown_object, count(DISTINCT name) AS num_unique_objects,
        CAST(sum(CAST(path = '' AS INT) + CAST(text IS NULL OR regexp_matches(text, '^\\s*$') AS INT) + CAST(label IS NULL AS INT)) AS BIGINT) AS num_null_required_fields FROM d GROUP BY dataset_name"""
)
def dataset_audit_gaps(spark, sf):
    """The audit where paths are missing and objects unknown."""
    n = F.col("n_chars")
    d = docs(spark, sf).withColumn("image_path", F.when(n % 4 == 0, " ").otherwise(F.col("sample_id"))).withColumn("object_name", F.when(n % 5 == 0, "unknown").otherwise(F.col("bucket")))
    a = quality.dataset_audit(d, ("dataset_name",), image="n_chars", question="text")
    return a.select("dataset_name", "num_records", "num_missing_image_path", "num_unknown_object", "num_unique_objects", "num_null_required_fields")


@query(
    f"""WITH {DOCS}, m AS (SELECT DISTINCT o_orderstatus AS model_name FROM orders), r AS (SELECT dataset_name, subset, least(count(*), 10) AS num_records, count(label) AS n FROM docs GROUP BY ALL)
    SELECT model_name, dataset_name, subset, num_records, CAST(ceil(num_records / 4.0) AS BIGINT) AS num_shards, '/cache/' || model_name || '/' || dataset_name || '/' || subset AS folder,
        CASE WHEN model_name = 'F' AND n >= num_records THEN 'done' WHEN model_name = 'F' AND n > 0 THEN 'partial' ELSE 'planned' END AS state FROM m CROSS JOIN r"""
)
def extraction_plan(spark, sf):
    """What a run over all documents would do for each model, with those done that have a label."""
    d = docs(spark, sf)
    models = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("model_name"))
    done = d.where("label is not null").groupBy(F.lit("F").alias("model_name"), "dataset_name", "subset").agg(F.count("*").alias("n"))
    return extraction.planned(d.withColumnRenamed("dataset_name", "source_dataset"), models, "/cache", rows_per_shard=4, limit=10, done=done)


@query(
    f"""WITH {DOCS}, d AS (SELECT * FROM docs WHERE label IS NOT NULL), specs AS (SELECT DISTINCT dataset_name, subset FROM d UNION ALL SELECT 'absent', 'all')
    SELECT dataset_name, subset, CASE WHEN count(d.doc_id) = 0 THEN 'missing' ELSE 'present' END AS status, count(d.doc_id) AS num_records, count(*) FILTER (label = 1) AS num_gt_yes, count(*) FILTER (label = 0) AS num_gt_no, CAST(0 AS BIGINT) AS num_invalid_label,
        CASE WHEN count(d.doc_id) > 0 THEN count(*) FILTER (parsed = 1) END AS num_parsed_yes, CASE WHEN count(d.doc_id) > 0 THEN count(*) FILTER (parsed = label) END AS num_correct, CASE WHEN count(d.doc_id) = 0 THEN 'missing' ELSE 'available' END AS parsed_answer_status
    FROM specs LEFT JOIN d USING (dataset_name, subset) GROUP BY dataset_name, subset"""
)
def label_balance_of_specs(spark, sf):
    d, by = docs(spark, sf).where("label is not null"), ("dataset_name", "subset")
    specs = d.select(*by).distinct().unionByName(spark.createDataFrame([("absent", "all")], "dataset_name string, subset string"))
    out = quality.label_balance_of_specs(specs, quality.label_balance(d, by, has_field=F.lit(True)), by)
    return out.select(*by, "status", "num_records", "num_gt_yes", "num_gt_no", "num_invalid_label", "num_parsed_yes", "num_correct", "parsed_answer_status")


@query(
    """SELECT 'row-' || lpad(CAST(row_number() OVER (ORDER BY event_id) - 1 AS VARCHAR), 6, '0') AS sample_id, -1 AS image_id, '' AS object_name, event_type AS subset, 0 AS label, 0 AS prediction, value AS score, 0 AS fold, '' AS note, CAST(user_id AS VARCHAR) AS user_key FROM events"""
)
def result_table(spark, sf):
    """Events as a result table: ids from their place, absent columns filled."""
    return metrics.result_frame(evt(spark, sf).select("event_id", "subset", "score", "user_key"), extra=("note", "user_key"), place="event_id")


@query(f"{_SHARDS}, r AS (SELECT 'tiny' AS model_name, 'pope' AS dataset_name, unnest(['popular', 'random']) AS subset) SELECT 'cache_label_balance.csv missing rows' AS \"check\", 'tiny/pope/random' AS item, '' AS detail UNION ALL SELECT 'cache_manifest status is not passed', 'failed', '' WHERE (SELECT count(*) FROM m) > 0")
def cache_issues(spark, sf):
    """What a run would be told of the cache: a subset without label balances, and a manifest that did not pass."""
    entries, sides = _cache(spark, sf)
    shards, _, summary = cache_checks.validated(entries, sides, order="vec_id")
    required = spark.createDataFrame([("tiny", "pope", "popular"), ("tiny", "pope", "random")], "model_name string, dataset_name string, subset string")
    return preflight.balance_issues(entries, required).unionByName(preflight.manifest_issues(summary, shards, first=0))
