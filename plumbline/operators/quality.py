"""Checks and audits of record tables: violations per row, dataset and label-balance audits, duplicates, vector validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import population_class, rate_text, text_or_null


def null_field_count(*fields: Column) -> Column:
    """How many of the fields are blank."""
    return sum((text_or_null(f).isNull().cast("int") for f in fields[1:]), text_or_null(fields[0]).isNull().cast("int"))


def violations(checks: dict[str, Column]) -> Column:
    """Messages of the checks that hold for a row, in order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(message)) for message, bad in checks.items()]))


def extraction_violations(df: DataFrame, required: tuple[str, ...], label: str = "label") -> DataFrame:
    """Rows that break the extraction contract, with their messages: blank required fields, then labels other than 0 and 1."""
    checks = {f"missing or blank {c}": text_or_null(c).isNull() for c in required if c != label}
    checks[f"{label} must be 0 or 1"] = F.col(label).isNull() | ~F.col(label).isin(0, 1)
    return df.withColumn("violations", violations(checks)).where(F.size("violations") > 0)


def require_none(bad: DataFrame, what: str) -> None:
    """Raises with a few examples if a violation table has rows."""
    rows = bad.limit(3).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def dataset_audit(df: DataFrame, by: tuple[str, ...], *, sample: str = "sample_id", image: str = "image_id", path: str = "image_path", question: str = "question", label: str = "label", name: str = "object_name") -> DataFrame:
    """Eleven counts per group in one aggregation."""
    filled = text_or_null(sample)
    image_key = F.coalesce(text_or_null(image), text_or_null(path))
    missing = lambda c: text_or_null(c).isNull()
    nulls = missing(sample).cast("int") + missing(path).cast("int") + missing(question).cast("int") + F.col(label).isNull().cast("int")
    return df.groupBy(*by).agg(
        F.count("*").alias("num_records"),
        F.count_if(F.col(label) == 1).alias("num_label_yes"),
        F.count_if(F.col(label) == 0).alias("num_label_no"),
        F.count_if(missing(path)).alias("num_missing_image_path"),
        F.count_if(missing(question)).alias("num_missing_question"),
        F.count_if(F.col(name) == "unknown").alias("num_unknown_object"),
        F.count_distinct(F.col(name)).alias("num_unique_objects"),
        F.count_distinct(image_key).alias("num_unique_images"),
        (F.count(filled) - F.count_distinct(filled)).alias("num_duplicate_sample_id"),
        F.sum(nulls).alias("num_null_required_fields"),
        F.count_if(F.col(label).isNull()).alias("num_invalid_label"),
    )


def audit_of_specs(specs: DataFrame, audit: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A row per spec, in its order: zero counts and status ``missing`` where nothing was found."""
    counts = [c for c in audit.columns if c not in by]
    out = specs.join(audit, list(by), "left")
    status = F.when(F.col(counts[0]).isNull(), "missing").otherwise("present")
    return out.select(*specs.columns, status.alias("status"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])


def label_balance(df: DataFrame, by: tuple[str, ...], *, label: str = "label", parsed: str = "parsed", has_field: Column | None = None) -> DataFrame:
    """Parsed answers against labels. ``has_field``: whether a row's answer was found with a parsed field; where no row of a group has one, its six parsed measures are null and the status says so; without the column nothing was cached yet."""
    y, p = F.col(label), F.col(parsed)
    hits = F.count_if((p == 1) & (y == 0))
    there = F.lit(False) if has_field is None else F.coalesce(F.bool_or(has_field), F.lit(False))
    late = "not_available_before_cache" if has_field is None else "not_available_in_cache"
    when = lambda c: F.when(there, c)
    return df.groupBy(*by).agg(
        F.count("*").alias("num_records"),
        F.count_if(y == 1).alias("num_gt_yes"),
        F.count_if(y == 0).alias("num_gt_no"),
        F.count_if(y.isNull()).alias("num_invalid_label"),
        when(F.count_if(p == 1)).alias("num_parsed_yes"),
        when(F.count_if(p == 0)).alias("num_parsed_no"),
        when(F.count_if(p.isNull())).alias("num_parsed_none"),
        when(F.count_if(p == y)).alias("num_correct"),
        when(hits).alias("num_hallucination"),
        when(rate_text(hits, F.count_if(y == 0))).alias("hallucination_rate"),
        F.when(there, "available").otherwise(late).alias("parsed_answer_status"),
    )


def label_balance_of_specs(specs: DataFrame, balance: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A row per spec, in its order: where it has no records, counts of them are 0, what is known of answers only is null, and both statuses are ``missing``."""
    counts = ("num_records", "num_gt_yes", "num_gt_no", "num_invalid_label")
    rest = [c for c in balance.columns if c not in (*by, *counts, "parsed_answer_status")]
    out = specs.join(balance, list(by), "left")
    gone = F.col("num_records").isNull()
    return out.select(*specs.columns, F.when(gone, "missing").otherwise("present").alias("status"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], *rest, F.coalesce("parsed_answer_status", F.lit("missing")).alias("parsed_answer_status"))


def cache_label_balance(df: DataFrame, by: tuple[str, ...], *, label: str = "label", parsed: str = "parsed") -> DataFrame:
    """As above per model and group; the denominator is the rows whose label is no."""
    y, p = F.col(label), F.col(parsed)
    hits, no = F.count_if((p == 1) & (y == 0)), F.count_if(y == 0)
    return df.groupBy(*by).agg(
        F.count("*").alias("num_entries"),
        F.count_if(y == 1).alias("num_gt_yes"),
        no.alias("num_gt_no"),
        F.count_if(p == 1).alias("num_parsed_yes"),
        F.count_if(p == 0).alias("num_parsed_no"),
        F.count_if(p.isNull()).alias("num_parsed_none"),
        F.count_if(p == y).alias("num_correct"),
        hits.alias("num_hard_hallucination"),
        F.count_if((p == 0) & (y == 1)).alias("num_false_negative_error"),
        no.alias("num_primary_population"),
        rate_text(hits, no).alias("hallucination_rate_in_primary_population"),
    )


def population_summary(df: DataFrame, by: tuple[str, ...], *, label: str = "label", parsed: str = "parsed", few: int = 20) -> DataFrame:
    """Counts of the five classes; primary is correct and hard hallucination together."""
    out = df.withColumn("__c", population_class(F.col(label), F.col(parsed))).groupBy(*by).agg(
        F.count("*").alias("num_entries"),
        *[F.count_if(F.col("__c") == c).alias(f"num_{c}") for c in ("correct", "hard_hallucination", "false_negative_error", "parsed_none", "invalid_label")],
    )
    primary = F.col("num_correct") + F.col("num_hard_hallucination")
    return out.withColumn("num_primary_population", primary).withColumn("hallucination_rate", F.try_divide(F.col("num_hard_hallucination").cast("double"), primary)).withColumn("low_positive_count", F.col("num_hard_hallucination") < few)


def excluded_counts(df: DataFrame, *, split: str = "split", subset: str = "subset", label: str = "label", parsed: str = "parsed") -> DataFrame:
    """Rows of each class that the primary population leaves out, per split pooled and per split and subset."""
    kept = df.withColumn("class", population_class(F.col(label), F.col(parsed))).where(~F.col("class").isin("correct", "hard_hallucination"))
    return kept.groupingSets([[F.col(split), F.col("class")], [F.col(split), F.col(subset), F.col("class")]], split, subset, "class").agg(F.count("*").alias("n"), F.grouping(subset).alias("__g")).select(F.col(split).alias("split"), F.when(F.col("__g") == 1, "pooled").otherwise(F.col(subset)).alias("scope"), "class", "n")


def object_audit(df: DataFrame, by: tuple[str, ...], name: str, *, label: str = "label", parsed: str = "parsed", has_field: Column) -> DataFrame:
    """Per object: records, and correct and hallucinated answers, null where no answer of the object has a parsed field."""
    y, p = F.col(label), F.col(parsed)
    there = F.coalesce(F.bool_or(has_field), F.lit(False))
    return df.groupBy(*by, name).agg(F.count("*").alias("num_records"), F.when(there, F.count_if(p == y)).alias("num_correct"), F.when(there, F.count_if((p == 1) & (y == 0))).alias("num_hallucination"))


def repeated(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys without blanks that more than one row has."""
    full = df.where(" and ".join(f"{k} is not null" for k in keys))
    return full.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def last_wins(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The last row of each key in an explicit order."""
    w = W.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def single_value(c: Column, fallback: Column) -> Column:
    """Aggregate: the one distinct value that is not blank, else the fallback."""
    return F.when(F.count_distinct(text_or_null(c)) == 1, F.max(text_or_null(c))).otherwise(fallback)


def layer_vector_errors(layers: Column, selected: Column, expected: Column) -> Column:
    """Messages for a row's matrix: missing, ragged, wrong layer count, layers not 0..n-1, or values that are not finite."""
    widths = F.array_distinct(F.transform(layers, F.size))
    odd = F.exists(layers, lambda r: F.exists(r, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return violations(
        {
            "missing layer_vectors": layers.isNull() | (F.size(layers) == 0),
            "layer_vectors must be two-dimensional": F.size(widths) > 1,
            "layer count differs": F.size(layers) != expected,
            "selected_layers must be contiguous from 0": ~selected.eqNullSafe(F.sequence(F.lit(0), expected.cast("int") - 1)),
            "layer_vectors must be finite": odd,
        }
    )


def identity_errors(entry: dict[str, Column], sidecar: dict[str, Column]) -> Column:
    """Identity columns that differ where both sides have one."""
    return violations({f"{k} differs from its sidecar": text_or_null(v).isNotNull() & text_or_null(sidecar[k]).isNotNull() & (text_or_null(v) != text_or_null(sidecar[k])) for k, v in entry.items()})


def shard_manifest(entries: DataFrame, *, shard: str = "shard_path", errors: str = "errors", hidden: str = "hidden_dim") -> DataFrame:
    """Per shard: entries, errors, hidden sizes, status; a hidden size must be the same in all of a shard."""
    per = entries.groupBy(shard).agg(F.count("*").alias("num_entries"), F.sum(F.size(errors)).alias("num_errors"), F.array_sort(F.collect_set(hidden)).alias("hidden_dims"))
    return per.withColumn("status", F.when((F.col("num_errors") == 0) & (F.size("hidden_dims") <= 1), "passed").otherwise("failed"))
