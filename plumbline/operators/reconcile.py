"""Joins that reconcile tables: cascaded lookups, relabelling, expected against observed, overlaps, capped candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import text_or_null
from .quality import require_none, violations
from .ranges import joined


def cascaded_match(records: DataFrame, answers: DataFrame, *, keys: tuple[str, str, str] = ("dataset_name", "subset", "sample_id"), model: str = "model_name", parsed: str = "parsed", for_model: str | None = None) -> DataFrame:
    """``records`` with ``parsed`` and ``matched`` (exact, keyed, sample or none).

    With a model, only its exact key counts, the last answer winning by ``ordinal``. Otherwise: the answer of the three
    keys if there is exactly one; else none if the sample id occurs in several records; else the answer of the sample id
    alone, if there is exactly one.
    """
    data, subset, sample = keys
    if for_model is not None:
        w = W.partitionBy(*keys).orderBy(F.desc("ordinal"))
        exact = answers.where(F.col(model) == for_model).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*keys, F.col(parsed).alias("__p"), F.lit(1).alias("__m"))
        out = records.join(exact, list(keys), "left")
        return out.withColumn(parsed, F.col("__p")).withColumn("matched", F.when(F.col("__m") == 1, "exact").otherwise("none")).drop("__p", "__m")
    three = answers.groupBy(*keys).agg(F.count("*").alias("__n3"), F.first(parsed).alias("__p3"))
    one = answers.groupBy(sample).agg(F.count("*").alias("__n1"), F.first(parsed).alias("__p1"))
    ambiguous = records.groupBy(sample).agg((F.count("*") > 1).alias("__amb"))
    out = records.join(three, list(keys), "left").join(one, sample, "left").join(ambiguous, sample, "left")
    keyed, alone = F.col("__n3") == 1, (~F.col("__amb")) & (F.col("__n1") == 1)
    out = out.withColumn(parsed, F.when(keyed, F.col("__p3")).when(alone, F.col("__p1")))
    out = out.withColumn("matched", F.when(keyed, "keyed").when(alone, "sample").otherwise("none"))
    return out.drop("__n3", "__p3", "__n1", "__p1", "__amb")


def relabelled(records: DataFrame, labels: DataFrame, *, key: str = "sample_id", label: str = "label", source: str = "source_dataset", name: str = "repope") -> DataFrame:
    """Labels replaced where the other table has the key (its last by ``ordinal``); other rows stay as they are."""
    w = W.partitionBy(key).orderBy(F.desc("ordinal"))
    new = labels.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(key, F.col(label).alias("__new"))
    out = records.join(new, key, "left")
    return out.withColumn(source, F.when(F.col("__new").isNotNull(), F.lit(name)).otherwise(F.col(source))).withColumn(label, F.coalesce("__new", label)).drop("__new")


def lossless_violations(left: DataFrame, right: DataFrame, *, ordinal: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows of two lists, matched by position, that differ in a field after trimming, or that one list lacks."""
    a = left.select(ordinal, *[text_or_null(f).alias(f"__l_{f}") for f in fields], F.lit(1).alias("__l"))
    b = right.select(ordinal, *[text_or_null(f).alias(f"__r_{f}") for f in fields], F.lit(1).alias("__r"))
    both = a.join(b, ordinal, "full_outer")
    lone = F.col("__l").isNull() | F.col("__r").isNull()
    bad = F.array_compact(F.array(F.when(lone, "row count"), *[F.when(~lone & ~F.col(f"__l_{f}").eqNullSafe(F.col(f"__r_{f}")), f) for f in fields]))
    return both.select(ordinal, F.array_join(bad, ",").alias("fields")).where("fields != ''")


def lossless_relabel(cache: DataFrame, targets: DataFrame, *, key: str = "sample_id", identity: tuple[str, ...] = ("sample_id", "image_id", "image_path", "question", "object_name"), replaced: tuple[str, ...] = ("label", "dataset_name", "subset", "split")) -> DataFrame:
    """Cache rows under their targets' labels and names; raises, before anything is written, unless both sides match one to one. One job looks for all faults."""
    cols = [F.col(c).alias(f"__t_{c}") for c in dict.fromkeys((*identity, *replaced))]
    t = targets.select(F.col(key).alias("__key"), (F.count("*").over(W.partitionBy(key)) > 1).alias("__many"), *cols)
    both = cache.join(t, cache[key] == F.col("__key"), "full_outer")
    lone = F.col(key).isNull() | F.col("__key").isNull()
    differs = {f"{f} differs": ~lone & ~text_or_null(f).eqNullSafe(text_or_null(f"__t_{f}")) for f in identity}
    faults = violations({"target keys repeat": F.coalesce(F.col("__many"), F.lit(False)), "rows without a partner": lone} | differs)
    require_none(both.select(key, "__key", faults.alias("faults")).where(F.size("faults") > 0), "not one to one")
    return both.select(*[F.col(f"__t_{c}").alias(c) if c in replaced else F.col(c) for c in cache.columns])


def must_match(rows: DataFrame, others: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], *, what: str = "partner") -> DataFrame:
    """``rows`` with columns of the one other row that has their keys; whenever it is computed, a row without one, or with several, raises with its keys.

    Null keys match null keys. The check is in the plan: no job of its own.
    """
    named = others.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.first(c).alias(f"__o_{c}") for c in columns))
    out = joined(rows, named, keys, "left")
    label = F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    fault = F.when(F.col("__n").isNull(), F.concat(F.lit(f"missing {what} for "), label)).when(F.col("__n") > 1, F.concat(F.lit(f"several {what}s for "), label))
    first, *rest = columns
    held = F.when(fault.isNotNull(), F.raise_error(fault).cast(out.schema[f"__o_{first}"].dataType)).otherwise(F.col(f"__o_{first}"))
    return out.select(*rows.columns, held.alias(first), *(F.col(f"__o_{c}").alias(c) for c in rest))


def required_matrix(models: DataFrame, specs: DataFrame) -> DataFrame:
    """All pairs of two short lists of names: the work that must be there."""
    return models.crossJoin(F.broadcast(specs))  # configuration lists, a few rows each


def reconciled(required: DataFrame, observed: DataFrame, keys: tuple[str, ...], *, expected: str = "expected", count: str = "observed") -> DataFrame:
    """Required rows with what was observed (0 where nothing was) and ``state``: completed, mismatch or missing."""
    out = required.join(observed, list(keys), "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))
    return out.withColumn("state", F.when(F.col(count) == F.col(expected), "completed").when(F.col(count) > 0, "mismatch").otherwise("missing"))


def mismatch_labels(rows: DataFrame, keys: tuple[str, ...], *, expected: str = "expected", count: str = "observed") -> DataFrame:
    return rows.where("state = 'mismatch'").select(F.concat(F.concat_ws("/", *keys), F.format_string(": expected %d, observed %d", F.col(expected), F.col(count))).alias("label"))


def count_differences(expected: DataFrame, observed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys whose counts ``n`` differ, either side missing counting as 0."""
    a, b = expected.select(*keys, F.col("n").alias("expected_n")), observed.select(*keys, F.col("n").alias("observed_n"))
    out = a.join(b, list(keys), "full_outer").select(*keys, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("expected_n", "observed_n")])
    return out.where("expected_n != observed_n")


def overlap_counts(left: DataFrame, right: DataFrame, keys: dict[str, tuple[str, ...]], pair: tuple[str, str]) -> DataFrame:
    """Distinct values that both sides share, per key definition and pair of subsets; blanks of a key's first part are left out."""

    def long(df: DataFrame, side: str) -> DataFrame:
        values = F.array(*[F.struct(F.lit(k).alias("key"), F.when(text_or_null(cols[0]).isNotNull(), F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])).alias("value")) for k, cols in keys.items()])
        return df.select(F.col(side), F.explode(values).alias("v")).select(side, "v.key", "v.value").where("value is not null").distinct()

    return long(left, pair[0]).join(long(right, pair[1]), ["key", "value"]).groupBy("key", *pair).agg(F.count("*").alias("n"))


def first_ids(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """``by`` and ``__most``: a key below which, itself included, a group has ``n`` distinct keys and not many more; null where all may be needed.

    It is the n-th smallest of the least keys of 4 n hash buckets, so a task holds 4 n keys of each group, not its rows.
    """
    least = df.groupBy(by, F.pmod(F.xxhash64(key), F.lit(4 * n)).alias("__bucket")).agg(F.min(key).alias("__least"))
    return least.groupBy(by).agg(F.try_element_at(F.array_sort(F.collect_list("__least")), F.lit(n)).alias("__most"))


def reference_candidates(images: DataFrame, categories: DataFrame, annotations: DataFrame, *, allowed: DataFrame, excluded: DataFrame, cap: int | None = None) -> DataFrame:
    """``image_id``, ``file_name``, ``object_names`` of images with an allowed object; each object counts on its first ``cap`` images by id only.

    ``images``: image_id, file_name; ``categories``: category_id, name; ``annotations``: image_id, category_id;
    ``allowed``: name; ``excluded``: image_id.
    """
    pairs = annotations.join(categories, "category_id").join(allowed.distinct(), "name", "left_semi").join(excluded, "image_id", "left_anti").select("image_id", "name")
    if cap is not None:
        pairs = joined(pairs, first_ids(pairs, "name", "image_id", cap), ("name",)).where(F.col("__most").isNull() | (F.col("image_id") <= F.col("__most"))).drop("__most")
    pairs = pairs.distinct()
    if cap is not None:
        w = W.partitionBy("name").orderBy("image_id")
        pairs = pairs.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= cap).drop("__rn")
    names = pairs.groupBy("image_id").agg(F.array_sort(F.collect_set("name")).alias("object_names"))
    return names.join(images, "image_id").select("image_id", "file_name", "object_names")


def missing(required: DataFrame, present: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return required.join(present, list(keys), "left_anti")


def counts_of_expected(entries: DataFrame, expected: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Entries per expected key; others are left out."""
    return entries.join(expected, list(keys), "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))
