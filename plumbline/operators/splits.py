"""Grouped splits without leakage, their counts, and reports of groups that stand in several splits."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import text_or_null
from . import ranges
from .quality import require_none

# Names, shares and seed of the four splits, and what a report says was done about conflicts.
NAMES = ("encoder_train", "bank", "cal", "test")
RATIOS = (0.5, 0.2, 0.1, 0.2)
SEED = 20260506
CONFLICT_ACTION = "ignored Stage 0 per-subset assignments and built a new POPE-family split"

#: Groups whose order may be shuffled on the driver.
EXACT_KEYS = 5_000_000


def check_ratios(ratios: tuple[float, ...]) -> None:
    if len(ratios) != len(NAMES) or any(not math.isfinite(r) or r < 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"{len(NAMES)} finite ratios of at least 0 must sum to 1: {ratios}")


def apportioned(n: int, ratios: tuple[float, ...] = RATIOS) -> list[int]:
    """Whole shares of ``n`` by largest remainder; of equal remainders the earlier comes first."""
    exact = [n * r for r in ratios]
    out = [math.floor(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda k: (out[k] - exact[k], k))[: n - sum(out)]:
        out[i] += 1
    return out


def split_of_rank(rank: Column, n: int, ratios: tuple[float, ...] = RATIOS) -> Column:
    """The split of the ``rank``-th (from 1) of ``n`` groups."""
    out, end = None, 0
    for name, share in zip(NAMES, apportioned(n, ratios), strict=True):
        end += share
        out = F.when(rank <= end, name) if out is None else out.when(rank <= end, name)
    return out


def grouped_split(df: DataFrame, group: str, *, ratios: tuple[float, ...] = RATIOS, seed: int = SEED, exact: bool = False) -> DataFrame:
    """``df`` with ``split``, all rows of a group in the same one.

    Groups are ranked by the md5 of seed and key, in Spark: hash buckets are counted first, then ranked inside, so no
    task sees all groups. ``exact`` shuffles sorted keys on the driver with Python's generator instead, which gives the
    very permutation of a Mersenne twister; it raises beyond ``EXACT_KEYS`` groups.
    """
    check_ratios(ratios)
    key = text_or_null(group)
    require_none(df.where(key.isNull()), f"missing or blank group key {group!r}")
    keys = df.select(key.alias("__key")).distinct()
    if exact:
        order = sorted(r[0] for r in keys.limit(EXACT_KEYS + 1).collect())
        if len(order) > EXACT_KEYS:
            raise ValueError(f"exact takes at most {EXACT_KEYS} groups: the driver holds them")
        random.Random(seed).shuffle(order)
        ranked = df.sparkSession.createDataFrame(list(enumerate(order, 1)) or [(0, "")], "__rank long, __key string")
        n = len(order)
    else:
        digest = keys.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), "__key"))).withColumn("__b", F.substring("__h", 1, 2))
        sizes = digest.groupBy("__b").agg(F.count("*").alias("__n"))  # at most 256 rows
        before = sizes.select("__b", (F.sum("__n").over(W.orderBy("__b")) - F.col("__n")).alias("__before"))
        n = sizes.agg(F.sum("__n")).first()[0] or 0
        inside = F.row_number().over(W.partitionBy("__b").orderBy("__h", "__key"))
        ranked = digest.withColumn("__i", inside).join(F.broadcast(before), "__b").select("__key", (F.col("__before") + F.col("__i")).alias("__rank"))
    named = ranked.select(F.col("__key"), split_of_rank(F.col("__rank"), n, ratios).alias("split"))
    return df.withColumn("__key", key).join(named, "__key").drop("__key")


def split_counts(df: DataFrame, *, split: str = "split") -> DataFrame:
    """Rows of each split in its fixed order, 0 where there are none."""
    names = df.sparkSession.createDataFrame(list(enumerate(NAMES)), "ordinal int, split string")
    counts = df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n"))
    return names.join(counts, "split", "left").select("ordinal", "split", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def field_counts(df: DataFrame, field: str, *, split: str = "split") -> DataFrame:
    """Per split, a map from the field's values to their numbers, in order."""
    per = df.groupBy(split, F.col(field).cast("string").alias("__v")).agg(F.count("*").alias("__n"))
    return per.groupBy(split).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n")))).alias("counts"))


def added_maps(df: DataFrame, map_col: str, by: tuple[str, ...]) -> DataFrame:
    """Maps of counts added up by key, one row per group and key."""
    return df.select(*by, F.explode(map_col).alias("value", "k")).groupBy(*by, "value").agg(F.sum("k").alias("n"))


def leaks(df: DataFrame, key: str, *, split: str = "split") -> DataFrame:
    """Values of a key that stand in more than one split."""
    per = df.groupBy(F.col(key).cast("string").alias("value")).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return per.where(F.size("splits") > 1)


def require_no_leaks(df: DataFrame, keys: tuple[str, ...], *, split: str = "split") -> None:
    for k in keys:
        require_none(leaks(df, k, split=split), f"{k} stands in several splits")


def split_conflicts(df: DataFrame, group: str, old_split: str) -> DataFrame:
    """Groups whose rows had different earlier splits, and what was done about it."""
    known = df.where(F.col(old_split).isin(*NAMES))
    per = known.groupBy(F.col(group).alias("group_key")).agg(F.array_sort(F.collect_set(old_split)).alias("splits")).where(F.size("splits") > 1)
    return per.withColumn("action", F.lit(CONFLICT_ACTION))


def first_n(df: DataFrame, by: tuple[str, ...], n: int, *order: str) -> DataFrame:
    """The first rows of each group in an explicit order."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def chunked(df: DataFrame, by: tuple[str, ...], size: int, *order: str) -> DataFrame:
    """Adds ``shard``: the number of the chunk of ``size`` rows within each group, numbered over ranges of the first order column."""
    if size <= 0:
        raise ValueError("size must be positive")
    first, *rest = order
    return ranges.ordinals(df, by, first, tie=tuple(rest), name="__i").withColumn("shard", F.floor(F.col("__i") / size).cast("long")).drop("__i")


# --- manifests -------------------------------------------------------------------------------------------------------

ASSIGNMENT_COLUMNS = ("split", "dataset_name", "subset", "sample_id", "image_id", "image_path", "object_name", "label", "question")


def assignment_rows(df: DataFrame, *, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The columns of an assignment as text, absent ones and nulls as ''; ``defaults`` name columns that the rows lack."""
    have = {c: F.col(c) for c in df.columns} | (defaults or {})
    return df.select(*(F.coalesce(have[c].cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in ASSIGNMENT_COLUMNS))


def stage0_split(c: Column | str) -> Column:
    """An earlier split's name, or ``missing``."""
    return F.coalesce(text_or_null(c), F.lit("missing"))


def manifests(assigned: DataFrame, by: tuple[str, ...] = ("dataset_name", "subset"), *, fields: tuple[str, ...] = ("label", "object_name"), keys: tuple[str, ...] = ("image_id", "sample_id"), split: str = "split", ratios: tuple[float, ...] = RATIOS, seed: int = SEED) -> DataFrame:
    """A manifest for each group: seed, names and ratios, ``counts_per_split``, for each field its values' counts by split, and for each key whether no value stands in two splits, with those that do.

    Counts are maps from every split's name in its order, to 0 or an empty map where it has no row. The assignments
    themselves stay a table (``assignment_rows``). ``overlaps`` has a pair of splits and its shared values, blanks left
    out; a manifest with many is as large as they are.
    """
    per = assigned.groupBy(*by, F.col(split).alias("__s")).agg(F.count("*").alias("__n"))
    names = F.array(*(F.lit(n) for n in NAMES))
    at = lambda found, n, none: F.coalesce(F.try_element_at(F.filter(found, lambda e: e["s"] == n), F.lit(1))["m"], none)
    by_name = lambda found, none: F.map_from_arrays(names, F.transform(names, lambda n: at(found, n, none)))
    out = per.groupBy(*by).agg(by_name(F.collect_list(F.struct(F.col("__s").alias("s"), F.col("__n").alias("m"))), F.lit(0).cast("long")).alias("counts_per_split"))
    empty = F.create_map().cast("map<string,bigint>")
    for f in fields:
        values = assigned.groupBy(*by, F.col(split).alias("__s"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("__v")).agg(F.count("*").alias("__n"))
        maps = values.groupBy(*by, "__s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n")))).alias("__m"))
        maps = maps.groupBy(*by).agg(by_name(F.collect_list(F.struct(F.col("__s").alias("s"), F.col("__m").alias("m"))), empty).alias(f"{f}_counts_per_split"))
        out = ranges.joined(out, maps, by)
    for k in keys:
        value = text_or_null(k)
        per_value = assigned.where(value.isNotNull()).groupBy(*by, value.alias("__v")).agg(F.array_sort(F.collect_set(split)).alias("__in")).where(F.size("__in") > 1)
        pairs = F.filter(F.flatten(F.transform("__in", lambda a: F.transform("__in", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda p: p["a"] < p["b"])
        shared = per_value.select(*by, "__v", F.explode(pairs).alias("p")).groupBy(*by, F.concat_ws("/", "p.a", "p.b").alias("pair")).agg(F.array_sort(F.collect_list("__v")).alias("values"))
        shared = shared.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", "values")))).alias("__o"))
        none = F.create_map().cast("map<string,array<string>>")
        out = ranges.joined(out, shared, by, "left").withColumn(f"{k}_overlap_validation", F.struct(F.col("__o").isNull().alias("valid"), F.coalesce("__o", none).alias("overlaps"))).drop("__o")
    return out.select(F.lit(seed).alias("seed"), names.alias("split_names"), F.array(*map(F.lit, ratios)).alias("ratios"), "*")


def nested_totals(manifest: DataFrame, counts: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Maps of maps of counts added up: for each group, every split in its order with the sums of its values; splits of other names and nulls are left out."""
    long = manifest.select(*by, F.explode(counts).alias("split", "__m")).where(F.col("split").isin(*NAMES)).select(*by, "split", F.explode("__m").alias("__v", "__n"))
    sums = long.groupBy(*by, "split", "__v").agg(F.sum("__n").alias("__n"))
    maps = sums.groupBy(*by, "split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n")))).alias("__m"))
    names = F.array(*(F.lit(n) for n in NAMES))
    found = F.collect_list(F.struct("split", "__m"))
    at = lambda found, n: F.coalesce(F.try_element_at(F.filter(found, lambda e: e["split"] == n), F.lit(1))["__m"], F.create_map().cast("map<string,bigint>"))
    return maps.groupBy(*by).agg(F.map_from_arrays(names, F.transform(names, lambda n: at(found, n))).alias(counts))


def overlap_summary(manifest: DataFrame, validation: str, *, label: tuple[str, str] = ("dataset_name", "subset")) -> DataFrame:
    """One row: ``valid`` where every manifest's validation is, ``overlaps`` of those that aren't and ``per_dataset`` of all, by dataset/subset."""
    name, v = F.concat_ws("/", *label), F.col(validation)
    entry = F.struct(name.alias("k"), v.alias("v"))
    bad = F.when(~F.coalesce(v["valid"], F.lit(False)), F.struct(name.alias("k"), v["overlaps"].alias("v")))
    return manifest.agg(
        F.coalesce(F.bool_and(F.coalesce(v["valid"], F.lit(False))), F.lit(True)).alias("valid"),
        F.map_from_entries(F.collect_list(bad)).alias("overlaps"),
        F.map_from_entries(F.collect_list(entry)).alias("per_dataset"),
    )
