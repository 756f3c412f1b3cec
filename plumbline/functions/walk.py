"""Walks over VARIANT values: a table of what they hold, lookups of one of several paths, strict integer lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = r"^(ARRAY<)+(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))>+$"


def depth(json: Column) -> Column:
    """How deep objects and lists stand in one another in a JSON text; 0 for a scalar."""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    step = lambda a, c: F.when(c.isin("[", "{"), F.struct((a["at"] + 1).alias("at"), F.greatest(a["most"], a["at"] + 1).alias("most"))).otherwise(F.struct((a["at"] - 1).alias("at"), a["most"].alias("most")))
    return F.when(brackets == "", 0).otherwise(F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step)["most"])


def shape(value: Column, kind: Column, most: int) -> Column:
    """Sizes of a list of numbers, and of the lists inside it as far as ``most``, by its first ones."""
    sizes = [F.when(F.length(kind) - F.length(F.replace(kind, F.lit("ARRAY<"), F.lit(""))) > 6 * k, F.size(F.try_variant_get(value, "$" + "[0]" * k, "array<variant>"))) for k in range(most)]
    return F.array_compact(F.array(*sizes))


def leaves(df: DataFrame, json_col: str, keys: tuple[str, ...], *, tensors: bool = False) -> DataFrame:
    """``keys``, ``path``, ``type``, ``leaf`` (as JSON text) of all scalars in a VARIANT column, and of empty objects and lists.

    Each level is one ``variant_explode`` of the containers of the level before. How many levels there are is found first,
    by one aggregation over the texts. With ``tensors``, a list of numbers, nested or not, is one row with its ``shape``.
    Keys that hold a dot or a bracket stand in the path as they are.
    """
    rows = df.select(F.struct(*keys).alias("own"), F.lit("").alias("path"), F.col(json_col).alias("v"))
    explode = df.sparkSession.tvf.variant_explode
    levels = rows.agg(F.max(depth(F.to_json("v")))).first()[0] or 0
    kind = F.schema_of_variant("v")
    done = []
    for level in range(levels + 1):
        rows = rows.where("v is not null").withColumn("type", kind)
        inner = F.regexp_like("type", F.lit("^(OBJECT|ARRAY)")) & ~F.col("type").isin("OBJECT<>", "ARRAY<VOID>")
        empty = F.to_json("v").isin("[]", "{}")
        whole = F.regexp_like("type", F.lit(_NUMBERS)) if tensors else F.lit(False)
        leaf = ~inner | empty | whole
        found = rows.where(leaf).select("own.*", "path", "type", F.to_json("v").alias("leaf"), *([F.when(whole, shape(F.col("v"), F.col("type"), levels + 1)).alias("shape")] if tensors else []))
        done.append(found)
        if level == levels:
            break
        part = F.when(F.col("key").isNotNull(), F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(""), "key")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        below = rows.where(~leaf).lateralJoin(explode(F.col("v").outer()))
        rows = below.select("own", part.alias("path"), F.col("value").alias("v"))
    return reduce(DataFrame.unionByName, done)


def first_at(value: Column, *paths: str, kind: str = "string") -> Column:
    """What stands at the first of several paths that is there, null values and steps into scalars aside."""
    return F.coalesce(*(F.try_variant_get(value, p, kind) for p in paths))


def int_list(value: Column, path: str = "$") -> Column:
    """A list of integers; null unless it is a list whose elements all are: numbers (cut towards zero) or texts of digits, no booleans."""
    each = F.try_variant_get(value, path, "array<variant>")

    def number(x: Column) -> Column:
        kind, text = F.schema_of_variant(x), F.try_variant_get(x, "$", "string")
        return F.when(kind == "BIGINT", F.try_variant_get(x, "$", "long")).when(F.regexp_like(kind, F.lit("^(DOUBLE|FLOAT|DECIMAL)")), F.try_variant_get(x, "$", "double").cast("long")).when((kind == "STRING") & F.regexp_like(text, F.lit(r"^\s*[+-]?\d{1,18}\s*$")), F.trim(text).cast("long"))

    numbers = F.transform(each, number)
    return F.when(F.forall(numbers, lambda n: n.isNotNull()), numbers)
