"""Token positions of spans of characters, and padding of ragged arrays of any depth to a batch's shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import held, subsequence_start

#: Characters to a bucket in which tokens and spans meet.
BUCKET = 256


def token_rows(df: DataFrame, key: str, offsets: str) -> DataFrame:
    """``key``, ``at`` (from 0), ``start``, ``stop``, ``id`` from a column of token offsets (array<struct<start, stop, id>>)."""
    return df.select(key, F.posexplode(offsets).alias("at", "t")).select(key, "at", "t.start", "t.stop", "t.id")


def token_spans(tokens: DataFrame, spans: DataFrame, key: str, *, bucket: int = BUCKET) -> DataFrame:
    """``spans`` (``key``, ``start``, ``stop``) with ``first``, ``last`` and ``ids`` of the tokens that overlap each; null and none where no token does.

    A token or span stands in every bucket of characters that it touches, and the two meet by key and bucket, so a long
    text is no hot key; a pair that meets in several buckets counts in the first that both touch. Spans without characters
    overlap the tokens that they stand inside. A span is known by key, start and stop; repeated ones are given back as
    often as they stand there.
    """
    touched = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.greatest(F.col("stop") - 1, F.col("start")) / bucket)))
    asked = spans.groupBy(key, "start", "stop").agg(F.count("*").alias("__times"))
    left = asked.where("start is not null and stop is not null").withColumn("__b", touched)
    right = tokens.withColumn("__b", touched).select(key, "__b", "at", "id", F.col("start").alias("__start"), F.col("stop").alias("__stop"))
    met = left.join(right, [key, "__b"]).where("__start < stop and __stop > start")
    first_shared = F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("__start") / bucket)) == F.col("__b")
    found = met.where(first_shared).groupBy(key, "start", "stop").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.array_sort(F.collect_list(F.struct("at", "id"))).alias("__ids"))
    out = asked.join(found, [key, "start", "stop"], "left").withColumn("ids", F.coalesce(F.col("__ids.id"), F.array().cast("array<long>")))
    return out.select(key, "start", "stop", "first", "last", "ids", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__t")).drop("__t")


def name_span(text: Column, question: Column, name: Column) -> Column:
    """Where a name stands in a prompt, from 0, whatever the case: from the question's place on if the question is in it; null without it."""
    t, q, n = (F.lower(c) for c in (text, question, name))
    from_ = F.greatest(F.instr(t, q), F.lit(1))
    at = F.instr(F.substr(t, from_), n)
    return F.when(at > 0, F.struct((from_ + at - 2).alias("start"), (from_ + at - 2 + F.length(n)).alias("stop")))


def object_token(input_ids: Column, span_ids: Column, fallbacks: Column) -> Column:
    """struct<at, id>: where the tokens of a span stand in the input, else those of the first fallback (array<array<long>>) that stand there; null if none does."""

    def first(found: Column) -> Column:
        return F.try_element_at(F.filter(found, lambda f: f["at"].isNotNull()), F.lit(1))

    tries = F.concat(F.array(span_ids), F.coalesce(fallbacks, F.array().cast("array<array<long>>")))
    return held(F.transform(tries, lambda ids: F.struct(subsequence_start(input_ids, ids).alias("at"), F.try_element_at(ids, F.lit(1)).alias("id"))), first)


def name_variants(name: Column) -> Column:
    """The spellings that are tried where offsets fail: as it is, behind a space, capitalised, both."""
    return F.array(name, F.concat(F.lit(" "), name), F.initcap(name), F.concat(F.lit(" "), F.initcap(name)))


# --- ragged arrays ---------------------------------------------------------------------------------------------------


def rank(kind: str) -> int:
    """How many arrays a type has in one another."""
    return kind.count("array<")


def shape_of(value: Column, dims: int) -> list[Column]:
    """The greatest size at each level of a ragged array."""
    out = [F.size(value)]
    for _ in range(dims - 1):
        out.append(F.coalesce(F.array_max(F.transform(value, F.size)), F.lit(0)))
        value = F.flatten(value)
    return out


def padded_to(value: Column, shape: list[Column], pad: Column, kind: str) -> Column:
    """A ragged array filled up to a shape, level by level."""
    n = shape[0]
    if len(shape) == 1:
        return F.concat(value, F.array_repeat(pad.cast(kind.removeprefix("array<").removesuffix(">")), F.greatest(n - F.size(value), F.lit(0))))
    inner = kind.removeprefix("array<").removesuffix(">")
    each: Callable[[Column], Column] = lambda x: padded_to(x, shape[1:], pad, inner)
    return F.transform(F.concat(value, F.array_repeat(F.array().cast(inner), F.greatest(n - F.size(value), F.lit(0)))), each)


def collated(df: DataFrame, by: tuple[str, ...], pads: dict[str, Column]) -> DataFrame:
    """``df`` with each field of ``pads`` filled up with its value to the greatest shape that its batch (``by``) has.

    Shapes are one row for each batch, found by an aggregation and joined back. Null arrays count as empty. Rows whose
    batch is null form one batch.
    """
    from .ranges import joined

    kinds = dict(df.dtypes)
    empty = {c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in pads}
    rows = df.withColumns(empty)
    sizes = [F.max(x).alias(f"__{c}_{k}") for c in pads for k, x in enumerate(shape_of(F.col(c), rank(kinds[c])))]
    out = joined(rows, rows.groupBy(*by).agg(*sizes), by)
    for c, pad in pads.items():
        out = out.withColumn(c, padded_to(F.col(c), [F.col(f"__{c}_{k}") for k in range(rank(kinds[c]))], pad, kinds[c]))
    return out.select(*df.columns)
