"""Representations from per-layer vectors, and distances to a bank of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-12


def held(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, the value worked out once: inside a lambda it would be again for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def norm(v: Column) -> Column:
    return F.sqrt(F.reduce(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    return held(F.struct(v.alias("v"), F.greatest(norm(v), F.lit(EPS)).alias("n")), lambda s: F.transform(s["v"], lambda x: x / s["n"]))


def log_norm(v: Column) -> Column:
    return F.ln(F.greatest(norm(v), F.lit(EPS)))


def mean_pool(layers: Column) -> Column:
    width = F.size(F.element_at(layers, 1))
    total = F.reduce(layers, F.array_repeat(F.lit(0.0), width), lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(layers))


def representation(name: str, layers: Column) -> Column:
    """One of the six variants that need no training."""
    last = F.element_at(layers, -1)
    return {
        "Raw-Static": lambda: last,
        "Sphere-Static": lambda: unit(last),
        "Norm-Static": lambda: F.array(log_norm(last)),
        "Raw-Traj-MeanPool": lambda: mean_pool(layers),
        "Sphere-Traj-MeanPool": lambda: unit(mean_pool(F.transform(layers, unit))),
        "Norm-Traj": lambda: F.transform(layers, log_norm),
    }[name]()


VARIANTS = ("Raw-Static", "Sphere-Static", "Norm-Static", "Raw-Traj-MeanPool", "Sphere-Traj-MeanPool", "Norm-Traj")


def representations(df: DataFrame, key: str, layers: str, variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """Long form: key, variant, vector."""
    each = F.array(*[F.struct(F.lit(v).alias("variant"), representation(v, F.col(layers)).alias("vector")) for v in variants])
    return df.select(key, F.explode(each).alias("r")).select(key, "r.variant", "r.vector")


def trajectory(layers: Column, permutation: list[int] | None = None, normalise: bool = True) -> Column:
    """Layers in a given order, each to unit length if wanted."""
    if permutation is not None:
        layers = F.transform(F.array(*[F.lit(i) for i in permutation]), lambda i: F.element_at(layers, i + 1))
    return F.transform(layers, unit) if normalise else layers


def layer_permutation(n: int, seed: int = 20260506) -> list[int]:
    """A seeded order that is never the identity for n > 1."""
    order = np.random.default_rng(seed).permutation(n).tolist()
    return order[1:] + order[:1] if n > 1 and order == list(range(n)) else order


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.reduce(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def angular(a: Column, b: Column) -> Column:
    """Angle over pi; vectors without a direction raise."""
    dot = F.reduce(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    safe = F.when(size > 0, size).otherwise(F.raise_error(F.lit("angular distance of a zero vector")).cast("double"))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / safe))) / F.lit(3.141592653589793)


#: Values of a bank that may be sent to every task; a larger one is dealt in blocks.
BANK_VALUES = 1 << 24
#: Values of the queries that one task holds, about.
QUERY_VALUES = 1 << 21
#: Rows of the queries and of the bank that are multiplied at once.
ASKED, MET = 512, 4096


def _apart(x: np.ndarray, y: np.ndarray, angular: bool) -> np.ndarray:
    """What rows are ordered by: the square of their distance, or the cosine with its sign turned."""
    return -(x * y).sum(axis=1) if angular else ((y - x) ** 2).sum(axis=1)


def nearest(x: np.ndarray, y: np.ndarray, k: int, angular: bool = False) -> np.ndarray:
    """The k smallest distances (all, if fewer) of each row of ``x`` to rows of ``y``, ascending.

    A matrix product tells which rows may be among them, rounding allowed for; only those distances are worked out.
    Rows that are not finite, or too large to be squared, are compared one by one.
    """
    k = min(k, len(y))
    if angular:
        x, y = (m / np.maximum(np.sqrt((m * m).sum(axis=1)), EPS)[:, None] for m in (x, y))
    plain = lambda m: (np.abs(m) < 1e150).all(axis=1)
    best, fit, bank = np.full((len(x), k), np.inf), plain(x), y[plain(y)]
    if len(bank) < k:
        fit[:] = False
    for i in np.flatnonzero(~fit):
        best[i] = np.partition(_apart(x[i], y, angular), k - 1)[:k]
    rows, at = x[fit], np.flatnonzero(fit)
    slack = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps
    for first in range(0, len(rows), ASKED):
        part = rows[first : first + ASKED]
        near, own = np.full((len(part), k), np.inf), (part * part).sum(axis=1)
        left = -part if angular else np.column_stack((-2 * part, np.ones(len(part))))
        for start in range(0, len(bank), MET):
            block = bank[start : start + MET]
            size = (block * block).sum(axis=1)
            about = left @ (block if angular else np.column_stack((block, size))).T  # less ``own`` where squares
            room = slack * (own + size.max())
            limit = near[:, -1] - (0 if angular else own)
            if start == 0 and len(block) > k:
                limit = np.partition(about, k - 1, axis=1)[:, k - 1] + room
            i, j = np.divmod(np.flatnonzero(about <= (limit + room)[:, None]), len(block))
            step = max(1, (1 << 22) // max(1, x.shape[1]))
            found = [_apart(part[i[s : s + step]], block[j[s : s + step]], angular) for s in range(0, len(i), step)]
            if found:
                many = np.bincount(i, minlength=len(part))
                more = np.full((len(part), many.max()), np.inf)
                more[i, np.arange(len(i)) - (np.cumsum(many) - many)[i]] = np.concatenate(found)
                near = np.partition(np.concatenate((near, more), axis=1), k - 1, axis=1)[:, :k]
        best[at[first : first + ASKED]] = near
    best = np.sort(best, axis=1)
    return np.arccos(np.clip(-best, -1, 1)) / np.pi if angular else np.sqrt(best)


def knn_scores(bank: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int = 10, metric: str = "euclidean") -> DataFrame:
    """``key``, ``score`` of each query row: mean distance to the k nearest bank rows. A query that is in the bank meets itself too.

    The distances are worked out in numpy: each bank block (of checked size) meets all queries and gives each its k
    smallest, which are merged per query. Rows that share a key are told apart by their vectors; equal ones are asked
    once and given back as often as they stand there. Of equal bank rows k are enough. Both sides are dealt in parts of bounded size, as many
    as it takes, and each pair of parts is a group with a partition of its own: neither side must fit a task, more rows are
    more tasks instead of longer ones, and no pair of rows is ever a row.
    """
    import pyarrow as pa

    size = bank.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if size["n"] < k:
        raise ValueError("bank has fewer than k rows")
    blocks = max(1, -(-size["n"] * size["d"] // BANK_VALUES))
    q = queries.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    q = q.groupBy("key", "v").agg(F.count("*").alias("times")).withColumn("own", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    b = bank.select(F.col(vector).cast("array<double>").alias("v")).groupBy("v").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    b = b.select("v", F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("v", "block")
    key_type = q.schema["key"].dataType.simpleString()

    def matrix(c: pa.ChunkedArray) -> np.ndarray:
        a = c.combine_chunks()
        return np.asarray(a.flatten(), dtype=np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 0))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y, angular = matrix(left.column("v")), matrix(right.column("v")), metric == "angular"
        if angular and len(x) and len(y) and not (np.abs(x).sum(axis=1).all() and np.abs(y).sum(axis=1).all()):
            raise ValueError("angular distance of a zero vector")
        found = nearest(x, y, k, angular) if len(x) and len(y) else np.zeros((0, 0))
        asked = left.select(["key", "own", "times"]).take(pa.array(np.repeat(np.arange(len(found)), found.shape[1]), type=pa.int64()))
        return asked.append_column("d", pa.array(found.ravel(), type=pa.float64()))

    parts = max(bank.sparkSession.sparkContext.defaultParallelism, -(-queries.count() * size["d"] // QUERY_VALUES))
    dealt = q.withColumn("part", F.pmod(F.xxhash64("own"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    copies = b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    groups = [df.repartition(4 * parts * blocks, "part", "block").groupBy("part", "block") for df in (dealt, copies)]  # not merged by their bytes: the work is in the pairs
    found = groups[0].cogroup(groups[1]).applyInArrow(meet, f"key {key_type}, own string, times long, d double")
    rank = F.row_number().over(W.partitionBy("key", "own").orderBy("d"))
    near = found.withColumn("rn", rank).where(F.col("rn") <= k).groupBy("key", "own", "times").agg(F.avg("d").alias("score"))
    return near.select(F.col("key").alias(key), "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")


def standard_scaled(df: DataFrame, vector: str, train: Column) -> DataFrame:
    """``df`` with each position of the vector less its mean over the training rows, divided by their population deviation (1 where that is 0).

    Means and deviations are one row, as long as a vector, which is sent to all tasks; the rows themselves are not shuffled.
    Positions that no training row has are left out.
    """
    long = df.where(train).select(F.posexplode(vector).alias("i", "x"))
    stats = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    one = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("__stats"))
    scaled = F.zip_with(F.slice(vector, 1, F.size("__stats")), F.slice("__stats", 1, F.size(vector)), lambda x, e: (x - e["m"]) / e["s"])
    return df.crossJoin(F.broadcast(one)).withColumn(vector, scaled).drop("__stats")


def subsequence_start(tokens: Column, part: Column) -> Column:
    """Index from 0 of the first occurrence of a contiguous part; null if there is none or it is empty."""

    def find(both: Column) -> Column:
        tokens, part = both["tokens"], both["part"]
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - F.size(part) + 1, F.lit(1)))
        hits = F.filter(starts, lambda i: F.slice(tokens, i, F.size(part)) == part)
        return F.when((F.size(part) > 0) & (F.size(part) <= F.size(tokens)), F.try_element_at(hits, F.lit(1)) - 1)

    return held(F.struct(tokens.alias("tokens"), part.alias("part")), find)


def last_nonzero(mask: Column) -> Column:
    """Index from 0 of the last 1, null without one."""
    at = F.array_position(F.reverse(mask), 1)
    return F.when(at > 0, F.size(mask) - at)


def token_span(ids: Column, token: int) -> Column:
    """First and last index from 0 of a token, null without it."""
    found = lambda ids: F.filter(F.sequence(F.lit(1), F.size(ids)), lambda i: F.element_at(ids, i) == token)
    span = lambda hits: F.when(F.size(hits) > 0, F.struct((F.array_min(hits) - 1).alias("start"), (F.array_max(hits) - 1).alias("stop")))
    return held(ids, lambda ids: F.when(F.size(ids) > 0, held(found(ids), span)))


def padded(values: Column, size: Column, pad: Column) -> Column:
    return F.concat(values, F.array_repeat(pad, F.greatest(size - F.size(values), F.lit(0))))


def compact_readout(hidden: Column, query: Column, name: Column, span: Column, layers: Column) -> Column:
    """From layers of token vectors: those of the query token, the object token and the last vision token, and the vision span of some layers."""
    token = lambda at: F.transform(hidden, lambda h: F.element_at(h, at + 1))
    part = F.transform(layers, lambda i: F.slice(F.element_at(hidden, i + 1), span["start"] + 1, span["stop"] - span["start"] + 1))
    return F.struct(token(query).alias("query"), token(name).alias("object"), token(span["stop"]).alias("vision_stop"), part.alias("vision"))


def prefill_layers(hidden: Column, token: Column) -> Column:
    """Vectors of one token by layer, the embedding layer dropped; negative tokens count from the end."""
    at = F.when(token < 0, token).otherwise(token + 1)
    return F.transform(F.slice(hidden, 2, F.size(hidden) - 1), lambda h: F.element_at(h, at))


def tensor_bytes(layers: Column, width: int = 2) -> Column:
    return F.size(F.flatten(layers)).cast("long") * width
