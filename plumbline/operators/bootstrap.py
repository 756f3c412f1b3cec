"""Bootstrap with exactly as many draws as there are rows, and metrics of one's own, over ranges of scores.

Rows are counted by group, score and label. Ranges of scores, split by label, are the leaves of a binary tree; a replicate's
n draws go down it by binomials, each conditional on what its node was given and keyed by the seed and the node. So any
task can work out, from the counts of the leaves alone, how many positives and negatives every replicate draws in and
above its range: it needs no other task's rows. Inside a range the draws go to the cells, from the highest score on, by
further conditional binomials. Counts add up to n in every replicate and depend on the seed, the table and the number of ranges only.

A metric is a function of a ``Step``: what it adds up over the distinct scores, for all replicates at once. Its sums over
ranges are its partial states; Spark adds them up. Only one range of one group is ever in a task, in blocks of ``BLOCK``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges

BLOCK = 256
SEED = 20260506


@dataclass(frozen=True)
class Step:
    """Distinct scores, highest first, by replicates: hits ``p`` and misses ``n`` at a score, ``tp`` and ``fp`` down to it, and each replicate's ``pos`` and ``neg``."""

    p: np.ndarray
    n: np.ndarray
    tp: np.ndarray
    fp: np.ndarray
    pos: np.ndarray
    neg: np.ndarray


Metric = Callable[[Step], np.ndarray]


def precision(tp: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """1 where nothing is above the score yet."""
    return np.where(tp + fp > 0, tp / np.maximum(tp + fp, 1), 1.0)


def roc_auc(s: Step) -> np.ndarray:
    return s.n / s.neg * (s.tp - s.p / 2) / s.pos


def pr_auc(s: Step) -> np.ndarray:
    return s.p / s.pos * (precision(s.tp, s.fp) + precision(s.tp - s.p, s.fp - s.n)) / 2


def average_precision(s: Step) -> np.ndarray:
    return s.p / s.pos * precision(s.tp, s.fp)


BOTH: dict[str, Metric] = {"roc_auc": roc_auc, "pr_auc": pr_auc}


def leaf_draws(sizes: list[int], replicates: int, seed: int = SEED) -> np.ndarray:
    """Draws of each leaf by replicate, ``sum(sizes)`` of them in each."""
    out = np.zeros((len(sizes), replicates), dtype=np.int64)
    nodes = [(0, len(sizes), np.full(replicates, sum(sizes), dtype=np.int64))]
    while nodes:
        low, high, m = nodes.pop()
        if high - low == 1:
            out[low] = m
            continue
        mid, whole = (low + high) // 2, sum(sizes[low:high])
        left = np.random.default_rng([seed, low, high]).binomial(m, sum(sizes[low:mid]) / whole) if whole else m
        nodes += [(low, mid, left), (mid, high, m - left)]
    return out


def cell_draws(sizes: np.ndarray, m: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Draws of each cell in turn: what is left is shared with the cells that are left."""
    rest, left = m.copy(), int(sizes.sum())
    for c in sizes.tolist():
        got = rng.binomial(rest, c / left) if c < left else rest.copy()
        rest, left = rest - got, left - c
        yield got


def swept(cells: pa.Table, leaves: list[dict], metrics: dict[str, Metric], replicates: int, seed: int) -> dict[str, np.ndarray]:
    """What a range adds to each metric, by replicate; behind the replicates, the table as it is. NaN where a class is missing."""
    part = cells.column("__part")[0].as_py()
    score, y, c = (cells.column(k).to_numpy() for k in ("score", "y", "c"))
    order = np.lexsort((-score, ~np.isnan(score)))
    score, y, c = score[order], y[order], c[order]
    key = lambda i: (leaves[i]["part"], leaves[i]["y"])
    drawn = leaf_draws([x["c"] for x in leaves], replicates, seed)
    drawn = np.concatenate((drawn, np.array([[x["c"]] for x in leaves])), axis=1)
    total = lambda y, above: sum((drawn[i] for i in range(len(leaves)) if key(i)[1] == y and key(i)[0] > above), np.zeros(replicates + 1))
    lowest = min(x["part"] for x in leaves) - 1
    pos, neg, tp, fp = total(1, lowest), total(0, lowest), total(1, part), total(0, part)
    own = {key(i): drawn[i, :replicates] for i in range(len(leaves))}
    draws = {k: cell_draws(c[y == k], own[part, k], np.random.default_rng([seed, part + 1, k, 1])) for k in (0, 1) if (y == k).any()}
    at = np.flatnonzero(np.concatenate(([True], (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1])))))
    ends = np.append(at[1:], len(score))
    out = {k: np.zeros(replicates + 1) for k in metrics}
    for first in range(0, len(at), BLOCK):
        rows = list(zip(at[first : first + BLOCK].tolist(), ends[first : first + BLOCK].tolist(), strict=True))
        p, n = np.zeros((len(rows), replicates + 1)), np.zeros((len(rows), replicates + 1))
        for k, (start, end) in enumerate(rows):
            for i in range(start, end):
                into = p if y[i] == 1 else n
                into[k, :replicates] += next(draws[int(y[i])])
                into[k, replicates] += c[i]
        step = Step(p, n, tp + p.cumsum(axis=0), fp + n.cumsum(axis=0), np.where(pos > 0, pos, np.nan), np.where(neg > 0, neg, np.nan))
        tp, fp = step.tp[-1], step.fp[-1]
        for name, f in metrics.items():
            out[name] += f(step).sum(axis=0)
    return {name: np.where((pos > 0) & (neg > 0), x, np.nan) for name, x in out.items()}


def _states(df: DataFrame, by: tuple[str, ...], label: str, score: str, metrics: dict[str, Metric], replicates: int, seed: int, parts: int) -> DataFrame:
    """``by``, ``replicate`` (``replicates``: the table as it is) and the metrics."""
    rows = df.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y")).where("score is not null and y in (0, 1)")
    at = ranges.cuts(rows, "score", parts)
    cells = rows.groupBy(*by, "score", "y").agg(F.count("*").alias("c")).withColumn("__part", ranges.range_of(F.col("score"), at))
    leaf = F.struct(F.col("__part").alias("part"), "y", "c")
    leaves = cells.groupBy(*by, "__part", "y").agg(F.sum("c").alias("c")).groupBy(*by).agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))  # two for each range
    kinds = [(k, df.schema[k].dataType.simpleString()) for k in by]

    def run(cells: pa.Table, leaves: pa.Table) -> pa.Table:
        out = swept(cells, leaves.column("leaves")[0].as_py(), metrics, replicates, seed)
        return pa.table({k: cells.column(k).slice(0, 1) for k in by} | {k: pa.array([v], pa.list_(pa.float64())) for k, v in out.items()})

    schema = ", ".join([f"`{k}` {t}" for k, t in kinds] + [f"{k} array<double>" for k in metrics])
    own = {k: f"__r_{k}" for k in (*by, "__part")}  # both sides come from the same rows: a column that is in both is ambiguous where the plan has a join
    each_part = leaves.withColumn("__part", F.explode(F.array_distinct(F.transform("leaves", lambda x: x["part"])))).select(*(F.col(k).alias(x) for k, x in own.items()), "leaves")  # a row for each range, not for each cell
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism  # not fewer for few bytes: the work is in the draws
    groups = [x.repartition(tasks, *keys).groupBy(*keys) for x, keys in ((cells, own), (each_part, own.values()))]
    each = groups[0].cogroup(groups[1]).applyInArrow(run, schema)
    long = each.select(*by, F.posexplode(F.arrays_zip(*metrics)).alias("replicate", "m"))
    return long.groupBy(*by, "replicate").agg(*(F.sum(f"m.{k}").alias(k) for k in metrics))


def intervals(
    df: DataFrame,
    by: tuple[str, ...] = (),
    *,
    label: str = "y",
    score: str = "score",
    replicates: int = 1000,
    confidence: float = 0.95,
    seed: int = SEED,
    metrics: dict[str, Metric] | None = None,
    parts: int = ranges.PARTS,
) -> DataFrame:
    """Per group and metric: the table's own value, and mean, percentile interval and number of the replicates with both classes.

    Rows without a score, or whose label is neither 0 nor 1, take no part. Scores that are NaN count as one value above all others.
    """
    if replicates <= 0:
        raise ValueError("replicates must be positive")
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    metrics = metrics or BOTH
    states = _states(df, by, label, score, metrics, replicates, seed, parts)
    each = states.select(*by, (F.col("replicate") == replicates).alias("own"), F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("x")) for k in metrics))).alias("m")).select(*by, "own", "m.metric", F.when(~F.isnan("m.x"), F.col("m.x")).alias("x"))
    drawn = F.when(~F.col("own"), F.col("x"))
    low = (1 - confidence) / 2
    return each.groupBy(*by, "metric").agg(F.max(F.when(F.col("own"), F.col("x"))).alias("value"), F.avg(drawn).alias("mean"), F.percentile(drawn, low).alias("lower"), F.percentile(drawn, 1 - low).alias("upper"), F.count(drawn).alias("num_bootstrap"))


def metric_values(df: DataFrame, by: tuple[str, ...] = (), *, label: str = "y", score: str = "score", metrics: dict[str, Metric] | None = None, parts: int = ranges.PARTS) -> DataFrame:
    """Per group, a column for each metric; null where a class is missing."""
    metrics = metrics or BOTH
    states = _states(df, by, label, score, metrics, 0, SEED, parts)
    return states.select(*by, *(F.when(~F.isnan(k), F.col(k)).alias(k) for k in metrics))
