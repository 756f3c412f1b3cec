"""Ranking metrics of binary scores: tie-aware ROC and precision-recall, threshold metrics, bootstrap intervals, scope grids."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bootstrap, ranges
from .tables import stored
from .vectors import held

NAN = float("nan")


def curve(df: DataFrame, by: tuple[str, ...], *, label: str = "y", score: str = "score", weight: str | None = None, parts: int = ranges.PARTS) -> DataFrame:
    """A row per distinct score and group: hits ``p`` and misses ``n`` there, ``tp`` and ``fp`` from the highest score down to it, the totals ``pos`` and ``neg``, and ``corner``.

    Ties are one row after a pre-aggregation. Running sums are taken within ranges of scores and added to those of the
    ranges above, so a task orders one range of one group. ``corner`` is false for a point on a straight run of equal
    steps; first and last are corners.
    """
    k = F.col(weight) if weight else F.lit(1)
    g = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, k).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, k).otherwise(0)).alias("n"))
    g = g.withColumn("__part", ranges.range_of(F.col("score"), ranges.cuts(df.select(F.col(score).alias("score")), "score", parts)))
    ends = g.groupBy(*by, "__part").agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"), F.max(F.struct("score", "p", "n")).alias("__first"))
    down = W.partitionBy(*by).orderBy(F.desc("__part"))  # a row for each range
    above, whole = down.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    ends = ends.select(*by, "__part", before("__p").alias("__tp"), before("__n").alias("__fp"), F.sum("__p").over(whole).alias("pos"), F.sum("__n").over(whole).alias("neg"), F.lead("__first").over(down).alias("__next"))
    inside = W.partitionBy(*by, "__part").orderBy(F.desc("score"))
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    out = ranges.joined(g, ends, (*by, "__part"))
    out = out.select(*by, "score", "p", "n", "pos", "neg", (F.col("__tp") + F.sum("p").over(so_far)).alias("tp"), (F.col("__fp") + F.sum("n").over(so_far)).alias("fp"), F.coalesce(F.lead(F.struct("p", "n")).over(inside), F.struct("__next.p", "__next.n")).alias("__then"))
    first, last = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("n")), F.col("__then.p").isNull()
    return out.withColumn("corner", first | last | (F.col("__then.p") != F.col("p")) | (F.col("__then.n") != F.col("n"))).drop("__then")


def ranking_metrics(df: DataFrame, by: tuple[str, ...] = (), *, label: str = "y", score: str = "score", max_fpr: float = 0.01, min_tpr: float = 0.95, weight: str | None = None, parts: int = ranges.PARTS) -> DataFrame:
    """Per group: roc_auc, pr_auc (trapezoid from recall 0 at precision 1), average_precision, tpr at ``max_fpr``, fpr at ``min_tpr``.

    Null, with ``metric_status`` undefined and the reason, where only one class is present.
    """
    pts = curve(df, by, label=label, score=score, weight=weight, parts=parts)
    over = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, p, n, pos, neg = (F.col(c) for c in ("tp", "fp", "p", "n", "pos", "neg"))
    pts = pts.withColumns({"tpr": over(tp, pos), "fpr": over(fp, neg), "prec": over(tp, tp + fp), "d_tpr": over(tp, pos) - over(tp - p, pos), "d_fpr": over(fp, neg) - over(fp - n, neg)})
    pts = pts.withColumns({"s_tpr": F.col("tpr") + over(tp - p, pos), "s_prec": F.col("prec") + F.coalesce(over(tp - p, tp - p + fp - n), F.lit(1.0))})
    ok = (F.max("pos") > 0) & (F.max("neg") > 0)
    low = F.max(F.when(F.col("corner") & (F.col("fpr") <= max_fpr), F.col("tpr")))
    high = F.min(F.when(F.col("corner") & (F.col("tpr") >= min_tpr), F.col("fpr")))
    return pts.groupBy(*by).agg(
        (F.max("pos") + F.max("neg")).cast("long").alias("num_samples"),
        F.max("pos").cast("long").alias("num_positive"),
        F.when(ok, F.sum(F.col("d_fpr") * F.col("s_tpr") / 2)).alias("roc_auc"),
        F.when(ok, F.sum(F.col("d_tpr") * F.col("s_prec") / 2)).alias("pr_auc"),
        F.when(ok, F.sum(F.col("d_tpr") * F.col("prec"))).alias("average_precision"),
        F.when(ok, "ok").otherwise("undefined").alias("metric_status"),
        F.when(~ok, "one class present in evaluation scope").alias("failure_reason"),
        F.when(ok, F.coalesce(low, F.lit(0.0))).alias("tpr_at_fpr"),
        F.when(ok, F.coalesce(high, F.lit(1.0))).alias("fpr_at_tpr"),
    )


def threshold_metrics(df: DataFrame, by: tuple[str, ...], *, label: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy (null with one class), precision, recall, F1 and false-positive rate at a threshold; ratios without a base are 0."""
    hit, y = F.col(score) >= threshold, F.col(label)
    tp, fp, fn, tn = (F.count_if(c) for c in (hit & (y == 1), hit & (y == 0), ~hit & (y == 1), ~hit & (y == 0)))
    out = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    out = out.withColumn("precision", part("tp", F.col("tp") + F.col("fp"))).withColumn("recall", part("tp", F.col("tp") + F.col("fn")))
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    return out.select(
        *by,
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("num_samples"),
        F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        F.when(both, (F.col("recall") + part("tn", F.col("fp") + F.col("tn"))) / 2).alias("balanced_accuracy"),
        "precision",
        "recall",
        F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"),
        part("fp", F.col("fp") + F.col("tn")).alias("false_positive_rate"),
    )


def poisson_steps() -> list[float]:
    """The distribution function of Poisson(1) at 0, 1, ... as far as a hash of 32 bits can reach."""
    steps, p, total = [], 0.36787944117144233, 0.36787944117144233
    while total <= 1 - 2**-32:
        steps.append(total)
        p /= len(steps)
        total += p
    return steps


def resample_weight(seed: int, replicate: Column, key: Column) -> Column:
    """A Poisson(1) count by hash: how often a replicate draws a row."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return held(u, lambda u: sum(((u >= step).cast("int") for step in poisson_steps()), F.lit(0)))


def hashed_weights(seed: int, replicates: int, keys: list[str | None]) -> np.ndarray:
    """``resample_weight`` of keys (rows) in all replicates (columns)."""
    heads = [f"{seed}:{r}".encode() for r in range(replicates)]
    tails = [b"" if k is None else b":" + k.encode() for k in keys]
    digests = b"".join([hashlib.md5(h + t, usedforsecurity=False).digest()[:4] for t in tails for h in heads])
    u, out = np.frombuffer(digests, dtype=">u4").astype(np.uint32), np.zeros(len(keys) * replicates, dtype=np.int16)
    for step in poisson_steps():
        out += u >= np.uint32(math.ceil(step * 2**32))
    return out.reshape(len(keys), replicates)


#: Rows whose draws are worked out at once, replicates of one group, scores of a group that are swept at once, and draws of a task.
ROWS, WIDTH, SWEPT, DRAWS = 256, 250, 1024, 1 << 24


def _starts(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where runs of equal values of the columns start, nulls and NaN equal to themselves."""
    new = np.zeros(len(table), dtype=bool)
    new[:1] = True
    for c in columns:
        v = table.column(c).combine_chunks()
        if pa.types.is_floating(v.type):
            null, x = v.is_null().to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)
            new[1:] |= (null[1:] != null[:-1]) | ((x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1])))
        else:
            x = v.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _lists(c: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return np.concatenate([a.flatten().to_numpy().reshape(len(a), -1) for a in c.chunks if len(a)])


def _weighted_cells(rows: DataFrame, by: tuple[str, ...], replicates: int, seed: int) -> DataFrame:
    """``by``, ``__part``, ``score``, ``first`` (replicate), ``whole``, and how often ``WIDTH`` replicates draw hits ``p`` and misses ``n`` there.

    A row with ``whole`` is of all scores of a range; several rows of one cell add up.
    """
    kinds = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by])
    schema = f"{kinds}{', ' if by else ''}__part int, score double, first int, whole boolean, p array<smallint>, n array<smallint>"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                t = pa.Table.from_batches([batch.slice(start, ROWS)])
                w, y = hashed_weights(seed, replicates, t.column("__key").to_pylist()), t.column("y").combine_chunks()
                sides = [w * pc.fill_null(pc.equal(y, k), False).to_numpy(zero_copy_only=False)[:, None] for k in (1, 0)]
                for whole, columns in ((False, (*by, "__part", "score")), (True, (*by, "__part"))):
                    at = _starts(t, columns)
                    p, n = (np.add.reduceat(x, at, axis=0, dtype=np.int16) for x in sides)
                    cells = t.take(pa.array(at)).select([*by, "__part"])
                    score = t.column("score").take(pa.array(at)) if not whole else pa.nulls(len(at), pa.float64())
                    for first in range(0, replicates, WIDTH):
                        one = cells.append_column("score", score).append_column("first", pa.array(np.full(len(at), first, dtype=np.int32))).append_column("whole", pa.array(np.full(len(at), whole)))
                        for name, x in (("p", p), ("n", n)):
                            x = x[:, first : first + WIDTH]
                            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * x.shape[1])
                            one = one.append_column(name, pa.ListArray.from_arrays(ends, pa.array(x.ravel())))
                        yield from one.combine_chunks().to_batches()

    return rows.mapInArrow(draw, schema)


def _replicates(rows: DataFrame, by: tuple[str, ...], replicates: int, seed: int) -> DataFrame:
    """``by``, ``replicate``, ``roc_auc``, ``pr_auc``; NaN where a replicate has one class."""
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in by)
    cells = stored(_weighted_cells(rows, by, replicates, seed), "bootstrap-cells")
    group = (*by, "__part", "first")

    def named(t: pa.Table, columns: tuple[str, ...], **lists: np.ndarray) -> pa.Table:
        return pa.table({c: t.column(c).slice(0, 1) for c in columns} | {k: pa.array([v], pa.list_(pa.float64())) for k, v in lists.items()})

    def added(t: pa.Table) -> pa.Table:
        return named(t, group, p=_lists(t.column("p")).sum(axis=0, dtype=np.int64), n=_lists(t.column("n")).sum(axis=0, dtype=np.int64))

    def above(t: pa.Table) -> pa.Table:  # a row for each range
        t = t.sort_by([("__part", "descending")])
        p, n = (np.array(t.column(c).to_pylist()) for c in ("p", "n"))
        lists = {"tp": p.cumsum(axis=0) - p, "fp": n.cumsum(axis=0) - n, "pos": [p.sum(axis=0)] * len(t), "neg": [n.sum(axis=0)] * len(t)}
        return pa.table({c: t.column(c) for c in group} | {k: pa.array(list(v), pa.list_(pa.float64())) for k, v in lists.items()})

    def sweep(t: pa.Table, ends: pa.Table) -> pa.Table:
        null = t.column("score").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        score = t.column("score").to_numpy()
        t = t.take(pa.array(np.lexsort((-score, ~np.isnan(score), null))))  # NaN first, nulls last
        at = _starts(t, ("score",))
        p, n = (np.add.reduceat(_lists(t.column(c)), at, axis=0, dtype=np.int64) for c in ("p", "n"))
        tp, fp, pos, neg = (np.array(ends.column(c)[0].as_py()) for c in ("tp", "fp", "pos", "neg"))
        pos, neg = (np.where((pos > 0) & (neg > 0), x, np.nan) for x in (pos, neg))
        out = {m: np.zeros(p.shape[1]) for m in bootstrap.BOTH}
        for i in range(0, len(at), SWEPT):
            a, b = p[i : i + SWEPT], n[i : i + SWEPT]
            step = bootstrap.Step(a, b, tp + a.cumsum(axis=0), fp + b.cumsum(axis=0), pos, neg)
            tp, fp = step.tp[-1], step.fp[-1]
            for m, f in bootstrap.BOTH.items():
                out[m] += f(step).sum(axis=0)
        return named(t, (*by, "first"), **out)

    whole = cells.where("whole").groupBy(*group).applyInArrow(added, f"{kinds}__part int, first int, p array<double>, n array<double>")
    ends = whole.groupBy(*by, "first").applyInArrow(above, f"{kinds}__part int, first int, tp array<double>, fp array<double>, pos array<double>, neg array<double>")
    swept = cells.where("not whole").groupBy(*group).cogroup(ends.groupBy(*group)).applyInArrow(sweep, f"{kinds}first int, roc_auc array<double>, pr_auc array<double>")
    long = swept.select(*by, "first", F.posexplode(F.arrays_zip("roc_auc", "pr_auc")).alias("i", "m"))
    return long.groupBy(*by, (F.col("first") + F.col("i")).alias("replicate")).agg(F.sum("m.roc_auc").alias("roc_auc"), F.sum("m.pr_auc").alias("pr_auc"))


def bootstrap_intervals(df: DataFrame, by: tuple[str, ...], *, key: str, label: str = "y", score: str = "score", replicates: int = 1000, confidence: float = 0.95, seed: int = 20260506) -> DataFrame:
    """Percentile intervals of roc_auc and pr_auc; replicates with one class are left out.

    Draws are Poisson weights, row by row, so a replicate's size varies around that of the table. A task works out all replicates of its rows,
    sorted by score, and adds them up per score; replicates then go through ranges of scores side by side, so no draw is ever a row.
    """
    rows = df.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y"), F.col(key).cast("string").alias("__key"))
    rows = rows.withColumn("__part", ranges.range_of(F.col("score"), ranges.cuts(rows.select("score"), "score")).cast("int"))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * replicates // DRAWS))
    rows = rows.repartitionByRange(parts, *by, "score", "__key").sortWithinPartitions(*by, "score")
    each = _replicates(rows, by, replicates, seed).where(~F.isnan("roc_auc"))
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    out = []
    for m in ("roc_auc", "pr_auc"):
        out += [F.avg(m).alias(f"{m}_mean"), F.percentile(m, low).alias(f"{m}_ci_low"), F.percentile(m, high).alias(f"{m}_ci_high")]
    return each.groupBy(*by).agg(F.count("*").alias("num_bootstrap"), *out)


def scope_rows(df: DataFrame, *, split: str = "split", subset: str = "subset", test: str = "test") -> DataFrame:
    """Each row under every scope that it counts in: its split pooled, and for the test split also its subset."""
    scopes = F.when(F.col(split) == test, F.array(F.lit("pooled"), F.col(subset))).otherwise(F.array(F.lit("pooled")))
    return df.withColumn("eval_split", F.col(split)).withColumn("eval_scope", F.explode(scopes))


def metric_grid(grid: DataFrame, metrics: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Metrics on the full grid of scopes; scopes without rows are undefined, with the reason."""
    out = grid.join(metrics, list(keys), "left")
    empty = F.col("metric_status").isNull()
    return out.withColumn("failure_reason", F.when(empty, "no samples in evaluation scope").otherwise(F.col("failure_reason"))).withColumn("num_samples", F.coalesce("num_samples", F.lit(0).cast("long"))).withColumn("metric_status", F.coalesce("metric_status", F.lit("undefined")))


# The columns of a result table and what stands for an absent one.
RESULT_DEFAULTS = {"sample_id": None, "image_id": -1, "object_name": "", "subset": "", "label": 0, "prediction": 0, "score": 0.0, "fold": 0}


def result_frame(df: DataFrame, defaults: dict[str, Column] | None = None, order: str = "sample_id", *, extra: tuple[str, ...] = (), place: str | None = None) -> DataFrame:
    """Fixed columns in order: absent ones filled, sorted by sample id.

    With no ``defaults``, the columns are those of a result table and then ``extra``, absent ones of which are ''; rows
    without a sample id get one from their place in ascending order of the column ``place``, counted over ranges.
    """
    if defaults is not None:
        return df.select(*[F.col(c) if c in df.columns else v.alias(c) for c, v in defaults.items()], *[c for c in df.columns if c not in defaults]).orderBy(order)
    if "sample_id" not in df.columns:
        if place is None:
            raise ValueError("rows without a sample id need a column that orders them")
        df = ranges.ordinals(df, (), place, name="__at").withColumn("sample_id", F.format_string("row-%06d", "__at"))
    filled = [F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in RESULT_DEFAULTS.items() if c != "sample_id"]
    more = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in extra]
    return df.select(F.col("sample_id").cast("string").alias("sample_id"), *filled, *more).orderBy("sample_id")
