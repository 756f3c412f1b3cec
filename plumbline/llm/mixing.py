"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a target of words: its share of all words by weight, at most ``cap`` times what it has, with the
excess reshared by weight among the sources below. A document is then wanted ``r = target / words`` times, the same for
all of its source: ``floor(r)`` copies surely, and one more with probability ``p = r - floor(r)``. Rounding these
independently would let the words taken scatter; pivotal rounding keeps their sum:

    two units with fractional probabilities p, q and sizes s, t move mass m / s and -m / t between them, in a random
    direction with the odds that keep each expectation, until one of the two is 0 or 1.

Units of a source are dealt to blocks of about ``BLOCK`` by hash. Each block is folded pair by pair; at most one unit
stays fractional, and those residuals are dealt to blocks again: a reduction tree whose depth is the logarithm of the
largest source. Only the last residual of a source is rounded by itself, to the nearer side, so a source's words miss
the target by at most half its largest document. All draws are hashes of a seed and the units, so reruns agree however rows are partitioned.

Rows that repeat id, source and size are one unit with their number as multiplicity, so copies never pile up in one
block; its copies are dealt evenly to its rows. Null sources are one source, the last in order; null texts have size 0,
and rows of size 0 take 0 words and 0 or more copies as ``floor(r)`` says. Very long texts are counted whole and are units
like others. Other columns, whatever their names, pass through ``mix``. An empty table gives an empty result. Sources
are few (one row each meets in a window that orders them all).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

BLOCK = 64
STEP = 65_536
#: Parts by hash and by place into which rows of one id, source and size are dealt to be numbered.
PARTS = 32
CAP = 3
WEIGHTS = (1, 2, 3)
SEED = 20_240_501


def word_count(text_col: str) -> Column:
    """Number of runs without ASCII white space: after squeezing those to a mark each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.octet_length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "\u0001"), " \t\n\u000b\f\r", "")).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source (``source``): ``source_size``, ``weight``, ``target``.

    Water filling in one pass over the sources: with ``cap * size / weight`` ascending, the first k reach their cap for
    the smallest k that leaves all others below it at their share of the rest.
    """
    order = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    asc = W.orderBy("ratio", F.col("source").cast("binary").asc_nulls_last())
    before, whole = asc.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    per = per.withColumn("capped_before", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("all_size", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    level = (F.col("all_size") - F.col("capped_before")) / (F.col("all_weight") - F.col("weight_before"))
    per = per.withColumn("level", F.when(F.col("ratio") > level, level))  # the first such level is everybody's
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(asc.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _uniform(*cols: Column) -> Column:
    """From 0 up to 1, by hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _fold(units: Column, level: int, seed: int, kind: str) -> Column:
    """Folds an array of (key, size, p): ``left``, the unit that stays fractional (or null), and ``decided``, the others with ``more``, 0 or 1."""
    none = F.lit(None).cast(f"struct<key: {kind}, size: double, p: double>")
    start = F.struct(none.alias("left"), F.array().cast(f"array<struct<key: {kind}, more: int>>").alias("decided"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        # words that can go from x to a, and from a to x, until one of them is whole
        up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])
        down = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])
        gain = _uniform(F.lit(seed), F.lit(level), a["key"], x["key"]) * (up + down) < down
        a_done = F.when(gain, (1 - a["p"]) * a["size"] <= x["p"] * x["size"]).otherwise(a["p"] * a["size"] <= (1 - x["p"]) * x["size"])
        moved = F.when(gain, up).otherwise(-down)
        p = F.when(a_done, x["p"] - moved / x["size"]).otherwise(a["p"] + moved / a["size"])
        kept = F.struct(F.when(a_done, x["key"]).otherwise(a["key"]).alias("key"), F.when(a_done, x["size"]).otherwise(a["size"]).alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))
        more = F.when(a_done, F.when(gain, 1).otherwise(0)).otherwise(F.when(gain, 0).otherwise(1)).cast("int")
        out = F.array(F.struct(F.when(a_done, a["key"]).otherwise(x["key"]).alias("key"), more.alias("more")))
        joined = F.struct(kept.alias("left"), F.concat(acc["decided"], out).alias("decided"))
        return F.when(a.isNull(), F.struct(x.alias("left"), acc["decided"].alias("decided"))).otherwise(joined)

    return F.reduce(units, start, step)


def rounded(units: DataFrame, *, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``key``, ``more`` (0 or 1) for units (``key`` distinct, of any type that can be compared; ``source``, ``size`` > 0, ``p``), by a tree of pivotal folds."""
    kind = units.schema["key"].dataType.simpleString()
    counts = units.groupBy("source").agg(F.count("*").alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0  # one number
    here = units.join(counts.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    out, level = None, 0
    while True:
        blocks = F.ceil(F.col("n") / block)
        last = largest <= block
        dealt = here.withColumn("blk", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("key")), blocks))
        row = F.struct(F.xxhash64(F.lit(seed + 1), F.col("key")).alias("h"), F.struct("key", "size", "p").alias("u"))
        grouped = dealt.groupBy("source", "blk").agg(F.array_sort(F.collect_list(row)).alias("us"), F.first("n").alias("n"))
        folded = grouped.select("source", "n", _fold(F.transform("us", lambda x: x["u"]), level, seed, kind).alias("f"))
        folded = cut(folded)  # the next level and the result both read it
        decided = folded.select(F.explode("f.decided").alias("d")).select("d.key", "d.more")
        out = decided if out is None else out.unionByName(decided)
        left = folded.where("f.left is not null").select("source", F.col("f.left.key").alias("key"), F.col("f.left.size").alias("size"), F.col("f.left.p").alias("p"), F.ceil(F.col("n") / block).alias("n"))
        if last:
            alone = left.select("key", (F.col("p") >= 0.5).cast("int").alias("more"))
            return out.unionByName(alone)
        here, largest, level = left, -(-largest // block), level + 1


def copies(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text", cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Per distinct (``id``, ``source``, ``size``): ``rows`` that have it, ``source_size``, ``target``, and ``total`` copies for all of them."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (size if size is not None else word_count(text_col)).alias("size"))
    units = rows.groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
    units = cut(units)  # the texts are read once
    targets = source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), cap, weights)
    t = targets.select(F.col("source").alias("__s"), "source_size", "target")
    units = units.join(t, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    wanted = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size")) * F.col("rows")).otherwise(0.0)
    units = units.withColumn("wanted", wanted).withColumn("sure", F.floor(F.col("wanted") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("wanted") - F.col("sure")))
    units = units.withColumn("key", F.struct("id", "source", "size"))  # the unit itself: no two share it
    open_units = units.where("size > 0 and p > 1e-12").select("key", "source", F.col("size").cast("double").alias("size"), "p")
    more = rounded(open_units, seed=seed)
    out = units.join(more, "key", "left")
    return out.select("id", "source", "size", "rows", "source_size", "target", (F.col("sure") + F.coalesce(F.col("more"), F.lit(0))).cast("long").alias("total"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row per document row: its id, ``size``, ``source_size``, ``target`` and ``taken`` words."""
    c = copies(docs, **options)
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(STEP).cast("long")))  # in steps, so that no array grows with the rows
    each = c.withColumn("low", low).withColumn("k", F.explode(F.sequence(F.col("low") + 1, F.least(F.col("low") + STEP, F.col("rows")))))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * _share()).alias("taken"))


def _share() -> Column:
    """Copies of the ``k``-th of ``rows`` equal rows."""
    total, rows, k = (F.col(c) for c in ("total", "rows", "k"))
    return (F.floor(total / rows) + (k <= F.pmod(total, rows)).cast("long")).cast("long")


def _hash_of(docs: DataFrame) -> Column:
    """Of all columns; what has no hash of its own, such as a map, by its JSON."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return F.xxhash64(*(F.to_json(F.struct(q(c))) if re.search("map<|variant", t) else q(c) for c, t in docs.dtypes))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, columns unchanged.

    Rows that share id, source and size are numbered by the hash of all their columns: counted by parts of hashes and
    places in the input first, so no task orders more than one part of them.
    """
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    c = copies(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    named = c.select(F.struct("id", "source", "size").alias("unit"), "rows", "total")
    unit = F.struct(q(id_col).alias("id"), q(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    rows = docs.select(F.struct(*(q(x) for x in docs.columns)).alias("row"), unit.alias("unit"), _hash_of(docs).alias("h"), F.monotonically_increasing_id().alias("place"))
    here = rows.join(named, "unit").where("total > 0")
    alone = here.where("rows = 1").select("row", "total")
    many = here.where("rows > 1").withColumn("part", F.struct(F.pmod("h", F.lit(PARTS)).alias("h"), F.pmod("place", F.lit(PARTS)).alias("p")))
    sizes = many.groupBy("unit", "part").agg(F.count("*").alias("m"))
    before = F.sum("m").over(W.partitionBy("unit").orderBy("part")) - F.col("m")  # PARTS * PARTS rows at most
    offsets = sizes.select("unit", "part", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("unit", "part").orderBy("h", "place"))
    dealt = many.join(offsets, ["unit", "part"]).withColumn("k", F.col("before") + inside).select("row", _share().alias("total"))
    out = alone.unionByName(dealt).where("total > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total")))).select("row.*")
