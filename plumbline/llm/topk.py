"""Exact top-k search by inner product: norm-bucketed retrieval.

Rows are ordered by length, longest first, over range partitions, and packed into buckets of ``BUCKET_ROWS`` rows; runs of
buckets of up to ``SHARD_NUMBERS`` numbers make a shard. Every query is first held against the longest bucket (bounded, sent
to all tasks), which gives it a first threshold: its k-th best product so far. It is then sent to those shards whose longest
vector can still reach that threshold. In a shard a query goes through the buckets from the longest on and stops at the first
whose longest vector falls short of its threshold, which rises on the way. In each bucket the local cosine threshold, that is
threshold / (query's length * bucket's greatest length), picks the way of pruning:

* by coordinate, where it is high: of the query's largest coordinates, the one whose feasible range in the bucket's list,
  sorted by that coordinate of the unit vectors, holds fewest rows gives the candidates, and the others thin them out;
* by length, else: the rows that are long enough to reach the threshold, the head of the bucket.

Candidates are verified by exact products. Bounds are rounded so that no row that could tie is lost. A threshold below zero
prunes nothing. Products are exact: in doubles while lengths multiply to less than 2^53, else in 64-bit integers; where a
product might not fit into 64 bits, ValueError is raised.

Rows with equal vectors are folded before packing to the k + 1 with the smallest ids, as no others can be among k answers,
and queries with equal vectors are searched once. A query's candidates are all rows but its own; rows that repeat an id, or
all of a row, are candidates each. Vectors that are null or hold a null or a non-finite number take no part, nor do rows
without an id. A shorter vector counts as followed by zeros, an empty one as zero. Other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, tidy

BUCKET_ROWS, SHARD_NUMBERS, SHARD_QUERIES = 2_048, 1 << 22, 1 << 18
#: Queries that a task holds at once, and numbers of products: what one step of a bucket takes.
QUERY_ROWS, PRODUCTS = 1_024, 1 << 21
#: Coordinates of a query that are tried, and the local cosine threshold from which on they are.
FOCUS, COSINE = 4, 0.5
#: Bounds in doubles are eased by this share.
EASE = 1e-9

_PACKED = "part int, bucket int, rows int, dim int, longest double, ids binary, values binary"
_BEST = pa.schema([("query", pa.int64()), ("found", pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())])))])


def lengths(values: np.ndarray) -> np.ndarray:
    """Rounded upwards, so that a product of two is never too small a bound."""
    x = values.astype(np.float64)
    return np.sqrt((x * x).sum(axis=1)) * (1 + EASE)


@dataclass
class Bucket:
    """Rows of about one length, longest first; what coordinate pruning needs is made when first asked for."""

    ids: np.ndarray
    values: np.ndarray
    norms: np.ndarray = field(init=False)
    doubles: np.ndarray = field(init=False)
    units: np.ndarray | None = None
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self):
        self.norms, self.doubles = lengths(self.values), self.values.astype(np.float64)

    def list_of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The unit vectors' coordinate f in ascending order, and their rows."""
        if self.units is None:
            self.units = self.doubles / np.where(self.norms > 0, self.norms, 1)[:, None]
        if f not in self.lists:
            order = np.argsort(self.units[:, f], kind="stable")
            self.lists[f] = self.units[order, f], order
        return self.lists[f]


class Best:
    """The best k entries of each query of a batch: scores, ids (ties to the smaller), and the threshold that others must reach."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(np.float64)
        self.scores: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids):
            return
        scores, ids = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        order = np.lexsort((ids, ~scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], float(self.scores[q][-1]) - abs(float(self.scores[q][-1])) * EASE)


def products(queries: np.ndarray, norms: np.ndarray, b: Bucket, rows: np.ndarray | slice) -> np.ndarray:
    """Exact inner products, queries by rows."""
    most = float(norms.max(initial=0)) * float(b.norms[0] if len(b.norms) else 0)
    if most < 2.0**53:
        return np.rint(queries.astype(np.float64) @ b.doubles[rows].T).astype(np.int64)
    if most >= 2.0**63:
        raise ValueError("an inner product might not fit into 64 bits")
    return queries @ b.values[rows].T


def candidates(b: Bucket, unit: np.ndarray, cosine: float, most: int) -> np.ndarray | None:
    """Rows of a bucket that the feasible ranges of a query's largest coordinates leave; none if these leave more than ``most``."""
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    slack = np.sqrt(max(0.0, 1 - cosine * cosine)) * np.sqrt(np.maximum(0, 1 - unit[focus] ** 2))
    low, high = unit[focus] * cosine - slack - 1e-7, unit[focus] * cosine + slack + 1e-7
    # beyond the cosine of the query's own axis the range is open to that side
    low, high = np.where(-unit[focus] > cosine, -np.inf, low), np.where(unit[focus] > cosine, np.inf, high)
    spans = []
    for f, lo, hi in zip(focus, low, high, strict=True):
        x, _ = b.list_of(int(f))
        spans.append((np.searchsorted(x, lo, side="left"), np.searchsorted(x, hi, side="right")))
    sizes = [e - s for s, e in spans]
    best = int(np.argmin(sizes))
    if sizes[best] > most:
        return None
    rows = b.list_of(int(focus[best]))[1][spans[best][0] : spans[best][1]]
    for f, lo, hi in zip(focus, low, high, strict=True):
        x = b.units[rows, f]
        rows = rows[(x >= lo) & (x <= hi)]
    return rows


def retrieve(b: Bucket, queries: np.ndarray, norms: np.ndarray, best: Best, seen: dict[str, int] | None = None) -> None:
    """Holds queries against a bucket, each by the way of pruning that its local threshold calls for."""
    if not len(b.ids):
        return
    reach = norms * b.norms[0] * (1 + EASE)
    alive = np.flatnonzero((best.least <= 0) | (reach >= best.least))
    heads: list[tuple[int, int]] = []
    for q in alive.tolist():
        least = best.least[q]
        if least <= 0:
            heads.append((len(b.ids), q))
            continue
        head = int(np.searchsorted(-b.norms, -(least / norms[q]) * (1 - EASE), side="right"))
        cosine = least / reach[q]
        rows = candidates(b, queries[q] / norms[q], cosine, head // 4) if cosine >= COSINE else None
        if rows is None:
            heads.append((head, q))
        elif len(rows):
            best.add(q, products(queries[q : q + 1], norms[q : q + 1], b, rows)[0], b.ids[rows])
        if seen is not None:
            seen["length" if rows is None else "coordinate"] = seen.get("length" if rows is None else "coordinate", 0) + (head if rows is None else len(rows))
    heads.sort()
    while heads:  # those with heads of about one size together
        most = heads[-1][0]
        step = [q for h, q in heads if 2 * h >= most][-max(1, PRODUCTS // max(1, most)) :]
        heads = heads[: len(heads) - len(step)]
        scores = products(queries[step], norms[step], b, slice(0, most))
        floor = np.maximum(best.least[step], np.partition(scores, -best.k, axis=1)[:, -best.k] if most >= best.k else -np.inf)
        at, row = np.nonzero(scores >= floor[:, None])
        ends = np.searchsorted(at, np.arange(len(step) + 1))
        for k, q in enumerate(step):
            found = row[ends[k] : ends[k + 1]]
            best.add(q, scores[k, found], b.ids[found])


def padded(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix, shorter rows filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), dtype=np.int64)
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def packed(dim: int, rows_of: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (part, id, v) in order of length: a row for each bucket of ``rows_of`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = bucket = part = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, bucket
            if not n:
                return
            ids, values = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = list(range(rows_of, n + 1, rows_of)) + ([n] if last and n % rows_of else [])
            start = 0
            for end in ends:
                own = values[start:end]
                longest = float(lengths(own).max(initial=0))
                yield pa.record_batch([pa.array([x], kind) for x, kind in ((part, pa.int32()), (bucket, pa.int32()), (end - start, pa.int32()), (dim, pa.int32()), (longest, pa.float64()), (ids[start:end].tobytes(), pa.binary()), (own.tobytes(), pa.binary()))], names=["part", "bucket", "rows", "dim", "longest", "ids", "values"])
                bucket, start = bucket + 1, end
            held, n = [(ids[start:], values[start:])], n - start

        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                held.append((batch.column(1).to_numpy(), padded(batch.column(2), dim)))
                n += batch.num_rows
                if n >= rows_of:
                    yield from out(False)
        yield from out(True)

    return run


def opened(ids: bytes, values: bytes, dim: int) -> Bucket:
    return Bucket(np.frombuffer(ids, dtype=np.int64), np.frombuffer(values, dtype=np.int64).reshape(-1, dim))


def search(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "vector", k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the rows with the highest inner products for each row that ``is_query`` (of ``id``) marks. Vectors are of whole numbers (array<long>)."""
    spark = rows.sparkSession
    valid = stored(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null)"), "topk-rows")
    asked = valid.where(is_query)
    found = stored(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("query"), "v"), "topk-queries")
    sizes = valid.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    n_queries = found.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, keep = max(1, sizes["dim"]), k + 1
    own = spark.sparkContext.defaultParallelism
    rows_of = max(1, min(BUCKET_ROWS, SHARD_NUMBERS // dim))
    parts = max(own, -(-sizes["n"] * dim // SHARD_NUMBERS))  # of at most so many numbers each, about

    nth = F.row_number().over(W.partitionBy("v").orderBy("id"))
    folded = valid.select("v", "id", nth.alias("nth")).where(F.col("nth") <= keep).select("id", "v")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    ordered = folded.withColumn("norm", norm2).repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    index = stored(ordered.select(F.spark_partition_id().alias("part"), "id", "v").mapInArrow(tidy(packed(dim, rows_of)), _PACKED), "topk-buckets")
    shards = index.groupBy("part").agg(F.max("longest").alias("longest")).orderBy("part").collect()  # one for each partition
    first = index.orderBy("part", "bucket").limit(1).first()  # one bucket
    seed = spark.sparkContext.broadcast((first["ids"], first["values"]))
    salts = max(-(-n_queries // SHARD_QUERIES), -(-2 * own // len(shards)))
    reaches = np.array([s["longest"] for s in shards])
    numbers = [s["part"] for s in shards]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = opened(*seed.value, dim)
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_ROWS):
                own = batch.slice(start, QUERY_ROWS)
                values = padded(own.column(1), dim)
                norms = lengths(values)
                best = Best(len(values), keep, np.full(len(values), -np.inf))
                retrieve(bucket, values, norms, best)
                least = best.least
                far = np.where(least > 0, least / np.where(norms > 0, norms, 1e-300) * (1 - EASE), -np.inf)
                needed = [numbers[:m] for m in np.searchsorted(-reaches, -far, side="right").tolist()]
                yield pa.record_batch([own.column(0), own.column(1), pa.array(least), pa.array(needed, pa.list_(pa.int32()))], names=["query", "v", "least", "parts"])

    routes = found.mapInArrow(tidy(routed), "query long, v array<bigint>, least double, parts array<int>")
    salt = F.pmod(F.xxhash64("query"), F.lit(salts)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    asking = routes.select(F.explode("parts").alias("part"), salt.alias("salt"), F.lit(1).alias("kind"), F.lit(0).alias("bucket"), none("binary").alias("ids"), none("binary").alias("values"), "query", "v", "least")
    there = index.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "bucket", "ids", "values", none("long").alias("query"), none("array<bigint>").alias("v"), none("double").alias("least"))
    meeting = there.unionByName(asking).repartition(F.col("part"), F.col("salt")).sortWithinPartitions("part", "salt", "kind", "bucket")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets of a shard come first and are held, then its queries pass by."""
        shard: list[Bucket] = []
        waiting: list[pa.RecordBatch] = []
        at = None

        def out() -> Iterator[pa.RecordBatch]:
            if waiting:
                rows = pa.Table.from_batches(waiting).combine_chunks()
                waiting.clear()
                values = padded(rows.column("v").combine_chunks(), dim)
                norms = lengths(values)
                best = Best(len(values), keep, rows.column("least").to_numpy())
                for bucket in shard:
                    retrieve(bucket, values, norms, best)
                tops = [[{"score": s, "id": i} for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] for scores, ids in zip(best.scores, best.ids, strict=True)]
                yield pa.record_batch([rows.column("query").combine_chunks(), pa.array(tops, _BEST.field("found").type)], schema=_BEST)

        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("part", "salt", "kind")), strict=True))
            start = 0
            while start < len(key):
                if key[start][:2] != at:
                    yield from out()
                    shard, at = [], key[start][:2]
                if key[start][2] == 0:
                    shard.append(opened(batch.column("ids")[start].as_py(), batch.column("values")[start].as_py(), dim))
                    start += 1
                    continue
                end = start + 1
                while end < len(key) and key[end] == key[start]:
                    end += 1
                waiting.append(batch.slice(start, end - start).select(["query", "v", "least"]))
                if sum(x.num_rows for x in waiting) >= QUERY_ROWS:
                    yield from out()
                start = end
        yield from out()

    # few rows to an Arrow batch, as a bucket is a row of 8 bytes for each of its numbers
    partial = stored(meeting.mapInArrow(tidy(met), "query long, found array<struct<score: bigint, id: bigint>>"), "topk-found", batch_rows=32)
    # at most k + 1 entries from each shard: the best of all, ties to the smaller id
    entries = partial.select("query", F.explode("found").alias("e")).select("query", "e.score", "e.id")
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    entries = entries.withColumn("nth", nth).where(F.col("nth") <= keep)
    tops = entries.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "id"))).alias("top"))
    answers = found.join(tops, "query").select("v", "top")
    mine = asked.join(answers, "v")
    itself = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    mine = mine.select("id", "top", itself.alias("itself"))
    own_at = F.aggregate("top", F.lit(keep), lambda a, e: F.when((a == keep) & (e["id"] == F.col("id")) & (e["score"] == F.col("itself")), e["nth"] - 1).otherwise(a))
    others = F.slice(F.filter("top", lambda e: e["nth"] - 1 != F.col("own")), 1, k)
    mine = mine.withColumn("own", own_at).select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "e"))
    return mine.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), "e.score")
