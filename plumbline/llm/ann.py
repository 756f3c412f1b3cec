"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a sample of the rows that grows with the table (one in ``SAMPLE_SHARE``, ``SAMPLE_ROWS`` at least,
``SAMPLE_VALUES`` numbers at most: beyond that, leaves grow); every row is then indexed: it goes down the tree to its leaf.
A query walks the tree with a priority queue of nodes by distance from their centre, nearest first; leaves are visited in
the order in which they leave the queue. How many are visited is calibrated on a sample of the queries themselves:
visits are widened until the mean recall of their neighbours in the sample reaches ``TARGET``. That is done by bins of
how far a query lies from its leaf's centre, compared with the leaf's own rows, so outliers get the visits that they need;
a walk also goes on until its leaves hold more rows of other ids than are asked for.

Rows and visits meet by block: leaves are packed into blocks of about ``BLOCK_ROWS`` rows, and a leaf with more is cut
into salted blocks of its own, so one vector that a third of all rows share is spread out. A block that many queries
visit is copied, once for each ``BLOCK_QUERIES`` of them; blocks that none visits are left out. A block gives each of its
queries the nearest rows of the leaves that the query visits, and no others.

Vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do those whose length is not the most
frequent one, nor rows without an id. A query's candidates are all rows with another id; ties go to the smaller id.
Repeated rows are candidates each; a repeated query id is searched once, with the smallest of its vectors. Numbers of
any size are taken: distances are scaled where squares would overflow or vanish. Extra columns are left out, and an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_VALUES = 20_000, 50, 1 << 24
BRANCHES, LEAF_ROWS = 8, 48
TARGET, CALIBRATION_QUERIES, BINS = 0.97, 256, 8
BLOCK_ROWS, BLOCK_QUERIES = 2_048, 4_096


class Tree:
    """Nodes as arrays: centres, first child and number of children (0 at a leaf), and the leaf's number. Vectors are scaled by a power of two on the way in."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scale = 2.0 ** -max(-1000, min(1000, int(np.frexp(np.abs(sample).max())[1])))
        sample = self.scaled(sample)
        centres, first, n_children = [sample.mean(axis=0)], [0], [0]
        open_nodes = [(0, np.arange(len(sample)))]
        for node, rows in open_nodes:  # grows while it is walked, level by level
            if len(rows) <= leaf_rows:
                continue
            parts = split(sample[rows], branches, rng)
            if parts is None:
                continue
            first[node], n_children[node] = len(centres), len(parts)
            for centre, part in parts:
                open_nodes.append((len(centres), rows[part]))
                centres.append(centre)
                first.append(0)
                n_children.append(0)
        self.centres = np.array(centres)
        self.first, self.n_children = np.array(first), np.array(n_children)
        self.leaf_of = np.where(self.n_children == 0, np.cumsum(self.n_children == 0) - 1, -1)
        self.leaves = int((self.n_children == 0).sum())
        at = self.nodes_of(sample)
        far = np.bincount(at, weights=((sample - self.centres[at]) ** 2).sum(axis=1), minlength=len(centres))
        self.spread = np.sqrt(far / np.maximum(np.bincount(at, minlength=len(centres)), 1))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x * self.scale, -1e100, 1e100)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        return self.leaf_of[self.nodes_of(self.scaled(x))]

    def remoteness(self, x: np.ndarray) -> np.ndarray:
        """How far each row lies from its leaf's centre, as compared with the sample's rows there."""
        x = self.scaled(x)
        at = self.nodes_of(x)
        return np.sqrt(((x - self.centres[at]) ** 2).sum(axis=1)) / (self.spread[at] + 1e-12)

    def nodes_of(self, x: np.ndarray) -> np.ndarray:
        """The nearest child at each node on the way."""
        node = np.zeros(len(x), dtype=np.int64)
        moving = np.flatnonzero(self.n_children[node] > 0)
        while len(moving):
            order = moving[np.argsort(node[moving], kind="stable")]
            at, starts = np.unique(node[order], return_index=True)
            for k, rows in zip(at, np.split(order, starts[1:]), strict=True):
                c = self.centres[self.first[k] : self.first[k] + self.n_children[k]]
                node[rows] = self.first[k] + squares(x[rows], c).argmin(axis=1)
            moving = moving[self.n_children[node[moving]] > 0]
        return node

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        q, queue = self.scaled(q), [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if n := int(self.n_children[node]):
                a = int(self.first[node])
                d = ((self.centres[a : a + n] - q) ** 2).sum(axis=1)
                for k in range(n):
                    heapq.heappush(queue, (float(d[k]), a + k))
            else:
                yield int(self.leaf_of[node])

    def visits(self, q: np.ndarray, least: int, counts: np.ndarray, rows: int) -> list[int]:
        """At least ``least`` leaves, and until they hold ``rows`` rows; leaves without rows are passed over."""
        out, held, walked = [], 0, 0
        for leaf in self.walk(q):
            if walked >= least and held >= rows:
                break
            walked += 1
            if counts[leaf]:
                out.append(leaf)
                held += int(counts[leaf])
        return out


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


def split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """k-means of some rows: centre and rows of each part; none if the rows are all alike."""
    centres = x[rng.integers(len(x))][None]
    while len(centres) < k:  # k-means++ seeding
        d = np.maximum(squares(x, centres).min(axis=1), 0)
        d[d < 1e-12 * max(1.0, float((x * x).sum(axis=1).max()))] = 0
        if not d.any():
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum())]])
    if len(centres) < 2:
        return None
    for _ in range(rounds):
        part = squares(x, centres).argmin(axis=1)
        centres = np.array([x[part == j].mean(axis=0) if (part == j).any() else centres[j] for j in range(len(centres))])
    part = squares(x, centres).argmin(axis=1)
    out = [(centres[j], np.flatnonzero(part == j)) for j in range(len(centres)) if (part == j).any()]
    return out if len(out) > 1 else None


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """From the differences themselves; scaled where their squares would leave the range of doubles."""
    apart = np.abs(x - q)
    most = apart.max(axis=1, initial=0)
    d = np.sqrt((apart * apart).sum(axis=1)) if (most < 1e150).all() else np.full(len(x), np.inf)
    odd = np.flatnonzero((most >= 1e150) | (most < 1e-150) & (most > 0)) if len(x) else []
    if len(odd):
        few = np.flatnonzero((most < 1e150) & (most >= 1e-150) | (most == 0))
        d[few] = np.sqrt((apart[few] ** 2).sum(axis=1))
        d[odd] = most[odd] * np.sqrt(((apart[odd] / most[odd, None]) ** 2).sum(axis=1))
    return d


@dataclass
class Calibration:
    """Least visits by remoteness: ``visits[i]`` below ``edges[i]``, the last beyond all."""

    edges: np.ndarray
    visits: np.ndarray

    def least(self, remoteness: np.ndarray) -> np.ndarray:
        return self.visits[np.searchsorted(self.edges, remoteness, side="right")]


def calibrate(tree: Tree, ids: np.ndarray, sample: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, target: float = TARGET, bins: int = BINS) -> Calibration:
    """For each bin of queries, the fewest leaf visits with which the mean recall of their neighbours in the sample reaches ``target``."""
    leaf, far = tree.assign(sample), tree.remoteness(queries)
    found_at = []
    for i, q in zip(query_ids, queries, strict=True):
        d = distances(sample, q)
        d[ids == i] = np.inf
        near = np.argsort(d, kind="stable")[:k]
        rank = np.empty(tree.leaves, dtype=np.int64)
        rank[list(tree.walk(q))] = np.arange(tree.leaves)
        found_at.append(rank[leaf[near[ids[near] != i]]] + 1)
    visits, edges = [], []
    parts = np.array_split(np.argsort(far, kind="stable"), min(bins, len(far)))
    for j, part in enumerate(parts):
        flat = np.sort(np.concatenate([found_at[x] for x in part]))
        visits.append(int(flat[min(len(flat) - 1, int(np.ceil(target * len(flat))))]) if len(flat) else 1)
        if j:
            edges.append(far[part[0]])
    return Calibration(np.array(edges), np.maximum.accumulate(np.array(visits)))  # the more remote, the more visits


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` of the rows that take part, before lengths are compared."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    return out.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def matrix(a: pa.Array, dim: int) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(a), dim)


def nearest(index_ids: np.ndarray, index: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows with another id the ``k`` nearest: ids and distances."""
    other = index_ids != query_id
    ids, d = index_ids[other], distances(index[other], query)
    few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    few = few[np.lexsort((ids[few], d[few]))][:k]
    return ids[few], d[few]


def packed(counts: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The first block of each leaf: small leaves share one up to ``BLOCK_ROWS`` rows, a larger leaf has as many of its own as salts."""
    out, block, held = np.zeros(len(counts), dtype=np.int64), 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK_ROWS:
            block, held = block + 1, 0
        out[leaf], held = block, held + n
        if salts[leaf] > 1:
            block, held = block + int(salts[leaf]), 0
    return out


def folded(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the rows with the k + 1 smallest ids, k of each: no others can be among k neighbours. What a task may leave out it leaves out before the shuffle."""
    same = W.partitionBy("v").orderBy("id")
    rows = rows.withColumn("__d", F.dense_rank().over(same)).where(F.col("__d") <= k + 1).drop("__d")
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("v", "id").orderBy("id"))).where(F.col("__n") <= k).drop("__n")


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, target: float = TARGET, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (Euclidean distance) of the nearest found to each row that ``is_query`` (of ``id_col``) marks."""
    spark = rows.sparkSession
    found = valid(rows, id_col, vector_col)
    lengths = found.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return none
    dim, n_rows = lengths[0]["dim"], lengths[0]["n"]
    found = found.where(F.size("v") == dim)
    queries = found.where(is_query).groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    found = folded(found, k)

    def sample_of(df: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        t = df.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id", "v").limit(most).select("id", "v").toArrow().combine_chunks()
        return t.column("id").to_numpy(), matrix(t.column("v").combine_chunks() if len(t) else pa.array([], pa.list_(pa.float64())), dim)

    asked_ids, asked = sample_of(queries, CALIBRATION_QUERIES)
    if not len(asked):
        return none
    ids, sample = sample_of(found, max(1, min(max(sample_rows, n_rows // SAMPLE_SHARE), SAMPLE_VALUES // dim)))  # bounded
    tree = Tree(sample)
    plan = calibrate(tree, ids, sample, asked_ids, asked, k, target)
    shared = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def leaf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array(shared.value.assign(matrix(x, dim)).astype(np.int32) if len(x) else [], type=pa.int32())

    index = stored(found.withColumn("leaf", leaf("v")), "ann-index")
    counts = np.zeros(tree.leaves, dtype=np.int64)
    for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # as many rows as leaves
        counts[r["leaf"]] = r["n"]
    salts = np.maximum(1, -(-counts // BLOCK_ROWS))
    firsts = packed(counts, salts)

    @F.arrow_udf("long")
    def block(leaf: pa.Array, h: pa.Array) -> pa.Array:
        at = leaf.to_numpy()
        return pa.array(firsts[at] + (h.to_numpy().view(np.uint64) % salts[at].astype(np.uint64)).astype(np.int64))

    @F.arrow_udf("array<struct<block: bigint, leaves: array<int>>>")
    def visited(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        t = shared.value
        for x, own in batches:
            out, m = [], matrix(x, dim) if len(x) else np.zeros((0, dim))
            least = plan.least(t.remoteness(m)) if len(m) else ()
            for q, n, rows in zip(m, least, own.to_pylist(), strict=True):
                by: dict[int, list[int]] = {}
                for leaf in t.visits(q, int(n), counts, k + rows):
                    for s in range(int(salts[leaf])):
                        by.setdefault(int(firsts[leaf]) + s, []).append(leaf)
                out.append([{"block": b, "leaves": v} for b, v in by.items()])
            yield pa.array(out, type=pa.list_(pa.struct([("block", pa.int64()), ("leaves", pa.list_(pa.int32()))])))

    probes = stored(queries.withColumn("p", F.explode(visited("v", "own"))).select("p.block", "p.leaves", "id", "v"), "ann-probes")
    parts = probes.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("parts"))
    asking = probes.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
    there = index.withColumn("block", block("leaf", F.xxhash64("id"))).join(parts, "block")
    there = there.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("block", "part", "leaf", "id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        (ids, x), (query_ids, q) = ((t.column("id").to_numpy(), matrix(t.column("v").combine_chunks(), dim)) for t in (left, right))
        leaf, out = left.column("leaf").to_numpy(), []
        for query_id, v, leaves in zip(query_ids.tolist(), q, right.column("leaves").to_pylist(), strict=True):
            here = np.isin(leaf, leaves)
            near, d = nearest(ids[here], x[here], query_id, v, k)
            out.append((np.full(len(near), query_id), near, d))
        return pa.table([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], schema=_FOUND)

    near = there.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
