"""Language-model scoring by deleted interpolation of word n-grams.

Maximum-likelihood estimates of all orders up to ``order`` and a uniform one are mixed with weights that depend on how
often the context was seen (a bucket per power of two). The weights are learned by expectation-maximisation on the
counts of a held-out fold of the training documents, whose own counts are deleted from the estimates meanwhile; then
the estimates use all training documents.

How it runs:

1. ``pack``: tasks turn whole texts into chunks of about ``CHUNK`` tokens (words as ids of a chunk's own vocabulary),
   which are written to the shared folder once.
2. ``count``: each chunk sends its distinct n-grams with their counts, as sorted arrays cut by key range, to that
   range's group, which adds them up over all chunks and sends each chunk the totals of its own n-grams. The number of
   ranges grows with the input, so a group's memory does not. A frequent n-gram is one entry per chunk: no hot keys.
   Keys are hashes of ``key_bits`` bits, ``SPARE`` more than it takes to number the corpus's tokens (64 at most): any
   n-gram shares its key with another one with a chance of ``2**-SPARE`` at most, at every size of the corpus.
3. ``score``: a chunk meets its totals again, and every token is scored there. Nothing that grows with the corpus goes
   through the driver: it gets sums, and a histogram of held-out tokens over a fixed grid of estimates.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, then one end token. A null text counts as empty (just
the end token). Without training documents every estimate but the uniform one is zero. Repeated rows stay repeated;
other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import END, combine, stored, text_slices, word_hashes

CHUNK = 1 << 20  # tokens
RANGE = 1 << 21  # n-grams that a group adds up, about
ORDER = 3
SPARE = 24
BUCKETS = 24
GRID = 2  # steps of the histogram to a power of two
_BEGIN = np.uint64(0x6A09E667F3BCC909)

_CHUNK = pa.schema([("chunk", pa.int64()), ("fold", pa.int32()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("vocab", pa.binary()), ("tokens", pa.binary())])
_CHUNK_DDL = "chunk long, fold int, ids array<bigint>, lengths array<int>, vocab binary, tokens binary"
_SENT = pa.schema([("n", pa.int32()), ("range", pa.int64()), ("chunk", pa.int64()), ("fold", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SENT_DDL = "n int, range long, chunk long, fold int, keys binary, counts binary"
_TOTAL = pa.schema([("n", pa.int32()), ("range", pa.int64()), ("chunk", pa.int64()), ("fold", pa.int32()), ("totals", pa.binary()), ("held", pa.binary()), ("known", pa.int64())])
_TOTAL_DDL = "n int, range long, chunk long, fold int, totals binary, held binary, known long"
_SCORE = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORE_DDL = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

#: Folds of documents: scored only; trained on; trained on, and held out while weights are learned.
SCORED, TRAINED, DELETED = 0, 1, 2


def planes(values: np.ndarray) -> bytes:
    """Bytes of the same place together, so that the zeros of small numbers compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes | pa.Buffer, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack(docs: DataFrame, id_col: str, text_col: str, fold: Column, size: int = CHUNK) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")), fold.cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held = {f: ([], [], [], 0) for f in (SCORED, TRAINED, DELETED)}

        def flush(f: int) -> pa.RecordBatch:
            nonlocal made
            ids, lengths, hashes, _ = held[f]
            vocab, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            held[f] = ([], [], [], 0)
            made += 1
            return pa.RecordBatch.from_pylist([{"chunk": part << 32 | made, "fold": f, "ids": ids, "lengths": lengths, "vocab": vocab.tobytes(), "tokens": planes(tokens.astype(np.uint32))}], schema=_CHUNK)

        for batch in batches:
            ids, texts, folds = (batch.column(k).to_pylist() for k in range(3))
            for a, b in text_slices(texts):
                words, counts = word_hashes([t.encode() for t in texts[a:b]])
                at = 0
                for k, n in zip(range(a, b), counts.tolist(), strict=True):
                    f = folds[k]
                    i, lengths, hashes, total = held[f]
                    i.append(ids[k])
                    lengths.append(n + 1)
                    hashes += [words[at : at + n], np.array([END])]
                    at += n
                    held[f] = (i, lengths, hashes, total + n + 1)
                    if total + n + 1 >= size:
                        yield flush(f)
        for f, (i, *_) in list(held.items()):
            if i:
                yield flush(f)

    return rows.mapInArrow(run, _CHUNK_DDL)


def key_bits(tokens: int) -> int:
    return min(64, max(1, tokens).bit_length() + SPARE)


class Chunk:
    """A chunk's tokens, the places of their n-grams of each order among the distinct ones, and, if wanted, the keys of these."""

    def __init__(self, row: dict, order: int, bits: int, keyed: bool = False):
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        vocab = np.frombuffer(row["vocab"], dtype=np.uint64)
        words = vocab[from_planes(row["tokens"], np.uint32)]
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.keys, self.places = [], []
        gram, begin = words, _BEGIN
        for n in range(1, order + 1):
            if n > 1:
                before = np.concatenate((gram[:1], gram[:-1]))
                before[self.starts] = begin
                gram = combine(before, words)
                begin = combine(np.array([begin]), np.array([_BEGIN]))[0]
            k, p = np.unique(gram >> np.uint64(64 - bits), return_inverse=True)
            if keyed:
                self.keys.append(k)
            self.places.append(p.astype(np.int32))


def cut_points(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each key range starts among sorted keys, and the end."""
    edges = [min((r << bits) // ranges, (1 << bits) - 1) for r in range(1, ranges)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)]))


def count(chunks: DataFrame, order: int, ranges: int, bits: int) -> DataFrame:
    """Per chunk, order and key range: total and held-out counts of the chunk's n-grams, in the order of their keys."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                c = Chunk(row, order, bits, keyed=True)
                out = []
                for n, (keys, places) in enumerate(zip(c.keys, c.places, strict=True), 1):
                    counts = np.bincount(places, minlength=len(keys)).astype(np.uint32)
                    cuts = cut_points(keys, ranges, bits)
                    for r in np.flatnonzero(np.diff(cuts)).tolist():
                        a, b = cuts[r], cuts[r + 1]
                        out.append({"n": n, "range": r, "chunk": row["chunk"], "fold": row["fold"], "keys": planes(np.diff(keys[a:b], prepend=np.uint64(0))), "counts": planes(counts[a:b])})
                yield pa.RecordBatch.from_pylist(out, schema=_SENT)

    def add(group: pa.Table) -> pa.Table:
        rows = group.select(["n", "range", "chunk", "fold"]).to_pylist()
        keys = np.concatenate([np.cumsum(from_planes(x.as_buffer(), np.uint64), dtype=np.uint64) for x in group.column("keys")])
        sizes = [len(x.as_buffer()) >> 2 for x in group.column("counts")]
        counts = np.concatenate([from_planes(x.as_buffer(), np.uint32) for x in group.column("counts")])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        del keys
        starts = np.flatnonzero(fresh)
        place = np.empty(len(order), dtype=np.int32)  # of each entry among the distinct keys
        place[order] = np.cumsum(fresh, dtype=np.int32) - 1
        folds = np.repeat(np.array([r["fold"] for r in rows], dtype=np.int8), sizes)[order]
        counts = counts[order].astype(np.int64)
        del order
        total = np.add.reduceat(counts * (folds != SCORED), starts).astype(np.uint64)
        held = np.add.reduceat(counts * (folds == DELETED), starts).astype(np.uint64)
        del counts, folds
        known, out, at = int((total > 0).sum()), [], 0
        for r, size in zip(rows, sizes, strict=True):
            p = place[at : at + size]
            at += size
            out.append(r | {"totals": planes(total[p]), "held": planes(held[p]) if r["fold"] == DELETED else b"", "known": known})
            known = 0  # once a group
        return pa.Table.from_pylist(out, schema=_TOTAL)

    return chunks.mapInArrow(send, _SENT_DDL).groupBy("n", "range").applyInArrow(add, _TOTAL_DDL)


def _totals(right: pa.Table, order: int, column: str) -> list[np.ndarray]:
    """Per order, the counts of the chunk's keys."""
    n, r, values = right.column("n").to_numpy(), right.column("range").to_numpy(), right.column(column)
    at = np.lexsort((r, n))
    parts = lambda k: [from_planes(values[i].as_buffer(), np.uint64).view(np.int64) for i in at[n[at] == k].tolist()]
    return [np.concatenate(parts(k) or [np.zeros(0, np.int64)]) for k in range(1, order + 1)]


def seen_contexts(c: Chunk, totals: list[np.ndarray], n: int, n_tokens: int, n_docs: int) -> np.ndarray:
    """How often each token's context of ``n - 1`` words was seen."""
    if n == 1:
        return np.full(len(c.places[0]), n_tokens, dtype=np.int64)
    before = totals[n - 2][c.places[n - 2]]
    seen = np.concatenate((before[:1], before[:-1]))
    seen[c.starts] = n_docs
    return seen


def estimates(c: Chunk, totals: list[np.ndarray], n_tokens: int, n_docs: int) -> Iterator[np.ndarray]:
    """Maximum-likelihood estimates of each token, order by order."""
    for n, (t, p) in enumerate(zip(totals, c.places, strict=True), 1):
        seen = seen_contexts(c, totals, n, n_tokens, n_docs)
        yield t[p] / np.maximum(seen, 1) * (seen > 0)


def bucket_of(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(seen.astype(np.float64))[1], BUCKETS - 1)


_NONE, _PLACES = -8191, 1 << 13  # the mark of no estimate, and how many places of the grid there are at most


def cells_of(bucket: np.ndarray, p: Iterator[np.ndarray]) -> np.ndarray:
    """A number for each token: its bucket and the grid places of its estimates."""
    out = bucket.astype(np.int64)
    for x in p:
        place = np.maximum(np.round(np.log2(np.where(x > 0, x, 1)) * GRID), _NONE + 1)
        out = out * _PLACES - np.where(x > 0, place, _NONE).astype(np.int64)
    return out


def learn(cells: np.ndarray, tokens: np.ndarray, order: int, uniform: float, steps: int = 60) -> np.ndarray:
    """Mixture weights by bucket (uniform first) from ``cells_of`` and how many tokens each cell has."""
    weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    if not len(cells):
        return weights
    p = np.empty((len(cells), order + 1))
    b = cells.copy()
    for k in range(order, 0, -1):
        place = -(b % _PLACES)
        p[:, k] = np.where(place == _NONE, 0.0, np.exp2(place / GRID))
        b //= _PLACES
    p[:, 0] = uniform
    for _ in range(steps):
        part = weights[b] * p
        part *= (tokens / part.sum(axis=1))[:, None]
        got = np.column_stack([np.bincount(b, weights=part[:, k], minlength=BUCKETS) for k in range(order + 1)])
        got += 1e-3  # no weight vanishes
        weights = got / got.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fold: Column, order: int = ORDER) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``. ``fold``: 0, 1 or 2 for each row, as ``SCORED``, ``TRAINED`` and ``DELETED`` say."""
    spark = docs.sparkSession
    chunks = stored(pack(docs, id_col, text_col, fold), "lm-chunks")
    n = F.reduce("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = {r["fold"]: r for r in chunks.groupBy("fold").agg(F.sum(n).alias("tokens"), F.sum(F.size("ids")).alias("docs")).collect()}  # three rows
    of = lambda f, what: int(sums[f][what]) if f in sums else 0
    tokens, n_docs = of(TRAINED, "tokens") + of(DELETED, "tokens"), of(TRAINED, "docs") + of(DELETED, "docs")
    every = tokens + of(SCORED, "tokens")
    ranges, bits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every // RANGE)), key_bits(every)
    totals = stored(count(chunks, order, ranges, bits), "lm-totals")
    vocabulary = int(totals.where("n = 1").agg(F.sum("known")).first()[0] or 0)
    uniform = 1.0 / (vocabulary + 1)
    left_tokens, left_docs = of(TRAINED, "tokens"), of(TRAINED, "docs")

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        c = Chunk(row, order, bits)
        rest = [t - h for t, h in zip(_totals(right, order, "totals"), _totals(right, order, "held"), strict=True)]
        bucket = bucket_of(seen_contexts(c, rest, order, left_tokens, left_docs))
        found, n = np.unique(cells_of(bucket, estimates(c, rest, left_tokens, left_docs)), return_counts=True)
        return pa.table({"cell": pa.array(found), "n": pa.array(n, type=pa.int64())})

    deleted = chunks.where(F.col("fold") == DELETED).groupBy("chunk").cogroup(totals.where(F.col("fold") == DELETED).groupBy("chunk"))
    histogram = stored(deleted.applyInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "lm-cells").toArrow()  # a fixed grid
    weights = learn(*(histogram.column(k).to_numpy() for k in ("cell", "n")), order, uniform)

    def result(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        c = Chunk(row, order, bits)
        found = _totals(right, order, "totals")
        bucket = bucket_of(seen_contexts(c, found, order, tokens, n_docs))
        mixed = weights[:, 0][bucket] * uniform
        for k, x in enumerate(estimates(c, found, tokens, n_docs), 1):
            x *= weights[:, k][bucket]
            mixed += x
        own = found[0][c.places[0]]
        per_doc = lambda x: np.add.reduceat(x, c.starts)
        base = np.log10((own + 1) / (tokens + vocabulary + 1))
        m = len(c.lengths)
        return pa.table([pa.array(row["ids"], type=pa.int64()), pa.array([row["fold"] == SCORED] * m), pa.array(c.lengths), pa.array(per_doc((own > 0).astype(np.int64))), pa.array(per_doc(base)), pa.array(per_doc(np.log10(mixed)))], schema=_SCORE)

    scored = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(result, _SCORE_DDL)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
