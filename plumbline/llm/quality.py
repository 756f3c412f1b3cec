"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

Features of a text, each hashed into ``2**BITS`` columns: its lower-cased words and pairs of words, and single, double and
triple word shapes (which kinds of characters a word has, its length class, whether it repeats the word before). A
feature's value is its share among the text's features of the same kind, so a score is the sparse dot product
``bias + sum over kinds of the mean weight of that kind's n-grams``, and long texts need no table of counts.

Fitting takes a sample of at most ``max_rows`` labelled rows (a documented bound, kept also where ids repeat), in one
task, and gives a weight vector of fixed size, which is what scoring broadcasts. Rows are taken, and seen by the fit, in
the order of their ids' hashes, then ids, then hashes of their texts, so that weights do not depend on partitioning.
Scoring covers every row and whole texts.

Null texts count as empty: their score is that of the bias alone. Labels other than 0 and 1 are left out; of several
labels of one document the larger counts. Without any label, weights are zero and every score is 0.5. Very long texts
are scored whole, one at a time. Repeated rows stay repeated, a column that has the name of the score is replaced, other
columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, combine, mix, text_slices, word_hashes, word_spans

BITS = 18
MAX_ROWS = 6_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 1e-5, 1e-6
_MASK = np.uint64((1 << BITS) - 1)
KINDS = 5


def _classes() -> np.ndarray:
    """Kinds of bytes, a bit each."""
    out = np.zeros(256, dtype=np.uint8)
    for bit, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b"*#%&$@^~", b"|<>{}[]=_", b".,;:'\"()-", bytes(range(128, 256)))):
        out[list(chars)] = 1 << bit
    return out


_CLASS = _classes()


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: column of each occurrence, and how many each text has."""
    words, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    first, last = word_spans(_LOWER[data])
    n = len(words)
    kinds = np.bitwise_or.reduceat(_CLASS[data], first).astype(np.uint64) if n else np.zeros(0, dtype=np.uint64)
    length = np.searchsorted([2, 3, 5, 9, 17], last - first, side="right").astype(np.uint64)
    inside = doc[1:] == doc[:-1]
    repeat = np.concatenate(([False], inside & (words[1:] == words[:-1]))) if n else np.zeros(0, dtype=bool)
    shapes = mix(kinds | length << np.uint64(8) | repeat.astype(np.uint64) << np.uint64(11) | np.uint64(1 << 20))
    grams = [(words, np.ones(n, dtype=bool)), (combine(words[:-1], words[1:]), inside), (shapes, np.ones(n, dtype=bool))]
    pair = combine(shapes[:-1], shapes[1:])
    grams.append((pair, inside))
    grams.append((combine(pair[:-1], shapes[2:]), inside[:-1] & inside[1:]))
    out = []
    for kind, (g, ok) in enumerate(grams):
        salt = np.uint64(0x9E3779B97F4A7C15 * (kind + 1) & 0xFFFFFFFFFFFFFFFF)
        column = ((g[ok] ^ salt) >> np.uint64(64 - BITS) & _MASK).astype(np.int64)
        out.append((column, np.bincount(doc[: len(ok)][ok], minlength=len(texts))))
    return out


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """``weights``: the columns', then the bias."""
    z = np.full(len(texts), weights[-1])
    for column, n in features(texts):
        total = np.concatenate(([0.0], np.cumsum(weights[column])))
        end = np.cumsum(n)
        z += (total[end] - total[end - n]) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights from rows of (columns, values), the bias as a column that is always 1, seen in order."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for (i, x), y in zip(rows, labels, strict=True):
            zi, ni = z[i], n[i]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[i] = more
    return weight(z, n)


def rows_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct columns of each text with their values, and the bias."""
    parts = [[] for _ in texts]
    for column, n in features(texts):
        end = np.cumsum(n)
        for k, (a, b) in enumerate(zip(end - n, end, strict=True)):
            if b > a:
                c, m = np.unique(column[a:b], return_counts=True)
                parts[k].append((c, m / (b - a)))
    out = []
    for p in parts:
        c = np.concatenate([x[0] for x in p] + [[1 << BITS]]).astype(np.int64)
        v = np.concatenate([x[1] for x in p] + [[1.0]])
        u, inverse = np.unique(c, return_inverse=True)
        out.append((u, np.bincount(inverse, weights=v)))
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from the texts of ``docs`` that ``labels`` (already free of held-out rows) marks."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    sample = marked.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)  # at most max_rows ids: small enough to broadcast
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(id_col, text.alias("__text")).join(F.broadcast(sample), id_col)
    chosen = chosen.select(F.xxhash64(id_col).alias("__h"), F.col(id_col).alias("__id"), F.xxhash64("__text").alias("__t"), "__y", "__text")
    chosen = chosen.orderBy("__h", "__id", "__t", "__text").limit(max_rows).select("__y", "__text")  # an id may have many rows

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for b in batches:
            texts = b.column(1).to_pylist()
            y += b.column(0).to_pylist()
            for i, j in text_slices(texts):
                rows += rows_of([t.encode() for t in texts[i:j]])
        w = ftrl(rows, np.array(y, dtype=float)) if rows else np.zeros((1 << BITS) + 1)
        yield pa.RecordBatch.from_pydict({"weights": [w.astype(np.float32).tobytes()]}, schema=pa.schema([("weights", pa.binary())]))

    held = chosen.coalesce(1).mapInArrow(train, "weights binary").first()  # the limit leaves one ordered partition
    return np.frombuffer(held[0], dtype=np.float32).astype(np.float64) if held else np.zeros((1 << BITS) + 1)


def score(df: DataFrame, weights: np.ndarray, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with each whole text's score, higher for label 1."""
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # of fixed size

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value.astype(np.float64)
        for x in batches:
            texts = x.to_pylist()
            parts = [scores([(t or "").encode() for t in texts[i:j]], w) for i, j in text_slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else [], type=pa.float64())

    return df.withColumn(score_col, run(F.col(text_col)))
