"""What several operators of this subpackage share: table access, the shared folder, and word hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and the ASCII controls from tab to carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Hash of the token that ends every text in the language model.
END = np.uint64(0xD1B54A32D192ED03)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one where that is unset (local tests only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if found:
        if held is None:
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


#: The shuffle files behind a table go once it is written; and tasks hand Python so many rows at once, as one row can be large.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
BATCH_ROWS = 1024


@contextlib.contextmanager
def _conf(spark: SparkSession, **values: str):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write(df: DataFrame, write: Callable[[DataFrameWriter], None], batch_rows: int) -> None:
    with _conf(df.sparkSession, **_WRITING, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}):
        write(df.write.option("compression", "zstd"))


def stored(df: DataFrame, label: str, *, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Writes ``df`` to a table of its own in the shared folder and reads that: lineage ends there, and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _write(df, lambda w: w.parquet(path), batch_rows)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, column: str) -> tuple[str, DataFrame]:
    """As ``stored``, in buckets of a column, so that joins on it need no shuffle of the table; and its name in the catalog, to be dropped there."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _write(df, lambda w: w.bucketBy(n, column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name), BATCH_ROWS)
    return name, spark.table(name)


def give_back() -> None:
    """Hands a worker's free memory back to the system: Spark keeps idle workers beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # malloc_trim is glibc's
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, giving memory back at its end."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^0..r^n and its inverses modulo 2^64, grown on demand."""
    if len(_POWERS.get("up", ())) <= n:
        size = 1 << max(16, (n + 1).bit_length())
        for name, base in (("up", _R), ("down", _R_INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no white space."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and how many each text has."""
    data = np.frombuffer(b" ".join(texts) if texts else b"", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    first, last = word_spans(data)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.concatenate(([0], np.searchsorted(first, ends, side="left"))))
    if not len(first):
        return np.zeros(0, dtype=np.uint64), counts
    out = np.empty(len(first), dtype=np.uint64)
    step = 1 << 16
    i = 0
    while i < len(first):  # pieces of whole words, so that powers and sums stay small
        j = max(i + 1, int(np.searchsorted(last, first[i] + step, side="right")))
        a, b = first[i], last[j - 1]
        up, down = _powers(int(b - a))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], dtype=np.uint64)))
        f, e = first[i:j] - a, last[i:j] - a
        out[i:j] = (total[e] - total[f]) * down[f] + (e - f).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        i = j
    return mix(out), counts


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its head and of its next word."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ np.uint64(0x2545F4914F6CDD1D)))


def text_slices(texts: list[str | None], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each, a longer text alone: what one step of a batch holds."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            out.append((start, i))
            start, size = i, 0
        size += n
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def crc_mod(id_col: str, k: int):
    """crc32 of the id's text modulo ``k``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k
