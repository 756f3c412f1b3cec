"""Source divergence audit: how far the term shares of a language's sources lie from one another and from the language's.

Texts are read once: tasks count terms and the documents that hold them by (language, source) and hand on their sums, also
before they end where these reach ``ENTRIES`` entries or come from ``TEXT_BYTES`` of text. A language keeps the terms of at least
``least_docs`` of its documents. A share is an integer, ``1 + floor(scale * (count + smoothing) / (N + smoothing * V))``,
worked out exactly in decimals.

Pairs of sources: the kept terms of a language are grouped by their sparse vector of counts by source. Every pair is
evaluated once for each distinct vector, and the difference is multiplied by how many terms share the vector. Tasks hold
sums for ``BLOCK`` sources against all others and hand them on when they reach ``SUM_BYTES``; no pair of sources is a row
before that. Terms: each kept term of each source whose share exceeds the language's is ranked, not its vector.

Null texts, languages and sources count as ''. Rows are documents, whatever their ids and however often they repeat.
Sources without terms take part with counts of 0, a language without kept terms has pairs of value 0. A very long text is
read in pieces of ``PIECE`` bytes between terms; its distinct terms are held at once. Values are exact below
9 * 10^18, that is up to 9 * 10^9 kept terms in a language. Other columns are left out, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_slices, tidy

#: A term, and what ends one, in UTF-8 bytes: code points beyond ASCII are bytes beyond ASCII.
_TERM, _GAP = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")
ENTRIES, TEXT_BYTES, PIECE = 600_000, 1 << 26, 1 << 20
BLOCK, SUM_BYTES, CELLS = 1_024, 1 << 26, 1 << 20

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``PIECE`` bytes, none of which ends inside a term."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text): sums of a term's occurrences and documents, and a row without a term for each group."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    read = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in n.items():
            size = len(terms) + 1
            held = docs[lang, source]
            words = pa.concat_arrays([pa.array([None], pa.string()), pa.array(terms, pa.binary()).cast(pa.string())])
            yield pa.record_batch([pa.array([lang] * size), pa.array([source] * size), words, pa.array([0, *terms.values()], pa.int64()), pa.array([0, *(held[t] for t in terms)], pa.int64())], schema=_COUNTED)
        n.clear()
        docs.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for start, end in text_slices(texts, PIECE):
            for lang, source, text in zip(langs[start:end], sources[start:end], texts[start:end], strict=True):
                terms, seen = n.setdefault((lang, source), Counter()), set()
                read += len(text)
                for piece in pieces(text.lower()):  # of bytes: A-Z only
                    found = _TERM.findall(piece)
                    terms.update(found)
                    seen.update(found)
                docs.setdefault((lang, source), Counter()).update(seen)
            if read > TEXT_BYTES or sum(map(len, n.values())) > ENTRIES:
                yield from out()
                read = 0
    yield from out()


def share(count: Column, total: Column, terms: Column, scale: int, smoothing: int) -> Column:
    """The integer share; null where there is neither a count nor a term."""
    whole = F.nullif(total.cast("decimal(20,0)") + (terms * smoothing).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    top = F.lit(scale).cast("decimal(10,0)") * (count + smoothing).cast("decimal(20,0)")
    return F.call_function("div", top, whole) + 1


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, block, zeros, no, share, m), a row for each distinct vector and block: sums by pair of m times the shares' difference."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    rows: dict[tuple[str, int], list[tuple[np.ndarray, int]]] = {}

    def add(key: tuple[str, int]) -> None:
        shares, m = (np.array(x) for x in zip(*rows.pop(key), strict=True))
        first = key[1] * BLOCK
        acc = sums.setdefault(key, np.zeros((min(BLOCK, shares.shape[1] - first), shares.shape[1]), dtype=np.int64))
        for i in range(len(acc)):
            acc[i] += m @ np.abs(shares - shares[:, first + i, None])

    def out() -> Iterator[pa.RecordBatch]:
        for key in list(rows):
            add(key)
        for (lang, block), acc in sums.items():
            for i, row in enumerate(acc):
                yield pa.record_batch([pa.array([lang] * len(row)), pa.array(np.full(len(row), block * BLOCK + i, dtype=np.int32)), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], schema=_SUMS)
        sums.clear()

    for batch in batches:
        lang, block, zeros, no, shares, m = batch.columns
        for k, key in enumerate(zip(lang.to_pylist(), block.to_pylist(), strict=True)):
            row = zeros[k].values.to_numpy().copy()
            row[no[k].values.to_numpy()] = shares[k].values.to_numpy()
            own = rows.setdefault(key, [])
            own.append((row, m[k].as_py()))
            if len(own) * len(row) >= CELLS:
                add(key)
            if sum(x.nbytes for x in sums.values()) + sum(8 * len(x) * len(x[0][0]) for x in rows.values()) > SUM_BYTES:
                yield from out()
    yield from out()


def audit(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = 30,
    smoothing: int = 5,
    scale: int = 1_000_000_000,
    top: int = 50,
) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value``, ``rank``: all other sources of the language, and the ``top`` terms that a source has more of than its language."""
    none = F.lit("")
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), none).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    rows = texts.mapInArrow(tidy(counted), "lang string, source string, term string, n long, docs long")
    keys = ["lang", "source", "term"]  # few rows of a task share one, so they are summed after the shuffle only
    counts = stored(rows.repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    in_order = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    sources = counts.where("term is null").select("lang", "source", in_order.alias("no"))
    vector = F.array_sort(F.collect_list(F.struct("no", "n"))).alias("vec")
    kept = counts.where("term is not null").join(sources, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), vector)
    kept = stored(kept.where(F.col("docs") >= least_docs).drop("docs"), "divergence-kept")

    sizes = kept.select("lang", F.explode("vec").alias("e")).groupBy("lang", F.col("e.no").alias("no")).agg(F.sum("e.n").alias("n"))
    sides = sources.join(sizes, ["lang", "no"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("no", "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("side"))
    totals = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("whole"))
    def of(count: Column, total: Column) -> Column:
        return share(count, total, F.col("terms"), scale, smoothing)

    langs = sides.join(totals, "lang", "left").select("lang", F.col("side.source").alias("names"), F.col("side.n").alias("ns"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("whole", F.lit(0)).alias("whole"))
    langs = stored(langs.withColumn("zeros", F.transform("ns", lambda n: of(F.lit(0), n))), "divergence-langs")

    # once for each distinct vector: the shares of the sources that have the terms, and the language's
    distinct = kept.groupBy("lang", "vec").agg(F.count("*").alias("m"), F.first("total").alias("total")).join(langs, "lang")
    shares = F.transform("vec", lambda e: of(e["n"], F.get("ns", e["no"])))
    distinct = distinct.select("lang", "vec", "m", F.col("vec.no").alias("no"), shares.alias("share"), of(F.col("total"), F.col("whole")).alias("own"), "names", "zeros")
    distinct = stored(distinct, "divergence-distinct")
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.size("zeros") - 1) / BLOCK).cast("int")))
    sums = distinct.select("lang", blocks.alias("block"), "zeros", "no", "share", "m").mapInArrow(tidy(summed), "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = langs.select("lang", "names", F.posexplode("names").alias("a", "source")).select("lang", "source", "a", F.posexplode("names").alias("b", "item")).where("a <> b")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    more = F.filter(F.zip_with("no", "share", lambda k, p: F.struct(F.get("names", k).alias("source"), (p - F.col("own")).alias("value"))), lambda e: e["value"] > 0)
    terms = kept.select("lang", "term", "vec").join(distinct.select("lang", "vec", more.alias("more")), ["lang", "vec"]).select("lang", "term", F.explode("more").alias("e"))
    terms = terms.select("lang", "e.source", F.lit("term").alias("part"), F.col("term").alias("item"), "e.value")

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
