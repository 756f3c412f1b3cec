"""N-gram Jaccard join: documents whose sets of word shingles overlap by a threshold, and the groups that links form.

The join is exact. Sets are those of distinct ``width``-word shingles (64-bit hashes) of whole texts with A-Z in lower case.

1. Equal sets are one class from the start (128-bit fingerprints), so copies are never paired.
2. Shingles have one global order, rare first: by their document frequency in a fixed-size table of counts, then hash.
   Two sets that reach the threshold share a shingle among the first ``n - ceil(t n) + 1`` of each (the prefix).
3. Prefix shingles are dealt by key range, those of very frequent shingles by class instead. A class stays a candidate if
   one of its buckets has another class of fitting length and place, or is very frequent; candidates meet again, in the
   order of shingle and size, with small signatures (counts of shingles by hash class), and those that still have a
   partner near them are *active*. Both only choose: whatever is passed costs time. Only the sets of these are kept.
4. Round one: in each prefix shingle's bucket, every class meets the bucket's first one, by a join. These pairs, as many
   as entries at most, go through the length, positional and suffix filters; what passes is verified and linked, and
   connected components follow.
5. Further rounds, in buckets that still hold different components: first every class outside a bucket's largest
   component meets its nearest class inside; then all pairs across components that are left go through the three
   filters. A bucket of more than ``BLOCK`` classes is cut into blocks, and each pair of blocks is a group of its own,
   so no task holds a whole large bucket.

The suffix filter bounds what the shingles behind the shared one can have in common: of both suffixes the shingles are
counted by hash class, and these counts differ by no more than the suffixes do. Pairs of each round are kept and left
out of the later ones, so a pair is verified once, on the sets themselves. After the last round the components are final.

So a group of thousands of near copies costs a filter of its unlinked pairs in place, but never rows for all pairs.
``links`` is for those who want every linked pair of different sets: there each class is a component of its own.

Classes are known by 64 bits of their fingerprints; the few whose 64 bits clash (checked, about ``n * n / 2**65``) take others.

A text without words has an empty set and no links; one with fewer than ``width`` words has its whole sequence as its one
shingle. Null texts count as empty. Rows without an id can link, but never name a component. Repeated rows stay
repeated, equal ids with different texts each have their own set, extra columns are left out, and an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, combine, give_back, mix, stored, text_slices, tidy, word_hashes
from .components import components
from .lm import from_planes, planes

WIDTH, THRESHOLD = 5, 80  # words, per cent
SKETCH, SLICES = 1 << 20, 64
SIGNED = 128  # hash classes of a row's signature
CLASSES, FEW_CLASSES = 512, 64  # hash classes of the suffix filter: across components, and in round one
SHIFTS = 256  # entries further apart in a bucket count as partners when candidates are chosen
FREQUENT = 1 << 15  # a shingle of so many rows, and of four times the mean slot's, is dealt by class
BLOCK = 8192  # classes of a bucket that meet in one group
GROUP = 8192  # entries of small buckets in one group, on the average
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, each text's sorted by hash, and how many each has."""
    words, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    gram, own = words, doc
    for _ in range(width - 1):
        gram = combine(gram[:-1], words[len(words) - len(gram) + 1 :])
    if len(words):
        k = max(0, len(words) - width + 1)
        own = doc[:k][doc[:k] == doc[len(doc) - k :]] if k else doc[:0]
        gram = gram[doc[:k] == doc[len(doc) - k :]] if k else words[:0]
    ends = np.cumsum(counts)
    few = np.flatnonzero((counts > 0) & (counts < width))
    whole = []
    for i in few:
        h = words[ends[i] - counts[i] : ends[i] - counts[i] + 1]
        for w in words[ends[i] - counts[i] + 1 : ends[i]]:
            h = combine(h, np.array([w]))
        whole.append(mix(h ^ _A)[0])
    gram = np.concatenate((gram, np.array(whole, dtype=np.uint64)))
    own = np.concatenate((own, few))
    order = np.lexsort((gram, own))
    gram, own = gram[order], own[order]
    if len(gram):
        fresh = np.concatenate(([True], (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])))
        gram, own = gram[fresh], own[fresh]
    return gram, np.bincount(own, minlength=len(texts))


def fingerprints(gram: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    ends = np.cumsum(counts)
    out = []
    for salt in (_A, _B):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(gram ^ salt), dtype=np.uint64)))
        out.append(mix(total[ends] - total[ends - counts] + counts.astype(np.uint64)).view(np.int64))
    return tuple(out)


def slot(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(20)).astype(np.int64) & (SKETCH - 1)


def batches_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = batch.column(column).to_pylist()
    for a, b in text_slices(texts):
        yield a, b, [(t or "").encode() for t in texts[a:b]]


_SETS = pa.schema([("id", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("f", pa.int64()), ("g", pa.int64()), ("sig", pa.binary()), ("slice", pa.int32()), ("sketch", pa.binary())])


def signatures(gram: np.ndarray, counts: np.ndarray, classes: int = SIGNED) -> np.ndarray:
    """Each set's counts of shingles by hash class, saturated."""
    doc = np.repeat(np.arange(len(counts)), counts)
    at = (mix(gram ^ _B) & np.uint64(classes - 1)).astype(np.int64)
    return np.minimum(np.bincount(doc * classes + at, minlength=len(counts) * classes), 255).astype(np.uint8).reshape(len(counts), classes)


def fingerprint_rows(docs: DataFrame, width: int) -> DataFrame:
    """Each row's id and key, set size, fingerprints and signature; and, with ``sketch``, each task's counts of shingles by slot, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for a, b, texts in batches_of(batch, 1):
                gram, counts = shingle_sets(texts, width)
                f, g = fingerprints(gram, counts)
                sketch += np.bincount(slot(gram), minlength=SKETCH)
                m = b - a
                sig = pa.array([x.tobytes() for x in signatures(gram, counts)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), batch.column(2).slice(a, m), pa.array(counts.astype(np.int64)), pa.array(f), pa.array(g), sig, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=_SETS)
        for k, part in enumerate(np.split(sketch.astype(np.uint32), SLICES)):
            yield pa.RecordBatch.from_pylist([{"slice": k, "sketch": planes(part)}], schema=_SETS)

    return docs.mapInArrow(tidy(run), "id long, key string, n long, f long, g long, sig binary, slice int, sketch binary")


def summed_sketch(rows: DataFrame) -> np.ndarray:
    """Of all tasks: a table of fixed size, added up slice by slice as rows stream by."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals[k] = totals.get(k, 0) + from_planes(x.as_py(), np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(totals), type=pa.int32()), "sum": pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in totals.values()], type=pa.binary())})

    parts = rows.where("sketch is not null").select("slice", "sketch").repartition("slice").mapInArrow(add, "slice int, sum binary").collect()
    total = np.zeros((SLICES, SKETCH // SLICES), dtype=np.uint32)
    for r in parts:
        total[r["slice"]] = np.frombuffer(r["sum"], dtype=np.uint32)
    return total.ravel()


def prefix_length(n: np.ndarray, t: int) -> np.ndarray:
    return n - (t * n + 99) // 100 + 1


def fits(n: np.ndarray, m: np.ndarray, t: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= t * np.maximum(n, m)


def least_overlap(n, m, t: int):
    """Smallest intersection of sets of these sizes that reaches the threshold."""
    return -(-t * (n + m) // (100 + t))


_ENTRY = pa.schema([("range", pa.int32()), ("token", pa.binary()), ("cls", pa.binary()), ("n", pa.binary()), ("pos", pa.binary())])
_ENTRY_DDL = "range int, token binary, cls binary, n binary, pos binary"
_NUMBERS = (("token", np.uint64), ("cls", np.int64), ("n", np.uint32), ("pos", np.uint32))


def dealt(token: np.ndarray, ranges: int, frequent: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Entries packed by the range of their token; those of frequent ones, by class, in ranges beyond."""
    r = ((token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    r = np.where(frequent, ranges + (columns["cls"].view(np.uint64) % np.uint64(ranges)).astype(np.int64), r)
    order = np.argsort(r, kind="stable")
    cuts = np.searchsorted(r[order], np.arange(2 * ranges + 1))
    columns = {"token": token} | columns
    rows = [{"range": k} | {c: planes(columns[c][order[cuts[k] : cuts[k + 1]]].astype(kind)) for c, kind in _NUMBERS} for k in np.flatnonzero(np.diff(cuts)).tolist()]
    return pa.RecordBatch.from_pylist(rows, schema=_ENTRY)


def undealt(group: pa.Table) -> dict[str, np.ndarray]:
    """Distinct entries of a range, by token, then set size, then class."""
    out = {c: np.concatenate([from_planes(x.as_py(), kind) for x in group.column(c)]).astype(np.uint64 if c == "token" else np.int64) for c, kind in _NUMBERS}
    order = np.lexsort((out["cls"], out["n"], out["token"]))
    out = {c: x[order] for c, x in out.items()}
    fresh = np.concatenate(([True], (out["token"][1:] != out["token"][:-1]) | (out["cls"][1:] != out["cls"][:-1])))
    return {c: x[fresh] for c, x in out.items()}


def ordered(gram: np.ndarray, counts: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Each set's shingles in the global order."""
    doc = np.repeat(np.arange(len(counts)), counts)
    return gram[np.lexsort((gram, sketch[slot(gram)], doc))]


def class_id(f: np.ndarray, g: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """64 bits of both fingerprints; other ones where these clash (``clashing``: sorted)."""
    out = combine(f.view(np.uint64), g.view(np.uint64)).view(np.int64)
    if len(clashing) and len(out):
        clash = clashing[np.minimum(np.searchsorted(clashing, out), len(clashing) - 1)] == out
        out = np.where(clash, combine(g.view(np.uint64), f.view(np.uint64)).view(np.int64), out)
    return out


class Seen:
    """Classes that a task has put out already; forgets when full, which costs repeats only."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.held = most, set()

    def fresh(self, cls: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cls), dtype=bool)
        for i, c in enumerate(cls.tolist()):
            if c not in self.held:
                out[i] = True
                self.held.add(c)
        if len(self.held) > self.most:
            self.held.clear()
        return out


def prefix_entries(docs: DataFrame, width: int, t: int, ranges: int, sketch, clashing: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counted = Seen(), sketch.value
        frequent = max(FREQUENT, 4 * int(counted.mean()))
        for batch in batches:
            for _, _, texts in batches_of(batch, 1):
                gram, counts = shingle_sets(texts, width)
                cls = class_id(*fingerprints(gram, counts), clashing)
                use = seen.fresh(cls) & (counts > 0)
                gram = ordered(gram, counts, counted)
                p = np.where(use, prefix_length(counts, t), 0)
                starts = np.cumsum(counts) - counts
                pos = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
                token = gram[np.repeat(starts, p) + pos]
                yield dealt(token, ranges, counted[slot(token)] > frequent, cls=np.repeat(cls, p), n=np.repeat(counts, p), pos=pos)

    return docs.mapInArrow(tidy(run), _ENTRY_DDL)


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between rows of counts; a saturated count says nothing."""
    apart = np.maximum(x, y) - np.minimum(x, y)
    apart[(x == 255) | (y == 255)] = 0
    return apart.sum(axis=1, dtype=np.int64)


def partnered(e: dict[str, np.ndarray], t: int, shifts: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Whether an entry's bucket has another class that the length and positional filters, and with ``counts`` the counts of whole sets by hash class, let through.

    Entries are sorted by token and size, so a bucket's fitting partners of an entry follow it without a gap.
    """
    token, n, pos = e["token"], e["n"], e["pos"]
    found = np.zeros(len(token), dtype=bool)
    i, k = np.arange(len(token)), 0
    while len(i):
        k += 1
        i = i[i + k < len(token)]
        i = i[(token[i] == token[i + k]) & fits(n[i], n[i + k], t)]
        if k > shifts:
            found[i] = found[i + k] = True
            break
        a = i[~(found[i] & found[i + k])]
        a = a[positional(n[a], pos[a], n[a + k], pos[a + k], t)]
        if counts is not None:
            for part in np.array_split(a, -(-len(a) // 65_536) or 1):
                allowed = n[part] + n[part + k] - 2 * least_overlap(n[part], n[part + k], t)
                part = part[differences(counts[part], counts[part + k]) <= allowed]
                found[part] = found[part + k] = True
        else:
            found[a] = found[a + k] = True
    return found


_CANDIDATE = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])


def candidates(entries: DataFrame, t: int, ranges: int) -> DataFrame:
    """Entries, as rows, whose bucket has another class of fitting size and place, and all of frequent shingles."""

    def run(group: pa.Table) -> pa.Table:
        e = undealt(group)
        ok = partnered(e, t, SHIFTS) if group.column("range")[0].as_py() < ranges else np.ones(len(e["token"]), dtype=bool)
        give_back()
        return pa.table([pa.array(e["token"][ok].view(np.int64)), *(pa.array(e[c][ok]) for c in ("cls", "n", "pos"))], schema=_CANDIDATE)

    return entries.groupBy("range").applyInArrow(run, "token long, cls long, n long, pos long")


def active_classes(two: DataFrame, signed: DataFrame, t: int) -> DataFrame:
    """Classes that have a partner, from ``candidates`` and the signatures (``cls``, ``sig``) of classes.

    Entries are dealt in the order of shingle, size and class, so that a large bucket goes on from task to task. What lies
    within ``SHIFTS`` entries of a batch's end, in a bucket that may go on there, counts as partnered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            e = {c: batch.column(c).to_numpy() for c in ("token", "cls", "n", "pos")}
            counts = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            found, at = partnered(e, t, SHIFTS, counts), np.arange(batch.num_rows)
            found |= (e["token"] == e["token"][0]) & (at < SHIFTS) | (e["token"] == e["token"][-1]) & (at >= len(at) - SHIFTS)
            yield pa.RecordBatch.from_pydict({"cls": pa.array(np.unique(e["cls"][found]))})

    rows = two.join(signed, "cls").select("token", "cls", "n", "pos", "sig")
    return rows.repartitionByRange("token", "n", "cls").sortWithinPartitions("token", "n", "cls").mapInArrow(tidy(run), "cls long").distinct()


def membership(cls: DataFrame, n: int) -> np.ndarray:
    """A bitmap over hashes of the classes, made in slices: at most 16 MB, about 16 bits a class as long as that holds. Passing others costs time only."""
    bits = 1 << min(27, max(16, (16 * n).bit_length()))
    part = bits // 16

    def run(group: pa.Table) -> pa.Table:
        out = np.zeros(part, dtype=bool)
        c = group.column("cls").to_numpy().view(np.uint64)
        out[(mix(c) >> np.uint64(8)).astype(np.int64) & (part - 1)] = True
        return pa.table({"slice": pa.array([int(c[0] & np.uint64(15))], type=pa.int32()), "bits": pa.array([np.packbits(out).tobytes()], type=pa.binary())})

    slices = np.zeros((16, part // 8), dtype=np.uint8)
    for r in cls.groupBy(F.col("cls").bitwiseAND(15).alias("s")).applyInArrow(run, "slice int, bits binary").collect():
        slices[r["slice"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return slices


def passes(slices: np.ndarray, cls: np.ndarray) -> np.ndarray:
    c = cls.view(np.uint64)
    at = (mix(c) >> np.uint64(8)).astype(np.int64) & (slices.shape[1] * 8 - 1)
    return (slices[(c & np.uint64(15)).astype(np.int64), at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


_CLASS_SET = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])


def kept_sets(docs: DataFrame, width: int, sketch, active, clashing: np.ndarray) -> DataFrame:
    """Sets of the active classes, one row each, in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for _, _, texts in batches_of(batch, 1):
                gram, counts = shingle_sets(texts, width)
                cls = class_id(*fingerprints(gram, counts), clashing)
                use = (counts > 0) & passes(active.value, cls)
                use[use] = seen.fresh(cls[use])
                if use.any():
                    mine = gram[np.repeat(use, counts)]
                    mine = ordered(mine, counts[use], sketch.value)
                    ends = np.cumsum(counts[use])
                    rows = [{"cls": int(c), "n": int(n), "tokens": mine[e - n : e].tobytes()} for c, n, e in zip(cls[use], counts[use], ends, strict=True)]
                    yield pa.RecordBatch.from_pylist(rows, schema=_CLASS_SET)

    return docs.mapInArrow(tidy(run), "cls long, n long, tokens binary").groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def suffix_counts(tokens: np.ndarray, pos: np.ndarray, classes: int) -> Iterator[np.ndarray]:
    """Of a set in the global order: for ascending places, some at a time, the counts by hash class of what stands behind them, saturated."""
    at = (mix(tokens ^ _B) & np.uint64(classes - 1)).astype(np.int64)
    left, done = np.bincount(at, minlength=classes), 0
    for k in range(0, len(pos), 512):
        part = pos[k : k + 512]
        last = int(part[-1]) + 1
        gone = np.zeros((len(part), classes), dtype=np.int64)
        np.add.at(gone, (np.searchsorted(part, np.arange(done, last)), at[done:last]), 1)
        np.cumsum(gone, axis=0, out=gone)
        yield np.minimum(left - gone, 255).astype(np.uint8)
        left, done = left - gone[-1], last


def set_of(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer(), dtype=np.uint64)


def binaries(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], type=pa.binary())


_SIGNED_ENTRY = pa.schema([*_CANDIDATE, ("sig", pa.binary())])


def set_entries(sets: DataFrame, t: int) -> DataFrame:
    """Prefix shingles of the kept sets, a row each, with a small signature of what stands behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (cls, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                tokens = set_of(batch.column(2), k)
                pos = np.arange(int(prefix_length(np.int64(n), t)))
                for part, sig in zip(np.split(pos, range(512, len(pos), 512)), suffix_counts(tokens, pos, FEW_CLASSES), strict=True):
                    same = lambda x, part=part: pa.array(np.full(len(part), x, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(tokens[part].view(np.int64)), same(cls), same(n), pa.array(part), binaries(sig)], schema=_SIGNED_ENTRY)

    return sets.select("cls", "n", "tokens").mapInArrow(tidy(run), "token long, cls long, n long, pos long, sig binary")


def positional(na, pa_, nb, pb, t: int):
    """Whether the sets can still reach the threshold if this is the first shingle they share."""
    return 1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= least_overlap(na, nb, t)


def allowed(na, pa_, nb, pb, t: int):
    """By how much the suffixes may differ then."""
    return (na - pa_ - 1) + (nb - pb - 1) - 2 * (least_overlap(na, nb, t) - 1)


def first_pairs(entries: DataFrame, t: int) -> DataFrame:
    """Each class of a bucket with the bucket's first one, by class, where length, positional and suffix filter let the pair through."""
    first = entries.groupBy("token").agg(F.min(F.struct("cls", "n", "pos", "sig")).alias("p"), F.count("*").alias("m")).where("m > 1").drop("m")

    @F.arrow_udf("boolean")
    def through(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for n, pos, sig, m, at, other in batches:
            n, pos, m, at = (x.to_numpy() for x in (n, pos, m, at))
            x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(len(n), FEW_CLASSES) for c in (sig, other))
            yield pa.array(fits(n, m, t) & positional(n, pos, m, at, t) & (differences(x, y) <= allowed(n, pos, m, at, t)))
        give_back()

    met = entries.join(first, "token").where("cls != p.cls").where(through("n", "pos", "sig", "p.n", "p.pos", "p.sig"))
    return met.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs whose sets reach the threshold, with the size of their intersection."""

    @F.arrow_udf("long")
    def overlap(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            out = []
            for a, b in zip(x, y, strict=True):
                a, b = np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                out.append(common if common >= least_overlap(len(a), len(b), t) else None)
            yield pa.array(out, type=pa.int64())
        give_back()

    sides = [pairs.select(F.col(c).alias("cls")).distinct() for c in ("a", "b")]  # a class may stand in many pairs
    needed = sides[0].union(sides[1]).distinct()
    sets = sets.join(needed, "cls", "left_semi")  # by bucket: what no pair names isn't shuffled
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    met = pairs.join(left, "a").join(right, "b")
    return met.select("a", "b", "na", "nb", overlap("ta", "tb").alias("overlap")).where("overlap is not null")


_CONTESTED = pa.schema([("token", pa.int64()), ("m", pa.int64()), ("cls", pa.int64()), ("comp", pa.int64()), ("inside", pa.bool_()), ("n", pa.int64()), ("pos", pa.int64()), ("counts", pa.binary())])


def contested(entries: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """Entries of buckets that hold several components (``comps``: cls, comp; others are their own): with the bucket's size
    ``m``, whether the class is inside the bucket's largest component, and counts of what stands behind."""
    e = entries.select("token", "cls", "n", "pos").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    of = e.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token")
    several = of.agg(F.sum("k").alias("m"), F.count("*").alias("c"), F.max_by("comp", F.struct("k", "comp")).alias("largest")).where("c > 1").select("token", "m", "largest")
    e = e.join(several, "token").withColumn("inside", F.col("comp") == F.col("largest"))
    by = e.groupBy("cls", "comp", "n").agg(F.collect_list(F.struct("token", "m", "inside", "pos")).alias("at"))  # a set's own prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, r in enumerate(batch.drop_columns(["tokens"]).to_pylist()):
                at = sorted(r.pop("at"), key=lambda x: x["pos"])
                of = {c: [x[c] for x in at] for c in ("token", "m", "inside", "pos")}
                done = 0
                for counts in suffix_counts(set_of(batch.column("tokens"), k), np.array(of["pos"]), CLASSES):
                    here = {c: v[done : done + len(counts)] for c, v in of.items()} | {c: [v] * len(counts) for c, v in r.items()}
                    done += len(counts)
                    yield pa.RecordBatch.from_pydict(here | {"counts": binaries(counts)}, schema=_CONTESTED)

    with_sets = by.join(sets.select("cls", "tokens"), "cls").select("cls", "comp", "n", "at", "tokens")
    return with_sets.mapInArrow(tidy(run), "token long, m long, cls long, comp long, inside boolean, n long, pos long, counts binary")


def cross_pairs(rows: DataFrame, t: int, nearest: bool, parts: int) -> DataFrame:
    """From ``contested``: pairs of different components that pass all filters; or, with ``nearest``, of each class outside
    its bucket's largest component the pair with the nearest inside. A saturated count only lets more through. Buckets of
    one block are dealt to ``parts`` groups."""
    blocks, zero = F.ceil(F.col("m") / BLOCK), F.lit(0).cast("long")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("cls"), blocks))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    several = F.transform(F.sequence(zero, blocks - 1), lambda k: pair(F.least(k, "blk"), F.greatest(k, "blk")))
    rows = rows.withColumn("p", F.explode(F.when(blocks > 1, several).otherwise(F.array(pair(zero, zero)))))
    group = F.when(blocks > 1, F.xxhash64("token", "p.i", "p.j")).otherwise(F.pmod("token", F.lit(parts)))
    rows = rows.select(group.alias("g"), "token", "p.i", "p.j", "blk", "cls", "comp", "inside", "n", "pos", "counts")
    empty = (pa.schema([(c, pa.int64()) for c in ("token", "cls", "other", "apart")]) if nearest else pa.schema([("a", pa.int64()), ("b", pa.int64())])).empty_table()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("token", "i", "j", "n", "cls")])
        token, i_, j_, blk, cls, comp, inside, n, pos = (group.column(c).to_numpy() for c in ("token", "i", "j", "blk", "cls", "comp", "inside", "n", "pos"))
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), dtype=np.uint8).reshape(len(token), CLASSES)
        fresh = (token[1:] != token[:-1]) | (i_[1:] != i_[:-1]) | (j_[1:] != j_[:-1])
        cuts = np.concatenate(([0], np.flatnonzero(fresh) + 1, [len(token)]))
        found: list[np.ndarray] = []

        def passing(x: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            y = y[(comp[y] != comp[x]) & fits(n[x], n[y], t) & positional(n[x], pos[x], n[y], pos[y], t)]
            if i_[x] != j_[x]:  # between two blocks
                y = y[blk[y] != blk[x]]
            apart = np.concatenate([differences(counts[x], counts[y[k : k + 4096]]) for k in range(0, len(y), 4096)] or [y])
            ok = apart <= allowed(n[x], pos[x], n[y], pos[y], t)
            return y[ok], apart[ok]

        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = np.arange(a, b)
            if nearest:
                within = here[inside[a:b]]
                for x in here[~inside[a:b]]:
                    y, apart = passing(x, within)
                    if len(y):
                        found.append(np.array([[token[x], cls[x], cls[y[apart.argmin()]], apart.min()]]))
                continue
            for x in here[:-1]:
                y, _ = passing(x, np.arange(x + 1, np.searchsorted(n[a:b], 100 * n[x] // t, side="right") + a))
                if len(y):
                    found.append(np.column_stack([np.full(len(y), cls[x]), cls[y]]))
        if not found:
            return empty
        out = np.concatenate(found) if nearest else np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.table([pa.array(out[:, k]) for k in range(out.shape[1])], schema=empty.schema)

    if not nearest:
        return rows.groupBy("g").applyInArrow(run, "a long, b long").distinct()
    near = rows.groupBy("g").applyInArrow(run, "token long, cls long, other long, apart long")
    best = near.groupBy("token", "cls").agg(F.min(F.struct("apart", "other")).alias("x"))
    return best.select(F.least("cls", "x.other").alias("a"), F.greatest("cls", "x.other").alias("b")).distinct()


class Prepared:
    """What the rounds start from: rows and classes of ``docs``; and, if any class has a candidate partner, sets and entries of the active classes."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, t: int, key_col: str | None = None):
        spark = docs.sparkSession
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        keyed = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.col(key_col).cast("string") if key_col else F.lit(None).cast("string"))
        rows = stored(fingerprint_rows(keyed, width), "jaccard-rows")
        sketch = spark.sparkContext.broadcast(summed_sketch(rows))  # of fixed size
        self.rows = rows.where("sketch is null").select("id", "key", "n", "f", "g", "sig")
        total = self.rows.agg(F.sum("n")).first()[0] or 0
        self.ranges = ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (1 << 23)))
        found = self.rows.where("n > 0").groupBy("f", "g").agg(F.min("id").alias("first_id"), F.first("sig").alias("sig"))
        named = lambda clashing: F.arrow_udf(lambda f, g: pa.array(class_id(f.to_numpy(), g.to_numpy(), clashing)), "long")("f", "g")
        none = np.zeros(0, dtype=np.int64)
        repeated = found.select(named(none).alias("cls")).groupBy("cls").agg(F.count("*").alias("k")).where("k > 1")
        clashing = np.array(sorted(r["cls"] for r in repeated.collect()), dtype=np.int64)  # about n * n / 2**65
        self.classes = found.select(named(clashing).alias("cls"), "f", "g", "first_id", "sig")
        two = stored(candidates(prefix_entries(texts, width, t, ranges, sketch, clashing), t, ranges), "jaccard-candidates")
        active = stored(active_classes(two, self.classes.select("cls", "sig"), t), "jaccard-active", batch_rows=10_000)
        n_active = active.count()
        self.any = n_active > 0
        if self.any:
            bitmap = spark.sparkContext.broadcast(membership(active, n_active))
            self.sets_name, self.sets = bucketed(kept_sets(texts, width, sketch, bitmap, clashing), "jaccard-sets", "cls")
            self.entries = stored(set_entries(self.sets, t), "jaccard-entries")
            self.parts = max(ranges, -(-self.entries.count() // GROUP))  # grow with the entries, so that a group doesn't

    def forget_sets(self) -> None:
        """Once no lazy result reads them any more."""
        if self.any:
            self.sets.sparkSession.sql(f"DROP TABLE IF EXISTS {self.sets_name}")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None, width: int = WIDTH, threshold: int = THRESHOLD, nearest_rounds: int = 1) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``key`` (of ``key_col``, or null), ``n_shingles``, ``component_id`` (smallest id that links reach), ``component`` (a number for it that needs no ids; null without words) and ``set_key``, the same for equal sets.

    Before all pairs across components are looked at, ``nearest_rounds`` rounds link classes with their nearest across them.
    The result is the same for any number: more rounds leave fewer pairs and cost a shuffle each.
    """
    t = threshold
    p = Prepared(docs, id_col, text_col, width, t, key_col)
    if p.any:
        tried = stored(first_pairs(p.entries, t), "jaccard-tried")
        links = stored(verified(tried, p.sets, t).select("a", "b"), "jaccard-links")
        linked = components(links)
        for nearest in (*[True] * nearest_rounds, False):
            comps = linked.select(F.col("node").alias("cls"), F.col("label").alias("comp"))
            more = cross_pairs(contested(p.entries, comps, p.sets), t, nearest, p.parts)
            more = stored(more.join(tried, ["a", "b"], "left_anti"), "jaccard-tried")  # a pair is verified once
            tried = tried.union(more)
            more = stored(verified(more, p.sets, t).select("a", "b"), "jaccard-links")
            if more.limit(1).count():
                links = links.union(more)
                linked = components(links)
        named = p.classes.join(linked.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    else:
        named = p.classes.withColumn("label", F.col("cls"))
    named = stored(named.select("f", "g", "label", "first_id"), "jaccard-named")
    p.forget_sets()
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(least, "label").select(F.col("f").alias("__f"), F.col("g").alias("__g"), "component_id", F.col("label").alias("component"))
    out = p.rows.join(of_class, (F.col("f") == F.col("__f")) & (F.col("g") == F.col("__g")), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    key = F.when(F.col("n") > 0, F.concat_ws("-", *[F.lower(F.hex(c)) for c in ("f", "g")]))
    return out.select(F.col("id").alias("doc_id"), "key", F.col("n").alias("n_shingles"), own.alias("component_id"), "component", key.alias("set_key"))


def links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """Every linked pair of different sets, once: ``a``, ``b`` (keys as ``set_key`` of ``groups``, a < b), ``a_id``, ``b_id`` (smallest ids of rows with these sets), ``jaccard``."""
    p = Prepared(docs, id_col, text_col, width, threshold)
    if not p.any:
        return docs.sparkSession.createDataFrame([], "a string, b string, a_id long, b_id long, jaccard double")
    alone = p.sets.select("cls", F.col("cls").alias("comp"))
    pairs = stored(cross_pairs(contested(p.entries, alone, p.sets), threshold, False, p.parts), "jaccard-tried")
    found = stored(verified(pairs, p.sets, threshold), "jaccard-links").withColumn("jaccard", F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap")))
    p.forget_sets()
    key = F.concat_ws("-", *[F.lower(F.hex(c)) for c in ("f", "g")])
    side = lambda s: p.classes.select(F.col("cls").alias(s), F.struct(key.alias("k"), F.col("first_id").alias("id")).alias(f"s{s}"))
    both = found.join(side("a"), "a").join(side("b"), "b").select(F.least("sa", "sb").alias("x"), F.greatest("sa", "sb").alias("y"), "jaccard")
    return both.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"), "jaccard")
