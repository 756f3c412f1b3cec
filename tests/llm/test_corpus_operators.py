"""Nearest neighbours, quality classifier, language model, n-gram Jaccard join and source mixing against brute force."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, components, jaccard, lm, mixing, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def documents(spark, sf):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


# --- nearest neighbours ----------------------------------------------------------------------------------------------


def exact_neighbours(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, q in zip(ids, x, strict=True):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_ann_recall_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact_neighbours(rows, 10)
    got = collections.defaultdict(list)
    for r in queries.op1_ann(spark, sf).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i, _ in rows if i % 100 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        found = sorted(got[q])
        assert [x[0] for x in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda x: (x[2], x[1]))
        exact = dict(want[q])
        hits += sum(x[1] in exact for x in found)
        assert all(x[1] not in exact or math.isclose(x[2], exact[x[1]], rel_tol=1e-12) for x in found)
    assert hits / (10 * len(asked)) >= 0.9


def recall(spark, rows, is_query, k=10):
    want = exact_neighbours(rows, k)
    got = collections.defaultdict(set)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), is_query, k=k).collect():
        got[r["query_id"]].add(r["vec_id"])
    each = {q: len(got[q] & {i for i, _ in want[q]}) / k for q in got}
    return float(np.mean(list(each.values()))), each


def test_ann_recall_at_a_larger_scale(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    mean, _ = recall(spark, rows, F.col("id") % 100 == 0)
    assert mean >= 0.95, mean


def test_ann_recall_of_queries_unlike_the_rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(120, 24)) * 10
    rows = [(i, (centres[i % 120] + rng.normal(size=24) * 0.3).tolist()) for i in range(6000)]
    rows += [(10_000 + i, (rng.normal(size=24) * 60).tolist()) for i in range(120)]
    outliers, _ = recall(spark, rows, F.col("id") >= 10_000)
    assert outliers >= 0.9, outliers
    mean, each = recall(spark, rows, (F.col("id") >= 10_000) & (F.col("id") % 3 == 0) | (F.col("id") % 20 == 0))
    far = [x for q, x in each.items() if q >= 10_000]
    assert mean >= 0.95 and np.mean(far) >= 0.9, (mean, np.mean(far))


def test_ann_takes_numbers_of_any_size_and_ids_with_many_rows(spark):
    rng = np.random.default_rng(6)
    for size in (1e200, 1e-200, 1e305):
        rows = [(i, (rng.normal(size=3) * size).tolist()) for i in range(30)]
        got = collections.defaultdict(list)
        for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"] / size))
        want = exact_neighbours([(i, [x / size for x in v]) for i, v in rows], 10)
        for q in (0, 10, 20):
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert np.allclose([d for _, d in got[q]], [d for _, d in want[q]], rtol=1e-9)
    far = [(7, [100.0 + k * 1e-3, 100.0, 0.0]) for k in range(60)]
    rows = far + [(100 + i, rng.normal(size=3).tolist()) for i in range(400)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 7).collect()
    assert len(got) == 10 and all(r["vec_id"] >= 100 for r in got)


def test_ann_copies_blocks_that_many_queries_visit(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(800)]
    mean, each = recall(spark, rows, F.col("id") % 5 == 0)
    assert len(each) == 160 and mean >= 0.95


def test_ann_takes_odd_vectors_ties_copies_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 4), 1.0, 0.0]) for i in range(12)]
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, nan, 0.0]), (103, [1.0, inf, 0.0]), (104, [1.0, None, 0.0]), (105, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 7) for r in good + bad + good[:1]], "vec_id long, embedding array<double>, rank int")
    got = ann.search(df, F.col("id") % 100 == 0).orderBy("rank").collect()
    assert {r["query_id"] for r in got} == {0}
    assert [(r["vec_id"], r["score"]) for r in got] == [(4, 0.0), (8, 0.0), (1, 1.0), (5, 1.0), (9, 1.0), (2, 2.0), (6, 2.0), (10, 2.0), (3, 3.0), (7, 3.0)]
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    few = ann.search(df.where("vec_id < 3"), F.col("id") == 1, k=10).collect()
    assert sorted(r["vec_id"] for r in few) == [0, 0, 2]  # repeated rows are candidates each


def test_ann_spreads_one_vector_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else rng.normal(size=4).tolist()) for i in range(1500)]
    want = exact_neighbours(rows, 10)
    got = collections.defaultdict(dict)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    assert all(max(got[q].values()) <= want[q][-1][1] * 1.5 + 1e-9 for q in got)
    shared = [q for q in got if q % 3]
    assert all(sorted(got[q]) == sorted(i for i, _ in want[q]) for q in shared)


# --- quality ---------------------------------------------------------------------------------------------------------


def test_quality_is_better_than_chance_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = {r["doc_id"]: r for r in queries.op3_quality(spark, sf).collect()}
    assert all(r["held_out"] == (fold(i, 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in scored.items())
    marked = [(scored[r["doc_id"]]["score"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if fold(r["doc_id"], 5) == 0]
    good, poor = [s for s, y in marked if y == 1], [s for s, y in marked if y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in poor])
    assert auc > 0.9, auc
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_quality_score_is_a_sparse_dot_product(spark, sf):
    texts = [t or "" for _, t, _ in documents(spark, sf)][:40] + ["", " ", "x"]
    weights = np.random.default_rng(2).normal(size=(1 << quality.BITS) + 1)
    got = quality.scores([t.encode() for t in texts], weights)
    rows = quality.rows_of([t.encode() for t in texts])
    want = [1 / (1 + math.exp(-max(-700, min(700, float(weights[i] @ x))))) for i, x in rows]
    assert np.allclose(got, want, atol=1e-9)


def plain_ftrl(rows, labels):
    """One weight at a time, as the papers write it."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for (columns, values), y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in columns.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in zip(columns.tolist(), values.tolist(), strict=True))))
            for i, x in zip(columns.tolist(), values.tolist(), strict=True):
                g = (p - y) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_quality_fit_is_plain_ftrl_over_the_rows_in_order(spark, sf):
    docs = [(i, t) for i, t, _ in documents(spark, sf)][:60]
    docs += docs[:3] + [(docs[0][0], "another text"), (5000, None)]
    labels = [(i, k % 2) for k, (i, _) in enumerate(docs[:60])] + [(5000, 1), (docs[1][0], 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    of = {}
    for i, y in labels:
        of[i] = max(y, of.get(i, 0))
    hashed = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("h"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()
    order = sorted(hashed, key=lambda r: (r["h"], r["doc_id"], r["t"]))
    for most in (1000, 20):
        take = order[:most]
        want = plain_ftrl(quality.rows_of([r["text"].encode() for r in take]), [of[r["doc_id"]] for r in take])
        for parts in (1, 5):
            got = quality.fit(d.repartition(parts), lab, max_rows=most)
            assert np.count_nonzero(got) == sum(w != 0 for w in want.values())
            assert all(math.isclose(got[i], w, rel_tol=1e-4, abs_tol=1e-7) for i, w in want.items())


def test_quality_bounds_rows_where_one_id_has_many(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "two")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    kept, quality.ftrl = quality.ftrl, lambda rows, y: seen.append(len(rows)) or np.full((1 << quality.BITS) + 1, float(len(rows)))
    try:
        assert quality.fit(docs, labels, max_rows=2)[0] == 2.0
    finally:
        quality.ftrl = kept


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "good words here " * 20_000, "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    flat = quality.score(df, quality.fit(df, none)).collect()
    assert [r["score"] for r in flat] == [0.5] * 4
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (2, 5), (None, 1), (2, None)], "doc_id long, quality int")
    by = {r["doc_id"]: r["score"] for r in quality.score(df, quality.fit(df, labels)).collect()}
    assert by[3] > by[1] == by[2]
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels)).count() == 0


# --- language model --------------------------------------------------------------------------------------------------


def brute_lm(docs, folds, order=2, steps=60):
    """Counts in dictionaries; weights by EM over all held-out tokens, estimates on the same grid."""
    tokens = {i: words(t) + [None] for i, t in docs}

    def counted(keep):
        grams, contexts, total = collections.Counter(), collections.Counter(), 0
        for i, ws in tokens.items():
            if folds[i] in keep:
                padded = ["<b>"] * (order - 1) + ws
                for k in range(len(ws)):
                    for n in range(1, order + 1):
                        g = tuple(padded[k + order - n : k + order])
                        grams[g] += 1
                        if n > 1:
                            contexts[g[:-1]] += 1
                total += len(ws)
        return grams, contexts, total

    def estimates(i, counts):
        grams, contexts, total = counts
        padded = ["<b>"] * (order - 1) + tokens[i]
        for k in range(len(tokens[i])):
            p, seen = [], total
            for n in range(1, order + 1):
                g = tuple(padded[k + order - n : k + order])
                seen = total if n == 1 else contexts[g[:-1]]
                p.append(grams[g] / seen if seen else 0.0)
            yield p, min(math.frexp(seen)[1], lm.BUCKETS - 1)

    full, rest = counted({lm.TRAINED, lm.DELETED}), counted({lm.TRAINED})
    vocabulary = sum(len(g) == 1 for g in full[0])
    uniform = 1 / (vocabulary + 1)
    held = [x for i in tokens if folds[i] == lm.DELETED for x in estimates(i, rest)]
    grid = [([2 ** (round(math.log2(v) * lm.GRID) / lm.GRID) if v else 0.0 for v in p], b) for p, b in held]
    weights = np.full((lm.BUCKETS, order + 1), 1 / (order + 1))
    for _ in range(steps if grid else 0):
        got = np.full_like(weights, 1e-3)
        for p, b in grid:
            part = weights[b] * np.array([uniform, *p])
            got[b] += part / part.sum()
        weights = got / got.sum(axis=1, keepdims=True)
    out = {}
    for i, ws in tokens.items():
        score = sum(math.log10(weights[b] @ np.array([uniform, *p])) for p, b in estimates(i, full))
        c = [full[0][(w,)] for w in ws]
        base = sum(math.log10((x + 1) / (full[2] + vocabulary + 1)) for x in c)
        out[i] = (folds[i] == lm.SCORED, len(ws), sum(x > 0 for x in c), full[2], base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_against_dictionaries(spark, sf, order, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 3000)
    docs = [(i, t) for i, t, _ in documents(spark, sf) if i < 60]
    docs += [(1000, None), (1001, ""), (1002, "One"), (1003, "a\x0bb C")]
    folds = {i: {2: lm.SCORED, 3: lm.DELETED}.get(fold(i, 7), lm.TRAINED) for i, _ in docs}
    want = brute_lm(docs, folds, order)
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    which = F.when(rest == 2, lm.SCORED).when(rest == 3, lm.DELETED).otherwise(lm.TRAINED)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in lm.score(df, fold=which, order=order).collect()}
    assert set(got) == set(want)
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isclose(r["score"], score, rel_tol=1e-6)


def test_lm_query_and_edges(spark, sf):
    rows = queries.op4_lm(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = lm.score(df, fold=F.lit(lm.TRAINED)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"]
    assert lm.score(df.limit(0), fold=F.lit(lm.TRAINED)).count() == 0
    alone = lm.score(df, fold=F.lit(lm.SCORED)).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in alone)


# --- n-gram Jaccard join ----------------------------------------------------------------------------------------------


def brute_groups(docs, width, t):
    sets = {}
    for i, text in docs:
        ws = words(text)
        sets[i] = frozenset([tuple(ws)] if 0 < len(ws) < width else [tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= t * max(len(x), len(y)):
            common = len(x & y)
            if 100 * common >= t * (len(x) + len(y) - common):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(rng, base, n, rate):
    out = []
    for _ in range(n):
        ws = list(base)
        for k in range(len(ws)):
            if rng.random() < rate:
                ws[k] = f"w{rng.integers(1000)}"
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize(("width", "t"), [(3, 90), (5, 80), (2, 60), (1, 50)])
def test_jaccard_groups_against_all_pairs(spark, sf, width, t):
    rng = np.random.default_rng(width)
    docs = [(i, x) for i, x, _ in documents(spark, sf)]
    for k in range(6):
        base = [f"b{k}x{rng.integers(60)}" for _ in range(int(rng.integers(3, 200)))]
        docs += [(10_000 + 100 * k + j, x) for j, x in enumerate(near_copies(rng, base, 25, 0.012 * k))]
    docs += [(20_000 + j, " ".join(["same"] * j)) for j in range(8)]
    docs += [(21_000, None), (21_001, ""), (21_002, " \n"), (21_003, "ONE two"), (21_004, "one TWO"), (21_005, "two one")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(spark.createDataFrame(docs, "doc_id long, text string"), width=width, threshold=t).collect()}
    assert got == brute_groups(docs, width, t)


def near_threshold(rng, groups=4, size=14, words_each=400):
    """Groups of texts whose pairs lie on both sides of the threshold, and a passage that all share."""
    common = [f"shared{k}" for k in range(12)]
    docs = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(words_each)]
        docs += [(100 * g + j, " ".join(common) + " " + x) for j, x in enumerate(near_copies(rng, base, size, 0.004 * (1 + j_rate(g))))]
    return docs


def j_rate(g):
    return g % 3


@pytest.mark.parametrize(("block", "frequent", "shifts"), [(1024, 1 << 15, 256), (3, 4, 2), (1, 1, 1)])
def test_jaccard_splits_large_buckets_and_verifies_each_pair_once(spark, monkeypatch, block, frequent, shifts):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "SHIFTS", shifts)
    seen = []
    plain = jaccard.verified

    def counted(pairs, sets, t):
        seen.extend((r["a"], r["b"]) for r in pairs.select("a", "b").collect())
        return plain(pairs, sets, t)

    monkeypatch.setattr(jaccard, "verified", counted)
    docs = near_threshold(np.random.default_rng(11))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(df, width=3, threshold=90).collect()}
    assert got == brute_groups(docs, 3, 90)
    assert seen and len(seen) == len(set(seen)) and all(a < b for a, b in seen)


@pytest.mark.parametrize(("width", "t", "block"), [(3, 90, 4), (5, 80, 1024)])
def test_jaccard_links_are_all_pairs_of_different_sets(spark, monkeypatch, width, t, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = near_threshold(np.random.default_rng(width), words_each=120)
    docs += [(9000 + j, docs[3][1]) for j in range(3)] + [(9100, None), (9101, "a b"), (9102, "A  b")]
    sets = {}
    for i, text in docs:
        ws = words(text)
        s = frozenset([tuple(ws)] if 0 < len(ws) < width else [tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)])
        if s:
            sets[s] = min(i, sets.get(s, i))
    want = {}
    for (x, i), (y, j) in itertools.combinations(sets.items(), 2):
        common = len(x & y)
        if 100 * common >= t * (len(x) + len(y) - common):
            want[min(i, j), max(i, j)] = common / (len(x) + len(y) - common)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard.links(df, width=width, threshold=t).collect()
    assert {(min(r["a_id"], r["b_id"]), max(r["a_id"], r["b_id"])): r["jaccard"] for r in rows} == pytest.approx(want)
    assert len(rows) == len(want) > 50
    keys = {r["set_key"] for r in jaccard.groups(df, width=width, threshold=t).collect()}
    assert {k for r in rows for k in (r["a"], r["b"])} <= keys and len(keys) == len(sets) + 1
    assert jaccard.links(df.limit(0)).count() == 0


def test_jaccard_suffix_counts_bound_what_suffixes_share():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    pos = np.array([0, 1, 7, 600, 1300, 1499])
    got = np.concatenate(list(jaccard.suffix_counts(tokens, pos, 64)))
    for p, row in zip(pos, got, strict=True):
        assert row.sum() == len(tokens) - p - 1
        assert np.array_equal(row, next(jaccard.suffix_counts(tokens[p:], np.array([0]), 64))[0])
    few = np.concatenate(list(jaccard.suffix_counts(tokens, np.arange(1500), 64)))
    assert np.array_equal(few[pos], got)


def test_jaccard_class_ids_that_clash_take_others():
    f, g = np.arange(5), np.arange(5, 10)
    plain = jaccard.class_id(f, g, np.zeros(0, dtype=np.int64))
    changed = jaccard.class_id(f, g, np.sort(plain[[1, 3]]))
    assert [a != b for a, b in zip(plain, changed, strict=True)] == [False, True, False, True, False]


def test_jaccard_edges(spark):
    long = " ".join(f"v{k}" for k in range(120_000))
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, "A B C D"), (9, long), (8, long + " more")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.groups(df.withColumn("n_shingles", F.lit("x")), width=3, threshold=90).collect())
    assert got == {(5, 2, 3): 2, (None, 2, 3): 1, (3, 2, 3): 1, (9, 119_998, 8): 1, (8, 119_999, 8): 1}
    assert jaccard.groups(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_cliques(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + list(itertools.combinations(range(200, 212), 2)) + [(300, 300), (7, 6)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 150)}, **{k: 200 for k in range(200, 212)}}
    assert got == want


# --- mixing ----------------------------------------------------------------------------------------------------------


def plain_targets(sizes, cap=3, weights=(1, 2, 3)):
    """Water filling source by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if cap * sizes[s] < level * weight[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def check_mix(rows, report):
    sizes, largest = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
        largest[s] = max(largest[s], len(WORD.findall(t or "")))
    target = plain_targets(dict(sizes))
    source = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in report:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r["taken"] <= 3 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(1, largest[s]) for s in sizes)


def test_mixing_query(spark, sf):
    rows = documents(spark, sf)
    first, again = (sorted(map(tuple, queries.op9_mixing(spark, sf).collect())) for _ in range(2))
    assert first == again and len(first) == len(rows)
    check_mix(rows, queries.op9_mixing(spark, sf).collect())


def test_mixing_hot_sources_nulls_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["hot", "hot", "b", None, "é", "𝒳"][i % 6]) for i in range(1500)]
    rows += [(5000, None, "hot"), (5001, "", None), (5002, "x", "single")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, rows int")
    report = mixing.mix_report(df).collect()
    check_mix(rows, report)
    other = mixing.mix_report(df.repartition(7, "text")).collect()
    assert sorted(map(tuple, report)) == sorted(map(tuple, other))
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in report if r["size"]}
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(df).where("length(text) > 1").collect())
    assert all(mixed[i] == n for i, n in taken.items() if i < 5000)
    assert mixing.mix(df).columns == df.columns
    same = spark.createDataFrame([(1, "a b", "s")] * 7 + [(2, "c", "t")], "doc_id long, text string, source string")
    got = mixing.mix_report(same).collect()
    assert len(got) == 8 and {r["doc_id"] for r in got} == {1, 2}
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_pivotal_rounding_keeps_probabilities(spark):
    rows = [(k, "s", 1.0 + k % 3, (k * 37 % 100 + 0.5) / 101) for k in range(300)]
    units = spark.createDataFrame(rows, "key long, source string, size double, p double")
    runs = [{r["key"]: r["more"] for r in mixing.rounded(units, block=16, seed=s).collect()} for s in range(12)]
    want = sum(size * p for _, _, size, p in rows)
    assert all(len(r) == 300 and abs(sum(size * r[k] for k, _, size, _ in rows) - want) <= 3 for r in runs)
    low = np.mean([r[k] for r in runs for k, _, _, p in rows if p < 0.25])
    high = np.mean([r[k] for r in runs for k, _, _, p in rows if p > 0.75])
    assert low < 0.2 < 0.8 < high
