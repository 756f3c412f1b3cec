"""The stages of the corpus pipeline, and the whole of it, against brute force."""

import collections
import hashlib
import math

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import quality

from test_corpus_operators import brute_groups, fold, plain_targets, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `key` string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "key"]


def odd_rows():
    prose = "the quiet river ran past the old mill and the children walked along it every morning before school began"
    rows = [
        (1, prose, "en", "web"),
        (7, prose, "en", "web"),
        (7, "an unrelated text that has the same id as a copy but says something else altogether and must stay", "en", "web"),
        (7, "an unrelated text that has the same id as a copy but says something else altogether and must stay", "en", "web"),
        (None, prose + " again", "en", "news"),
        (None, "a text without an id that stands alone among all of these and has no copy at all here", "en", None),
        (None, "two texts without any id that are the same as each other so one of them goes away now", "fr", "x"),
        (None, "two texts without any id that are the same as each other so one of them goes away now", "de", "x"),
        (3, None, "en", "web"),
        (4, "", None, "web"),
        (4, "", None, "web"),
        (5, " \n\t ", "en", "é"),
        (8, " ".join(f"w{k}" for k in range(60_000)), "en", "long"),
        (9, " ".join(f"w{k}" for k in range(60_001)), "en", "long"),
        (10, "short one", "en", "web"),
        (11, "Short ONE", "en", "web"),
    ]
    return [(*r, len(r[1] or ""), 0.5, "k") for r in rows]


def near_copies_by_brute_force(rows):
    """Rows kept, of rows (doc_id, text, ...)."""
    named = dict(enumerate((i, t) for i, t, *_ in rows))
    comp = {k: c for k, (n, c) in brute_groups([(k, t) for k, (_, t) in named.items()], 5, 80).items() if n}
    groups = collections.defaultdict(list)
    for k, c in comp.items():
        groups[c].append(k)
    least = {c: min((named[k][0] is None, named[k][0] or 0) for k in ks) for c, ks in groups.items()}
    return named, groups, least, [k for k in named if k not in comp]


def test_near_copies_keep_one_row_of_each_group(spark, sf):
    rows = odd_rows() + [(*r, 0.1, "z") for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS[:5]).collect()]
    df = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.one_of_each(spark, df.repartition(5), sf)
    assert out.columns == df.columns
    kept = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    named, groups, least, free = near_copies_by_brute_force(rows)
    assert not kept - collections.Counter((i, t) for i, t, *_ in rows)
    for k in free:  # without words
        assert kept[named[k]] >= 1
    assert sum(kept.values()) == len(groups) + len(free)
    for c, ks in groups.items():
        mine = {named[k] for k in ks}
        assert sum(kept[x] for x in mine) == 1
        (stays,) = [x for x in mine if kept[x]]
        assert (stays[0] is None, stays[0] or 0) == least[c]
    assert kept[7, odd_rows()[2][1]] == 1  # a unique text whose id a copy has too
    assert corpus_pipeline.one_of_each(spark, df.limit(0), sf).count() == 0


def classified(spark, sf, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    weights = quality.fit(docs, labels)
    return weights, collections.Counter(r for r in rows if quality.scores([(r[1] or "").encode()], weights)[0] >= corpus_pipeline.LEAST_QUALITY)


def test_classify_drops_the_rows_below_the_threshold(spark):
    sf = "/root/testdata/sf0.01"  # as many labels as it takes to reject anything
    rows = odd_rows() + [(*r, 0.1, "z") for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS[:5]).collect()]
    df = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.classify(spark, df.repartition(3), sf)
    assert out.columns == df.columns
    _, want = classified(spark, sf, rows)
    assert collections.Counter(map(tuple, out.collect())) == want
    assert 0 < sum(want.values()) < len(rows)
    assert corpus_pipeline.classify(spark, df.limit(0), sf).count() == 0
    marked = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if fold(r["doc_id"], 5) == 0}
    kept = {r[0] for r in want}
    good = [i for i, y in marked.items() if y == 1]
    assert sum(i in kept for i in good) >= 0.9 * len(good)


def test_mix_takes_words_near_the_targets(spark, sf):
    rows = odd_rows() + [(*r, 0.1, "z") for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS[:5]).collect()]
    df = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.mix(spark, df, sf)
    assert out.columns == df.columns
    taken, sizes, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        n = len(words(r[1]))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    had, got = collections.Counter(rows), collections.Counter(map(tuple, out.collect()))
    for r, n in got.items():
        assert r in had and n <= 3 * had[r]
        taken[r[3]] += n * len(words(r[1]))
    target = plain_targets(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= max(1, largest[s]) for s in sizes)
    again = collections.Counter(map(tuple, corpus_pipeline.mix(spark, df.repartition(6), sf).collect()))
    assert {k: n for k, n in got.items() if had[k] == 1} == {k: n for k, n in again.items() if had[k] == 1}
    assert corpus_pipeline.mix(spark, df.limit(0), sf).count() == 0


def test_tokenise_is_the_librarys(spark, sf):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.tokenise(spark, df, sf).collect())
    want = collections.Counter()
    for r in odd_rows():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], tuple(ids), len(ids), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert corpus_pipeline.tokenise(spark, df.limit(0), sf).count() == 0


def test_run_is_its_stages_one_after_another(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS[:5]).collect()))
    _, good = classified(spark, sf, [(*r, 0.0, "") for r in rows])
    named, groups, least, free = near_copies_by_brute_force([r[:5] for r in good.elements()])
    kept = [named[k] for k in free] + [next(named[k] for k in ks if named[k][0] == least[c][1]) for c, ks in groups.items()]
    source = {r[0]: r[3] for r in rows}
    sizes, largest, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for i, text in kept:
        sizes[source[i]] += len(words(text))
        largest[source[i]] = max(largest[source[i]], len(words(text)))
    text_of = dict(kept)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} <= set(text_of)
    for r in out:
        taken[r["source"]] += len(words(text_of[r["doc_id"]]))
    target = plain_targets(dict(sizes))
    assert all(math.isclose(taken[s], target[s], abs_tol=max(1, largest[s])) for s in sizes)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near-copies", "mix", "tokens"]
    assert pytest.approx(sum(target.values()), rel=0.2) == sum(taken.values())
