"""Fill-in-middle, source divergence audit and exact top-k search against brute force and DuckDB."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, chat, divergence, fim, mixing, queries, token_counts, topk, warc


def duck(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con.execute(sql)


@pytest.mark.parametrize("name", ["op11_fim", "op12_divergence", "op13_topk"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_queries_equal_their_sql(spark, name, size):
    sf = f"/root/testdata/{size}"
    found = queries.QUERIES[name](spark, sf)
    want = duck(sf, queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    got, rows = sorted(map(tuple, found.select(names).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(rows) > 10 and got == rows


# --- fill-in-middle --------------------------------------------------------------------------------------------------

ODD = [None, "", "a", "ab", "a b", "🙂", "🙂🙂a🙂b", "é é", "\n\n", "ab\ncd\n", "x <P> y", "a <S", "<M>", "word" * 50, "don't" * 20, "日本 ab語c", "\x00a", " ", "<P", "S>", "\\E.*"]


def fim_plainly(key, text, pattern, marks=("<P>", "<S>", "<M>")):
    text, (p, s, m) = text or "", marks
    units = re.findall(pattern, text, re.S)
    n, h = len(units), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in marks) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(x), len(y), f"{s}{z}{p}{x}{m}{y}") if h[3] % 100 < 20 else (n, "psm", len(x), len(y), f"{p}{x}{s}{z}{m}{y}")


@pytest.mark.parametrize("grammar, pattern", [(fim.WORDS, r"[A-Za-z]+|[^A-Za-z]"), (fim.CHARACTERS, "."), (fim.LINES, r"[^\n]*\n|[^\n]+"), (fim.RUNS, r"[ \n]+|[^ \n]+")])
@pytest.mark.parametrize("section", [1, 3, fim.SECTION])
def test_fim_equals_plain_version(spark, grammar, pattern, section):
    rows = [(None if i == 3 else i * 7 + k, t) for k in range(5) for i, t in enumerate(ODD)]
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), grammar=grammar, section=section)
    out = out.select("doc_id", "text", "fim.*", fim.restore(F.col("fim.output"), F.col("fim.form")).alias("restored")).collect()
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert tuple(r)[2:7] == fim_plainly(r.doc_id, r.text, pattern)
        assert r.restored == (r.text or "")


def test_fim_very_long_text_over_sections(spark):
    text = "some words, and more words. " * 30_000  # 840,000 characters
    df = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    for r in fim.fill_in_middle(df).select("doc_id", "text", "fim.*").collect():
        assert tuple(r)[2:] == fim_plainly(r.doc_id, text, r"[A-Za-z]+|[^A-Za-z]")


def test_fim_columns_sentinels_and_empty_table(spark):
    kind = "doc_id long, text string, n int, form string, row string, lengths map<string, int>, Fim int, key string"
    df = spark.createDataFrame([(1, "some text here", 5, "f", "r", {"a": 1}, 3, "k"), (1, "some text here", 5, "f", "r", {"a": 1}, 3, "k")], kind)
    out = fim.fill_in_middle(df, percent=100, spm_percent=0, sentinels=fim.Sentinels("[\\Ep]", "[.s*]", "[m$1]"))
    assert out.columns == ["doc_id", "text", "n", "form", "row", "lengths", "key", "fim"]
    a, b = out.select("*", fim.restore(F.col("fim.output"), F.col("fim.form"), fim.Sentinels("[\\Ep]", "[.s*]", "[m$1]")).alias("restored")).collect()
    assert a == b and a.restored == "some text here" and a.n == 5 and a.lengths == {"a": 1} and a.fim.form == "psm"
    assert fim.fill_in_middle(df.limit(0)).collect() == []
    broken = spark.createDataFrame([("<P>ab<S>c", "psm"), ("abc", "spm"), ("abc", "plain")], "output string, form string")
    assert [r[0] for r in broken.select(fim.restore(F.col("output"), F.col("form"))).collect()] == [None, None, "abc"]
    for odd in (("", "b", "c"), ("ab", "bc", "d"), ("a", "a", "c"), ("abc", "b", "d"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fim.Sentinels(*odd)


# --- source divergence -----------------------------------------------------------------------------------------------


def audit_plainly(rows, least, smoothing, scale, top):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        own[None] = {t: sum(own[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + scale * (c + smoothing) // (sum(x.values()) + smoothing * len(kept)) for t, c in x.items()} for s, x in own.items()}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((-(p[s][t] - p[None][t]), t.encode()) for t in kept if own[s][t] and p[s][t] > p[None][t])[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_audit_of_odd_rows_equals_plain_version(spark, monkeypatch):
    rows = [("en", "a", "One two TWO straße Ünder ünder"), ("en", "b", "two three"), ("en", "b", "two three"), ("en", None, None), (None, "a", ""), ("de", "x", "allein"), ("en", "é", "🙂 two 🙂x"), ("fr", None, "un un"), ("fr", "", "deux un")]
    rows += [("en", f"s{k % 7}", " ".join(f"w{chr(97 + j % 26)}" for j in range(k))) for k in range(60)]
    df = spark.createDataFrame([(*r, {"n": 1}, 7) for r in rows], "lang string, source string, text string, terms map<string, int>, no int")
    for least, top in ((1, 50), (2, 3), (1000, 5)):
        want = audit_plainly(rows, least, 5, 1_000_000_000, top)
        assert sorted(map(tuple, divergence.audit(df, least_docs=least, top=top).collect())) == want
    assert all(r[4] == 0 for r in want) and len(want) > 50
    assert divergence.audit(df.limit(0)).collect() == []
    long = [("en", "a", "ab " * 900_000 + "z" * 2_000_000), ("en", "b", "ab cd")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(long, "lang string, source string, text string"), least_docs=1).collect())) == audit_plainly(long, 1, 5, 1_000_000_000, 50)


def test_audit_tasks_flush_and_blocks(monkeypatch):
    """What tasks hand on early adds up to the same sums."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    vectors = [(rng.integers(0, 50, 5), int(rng.integers(1, 4))) for _ in range(200)]
    kind = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("zeros", pa.list_(pa.int64())), ("no", pa.list_(pa.int32())), ("share", pa.list_(pa.int64())), ("m", pa.int64())])
    monkeypatch.setattr(divergence, "BLOCK", 2)
    rows = [{"lang": "en", "block": b, "zeros": [1, 2, 3, 4, 5], "no": [0, 2, 4], "share": v[[0, 2, 4]].tolist(), "m": m} for v, m in vectors for b in range(3)]
    dense = np.array([[v[0], 2, v[2], 4, v[4]] for v, _ in vectors])
    want = {(i, j): int(sum(m * abs(int(d[i]) - int(d[j])) for d, (_, m) in zip(dense, vectors, strict=True))) for i in range(5) for j in range(5)}
    for most in (1 << 26, 2_000):
        monkeypatch.setattr(divergence, "SUM_BYTES", most)
        got = Counter()
        for batch in divergence.summed(iter(pa.Table.from_pylist(rows, schema=kind).to_batches(max_chunksize=50))):
            for r in batch.to_pylist():
                got[r["a"], r["b"]] += r["value"]
        assert {k: got[k] for k in want} == want
    texts = pa.record_batch([pa.array(["en"] * 30), pa.array(["a", "b", "c"] * 10), pa.array([f"one two{'x' * (k % 4)}" for k in range(30)])], names=["lang", "source", "text"])
    sums = []
    for most in (1 << 26, 10):
        monkeypatch.setattr(divergence, "TEXT_BYTES", most)
        got = Counter()
        for batch in divergence.counted(iter([texts.slice(0, 7), texts.slice(7)])):
            for r in batch.to_pylist():
                got[r["source"], r["term"]] += r["n"] * 1000 + r["docs"]
        sums.append(got)
    assert sums[0] == sums[1] and sums[0]["a", "one"] == 10_010


# --- exact top-k -----------------------------------------------------------------------------------------------------


def topk_plainly(rows, k, asked):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    dim = max((len(v) for _, v in rows), default=0) or 1
    x = np.array([[*v, *[0] * (dim - len(v))] for _, v in rows], dtype=np.int64).reshape(-1, dim)
    out = []
    for a, (i, _) in enumerate(rows):
        if asked(i):
            s = x @ x[a]
            best = sorted((-int(s[b]), rows[b][0]) for b in range(len(rows)) if b != a)[:k]
            out += [(i, r + 1, j, -n) for r, (n, j) in enumerate(best)]
    return sorted(out)


def vectors_of(kind, n=900):
    rng = np.random.default_rng(5)
    if kind == "lengths":
        x = rng.normal(size=(n, 8)) * 100 * np.exp(1.5 * rng.normal(size=(n, 1)))
    elif kind == "clusters":
        x = 300 * (rng.normal(size=(6, 8))[np.arange(n) % 6] + 0.1 * rng.normal(size=(n, 8)))
    elif kind == "ties":
        x = rng.integers(-1, 2, size=(n, 4))
    elif kind == "large":
        x = rng.normal(size=(n // 3, 3)) * 3e8
    else:
        x = np.full((n // 3, 2), 7)
    return [(i, v) for i, v in enumerate(x.astype(int).tolist())]


@pytest.mark.parametrize("kind", ["lengths", "clusters", "ties", "large", "same"])
def test_topk_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 64)
    rows = vectors_of(kind)
    got = topk.search(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("id") % 5 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == topk_plainly(rows, 5, lambda i: i % 5 == 0)


def test_topk_odd_rows(spark):
    rows = [(0, None), (5, [0, 0]), (5, [1, 2]), (10, []), (15, [1]), (1, [None, 2]), (2, [0, 0]), (3, [3, 4, 5]), (3, [3, 4, 5]), (5, [1, 2]), (None, [1, 2]), (20, [-1, -5])]
    df = spark.createDataFrame([(*r, {"a": 1}, 1, 2) for r in rows], "vec_id long, vector array<long>, v map<string, int>, id int, query int")
    assert sorted(map(tuple, topk.search(df, F.col("id") % 5 == 0, k=5).collect())) == topk_plainly(rows, 5, lambda i: i % 5 == 0)
    assert topk.search(df.limit(0), F.col("id") % 5 == 0).collect() == []
    assert topk.search(df.where("vec_id = 3"), F.col("id") % 5 == 0).collect() == []
    assert topk.search(df.where("vec_id = 20"), F.col("id") % 5 == 0).collect() == []


def test_topk_prunes_by_length_and_by_coordinate():
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(16), 256, axis=0) + 0.02 * rng.normal(size=(4096, 16))
    x = np.round(x * (10_000 * (1 + 0.01 * rng.random(4096)) / np.linalg.norm(x, axis=1))[:, None]).astype(np.int64)
    order = np.argsort(-topk.lengths(x), kind="stable")
    buckets = [topk.Bucket(order[k : k + 512], x[order[k : k + 512]]) for k in range(0, 4096, 512)]
    q = x[:64]
    norms, seen = topk.lengths(q), {}
    best = topk.Best(len(q), 6, np.full(len(q), -np.inf))
    for b in buckets:
        topk.retrieve(b, q, norms, best, seen)
    want = x @ q.T
    for k in range(len(q)):
        order = np.lexsort((np.arange(4096), -want[:, k]))[:6]
        assert best.ids[k].tolist() == order.tolist()
    assert seen["coordinate"] > 0 and sum(seen.values()) < 0.5 * len(q) * len(x)


def test_topk_refuses_what_does_not_fit():
    b = topk.Bucket(np.arange(2), np.full((2, 2), 1 << 40))
    q = np.full((1, 2), 1 << 40)
    with pytest.raises(ValueError):
        topk.products(q, topk.lengths(q), b, slice(0, 2))


# --- faults of earlier operators -------------------------------------------------------------------------------------


def test_mix_keeps_any_column_and_spreads_rows_that_share_a_unit(spark):
    rows = [(k % 3 if k % 4 else None, f"{'w ' * (k % 5 + 1)}", "ab"[k % 2] if k % 7 else None, {"k": k}, k, f"h{k}", k, k) for k in range(60)]
    rows += [(1, "same text", "a", {"k": 0}, 0, "h", 0, 0)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string, int>, __n int, h string, unit int, total int")
    out = mixing.mix(df)
    assert out.columns == df.columns
    have = {(r["doc_id"], r["text"], r["source"], r["tags"]["k"], r["__n"], r["h"]) for r in df.collect()}
    got = Counter((r["doc_id"], r["text"], r["source"], r["tags"]["k"], r["__n"], r["h"]) for r in out.collect())
    assert set(got) <= have and got == Counter((r["doc_id"], r["text"], r["source"], r["tags"]["k"], r["__n"], r["h"]) for r in mixing.mix(df).collect())
    words = lambda t: len(t.split())
    report = mixing.mix_report(df).collect()
    assert len(report) == 100 and sum(r["taken"] for r in report) == sum(words(k[1]) * n for k, n in got.items())
    copies = got[1, "same text", "a", 0, 0, "h"]
    assert 40 * (copies // 40) <= copies <= 40 * 3


def test_units_are_joined_by_what_they_are(spark):
    """No hash can melt two units into one: keys hold id, source and size."""
    df = spark.createDataFrame([(k, "w " * (k % 9 + 1), f"s{k % 2}") for k in range(200)], "doc_id long, text string, source string")
    units = df.select(F.struct(F.col("doc_id").alias("id"), "source", F.lit(1).cast("long").alias("size")).alias("key"), "source", F.lit(1.0).alias("size"), F.lit(0.5).alias("p"))
    got = mixing.rounded(units, block=16).collect()
    assert len({r["key"] for r in got}) == 200 and sum(r["more"] for r in got) == 100
    assert mixing.copies(df).count() == 200


def test_warc_headers_keep_white_space_that_is_not_ascii():
    got = warc.parse_headers("WARC/1.1\r\nWARC-Target-URI: \t http://x/ 　 \r\nA:b".encode())
    assert got == {"warc-target-uri": "http://x/ 　", "a": "b"}


def test_unknown_vocabularies_are_counted_whole(tmp_path):
    from tokenizers import Tokenizer, models

    path = tmp_path / "own.json"
    Tokenizer(models.BPE(vocab={"a": 0, "b": 1, " ": 2, "a ": 3, "a b": 4}, merges=[("a", " "), ("a ", "b")])).save(str(path))
    assert token_counts.count("a b", str(path)) == 1
    assert token_counts.count("a b" * 30_000, str(path)) == len(Tokenizer.from_file(str(path)).encode("a b" * 30_000).ids)


def test_chat_query_renders_every_prefix(spark):
    """The query's template is a black box: of 200 turns the longest prefix rendered has all."""
    turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(200)]
    seen = []

    def template(t):
        seen.append(len(t))
        return queries.rendered(t)

    r = chat.Renderer(template)
    for t in turns:
        r.add(t)
    assert max(seen) >= 200 and not getattr(queries.rendered, "local", False)


def test_ann_folds_equal_vectors(spark):
    rows = [(k, [1.0, 2.0]) for k in range(400)] + [(7, [1.0, 2.0])] * 5 + [(1000 + k, [float(k), 3.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    kept = ann.folded(df, 3).collect()
    assert Counter(r["id"] for r in kept if r["v"] == [1.0, 2.0]) == {0: 1, 1: 1, 2: 1, 3: 1}
    assert sum(r["id"] >= 1000 for r in kept) == 40
    assert Counter(r["id"] for r in ann.folded(spark.createDataFrame([(7, [1.0])] * 9 + [(8, [1.0])], "id long, v array<double>"), 3).collect()) == {7: 3, 8: 1}
    found = ann.search(df.withColumnsRenamed({"id": "vec_id", "v": "embedding"}), F.col("id").isin(7, 399), k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(7, 1, 0), (7, 2, 1), (7, 3, 2), (399, 1, 0), (399, 2, 1), (399, 3, 2)]


def test_classifier_leaves_columns_of_any_name(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20).withColumns({"__score": F.lit(7), "Score": F.lit("s"), "score_": F.lit(1)})
    out = corpus_pipeline.classify(spark, docs, sf)
    assert out.columns == docs.columns
    assert {(r["__score"], r["Score"], r["score_"]) for r in out.collect()} <= {(7, "s", 1)}
