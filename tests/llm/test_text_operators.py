"""BPE, token counts, GIF media, chat formatting and WARC against libraries, round trips and DuckDB."""

import hashlib
import io
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, chat, gif, queries, token_counts, warc

ODD = [
    None,
    "",
    " ",
    "\n\t  \n",
    "a",
    "Hello, World!  It's  1999.",
    "<|endoftext|> x <|endoftext|><|startoftext|>",
    "naïve café Straße ΣΑΣ İstanbul ﬁ é ẛ̣",
    "日本語テキスト 한국어 🙂👍🏽",
    "\x1c\x1d a\x1eb \x85  x　y",
    "x" * 5000,
    "word " * 3000,
    "don't we'll I'M they'RE",
    "\x00\x01 null \x7f",
    "   leading and trailing   ",
]


def texts_of(spark, sf):
    return [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_is_the_librarys(spark, sf):
    t, own = library("word_bpe_49k.json"), bpe.load("word_bpe_49k.json")
    for x in ODD + texts_of(spark, sf):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert own.encode(x) == ids
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, sf):
    t = library("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in queries.op7_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        x = got[r["doc_id"]]
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert x["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_keeps_other_columns_and_takes_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "a", [5]), (1, None, "a", [5]), (2, "cat dog", "b", [6])], "doc_id long, text string, decoded string, ids array<int>")
    rows = bpe.encode(df).collect()
    assert sorted((r["doc_id"], len(r["ids"]), r["decoded"] != "a") for r in rows) == [(1, 0, True), (1, 0, True), (2, 2, True)]
    assert bpe.encode(df.limit(0)).count() == 0
    assert [r["decoded"] for r in bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).collect()] == [""]


def test_token_counts_are_the_librarys(spark, sf):
    t = library("byte_bpe_50k.json")
    for x in ODD + texts_of(spark, sf):
        want = len(t.encode(x or "", add_special_tokens=False).ids)
        assert token_counts.count(x, "byte_bpe_50k.json") == want
        assert token_counts.count(x, "byte_bpe_50k.json", window=40, overlap=8) == want


def test_resynchronisation_on_random_texts():
    t, rng = library("byte_bpe_50k.json"), random.Random(3)
    starts = lambda s: [o[0] for o in t.encode(s, add_special_tokens=False).offsets]
    for _ in range(60):
        x = "".join(rng.choice(["a", "b", " ", "  ", "\n", "é", "🙂", "word", "1", "'s", "　", "-" * 30]) for _ in range(rng.randrange(1, 400)))
        assert token_counts.spliced_count(x, starts, 50, 6) == len(t.encode(x, add_special_tokens=False).ids)


def test_token_count_query(spark, sf):
    rows = queries.op10_token_counts(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    df = spark.createDataFrame([(1, None, 7), (1, "a b", 7)], "doc_id long, text string, n_tokens int")
    got = token_counts.token_counts(df).orderBy("n_tokens").collect()
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got] == [(0, 0, False), (3, 2, False)]
    assert token_counts.token_counts(df.limit(0)).count() == 0


def plain_lzw(stream, bits, n):
    """A decoder as in the textbooks, code by code."""
    clear, end = 1 << bits, (1 << bits) + 1
    bitstream = int.from_bytes(stream, "little")
    at, width, out = 0, bits + 1, b""
    table, prev = [bytes([i]) for i in range(clear)] + [b"", b""], None
    while len(out) < n:
        code = bitstream >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, prev, width = table[: clear + 2], None, bits + 1
            continue
        if code == end:
            break
        entry = table[code] if code < len(table) else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table.append(prev + entry[:1])
        out, prev = out + entry, entry
        if len(table) == 1 << width and width < 12:
            width += 1
    return out


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_round_trip_and_plain_decoder(bits):
    rng = np.random.default_rng(bits)
    for n in (1, 2, 3, 100, 5000, 40_000):
        for data in (rng.integers(0, 1 << bits, n), np.zeros(n), np.arange(n) % 3):
            data = data.astype(np.uint8).tobytes()
            stream = gif.lzw_encode(data, bits)
            assert gif.lzw_decode(stream, bits, n) == data
            assert plain_lzw(stream, bits, n) == data


def block(stream):
    return b"".join(bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)) + b"\0"


def image(left, top, w, h, samples, flags=0, local=b""):
    return struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + local + b"\x02" + block(gif.lzw_encode(bytes(samples), 2))


def control(disposal=0, delay=5, clear=None):
    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)


def test_gif_palettes_disposal_transparency_and_interlace():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette
    frames = [
        control(0, 7) + image(0, 0, 2, 2, [1, 1, 1, 1]),
        control(3, 1, clear=0) + image(0, 0, 2, 1, [0, 2]),  # the first sample is transparent; undone afterwards
        control(2, 1) + image(1, 1, 1, 1, [3]),  # cleared afterwards
        control(1, 1) + image(0, 0, 1, 1, [0], flags=0x81, local=bytes([9, 9, 9] * 4)),
    ]
    got = gif.decode_gif(head + b"".join(frames) + b"\x3b")
    red, green, blue, none, grey = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0), (9, 9, 9, 255)
    shown = [[tuple(int(v) for v in px) for px in f.canvas.reshape(-1, 4)] for f in got]
    assert shown == [[red] * 4, [red, green, red, red], [red, red, red, blue], [grey, red, red, none]]
    assert [f.delay_ms for f in got] == [70, 10, 10, 10]
    tall = b"GIF89a" + struct.pack("<HHBBB", 1, 9, 0x81, 0, 0) + palette + control() + image(0, 0, 1, 9, [0, 1, 2, 3, 0, 1, 2, 3, 0], flags=0x40) + b"\x3b"
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    want = [0] * 9
    for value, row in zip([0, 1, 2, 3, 0, 1, 2, 3, 0], order, strict=True):
        want[row] = value
    assert [int(x) for x in gif.decode_gif(tall)[0].canvas[:, 0, 2]] == [255 if v == 3 else 0 for v in want]


def test_gif_query_round_trip(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op5_gif(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = rows[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"]) == (len(raw), len(payload))
        assert x["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert x["tail_crc32"] == zlib.crc32(payload[-64:])
        counts = np.bincount(np.frombuffer(payload, np.uint8) // 16, minlength=16)
        assert x["feature"] == ",".join(map(str, counts))


def test_gif_nulls_broken_media_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a" * 70_000, "y"), (2, "a" * 70_000, "y")], "doc_id long, text string, frames string")
    media = gif.to_gif(df)
    out = {r["doc_id"]: r for r in gif.with_frames(media).collect()}
    assert [len(f["samples"]) for f in out[1]["frames"]] == [64]
    assert b"".join(bytes(f["samples"]) for f in out[2]["frames"])[:70_000] == b"a" * 70_000 and len(out[2]["frames"]) == 2
    broken = spark.createDataFrame([(None,), (b"GIF89a",), (b"junk",)], "media binary")
    got = gif.with_frames(broken).collect()
    assert all(r["frames"] is None for r in got) and sum(r["error"] is None for r in got) == 1
    assert gif.with_frames(media.limit(0)).count() == 0


def duck(sf, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


@pytest.mark.parametrize(("name", "table"), [("op2_chat", "conversations"), ("op6_jaccard", "documents"), ("op8_warc", "pages")])
def test_queries_equal_their_sql(spark, sf, name, table):
    columns, rows = duck(sf, queries.SQL[name], [table])
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, rows))


def test_chat_reads_back_what_it_was_given(spark):
    rng = random.Random(5)
    parts = ["\\", "###", "</turn>", " ", ":", "\n", "x", "Assistant", "### Assistant: ", "🙂"]
    turns = [(c, k, rng.choice(["user", "assistant", "sys:tem", "a###b\\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for c in range(30) for k in range(rng.randrange(1, 9))]
    turns += [(100, k, ("user", "assistant")[k % 2], f"turn {k} \\") for k in range(400)]  # beyond the window
    turns += [(None, None, None, None), (None, None, None, None), (101, 1, "assistant", None)]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    by = {}
    for c, k, role, text in turns:
        by.setdefault(c, []).append((-1 if k is None else k, role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["rewrites"]) == (len(rows), len(loss), False)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        whole = chat.plain_template([(r, t) for _, r, t in rows])
        assert got[c]["formatted_chars"] == len(whole)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert not chat.rewrites_history(chat.plain_template, turns)
    assert not chat.rewrites_history(lambda t: chat.plain_template(t) + "<end>", turns)  # a suffix that moves on
    assert chat.rewrites_history(lambda t: f"{len(t)} turns\n" + chat.plain_template(t), turns)
    last_only = lambda t: "".join(x for r, x in t if r == "user") + "".join(x for r, x in t[-1:] if r != "user")
    assert chat.rewrites_history(last_only, turns)


LATE = {
    "keeps the last 100": lambda t: chat.plain_template(t[-100:]),
    "drops old turns past a budget": lambda t: chat.plain_template(t if len(t) <= 100 else t[:1] + t[-50:]),
    "changes turns more than 4 back": lambda t: chat.plain_template(t if len(t) <= 100 else [*[(r, x.upper()) for r, x in t[:-5]], *t[-5:]]),
}


@pytest.mark.parametrize("template", LATE.values(), ids=LATE.keys())
def test_chat_finds_a_template_that_starts_to_rewrite_at_turn_100(spark, template):
    turns = [("user" if k % 2 == 0 else "assistant", f"said {k}") for k in range(130)]
    assert not chat.rewrites_history(template, turns[:100])
    assert chat.rewrites_history(template, turns)
    df = spark.createDataFrame([(1, k, r, x) for k, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_turns(df, template=template).collect(), key=lambda r: r["position"])
    assert [r["rewrites"] for r in rows] == [k >= 100 for k in range(130)]
    assert [r["loss"] for r in rows] == [k < 100 and k % 2 == 1 for k in range(130)]
    assert chat.read_back(chat.format_turns(df, template=template)).first()["rewrites"]


def test_chat_takes_the_short_cut_only_where_the_template_is_declared_local():
    most = {}

    def seen(name):
        def template(turns):
            most[name] = max(most.get(name, 0), len(turns))
            return chat.plain_template(turns)

        return template

    turns = [("user", f"said {k}") for k in range(200)]
    spans = {name: [r.add(t) for t in turns] for name, r in (("unknown", chat.Renderer(seen("unknown"))), ("declared", chat.Renderer(chat.local(seen("declared")))))}
    assert most == {"unknown": 200, "declared": chat.WINDOW}
    assert spans["unknown"] == spans["declared"]


def test_warc_sizes_of_records_with_long_urls(spark, tmp_path):
    big = "x" * 500
    noise = "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(300))
    lengths = [*range(3400, 4140, 20), *range(7500, 8240, 20), 16_000]
    rows = [(1, "http://a/1", big)]
    for k, n in enumerate(lengths):
        for text in (noise, "y" * len(noise)):  # that shrink little and much
            rows += [(len(rows) + 1, f"http://a/{text[:n]}", big), (len(rows) + 2, f"http://a/{text[:n]}", f"own {k} {text[0]}")]
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string")), path)
    want = {k: len(t) for k, _, t in rows}
    for columns in (None, "page_id,record_type,payload_bytes"):
        got = warc.read_warc(spark, path, columns=columns).select("page_id", "record_type", "payload_bytes").collect()
        assert sum(r["record_type"] == "revisit" for r in got) == 2 * len(lengths)
        assert {r["page_id"]: r["payload_bytes"] for r in got} == want


def test_warc_pushdown_headers_and_edges(spark, tmp_path):
    big = "x" * 500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (2, "http://b/2", big), (3, None, None), (4, "http://a b/4", ""), (5, "http://c", "short"), (6, "http://c", "short"), (None, "http://d", big), (7, "http://e", "é" * 200_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_records(df), path, rollBytes=2000)
    back = warc.read_warc(spark, path)
    got = back.collect()
    assert len(got) == len(rows)
    assert sorted((r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit") == [(2, 1), (2, 1)]
    assert all(bytes(r["payload"]) == {1: big, 3: "", 4: "", 5: "short", 6: "short", 7: "é" * 200_000, None: big}[r["page_id"]].encode() for r in got if r["record_type"] == "response")
    assert all(r["payload_bytes"] == 500 for r in got if r["record_type"] == "revisit")
    only = warc.read_warc(spark, path, columns="page_id,record_type,target_uri").where("record_type = 'response' and page_id in (5, 6)")
    assert sorted(r["page_id"] for r in only.collect()) == [5, 6]
    assert {r["page_id"] for r in back.where("target_uri like 'http://a%'").collect()} == {1, 2, 4}
    reader = warc.WarcReader(path, ["page_id"])
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 1)]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    empty = str(tmp_path / "none")
    warc.write_warc(warc.plan_records(df.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_members_are_plain_gzip():
    import gzip

    row = {"page_id": 1, "record_type": "response", "target_uri": "http://x", "payload_digest": "0" * 64, "refers_to": None, "payload_bytes": 3, "payload": b"abc"}
    data = warc.member(row) * 3
    assert gzip.decompress(data).count(b"WARC/1.1") == 3
    plain = b"".join(gzip.compress(gzip.decompress(warc.member(row)), mtime=0) for _ in range(3))  # no lengths inside
    for blob in (data, plain):
        seen = [(h["warc-type"], w()[-3:]) for h, _, w in warc.Members(io.BytesIO(blob), len(blob), chunk=7)]
        assert seen == [("response", b"abc")] * 3
    bad = bytearray(data)
    bad[80] ^= 0xFF
    with pytest.raises((ValueError, zlib.error)):
        [w() for _, _, w in warc.Members(io.BytesIO(bytes(bad)), len(bad))]


def test_sentencepiece_models_count_whole_texts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    t = sentencepiece.SentencePieceProcessor(model_file=path)
    for x in ODD:
        assert token_counts.count(x, path, window=10) == len(t.encode(x or ""))
