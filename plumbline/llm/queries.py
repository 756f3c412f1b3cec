"""One thin query for each operator of this subpackage, and DuckDB SQL where SQL can express its result.

Each reads whole tables; the digest columns that its contract names are derived here from the operator's real output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, divergence, fim, gif, jaccard, lm, mixing, quality, token_counts, topk, warc
from .common import crc_mod, shared_dir, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


def rendered(turns: list[chat.Turn]) -> str:
    """The plain template as a black box: nothing is declared of it, so every prefix is rendered whole."""
    return chat.plain_template(turns)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_turns(rows.unionByName(own), template=rendered))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    out = quality.score(docs, weights)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = crc_mod("doc_id", 7)
    fold = F.when(rest == 2, lm.SCORED).when(rest == 3, lm.DELETED).otherwise(lm.TRAINED)
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold=fold)


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = gif.with_frames(gif.to_gif(docs).select("doc_id", "n_bytes", "media"))
    payload = F.reduce("frames", F.lit(b""), lambda a, f: F.concat(a, f["samples"]))
    greys = F.reduce("frames", F.array_repeat(F.lit(0).cast("long"), 16), lambda a, f: F.zip_with(a, f["greys"], lambda x, y: x + y))
    out = out.select("doc_id", "n_bytes", payload.alias("payload"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.array_join(greys, ",").alias("feature"), F.size("frames").cast("long").alias("n_frames"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "n_frames",
    )


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, threshold=90, nearest_rounds=2)
    return out.select("doc_id", "n_shingles", "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.plan_records(table(spark, sf_dir, "pages")), path)
    out = warc.stored_digest(warc.read_warc(spark, path))
    size = F.coalesce(F.octet_length("payload"), F.col("payload_bytes")).cast("long")
    return out.select("page_id", size.alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), "record_type", "refers_to")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fim.restore(F.col("fim.output"), F.col("fim.form"))
    return out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.when(~odd, F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))))
    return topk.search(rows.select("vec_id", whole.alias("vector")), F.col("id") % 50 == 0, k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_lm": op4_lm,
    "op5_gif": op5_gif,
    "op6_jaccard": op6_jaccard,
    "op7_bpe": op7_bpe,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_fim": op11_fim,
    "op12_divergence": op12_divergence,
    "op13_topk": op13_topk,
}

SQL: dict[str, str] = {
    "op2_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS escaped,
                replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS header
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(4 + length(header) + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op6_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), g AS (
            SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM w WHERE len(w) >= 3
        ), s AS (
            SELECT DISTINCT doc_id, a || ' ' || b || ' ' || c AS s FROM g WHERE c IS NOT NULL
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)
        ), n AS (
            SELECT doc_id, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS k FROM s GROUP BY doc_id
        ), rep AS (
            SELECT k, min(doc_id) AS r, min(n) AS n FROM n GROUP BY k
        ), t AS (
            SELECT r, n, s FROM rep JOIN s ON doc_id = r
        ), p AS (
            SELECT x.r AS a, y.r AS b FROM t x JOIN t y ON x.s = y.s AND x.r < y.r GROUP BY x.r, y.r, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
        ), both_ways AS (
            SELECT a, b FROM p UNION ALL SELECT b, a FROM p
        ), reach AS (
            SELECT r AS a, r AS b FROM rep UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
        ), comp AS (
            SELECT a, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (k) LEFT JOIN comp ON comp.a = r
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), q AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM q
    """,
    "op11_fim": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), k AS (
            SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
                CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS e
            FROM d
        ), f AS (
            SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form,
                array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s
            FROM k
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
            CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM f
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), w AS (
            SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), keep AS (
            SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30
        ), c AS (
            SELECT lang, source, term, count(*) AS c FROM w JOIN keep USING (lang, term) GROUP BY lang, source, term
        ), v AS (
            SELECT lang, count(*) AS v FROM keep GROUP BY lang
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), n AS (
            SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
        ), p AS (
            SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n::HUGEINT + 5 * v) AS p
            FROM n JOIN v USING (lang) JOIN keep k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term
        ), q AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM p JOIN v USING (lang) GROUP BY lang, term
        ), s AS (
            SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
        ), parts AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
            FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op13_topk": """
        WITH e AS (
            SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 50 = 0
        ), k AS (
            SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
    """,
}
