"""The corpus pipeline: classify, link near copies, mix, tokenise.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Every stage decides by rows, not by ids: null ids and repeated ids with different texts are rows like others. Null texts
count as empty, very long texts are taken whole, other columns pass through whatever their names, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, jaccard, mixing, quality
from plumbline.llm.common import crc_mod, stored, table

#: A document whose quality score is below this is rejected.
LEAST_QUALITY = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. Equal texts have equal scores: all of them go, or none; empty texts have the bias's score."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    name = "score"
    while name in {c.lower() for c in docs.columns}:  # a column of the documents stays as it is
        name += "_"
    scored = quality.score(docs, quality.fit(docs, labels), score_col=name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that the n-gram Jaccard join links: the one with the smallest id (null ids last).

    Of several rows with that id, the one whose set of shingles has the smaller key stays, then the one that was stored
    first. Rows without words are linked with nothing and all stay. Rows are known by their place in the stored files.
    """
    rows = placed(docs)
    if rows is None:
        rows = placed(stored(docs, "near-copies-rows"))
    found = jaccard.groups(rows, key_col="__row").where("component is not null").select("component", "key", F.struct(F.col("doc_id").isNull(), "doc_id", "set_key", "key").alias("place"))
    found = stored(found, "near-copies-found")
    first = found.groupBy("component").agg(F.min("place").alias("least"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("component", F.col("least.key").alias("__kept")), "near-copies-first")
    gone = stored(found.join(first, "component").where("key != __kept").select(F.col("key").alias("__row")), "near-copies-gone")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def placed(docs: DataFrame) -> DataFrame | None:
    """``docs`` with ``__row``, each row's place in the files that it is read from; none if it isn't read from files."""
    try:
        file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        return docs.select(*docs.columns, F.concat_ws(":", F.hex(F.xxhash64(file)), row.cast("string")).alias("__row"))
    except AnalysisException:
        return None


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. Of equal rows each may be taken another number of times."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digest of what they decode to: what training reads. An empty text has no ids."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", classify), ("near-copies", one_of_each), ("mix", mix), ("tokens", tokenise)]

#: Not expressible in SQL: a fitted classifier, random rounding and byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
