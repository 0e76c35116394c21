"""A corpus from raw documents to piece ids, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; its
result is written as Parquet and read again as the next one's ``docs``.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import jaccard, langid, mixing, pieces, quality
from lacuna.llm.common import release, settle, ship, spread, table, unused
from lacuna.llm.entry import tokenizer_path

#: Share of a text's letters that its language must have.
MIN_LANGUAGE_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without one that prevails, go."""
    ship(spark)
    at = unused(docs, "language")
    named = langid.label(docs, langid.train(docs), into=at)
    return named.filter((F.col(at)["lang"] != langid.UNKNOWN) & (F.col(at)["score"] >= MIN_LANGUAGE_SHARE)).drop(at)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    at = unused(docs, "quality")
    return quality.assess(docs, into=at).filter(F.col(at)["kept"]).drop(at)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, in whole documents: some go, some repeat up to three times."""
    return mixing.whole_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document: doc_id, source, n_pieces, piece_ids, text_crc32 (decoded)."""
    ship(spark)
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), model, decoded="text")  # in the text's place, so that it passes once
    return encoded.select("doc_id", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


STAGES = [("language_id", language), ("quality_rules", rules), ("jaccard_join", near_copies), ("source_mix", source_mix), ("piece_sampling", piece_ids)]

#: Learned models, hashed paths and sampled pieces have no SQL; the tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = spread(table(spark, sf_dir, "documents")), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
        release(*used)
        used = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
