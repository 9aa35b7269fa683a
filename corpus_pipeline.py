"""The corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, benchmark decontamination, BPE.

A stage takes (spark, docs, sf_dir) and gives what the next one reads; all but the last give the columns of docs as they came, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, jaccard, langid, suffix
from quire.llm.common import crc32_bucket, small_batches, stored
from quire.llm.queries import VOCABULARY



def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language: all with a letter. Null and letterless texts go. Learns as op9 does, from docs."""
    small_batches(spark)
    model = langid.learn(docs.where(~langid.held_out(crc32_bucket(F.col("doc_id"), 4))))
    judged = langid.predict(docs, model, lang_out="_pipeline_lang", score_out="_pipeline_score")
    return judged.where("_pipeline_lang <> 'und'").select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents (five words, 0.8) the one with the least id; of rows of one id and one text a single one. A row goes for its own text,
    whatever other rows have its id. Documents without words stay."""
    small_batches(spark)
    return jaccard.one_of_each(docs, k=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a passage of over 50 words, or of 400 bytes, that stands more than once goes; n_chars follows the text. All rows stay, an emptied one with an empty text; null stays null."""
    small_batches(spark)
    kept = suffix.dedup(docs, out_col="_pipeline_kept", words=suffix.WORDS)
    new = {"text": F.when(F.col("text").isNull(), None).otherwise(F.col("_pipeline_kept")), "n_chars": F.length("_pipeline_kept").cast("bigint")}
    return kept.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within the error budget, go."""
    small_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    small_batches(spark)
    import public_tokenizers

    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, prefix="", digests=True).drop("text")


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", suffix_dedup), ("benchmark decontamination", decontamination), ("byte-level BPE encoding and decoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
