"""The corpus pipeline: language ID, line deduplication, near-duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), does its work on all rows of docs and returns a DataFrame; all but the last
return the columns of docs. run() writes each stage's result as Parquet to the shared folder and reads it again; all but
the last go when the last is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, line_dedup, simhash
from tidemark.llm.common import prepare, table
from tidemark.llm.queries import LINE_PAGES, LINE_RATIO, byte_bpe
from tidemark.session import remove


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the network is trained on those of them that have a label."""
    prepare(spark)
    return langid.accepted(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; n_chars follows the text."""
    prepare(spark)
    out = line_dedup.drop_boilerplate(docs, LINE_RATIO, LINE_PAGES)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that are left."""
    prepare(spark)
    return bpe.round_trip(docs, *byte_bpe())


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("decontamination", decontamination), ("byte_bpe", tokens)]

#: Language ID, SimHash and BPE can't be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    for name, _ in STAGES[:-1]:
        remove(spark, f"{folder}/{name}")
    return docs
