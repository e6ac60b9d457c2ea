"""From raw documents to packed training sequences: each stage works on what the one before it kept.

A stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import langid
from lamina.llm.common import shared_folder, table
from lamina.llm.near_copies import keep_first
from lamina.llm.packing import pack
from lamina.llm.queries import vocabulary
from lamina.llm.substring import SubstringDedup
from lamina.plans.workers import let_workers_import

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null, empty and letterless ones among them. The model
    learns from this stage's own input; a missing language is filled in; rows that repeat all stay."""
    return langid.kept(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document of smallest id stays: SimHash proposes pairs, and 0.8 of all distinct
    five-word shingles decides. See keep_first for nulls, empty texts and repeated rows."""
    return keep_first(docs, least=0.8)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans of sentences go from the texts, and documents of which nothing is left. Null and
    empty texts stay as they are; n_chars is that of the new text."""
    cleaned = SubstringDedup().dedup(docs)
    left = cleaned.where(~((F.col("n_removed") > 0) & (F.trim("text") == "")))
    return left.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a null or empty text is one token."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=1)


def _prepared(stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: stage(let_workers_import(spark), docs, sf_dir)


STAGES = [
    ("language ID", _prepared(identify_language)),
    ("SimHash near-dedup", _prepared(drop_near_copies)),
    ("substring dedup", _prepared(drop_repeated_passages)),
    ("packing", _prepared(pack_sequences)),
]

#: No stage but the last could be said in SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        folder = shared_folder(spark, f"stage-{number}")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
