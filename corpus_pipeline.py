"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; ``run`` writes a stage's rows as Parquet in the shared folder and reads them
again for the next one.  All stages but the last return the columns of documents.

Defined results: a null or empty text has no words, fails the quality rules and
goes at once; a null lang or source is a language or source of its own; repeated
rows lose their lines alike, one of them stays in near-duplicates, whatever their
ids, and rows of one id with different texts are documents of their own; further
columns go along as they are up to the mixture, whatever their names, but for those
that begin with two underscores, which are the stages' own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from quillmark.llm.shared import shared_dir, tokenizer_file


#: Edits up to which lines are near copies; short lines allow fewer.
LINE_EDITS = 5
#: Similarity in percent from which documents are near-duplicates.
NEAR_PERCENT = 80


def _sized(docs: DataFrame) -> DataFrame:
    """Documents whose texts have changed, with n_chars as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated or nearly repeated lines; documents that lose every word go."""
    left = _sized(line_dedup.clean(docs, LINE_EDITS))
    return left.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.first_of_each(docs, NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeat where their source does."""
    return _sized(mixing.mix(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in training sequences."""
    return packing.pack(packing.encode(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", sequences),
]

#: The quality stage's perplexity and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
