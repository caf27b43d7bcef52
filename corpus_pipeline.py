"""The corpus pipeline: documents through the stages of STAGES, in order.

Each stage works on all rows that the one before it kept and returns the columns of ``documents``; the last
returns encoded texts. What a stage returns is written to the shared folder and read again for the next.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables, and columns
beside those of ``documents`` under any names, which come through all stages but the last. Null and empty texts are no more toxic than
a text that tells nothing, are near-duplicates of each other (as are other texts without words), hold no
benchmark passage and no secret, and are encoded as null and as no pieces. Of equal rows one stays from the
near-dedup on; of rows of one key with different texts each is judged by its own text. Ties: a toxicity equal to
the threshold goes, a likeness of exactly 0.8 links, and of a group the smallest doc_id stays, missing ones last.
Whole texts are read, in blocks where they are long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, secret_scan, segmentation, simhash, toxicity
from tidemark.llm.shared import small_batches, written


#: Jaccard distance of sets of five-word shingles, an exact bound.
NEAR = 0.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go."""
    small_batches(spark)
    return toxicity.keep_ordinary(spark, docs, sf_dir)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays.

    Two documents are linked if they are alike in 0.8 or more of their shingles of five words.
    """
    small_batches(spark)
    return simhash.keep_first(docs, radius=NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with the benchmark go."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark."""
    small_batches(spark)
    return secret_scan.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's best segmentation and the changes that make the other N best of it, with scores and digests."""
    small_batches(spark)
    return segmentation.encode_documents(docs, nbest_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece_encoding", encode),
]
#: Models, fingerprints and segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
