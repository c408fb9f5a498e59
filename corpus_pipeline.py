"""A corpus-cleaning pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; whoever runs the stages one by one
writes each result as Parquet and reads it again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, minhash, mixing, repetition, substrings
from tessella.llm.common import cut, forget


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the repetition rules reject.

    Null and empty texts have no words and go; every row is judged alone, so repeated rows are treated alike.
    An empty table stays empty; columns stay as they are, whatever their names.
    """
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near duplicates (five words, similarity 0.8).

    Equal rows become one; rows of one id with different texts stay unless another id's document covers them; rows
    with a null id and texts without words stay.  An empty table stays empty; columns stay as they are.
    """
    return minhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has too; null ids come last.

    A document that loses all its words goes; one that loses none keeps its text as it is, a null or empty text
    too.  Rows of one id do not cut each other.  An empty table stays empty; other columns stay as they are.
    """
    return substrings.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight asks.

    A null source is a source; equal rows share their copies; a document may be taken up to three times, so the result may
    repeat rows.  An empty table stays empty; columns stay as they are.
    """
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every taken document, with digests of the ids and of what they decode to.

    A null or empty text has no ids; very long texts are encoded whole; repeated rows get equal results, and an
    empty table gives an empty one.  The id column stays, the others are replaced by the results.
    """
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenize),
]

#: SQL expresses neither the rounding draws nor the merges; a test holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to ``documents``; stages are cut by checkpoints in the shared folder, and each is deleted
    when the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
            forget(before)
    return docs
