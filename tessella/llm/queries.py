"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import alignment, bpe, chat, embeddings, langid, minhash, mixing, oracles, pages, quality, repetition, substrings, toxicity, trie
from tessella.llm.common import is_held_out, read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    sample = quality.labelled_sample(labels, "quality", ~is_held_out(F.col("doc_id")), max_train=20_000)
    vectors, network = quality.train(docs, sample)
    return quality.score(docs, vectors, network).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    learnable = ~is_held_out(F.col("doc_id"))
    sample = quality.labelled_sample(labels, "toxic", learnable, max_train=20_000)
    model = toxicity.train(docs, sample, learnable)
    return toxicity.score(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), forest=minhash.Forest(shingle=4))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read_table(spark, sf_dir, "pages"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents")).drop("spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs, "text", "lang", ~is_held_out(F.col("doc_id")))
    return langid.predict(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(more)), arranged=True)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    docs = read_table(spark, sf_dir, "documents")
    return alignment.link_statistics(docs, files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"), files.PATTERN)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(read_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_minhash": op4_minhash,
    "op5_html_text": op5_html_text,
    "op6_substrings": op6_substrings,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_embeddings": op9_embeddings,
    "op10_language_id": op10_language_id,
    "op11_chat": op11_chat,
    "op12_alignment": op12_alignment,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = oracles.ORACLES
