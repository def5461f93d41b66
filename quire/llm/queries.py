"""Registered queries of the training-data operators: ``opN_<name>(spark, sf_dir)`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, chat, collocations, flat_tokens, line_dedup, mixing, oracles, pii, quality, sentencepiece_np, separator_scan, toxicity, word_tokens
from .minhash import near_duplicates
from .store import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; rows that share a doc_id are one document, see ``minhash``."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=85)


#: Score from which a document is predicted toxic.
TOXIC_FROM = 0.3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, n_spans, predicted) of every document.

    Null and empty texts have the score of a text without toxic tokens; a null doc_id is scored and its ``held_out`` is null.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.tag(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", F.size("spans").alias("n_spans"))
    return found.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; a null text is empty and has the end id only."""
    return sentencepiece_np.round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, read back from the formatted segments; null text is empty, a null conv_id is a conversation of its own."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.segments(rows))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block, release, deadline, slot and place of every document; null sources are a source, null texts have size 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"), F.md5("text").alias("text_md5"))
    return mixing.mix(docs).drop("source", "size", "text_md5")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document and the hash of its text without the lines that failed (null for a null text)."""
    found = quality.clean(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("clean_sha256", F.sha2("text", 256)).drop("text")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of every query; vectors that are null or hold null or non-finite components take no part, see ``bitsliced``."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bitsliced.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of every document: texts as flat files without an index, each ended by <|endoftext|>, and a scan of those files.

    Null texts have 0 tokens.
    """
    path, folder, end_id = vocabulary("word_bpe_49k.json"), shared_dir(spark), 49407

    def encoder():
        tok = word_tokens.tokenizer(path, plain_specials=True)
        return lambda texts: tok.encode(texts, end_id)

    dtype = word_tokens.tokenizer(path, True).dtype
    manifest = flat_tokens.write(_table(spark, sf_dir, "documents"), encoder, dtype, folder, ordered=False)
    return separator_scan.token_counts(spark, manifest, folder, dtype, end_id)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated lines; the hash of a null text is null, see ``line_dedup``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.drop_lines(docs, line_dedup.duplicate_lines(docs))
    return cleaned.select("doc_id", "n_lines", "n_dropped", "emptied", F.sha2("text", 256).alias("text_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; null texts hold the end id only, null doc_ids come last."""
    path, folder, end_id = vocabulary("word_bpe_49k.json"), shared_dir(spark), 1

    def encoder():
        tok = word_tokens.tokenizer(path)
        return lambda texts: tok.encode(texts, end_id)

    dtype = word_tokens.tokenizer(path).dtype
    manifest = flat_tokens.write(_table(spark, sf_dir, "documents"), encoder, dtype, folder)
    return flat_tokens.read_documents(spark, manifest, folder, dtype)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document, see ``pii``; null texts are empty, a null doc_id is judged like any other."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(docs, pii.train(docs)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every lang with at least 100 occurrences; null texts are empty, a null lang is ``und``, see ``collocations``."""
    return collocations.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def queries() -> dict[str, Query]:
    found = (op1_minhash, op2_toxicity, op3_sentencepiece, op4_chat, op5_mixing, op6_quality_rules, op7_topk, op8_token_counts, op9_line_dedup, op10_token_files, op11_pii, op12_collocations)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": oracles.MINHASH, "op4_chat": oracles.CHAT, "op5_mixing": mixing.oracle_sql(), "op6_quality_rules": oracles.QUALITY, "op7_topk": oracles.TOPK, "op9_line_dedup": oracles.LINES, "op12_collocations": collocations.ORACLE_SQL}
