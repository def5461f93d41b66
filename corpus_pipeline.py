"""The corpus pipeline: five operators, one after another, each stage written as Parquet and read again.

toxicity -> line dedup -> MinHash near-dedup -> mixing to target weights -> SentencePiece.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import line_dedup, minhash, mixing, sentencepiece_np, toxicity
from quire.llm.queries import TOXIC_FROM, vocabulary
from quire.llm.store import written


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source, row): the columns of ``docs`` as one struct beside those that operators read.

    No column an operator adds can then take the place of a column of the table.
    """
    return docs.select("doc_id", "text", *["source"] * ("source" in docs.columns), F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("row"))


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``found``, n_chars by the text it has now."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[own[c] if c in own else F.col("row").getField(c).alias(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold, with a model fitted to a bounded sample of the labels of ``sf_dir``.

    Null and empty texts have the score of a text without toxic tokens.  Without labels every score is 0 and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.train(docs, labels)
    return _unpacked(toxicity.tag(_packed(docs), model, spans=False).where(F.col("score") < TOXIC_FROM), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines of three words or more, and without shorter ones in copied runs; documents of which nothing is left go.

    Documents that had no words stay.
    """
    gone = line_dedup.duplicate_lines(docs, min_words=3, short_runs=True)
    cleaned = line_dedup.drop_lines(_packed(docs), gone, min_words=3, short_runs=True)
    return _unpacked(cleaned.where(~F.col("emptied")), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest doc_id, of each group of near copies; different texts of one doc_id are judged each by itself.

    Five-word shingles and a similarity of 0.8, the thresholds that hold where no contract names others.  Rows without words stay.
    """
    return minhash.representatives(docs, width=5, percent=80, components=80, bands=20)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in mixed order: partitions follow each other by slot, and rows within them by slot and place.

    Every document stays, also one without a source, an id or a text.
    """
    mixed = mixing.mix(_packed(docs))
    return _unpacked(mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place"), docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids, position) of every text that is left.

    Readers plan files by size, so rows do not come in the order in which they were written.  ``position`` (part, file and row of
    the table that ``docs`` reads) has it: the result ordered by it is the mixed order.
    """
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("int")
    position = F.struct(number(r"^part-(\d+)").alias("part"), number(r"-c(\d+)\.").alias("file"), F.col("_metadata.row_index").alias("row"))
    return sentencepiece_np.round_trip(docs.withColumn("position", position), vocabulary("piece_bpe_32k.model"), with_ids=True, keep=("position",))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: SQL can express neither a fitted model nor this tokenizer; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
