"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``; the last returns the encoded documents. In every stage whole texts count, however long; columns beyond
doc_id, text and lang pass through unread, also such with clashing names; nulls in them change nothing; an empty table gives an empty one.
What a stage does with nulls, empty texts, ties and repeated rows is said beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm import decon, exact, langid, near, pieces
from orbweave.llm.frames import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, of uncertain language or unlike all taught ones go.

    A null or empty text goes. Repeated rows share their fate; of equal scores the first language by name counts. A null doc_id may stay.
    Rows without ``lang`` are judged, but teach nothing; if no row has one all go."""
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of byte-equal texts: that of the smallest doc_id (nulls last), of ties the least by its other columns.

    A null text stays, empty ones are equal, repeated rows are copies."""
    return exact.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Texts without words (null, empty) and rows with a null doc_id stay. Rows repeated with one doc_id are one document and stay or go together."""
    return near.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    A null or empty text stays; null, empty and repeated items change nothing. Repeated rows share their fate, whatever their doc_id."""
    return decon.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's best segmentation and its N best, checked by decoding.

    A null text has null ids, an empty one none; of equal scores the one whose last differing piece is longer comes first; repeated rows have equal results."""
    return pieces.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Trained models, sketches and piece lattices are beyond SQL; the stages are tested one by one by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
