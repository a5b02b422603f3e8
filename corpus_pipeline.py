"""A corpus pipeline: toxicity, line dedup, near-dedup, source mixing and encoding, one stage after the other.

Each stage takes all rows that the one before it has kept, as a Parquet table, and all but the
last return the columns of ``documents``, whatever their names. Texts that a stage changes get their
n_chars anew. Each stage of an empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import lines, mixing, near, pieces, toxicity
from rulewright.llm.common import stored
from rulewright.llm.queries import tokenizer_path
from rulewright.sources.tables import table


def _columns_of(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``, n_chars counted anew where there is such a column."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go; it learns from the labels of ``sf_dir``.

    Null and empty texts stay, rows that repeat go or stay together; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; every document stays.

    Null and empty texts stay as they are; rows of one doc_id with other texts are told apart.
    """
    return _columns_of(docs, lines.drop_repeated_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, at a similarity of 0.8 on five-word shingles.

    Rows with a null doc_id, null texts and texts without words are in no group and stay.
    """
    return near.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, so that the sources come to their target weights.

    Texts without words go; a null source is a source of its own.
    """
    return _columns_of(docs, mixing.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to the same text; null counts as empty."""
    return pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, n_tokens, ids, round_trip."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
