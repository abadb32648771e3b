"""The corpus pipeline: clean, deduplicated and decontaminated documents, packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns to the shared folder
and hands the written table on. All stages but the last keep the columns of documents. Null or empty texts pass the
filters and are packed as their end id alone; very long texts are read whole; rows without an id are scored, searched for
test items and packed, but no other row stands for them; of equal documents the least id stays, and rows that share an id
are one document; an empty table passes through, and other columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import toxicity
from tabulon.llm.decontaminate import without_leaks
from tabulon.llm.near_dup import keep_first
from tabulon.llm.packing import pack_documents
from tabulon.llm.queries import VOCABULARY
from tabulon.llm.substring import repeats, without_repeats
from tabulon.llm.tokens import public_path
from tabulon.session import passing, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity reaches the threshold of their language."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return keep_first(docs, k=5, similarity=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that an earlier document has."""
    return without_repeats(docs, repeats(docs, min_words=51, similarity=0.8))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    return pack_documents(docs, public_path(VOCABULARY), size=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL = None  # the stages are tested against brute force in tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark) as kept:  # what a stage wrote for itself goes with it
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
