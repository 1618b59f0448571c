"""From raw documents to packed training sequences, in five stages; each stage's rows are written and
read again before the next one runs, so a lost executor costs a stage at most.

Every stage but the last returns the columns of documents and works on all rows it is given.

Defined cases, as in the operators: null and empty texts fail the rules and go; very long texts are whole; rows
that are repeated are near copies, so that one doc_id's rows stay or go together; an empty table gives no rows;
extra columns pass all stages but the last, but for names with the operators' prefixes (_q_, _ld_, _dc_, _nd_).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoq.llm import decontaminate, line_dedup, near_dedup, packing, quality
from mnemoq.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the likelihood ratio reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five documents or more stay in one of them."""
    return line_dedup.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages for a twentieth of their words or more go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, each with its sequence and place there."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: hashed likelihood ratios and tokenizer ids are beyond SQL; tests hold each stage's operator against brute force, and run() against its stages' documents
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
