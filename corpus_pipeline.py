"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Counted as part of the subpackage ``ballotbook.llm`` and taken out together with it.

All stages: texts are read whole, however long. All but the last return the columns of ``docs``, and other columns,
of any name, pass through. An empty table stays empty. Repeated rows are told apart only where a stage says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ballotbook.llm.decontamination import remove_contaminated
from ballotbook.llm.lines import dedup_lines
from ballotbook.llm.minhash import drop_near_duplicates
from ballotbook.llm.packing import pack_documents
from ballotbook.llm.quality import keep_quality
from ballotbook.llm.queries import table, tokenizer_path
from ballotbook.llm.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored too, and repeated rows have the same score. A tie with the threshold stays.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines one occurrence stays in the texts.

    All rows stay; null texts stay null. Of equal lines that with the smallest (doc_id, row, line) stays, of repeated
    rows too. Rows without doc_id are not compared.
    """
    return dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Null texts and texts without words are duplicates of nothing. Rows without doc_id stay. Rows that share a doc_id
    stay or go together.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.

    Null texts have no words and stay. Without benchmark items all stay.
    """
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, mixed by source.

    A null text is its end token alone, null sources are one source, and each of repeated rows is packed.
    """
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Several stages have no SQL form; tests/llm holds the operators against brute force and the stages against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
