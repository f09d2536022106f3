"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage as Parquet to the shared folder named in
``spark.checkpoint.dir`` and reads it again as the next one's input, so a lost
executor costs at most the running stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mesaquery.llm import linededup, mixing, pieces, quality, simhash
from mesaquery.llm.common import materialise, table
from mesaquery.llm.queries import DOCS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and so do documents that fail the base rules or lose too much.

    Null and empty texts fail the base rules. Rows with null ids or other null
    columns, and rows that repeat, are judged one by one; very long texts whole.
    An empty table stays empty; columns keep their names and values.
    """
    return quality.apply_quality_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines too frequent within their source go; every document stays, with an empty text if all its lines go.

    Rows with a null source are one host. Texts that repeat count once, and rows
    that repeat lose the same lines. An empty table stays empty.
    """
    return linededup.apply_line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id, a null one only where all are null.

    Groups are judged by the texts alone: five words, similarity 0.8 or more. Rows
    that share a doc_id but not their text aren't copies. Rows equal in all
    columns are one document. Empty texts are copies of each other.
    """
    return simhash.apply_near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes.

    A null source is a source. Documents without words stay once. In each source
    one copy at most is cut, also among rows that repeat. An empty table stays empty.
    """
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and decoded text of every row; null and empty texts give the begin and end ids."""
    return pieces.encode_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mix_sources", mix), ("sentencepiece", encode)]

#: SQL can express neither the fingerprints nor the encoding; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents", DOCS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
