"""From documents to training sequences: quality rules, near duplicates, personal data, packing.

Every stage takes rows with nulls in any column, empty and very long texts and repeated rows, and columns beyond those of
documents, whatever their names. A null or empty text fails the quality rules. Rows with a null doc_id are no near duplicates of
others and are packed like others. Of repeated rows one stays. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfarer.llm import jaccard, packing, pii, quality
from wayfarer.llm.queries import table, vocabulary_file
from wayfarer.shared import delete, new_folder, passing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; those they reject go. All columns stay."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group linked by five-word n-grams alike to 0.8 or more."""
    return jaccard.keep_first(docs, k=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data in its text replaced; n_chars follows the text."""
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences of at most 2048 tokens."""
    cut = packing.pieces(docs, vocabulary_file("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packing.pack(cut, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("sequences", sequences),
]

#: Packing and the tokens it packs can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written in the shared folder and read by the next.

    When a stage's rows are written, its own tables and the stage before's rows are deleted. Those of the last stage stay, as its result is
    read from them.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        with passing(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(folder)
        docs = spark.read.schema(kept.schema).parquet(folder)
        if last:
            delete(spark, last)
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
