"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, in the columns of documents except for
the last. Between stages the rows are written to the shared folder and read again.

For all stages: rows that repeat are rows of their own; an empty table gives an empty one; columns beside
those of documents pass through, whatever their names, but for the last stage, which has its own; nothing depends on
the order of rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvia.llm import jaccard, line_dedup, mixing, packing, quality
from corvia.llm.queries import vocabulary
from corvia.llm.store import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects, each judged by its text alone.

    Null and empty texts have no words and get the network's score for that; null ids teach nothing and are judged
    as others; with labels of one kind only, or none, all stay or all go as the share of good labels says.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without cross-site boilerplate lines; documents of which nothing else is left go with them.

    Null and empty texts stay as they are; a null source is a site; of documents that share a line the one with the
    smallest doc_id keeps it, null ids last; n_chars is counted anew where lines went.
    """
    return line_dedup.without_boilerplate(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays; documents without words, and rows without doc_id, are in no group and stay.
    """
    return jaccard.one_of_each_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each time that a document is served.

    Documents without words are never served; a null source is a source; a last service in part has the
    document's first words, and n_chars set to match.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Null and empty texts are documents of the end token alone; rows with one doc_id are packed each on its own.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing to weights", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{i}")
    return docs
