"""A corpus pipeline: toxic documents go, exact and near copies go, sources are mixed to weights, and windows are packed.

Each stage takes (spark, docs, sf_dir) and works on all of docs. For every stage null and empty texts are texts without words, a
table without rows gives one without rows, repeated rows are rows of their own until a copy stage drops them, long
texts are read whole, and further columns, whatever their names, stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plexmat.llm import common, exact_dedup, mixing, near_dedup, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity, by a lexicon learned from the table `labels`, is under the threshold. Without labels all stay."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, up to white space, the one of the smallest id; null ids come last, ties are one row."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id; null ids come last, ties are one row."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in ranges of their places in the mix. Texts without words are not taken."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens. A text without words is its closing id."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_windows)]
#: The stages learn from labels, follow similarity and encode tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result written to the shared folder and read by the next.

    What a stage stores for itself is deleted when its result is written, and so is each result after the next one.
    """
    with common.Scratch() as own:
        docs = common.table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            with common.Scratch() as inner:
                docs = inner.keep(common.stored(stage(spark, docs, sf_dir), f"stage-{name}"))
        return own.keep(common.stored(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}"))
