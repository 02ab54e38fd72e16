"""From raw documents to packed sequences: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm import line_dedup, mixing, ngram_join, packing, toxicity
from lipika.llm.common import settled, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored one half or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are nearly an earlier line go from the texts; every document stays, if only as an empty text."""
    out = line_dedup.without_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard, the one of smallest id stays."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: A trained classifier, a random sample and a packing plan are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # A stage's own tables go once its output is written.
        docs = settled(lambda: stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))  # noqa: B023
    return docs
