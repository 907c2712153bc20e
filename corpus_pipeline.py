"""A training-data pipeline over documents: each stage's rows are written as Parquet and read again by the next.

Every stage takes texts whole, however long, and keeps all columns but for the last; columns of any other name pass through.
A null or empty text scores 0, has no lines, no shingles (such texts are one group, of which one row stays), no windows and no
tokens.  Rows that repeat are judged alike; near-dedup keeps one of them.  Ties go to the smallest doc_id; a null one is the largest.
Empty tables give empty results, an empty benchmark removes nothing, and without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import bpe, decontam, jaccard, linededup, toxicity
from latticework.llm.common import new_path, table
from latticework.llm.queries import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the threshold go.  The lexicon is learnt from the rows it is given."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are taken out of the text; every row stays."""
    return linededup.cleaned(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more stays, the one with the smallest doc_id (of rows that repeat it, one).

    SimHash balls wide enough for that similarity bring the texts together; exact similarity decides.
    """
    return jaccard.without_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]
#: Folding, shingles and merges aren't expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
