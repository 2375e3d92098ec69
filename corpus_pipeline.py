"""The corpus pipeline over ``documents``: five stages, each an operator of
``convspark.llm`` over all rows that its predecessor kept.

1. ``quality``: documents that the trained rule ensemble scores below 0.7 go.
2. ``exact_dedup``: of equal texts the row with the largest id stays.
3. ``near_dedup``: documents whose sets of five-word shingles have a Jaccard
   similarity of 0.8 or more are linked; of each component of links the
   document with the smallest id stays.
4. ``decontaminate``: documents that hold a benchmark item go.
5. ``tokenize``: token ids of every text that is left, with digests of the ids
   and of the bytes they decode to.

Stages 1 to 4 return the columns of ``documents`` as they came.  Null and
empty texts pass through (one of the equal ones stays); an empty table passes
every stage.  The quality model is trained, so no SQL gives these rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convspark.llm import byte_bpe, decontam, exact_dedup, jaccard_join, quality
from convspark.llm.common import materialize
from convspark.sources.tables import read_table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_group(docs, k=5, percent=80)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, *byte_bpe.default_tokenizer())


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("decontaminate", decontam_stage), ("tokenize", tokenize_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
