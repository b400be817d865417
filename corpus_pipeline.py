"""A training corpus from raw documents: five stages, each a table for the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise
from hourgrid.llm.decontam import find_overlaps
from hourgrid.llm.line_dedup import dedup_lines
from hourgrid.llm.mixing import mix_sources
from hourgrid.llm.near_copies import drop_near_copies as drop_copies
from hourgrid.llm.quality import fit_quality, resample


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the rejected ones go."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return resample(docs, model).filter("selected").select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: texts whose SimHash fingerprints of
    five-word shingles differ in two bits or fewer, or whose shingles are similar by 0.8 or more.
    Repeated rows are one document; empty and null texts are copies of each other."""
    return drop_copies(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    return find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(~F.col("contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with how often the mix takes each, 0 to 2 times, by source weights 3, 1, 2."""
    return mix_sources(docs, (3.0, 1.0, 2.0)).select(*docs.columns, "size", "target", "times", "taken")


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", drop_shared_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix),
]

#: Hashed models, Gumbel noise and shingle similarity are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder
    and read again, so a later stage never repeats an earlier one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
