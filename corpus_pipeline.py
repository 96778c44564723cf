"""From raw documents to a training mix: each stage works on what the one before it kept.

Every stage returns the columns of ``documents``; the last adds how many copies the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tailseries.llm.common import read
from tailseries.llm.decontaminate import decontaminate
from tailseries.llm.language_id import fit, fold, identify
from tailseries.llm.line_dedup import line_dedup
from tailseries.llm.mixing import mixed
from tailseries.llm.near_dedup import one_of_each


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; no text, no letter or no such language: they go."""
    model = fit(docs.where(fold() != 2))
    return identify(docs, model).where(~F.col("rejected")).select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document of which nothing is left goes."""
    cut = line_dedup(docs, carry=tuple(docs.columns)).where(
        (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))
    )
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in the shares of its sources."""
    return mixed(docs)


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("mixing", mix),
]

#: Language models, fingerprints and seeded choices are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
