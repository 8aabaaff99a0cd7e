"""The corpus pipeline: language ID, quality, near-dedup, substring dedup, packing.

Each stage takes the documents that its predecessor kept, whole rows with all
columns, and returns those it keeps; the last returns the pieces of the packed
sequences. Every stage is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import common
from quarrylight.llm.catalog import tokenizer
from quarrylight.llm.language_id import UNKNOWN, fit_profiles, language
from quarrylight.llm.near_dedup import one_of_each
from quarrylight.llm.packing import pack
from quarrylight.llm.quality import fit_quality, quality_score
from quarrylight.llm.substring_dedup import remove_repeats


def _kept(docs: DataFrame, decision, keep) -> DataFrame:
    """The rows of ``docs`` whose ``decision`` satisfies ``keep``; one struct beside the rows, so no name can clash."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), decision.alias("found"))
    return rows.where(keep(F.col("found"))).select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: null texts and texts without letters. Profiles come from all rows with a language."""
    return _kept(docs, language(F.col("text"), fit_profiles(docs)), lambda found: found["lang"] != UNKNOWN)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below 0.5 under the model of the labelled ones among ``docs``."""
    common.bounded_batches(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, quality_score(F.col("text"), model), lambda score: score >= 0.5)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike in 80 of 100 five-word shingles, the one of smallest id stays."""
    return one_of_each(docs, shingle_words=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words that a window of 20 words covers whose words also start earlier. All documents stay, some shorter."""
    out = remove_repeats(docs, window=20)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language), ("quality_classifier", good_quality), ("near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeats), ("packing", packed),
]
#: SQL cannot express the learned stages; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = common.documents(spark, sf_dir)
    tables = common.Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
