"""Constraint checks that Parquet does not enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V


def _found(df: DataFrame, rule: str, key: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def repeated(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return _found(many, rule, F.concat_ws("/", *keys))


def missing_parent(child: DataFrame, column: str, parent: DataFrame, rule: str) -> DataFrame:
    keys = parent.select(F.col("id").alias(column))
    lost = child.where(F.col(column).isNotNull()).select(column).distinct().join(keys, column, "left_anti")
    return _found(lost, rule, F.col(column))


def out_of_unit(df: DataFrame, rule: str) -> DataFrame:
    return _found(df.where("confidence < 0 OR confidence > 1"), rule, F.col("id"))


def corpus_violations(domains, sources, jobs, documents, programs, claims) -> DataFrame:
    parts = [
        repeated(domains, "domain_unique", ["domain"]), repeated(sources, "canonical_url_unique", ["canonical_url"]),
        missing_parent(sources, "domain_id", domains, "source_domain"),
        missing_parent(sources, "latest_document_id", documents, "source_latest_document"),
        missing_parent(jobs, "source_id", sources, "crawl_source"),
        missing_parent(documents, "source_id", sources, "document_source"),
        missing_parent(documents, "crawl_job_id", jobs, "document_crawl"),
        missing_parent(programs, "document_id", documents, "program_document"),
        missing_parent(claims, "document_id", documents, "claim_document"),
        missing_parent(claims, "program_id", programs, "claim_program"),
        out_of_unit(programs, "program_confidence"), out_of_unit(claims, "claim_confidence"),
    ]
    return reduce(DataFrame.unionByName, parts)


def dataset_violations(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Broken rules of queries(query_id, query, candidate_collection, status) and
    their candidates(query_id, key, relevance)."""
    status = queries.select("query_id", "status")
    blank = (F.coalesce("query_id", F.lit("")) == "") | (F.coalesce("query", F.lit("")) == "")
    judged = candidates.join(status, "query_id")
    per_query = F.concat_ws("/", "query_id", "key")
    parts = [
        _found(queries.where(blank), "query_incomplete", F.coalesce("query_id", F.lit(""))),
        _found(queries.where(~F.col("candidate_collection").isin(*V.CANDIDATE_COLLECTIONS)), "unknown_collection", F.col("query_id")),
        _found(queries.where(~F.col("status").isin(*V.DATASET_STATUSES)), "unknown_status", F.col("query_id")),
        repeated(queries, "query_id_repeated", ["query_id"]), repeated(candidates, "candidate_repeated", ["query_id", "key"]),
        _found(candidates.where("relevance NOT IN (0, 1, 2, 3)"), "grade_out_of_range", per_query),
        _found(judged.where("status = 'frozen' AND relevance IS NULL"), "unjudged_in_frozen", per_query),
    ]
    return reduce(DataFrame.unionByName, parts)


def experiment_name(queries: DataFrame) -> DataFrame:
    """The one candidate collection names the experiment; else it is NULL."""
    return queries.agg(F.min("candidate_collection").alias("low"), F.max("candidate_collection").alias("high")).select(
        F.when(F.col("low") != F.col("high"), F.lit(None).cast("string"))
        .when(F.col("low") == "source_evidence", "source_search_baseline")
        .when(F.col("low") == "program", "program_search_baseline").alias("experiment")
    )

