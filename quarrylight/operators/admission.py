"""Backlog report, domain quality and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.operators.groups import top_n, top_n_by
from quarrylight.sources.corpus import Corpus
from quarrylight.sources.policies import THRESHOLDS, has_thresholds


def backlog_report(
    c: Corpus, now: Column, stale_after_days: int = V.STALE_AFTER_DAYS, samples: int = 5, domains: list[str] | None = None
) -> DataFrame:
    """Counts per domain and, with ``domain`` NULL, over all domains."""
    dom = c.domains.select(F.col("id").alias("domain_id"), "domain")
    rows = c.sources.join(dom, "domain_id").select("id", "domain", "status", "last_crawled_at", "canonical_url")
    wanted = [d.strip().lower() for d in domains or [] if d.strip()]
    if wanted:
        rows = rows.where(F.col("domain").isin(*wanted))
    cutoff = F.timestamp_micros(F.unix_micros(now) - max(1, stale_after_days) * 86_400_000_000)
    stale = (F.col("status") == "succeeded") & (F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < cutoff))
    counts = rows.rollup("domain").agg(
        F.count("*").alias("sources_total"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(stale).alias("stale_succeeded"), F.grouping("domain").alias("is_total"),
    )
    first = top_n(rows.where("status = 'pending'"), ["domain"], [F.asc("id")], samples)
    listed = first.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("id", "canonical_url"))).alias("pending_samples"))
    return counts.join(listed, "domain", "left")


def recent_failures(c: Corpus, policies: DataFrame) -> DataFrame:
    """The last N source-linked jobs of each domain, whatever their status.

    N comes from the domain's policy. A domain may own a large part of all
    jobs: the cut is taken in hashed slices first.
    """
    dom = c.domains.select(F.col("id").alias("domain_id"), "domain")
    windows = policies.select("domain", "admission_recent_crawl_window")
    src = c.sources.select(F.col("id").alias("source_id"), "domain_id")
    jobs = c.crawl_jobs.where("source_id IS NOT NULL").select("id", "source_id", "status", "started_at")
    window = F.greatest(F.lit(1), F.coalesce("admission_recent_crawl_window", F.lit(V.RECENT_WINDOW)))
    limits = dom.join(windows, "domain", "left").select("domain_id", "domain", window.alias("recent_crawl_window"))
    rows = jobs.join(src, "source_id").join(limits.drop("domain"), "domain_id")
    last = top_n_by(
        rows, ["domain_id"], [F.desc_nulls_first("started_at"), F.desc("id")], F.col("recent_crawl_window"), ["id"]
    )
    per = last.groupBy("domain_id").agg(
        F.count_if(F.col("status").isin("succeeded", "failed")).alias("attempted"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    attempted, failed = F.coalesce("attempted", F.lit(0)), F.coalesce("failed", F.lit(0))
    return limits.join(per, "domain_id", "left").select(
        "domain_id", "domain", "recent_crawl_window", attempted.alias("recent_attempted_crawls"),
        failed.alias("recent_failed_crawls"), F.round(F.try_divide(failed, attempted), 6).alias("recent_failure_rate"),
    )


def domain_quality(c: Corpus, policies: DataFrame) -> DataFrame:
    """Quality of every domain in one pass: sources with their latest document."""
    good = c.sources.where("status = 'succeeded'").select("domain_id", F.col("latest_document_id").alias("document_id"))
    docs = c.documents.select(F.col("id").alias("document_id"), "parse_confidence")
    with_program = c.programs.select("document_id", F.lit(True).alias("has_program")).distinct()
    rows = good.join(docs, "document_id", "left").join(with_program, "document_id", "left")
    have = F.col("document_id").isNotNull()
    per = rows.groupBy("domain_id").agg(
        F.count("*").alias("succeeded"), F.avg("parse_confidence").alias("conf"), F.count_if(have).alias("with_docs"),
        F.count_if(have & F.col("has_program").isNull()).alias("zero"),
    )
    zero, docs_n = F.coalesce("zero", F.lit(0)), F.coalesce("with_docs", F.lit(0))
    return recent_failures(c, policies).join(per, "domain_id", "left").select(
        "domain_id", "domain", F.coalesce("succeeded", F.lit(0)).alias("succeeded_sources"), "recent_crawl_window",
        "recent_attempted_crawls", "recent_failed_crawls", "recent_failure_rate",
        F.round("conf", 10).alias("avg_parse_confidence"), docs_n.alias("succeeded_with_documents"),
        zero.alias("zero_program_succeeded_sources"), F.round(F.try_divide(zero, docs_n), 6).alias("zero_program_rate"),
    )


def block_reason() -> Column:
    """The first threshold a domain misses; NULL when it is admitted."""
    rate, conf, zero = F.col("recent_failure_rate"), F.col("avg_parse_confidence"), F.col("zero_program_rate")
    min_sources, max_fail, min_conf, max_zero = (F.col(t) for t in THRESHOLDS)
    return (
        F.when(F.col("succeeded_sources") < min_sources, "domain_quality_insufficient_succeeded_sources")
        .when(max_fail.isNotNull() & rate.isNull(), "domain_quality_insufficient_recent_crawl_history")
        .when(rate > max_fail, "domain_quality_recent_failure_rate_exceeded")
        .when(min_conf.isNotNull() & conf.isNull(), "domain_quality_missing_parse_confidence")
        .when(conf < min_conf, "domain_quality_low_parse_confidence")
        .when(max_zero.isNotNull() & zero.isNull(), "domain_quality_missing_zero_program_rate")
        .when(zero > max_zero, "domain_quality_high_zero_program_rate")
    )


def admissions(c: Corpus, policies: DataFrame) -> DataFrame:
    """Quality, thresholds and decision of every domain."""
    flags = c.domains.select("domain", "allowlisted", "paused")
    rules = policies.select("domain", *THRESHOLDS, F.lit(True).alias("policy_present"), "per_domain_limit", "seed_urls")
    rows = domain_quality(c, policies).join(flags, "domain").join(rules, "domain", "left")
    reason = block_reason()
    return rows.withColumn("policy_present", F.coalesce("policy_present", F.lit(False))).withColumn(
        "admission_policy_enabled", has_thresholds()
    ).withColumn("admitted", reason.isNull()).withColumn("admission_block_reason", reason)


def quality_totals(decided: DataFrame) -> DataFrame:
    return decided.agg(
        F.count("*").alias("domains_count"), F.count_if("admitted").alias("admitted"),
        F.count_if(~F.col("admitted")).alias("blocked"),
    )
