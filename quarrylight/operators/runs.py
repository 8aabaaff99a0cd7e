"""Run summaries, run history and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.operators.groups import top_n
from quarrylight.sources.corpus import Corpus

SOURCE_ITEMS = ("extract_pending", "refresh_empty")


def top_errors(counts: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """``code:count`` of the most common codes; ties by code."""
    best = top_n(counts, keys, [F.desc("count"), F.asc("code")], n)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "code", "count").alias("t"))))
    return best.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["t"]), ",").alias("top_error_codes"))


def run_summary(items: DataFrame, threshold: float = V.FAILURE_RATE_THRESHOLD) -> DataFrame:
    """One row per run: counts, rates, sums and the most common error codes."""
    status, kind = F.col("status"), F.col("item_type")
    src = kind.isin(*SOURCE_ITEMS)
    ok = src & (status == "succeeded")
    programs = F.coalesce("program_count", F.lit(0))
    sums = items.groupBy("run_id").agg(
        F.count_if(ok).alias("succeeded"), F.count_if(src & (status == "failed")).alias("failed"),
        F.count_if(src & (status == "blocked")).alias("blocked_sources"), F.count_if(src & (status == "skipped")).alias("skipped"),
        F.count_if((kind == "domain_gate") & (status == "blocked")).alias("blocked_domain_gates"),
        F.sum(F.when(ok, programs).otherwise(0)).alias("programs_created_total"),
        F.avg(F.when(ok, F.col("parse_confidence"))).alias("conf"),
        F.count_if(ok & (F.col("mode") == "refresh_empty") & (programs > 0)).alias("empty_program_successes"),
        F.sum(F.coalesce("retry_count", F.lit(0))).alias("retry_events"),
        F.count_if(F.col("error_code") == "timeout").alias("timeout_count"),
        F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost"),
        F.min("at").alias("started_at"), F.max("at").alias("completed_at"),
    )
    bad = items.where(status.isin("failed", "blocked") & (F.coalesce("error_code", F.lit("")) != ""))
    codes = bad.groupBy("run_id", F.col("error_code").alias("code")).agg(F.count("*").alias("count"))
    rows = sums.join(top_errors(codes, ["run_id"]), "run_id", "left")
    done, failed = F.col("succeeded"), F.col("failed")
    rate = F.coalesce(F.try_divide(failed, done + failed), F.lit(0.0))
    return rows.select(
        "run_id", "started_at", "completed_at", done, failed, "skipped", "blocked_domain_gates",
        (F.col("blocked_sources") + F.col("blocked_domain_gates")).alias("blocked"),
        (done + failed + F.col("blocked_sources") + F.col("blocked_domain_gates") + F.col("skipped")).alias("processed"),
        "programs_created_total",
        F.round(F.coalesce(F.try_divide("programs_created_total", done), F.lit(0.0)), 6).alias("program_yield_rate"),
        F.round("conf", 10).alias("avg_parse_confidence"), "empty_program_successes", F.round(rate, 6).alias("failure_rate"),
        "retry_events", "timeout_count", F.coalesce("top_error_codes", F.lit("")).alias("top_error_codes"),
        F.round("cost", 6).alias("cost_usd_total"), F.round(F.try_divide("cost", done), 10).alias("avg_cost_per_success"),
        ((done + failed > 0) & (rate > threshold)).alias("should_fail"),
    )


def run_by_domain(items: DataFrame) -> DataFrame:
    src = F.col("item_type").isin(*SOURCE_ITEMS)
    known = items.where(F.col("status").isin("succeeded", "failed", "blocked", "skipped"))
    domain = F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown"))
    return known.groupBy("run_id", domain.alias("domain")).agg(
        F.count_if(src).alias("queued"), F.count("*").alias("processed"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "blocked", "skipped")],
        F.sum(F.when(src, F.coalesce("retry_count", F.lit(0))).otherwise(0)).alias("retry_events"),
        F.round(F.sum(F.when(src, F.coalesce("cost_usd", F.lit(0.0))).otherwise(0.0)), 6).alias("cost_usd_total"),
    )


def run_history(runs: DataFrame) -> DataFrame:
    """One row over all runs; zeros when there is none."""
    names = ("processed", "succeeded", "failed", "blocked", "blocked_domain_gates", "skipped")
    sums = runs.agg(
        F.count("*").alias("runs_analyzed"), F.max_by("run_id", F.struct("completed_at", "run_id")).alias("latest_run_id"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        F.round(F.coalesce(F.sum("cost_usd_total"), F.lit(0.0)), 6).alias("cost_usd_total"),
        F.round(F.coalesce(F.avg("failure_rate"), F.lit(0.0)), 10).alias("avg_failure_rate"),
        F.coalesce(F.max("failure_rate"), F.lit(0.0)).alias("max_failure_rate"),
    )
    parts = runs.where("top_error_codes <> ''").select(F.explode(F.split("top_error_codes", ",")).alias("part"))
    codes = parts.groupBy(F.split_part("part", F.lit(":"), F.lit(1)).alias("code")).agg(
        F.sum(F.split_part("part", F.lit(":"), F.lit(2)).cast("long")).alias("count")
    )
    best = top_errors(codes.withColumn("one", F.lit(1)), ["one"])
    return sums.withColumn("one", F.lit(1)).join(best, "one", "left").drop("one").withColumn(
        "top_error_codes", F.coalesce("top_error_codes", F.lit(""))
    )


def dashboard(c: Corpus) -> DataFrame:
    """One row of corpus counts; each table is aggregated once."""
    status = F.col("status")
    parts = [
        c.domains.agg(
            F.count("*").alias("domains_total"), F.count_if("allowlisted").alias("allowlisted_domains"),
            F.count_if("paused").alias("paused_domains"),
        ),
        c.sources.agg(
            F.count("*").alias("sources_total"), F.count_if(status == "pending").alias("sources_pending"),
            F.count_if(status == "succeeded").alias("sources_succeeded"), F.count_if(status == "failed").alias("sources_failed"),
        ),
        c.documents.agg(F.count("*").alias("documents_total")), c.programs.agg(F.count("*").alias("programs_total")),
        c.claim_refs.agg(F.count("*").alias("claims_total")),
        c.crawl_jobs.agg(F.max(F.when(status == "succeeded", F.col("started_at"))).alias("latest_successful_crawl_at")),
        c.crawl_jobs.orderBy(F.desc_nulls_first("started_at"), F.desc("id")).limit(20).agg(
            F.count("*").alias("recent_crawls_analyzed"), F.count_if(status == "failed").alias("recent_crawls_failed")
        ),
    ]
    out = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("one", F.lit(1)), "one")  # single rows
    return out.drop("one")
