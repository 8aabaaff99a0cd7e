"""Corpus maintenance: domain changes, applied extractions, stopped crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allowed_domains(domains: DataFrame) -> DataFrame:
    return domains.where("allowlisted AND NOT paused")


def domain_snapshot(base: DataFrame, log: DataFrame) -> DataFrame:
    """Domains after the changes of log(seq, domain, action, allowlisted).

    ``add`` creates a domain or sets its flag; ``pause`` and ``resume`` count
    only once the domain exists. The latest change wins; both steps are hash
    aggregates, however many changes one domain has.
    """
    have = base.select("domain", F.col("allowlisted").alias("old_allowed"), F.col("paused").alias("old_paused"), F.lit(-1).alias("since"))
    adds = log.where("action = 'add'").groupBy("domain").agg(
        F.min("seq").alias("first_add"), F.max_by("allowlisted", "seq").alias("new_allowed")
    )
    state = have.join(adds, "domain", "full").withColumn("since", F.coalesce("since", "first_add"))
    moves = log.where("action IN ('pause', 'resume')").join(state.select("domain", "since"), "domain")
    last = moves.where("seq > since").groupBy("domain").agg(
        (F.max_by("action", "seq") == "pause").alias("new_paused")
    )
    return state.join(last, "domain", "left").select(
        "domain", F.coalesce("new_allowed", "old_allowed").alias("allowlisted"),
        F.coalesce("new_paused", "old_paused", F.lit(False)).alias("paused"),
        F.col("old_allowed").isNull().alias("is_new"),
    )


def apply_extractions(sources: DataFrame, batch: DataFrame) -> DataFrame:
    """Sources after batch(document_id, source_id, title, author, source_type, at).

    The newest document of the batch sets the source's fields; earlier ones
    stay in the document history only.
    """
    newest = batch.groupBy("source_id").agg(
        F.max(F.struct("at", "document_id", "title", "author", "source_type")).alias("n")
    )
    rows = sources.join(newest, sources.id == newest.source_id, "left")
    hit = F.col("n").isNotNull()

    def moved(new: str, old: str):
        return F.when(hit, F.col(f"n.{new}")).otherwise(F.col(old)).alias(old)

    return rows.select(
        "id", "canonical_url", moved("title", "title"), moved("author", "author"), moved("source_type", "source_type"),
        F.when(hit, "succeeded").otherwise(F.col("status")).alias("status"),
        moved("at", "last_crawled_at"), moved("document_id", "latest_document_id"),
    )


def stop_crawls(jobs: DataFrame, requests: DataFrame, now) -> DataFrame:
    """Jobs after the stop requests(crawl_id): open ones fail, others stay."""
    wanted = requests.select(F.col("crawl_id").alias("id"), F.lit(True).alias("asked")).distinct()
    rows = jobs.join(wanted, "id", "left")
    open_ = F.col("status").isin("pending", "running")
    stop = F.coalesce("asked", F.lit(False)) & open_
    suffix = " (operator-stopped)"
    message = (
        F.when(F.coalesce("error_message", F.lit("")) == "", "Stopped by operator")
        .when(F.contains("error_message", F.lit(suffix)), F.col("error_message"))
        .otherwise(F.concat("error_message", F.lit(suffix)))
    )
    return rows.select(
        "id", F.when(stop, "failed").otherwise(F.col("status")).alias("status"),
        F.when(stop, now).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(stop, message).otherwise(F.col("error_message")).alias("error_message"),
        F.when(F.col("asked").isNull(), F.lit(None).cast("string")).when(open_, "stopped").otherwise("no-op").alias("result"),
    )
