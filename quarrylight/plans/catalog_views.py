"""The corpus tables themselves, as scans with fixed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.plans import sqltext as S
from quarrylight.plans.registry import query
from quarrylight.sources.corpus import Corpus


def iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


@query("table_documents", f"""
SELECT id, source_id, crawl_job_id, {S.iso('published_at')} AS published_at, raw_text, title, summary,
  parse_confidence, {S.iso('created_at')} AS created_at FROM v_documents""")
def table_documents(c: Corpus):
    return c.documents.join(c.document_texts, "id").select(
        "id", "source_id", "crawl_job_id", iso("published_at").alias("published_at"), "raw_text", "title",
        "summary", "parse_confidence", iso("created_at").alias("created_at"),
    )


@query("table_programs", f"SELECT * REPLACE ({S.iso('created_at')} AS created_at) FROM v_programs")
def table_programs(c: Corpus):
    return c.programs.withColumn("created_at", iso("created_at"))


@query("table_claims", "SELECT * FROM v_claim_refs")
def table_claims(c: Corpus):
    return c.claim_refs


@query("table_crawl_jobs", f"""
SELECT * REPLACE ({S.iso('started_at')} AS started_at, {S.iso('completed_at')} AS completed_at) FROM v_crawl_jobs""")
def table_crawl_jobs(c: Corpus):
    return c.crawl_jobs.withColumn("started_at", iso("started_at")).withColumn("completed_at", iso("completed_at"))


@query("table_domains", "SELECT * FROM v_domains")
def table_domains(c: Corpus):
    return c.domains


@query("table_requests", "SELECT * FROM v_asked")
def table_requests(c: Corpus):
    """Every request as it came, those that the service rejects included."""
    return c.asked


@query("scan_sources", f"""
SELECT id, canonical_url, status, title, domain_id, source_type, author, latest_document_id,
  {S.iso('last_crawled_at')} AS last_crawled_at FROM v_sources""")
def scan_sources(c: Corpus):
    return c.sources.select(
        "id", "canonical_url", "status", "title", "domain_id", "source_type", "author", "latest_document_id",
        iso("last_crawled_at").alias("last_crawled_at"),
    )
