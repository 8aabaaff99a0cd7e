"""Extraction batches: several tables changed as one.

A batch writes its rows of every table under folders of its own and names them
in a manifest, which appears by one rename at the very end. Readers see just
the folders that manifests name, so documents, programs, claims and the sources'
new pointers become visible together or not at all, and a batch that stopped
half-way leaves nothing behind that anyone reads. A batch that is already in
the log is not written again, so a replay does no harm.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import normalize as N

#: Room for so many programs, or claims, of one document in their numbers.
PER_DOCUMENT = 1 << 20


class BatchLog:
    """Tables in ``folder`` that are changed in batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _manifest(self, batch: str) -> str:
        return f"{self.folder}/_manifests/{batch}.json"

    def has(self, batch: str) -> bool:
        return self._fs.exists(self._path(self._manifest(batch)))

    def commit(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Write ``tables`` as one change; False if the batch is there already, be it from another session just now."""
        if self.has(batch):
            return False
        attempt = uuid.uuid4().hex[:12]
        paths = {}
        for name, rows in tables.items():
            paths[name] = f"{name}/{batch}-{attempt}"
            rows.write.parquet(f"{self.folder}/{paths[name]}")
        aside = self._path(f"{self.folder}/_manifests/.{batch}-{attempt}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps({"batch": batch, "tables": paths}).encode()))
        out.close()
        # A rename onto a file that is there fails: the first attempt counts.
        if not self.has(batch) and self._fs.rename(aside, self._path(self._manifest(batch))):
            return True
        self._fs.delete(aside, True)
        return False

    def batches(self) -> list[dict]:
        """The manifests, one small file a batch."""
        home = self._path(f"{self.folder}/_manifests")
        if not self._fs.exists(home):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(home)]
        paths = [f"{self.folder}/_manifests/{n}" for n in sorted(names) if n.endswith(".json") and not n.startswith(".")]
        texts = self.spark.read.option("wholetext", True).text(paths).collect() if paths else []
        return sorted((json.loads(t[0]) for t in texts), key=lambda m: m["batch"])

    def read(self, table: str, schema) -> DataFrame:
        """All committed rows of a table."""
        paths = [f"{self.folder}/{m['tables'][table]}" for m in self.batches() if table in m["tables"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def extraction_tables(normalized: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """What a batch of valid extractions adds: documents, programs, claims that are linked to them, and each source's newest state.

    ``jobs`` has (document_id, new_id, at): the number and time of the new
    document of each extraction. Programs and claims are numbered by document
    and place, so a batch that is made again gets the same numbers. The newest
    document of a source, by time and number, sets its state.
    """
    good = normalized.where(F.size("validation_errors") == 0).join(jobs, "document_id")
    documents = good.select(
        F.col("new_id").alias("id"), "source_id", F.col("document_id").alias("crawl_job_id"), "title", "summary", "raw_text", "parse_confidence",
        F.concat(F.lit("sources/"), "source_id", F.lit("/crawls/"), "document_id", F.lit("/extracted.json")).alias("json_path"), F.col("at").alias("created_at"),
    )
    rows = good.select(F.col("new_id").alias("document_id"), "source_id", "programs", "claims", "programs_inferred", "at")
    number = (F.col("document_id") * PER_DOCUMENT + F.col("pos")).alias("id")
    programs = rows.select("document_id", F.posexplode("programs").alias("pos", "p"), "at").select(number, "document_id", "p.*", F.col("at").alias("created_at"))
    claims = rows.select("document_id", F.posexplode("claims").alias("pos", "p"), "at").select(number, "document_id", "p.*", F.col("at").alias("created_at"))
    linked = N.link_claims(claims, programs.select("id", "document_id", "name"))
    newest = good.groupBy("source_id").agg(F.max(F.struct("at", "new_id", "title", "author", "source_type")).alias("n"))
    states = newest.select(
        "source_id", F.col("n.at").alias("last_crawled_at"), F.col("n.new_id").alias("latest_document_id"), "n.title", "n.author", "n.source_type", F.lit("succeeded").alias("status"),
    )
    return {
        "documents": documents, "programs": programs,
        "claims": linked.select("id", "document_id", "program_id", "claim_type", "raw_text", "normalized_value", "confidence", "created_at"), "states": states,
    }


def current_sources(sources: DataFrame, states: DataFrame) -> DataFrame:
    """Sources after all batches: the newest state of each, by time and document, else as they were."""
    fields = ("title", "author", "source_type", "status", "last_crawled_at", "latest_document_id")
    last = states.groupBy("source_id").agg(F.max(F.struct("last_crawled_at", "latest_document_id", "title", "author", "source_type", "status")).alias("n"))
    rows = sources.join(last, sources.id == last.source_id, "left")
    hit = F.col("n").isNotNull()
    return rows.select("id", "canonical_url", *[F.when(hit, F.col(f"n.{f}")).otherwise(F.col(f)).alias(f) for f in fields])
