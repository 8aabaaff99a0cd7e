"""Raw artifacts of extractions: page text and extracted JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File names of the two artifact kinds.
FILE_NAMES = {"html": "raw.html", "json": "extracted.json"}


def artifact_path(source_id: Column, crawl_id: Column, kind: Column) -> Column:
    name = F.when(kind == "html", FILE_NAMES["html"]).otherwise(FILE_NAMES["json"])
    return F.concat(F.lit("sources/"), source_id, F.lit("/crawls/"), crawl_id, F.lit("/"), name)


def write_artifacts(artifacts: DataFrame, folder: str) -> None:
    """Store artifacts(source_id, crawl_id, kind, body) as a table, by kind.

    Millions of small objects become few large files; the path of the object
    layout stays a computed column.
    """
    artifacts.write.mode("overwrite").partitionBy("kind").parquet(folder)


def index_artifacts(artifacts: DataFrame) -> DataFrame:
    path = artifact_path(F.col("source_id"), F.col("crawl_id"), F.col("kind"))
    return artifacts.select(
        "source_id", "crawl_id", "kind", path.alias("path"), F.length("body").cast("long").alias("size"),
        F.md5(F.col("body").cast("binary")).alias("digest"),
    )


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Read an existing object tree: whole files, keys taken from their paths."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    pattern = r"sources/(\d+)/crawls/(\d+)/(raw\.html|extracted\.json)$"
    part = [F.regexp_extract("file", pattern, i) for i in (1, 2, 3)]
    kind = F.when(part[2] == FILE_NAMES["html"], "html").otherwise("json")
    return rows.where(part[2] != "").select(
        part[0].cast("long").alias("source_id"), part[1].cast("long").alias("crawl_id"), kind.alias("kind"), "body"
    )
