"""Append-only logs: run ledger and retrieval traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import payload as P
from quarrylight.functions import text as T


def as_lines(records: DataFrame) -> DataFrame:
    """(value): one JSON object per record with its keys in order."""
    return records.select(F.to_json(F.struct(*sorted(records.columns))).alias("value"))


def append_lines(records: DataFrame, path: str) -> None:
    as_lines(records).write.mode("append").text(path)


def parse_lines(lines: DataFrame) -> DataFrame:
    """The objects among lines(value); blank, broken and other lines are skipped."""
    parsed = lines.select(F.try_parse_json(T.strip(F.col("value"))).alias("record"))
    return parsed.where(P.kind(F.col("record")) == "OBJECT")


def recent(records: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` records by completion time and run id; none for limit <= 0."""
    at = F.try_variant_get("record", "$.completed_at", "string")
    run = F.try_variant_get("record", "$.run_id", "string")
    rows = records.select("record", at.alias("completed_at"), run.alias("run_id"))
    return rows.orderBy(F.desc_nulls_last("completed_at"), F.desc_nulls_last("run_id")).limit(max(0, limit))


def read_recent(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    return recent(parse_lines(spark.read.text(path)), limit)


def write_traces(traces: DataFrame, path: str) -> None:
    """Append traces(recorded_at, ...) in folders by day."""
    dated = traces.withColumn("day", F.to_date("recorded_at"))
    dated.write.mode("append").partitionBy("day").json(path)
