"""Extraction batches that stop half-way, streams over several micro-batches and restarts, the exact reranker."""

from __future__ import annotations

import glob
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import learn as LR
from quarrylight.sources.batches import BatchLog, extraction_tables
from quarrylight.streaming import feeds, limits

PROGRAM = "name string, coach_name string, days_per_week long, specialization string, experience_level string, progression_type string, split_type string, summary string, confidence double"
CLAIM = "raw_ref string, claim_type string, raw_text string, normalized_value string, confidence double"
NORMALIZED = (
    f"document_id long, source_id long, title string, author string, source_type string, summary string, raw_text string, parse_confidence double, "
    f"programs array<struct<{PROGRAM.replace(' ', ':').replace(',:', ',')}>>, claims array<struct<{CLAIM.replace(' ', ':').replace(',:', ',')}>>, programs_inferred boolean, validation_errors array<string>"
)


def extracted(spark, ids, errors=()):
    def program(name):
        return (name, None, 3, None, None, None, None, None, 0.5)

    def claim(ref):
        return (ref, "volume", f"claims {ref}", None, None)

    rows = [
        (i, i % 2, f"title {i}", "who", "article", None, f"text {i}", 0.7, [program("Base"), program("Peak")], [claim("1"), claim(" peak "), claim("9"), claim(None)], False, ["bad"] if i in errors else [])
        for i in ids
    ]
    jobs = spark.createDataFrame([(i, 100 + i) for i in ids], "document_id long, new_id long").withColumn("at", F.timestamp_seconds(F.col("new_id")))
    return extraction_tables(spark.createDataFrame(rows, NORMALIZED), jobs)


def test_a_batch_is_seen_as_a_whole_or_not_at_all(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    documents = "id long, source_id long"
    assert log.read("documents", documents).collect() == []
    assert log.commit("a", extracted(spark, [1, 2, 3], errors=[3]))
    broken = extracted(spark, [4, 5])
    broken["claims"] = broken["claims"].withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        log.commit("b", broken)
    # Documents and programs of the broken batch were written, and nobody sees them.
    assert glob.glob(f"{tmp_path}/log/documents/b-*")
    assert sorted(r["id"] for r in log.read("documents", documents).collect()) == [101, 102]
    assert log.commit("b", extracted(spark, [4, 5])) and not log.commit("b", extracted(spark, [4, 5])) and not log.commit("a", extracted(spark, [1, 9]))
    assert sorted(r["id"] for r in log.read("documents", documents).collect()) == [101, 102, 104, 105]
    assert [m["batch"] for m in log.batches()] == ["a", "b"]
    programs = {r["id"]: r["name"] for r in log.read("programs", "id long, name string").collect()}
    claims = log.read("claims", "id long, document_id long, program_id long, raw_text string").collect()
    assert len(programs) == 8 and len(claims) == 16
    # By place from 0, by name, out of range, without reference.
    assert {r["raw_text"]: programs.get(r["program_id"]) for r in claims if r["document_id"] == 104} == {"claims 1": "Peak", "claims  peak ": "Peak", "claims 9": None, "claims None": None}
    assert {r["source_id"]: r["latest_document_id"] for r in log.read("states", "source_id long, latest_document_id long").groupBy("source_id").agg(F.max("latest_document_id").alias("latest_document_id")).collect()} == {0: 104, 1: 105}


def fed(spark, tmp_path, name, batches, schema, build, **end):
    """Each batch is a run of its own from the same checkpoint."""
    source, checkpoint = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-cp")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        feeds.run_to_end(build(spark.readStream.schema(schema).parquet(source)), checkpoint, **end)


REQUEST = "key string, at double, request_id long"


def test_rate_limit_over_micro_batches(spark, tmp_path):
    """Three micro-batches with restarts between them; a row that comes late is judged by the state of now."""
    sink = str(tmp_path / "out")
    batches = [[("a", 0.0, 1), ("a", 5.0, 2), ("b", 1.0, 3)], [("a", 6.0, 4), ("a", 20.0, 5), ("b", 2.0, 6), ("b", 3.0, 7)], [("a", 15.0, 8), ("a", 31.0, 9), (None, 1.0, 10)]]
    fed(spark, tmp_path, "limit", batches, REQUEST, lambda s: limits.rate_limit_stream(s, 10, 2), sink=sink)
    got = {r["request_id"]: (r["accepted"], r["late"]) for r in spark.read.schema(limits.DECISION).parquet(sink).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False), 6: (True, False), 7: (False, False), 8: (False, True), 9: (True, False), 10: (True, False)}


def state_rows(spark, checkpoint):
    return spark.read.format("statestore").option("stateVarName", "window").load(checkpoint).count()


def test_idle_keys_are_forgotten(spark, tmp_path):
    """State of keys that nothing comes from any more is dropped by the clock."""
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "limit-cp")
    first = [(f"k{i}", float(i), i) for i in range(30)]
    fed(spark, tmp_path, "limit", [first], REQUEST, lambda s: limits.rate_limit_stream(s, 1, 2, keep=1.0), sink=sink)
    assert state_rows(spark, checkpoint) == 30
    time.sleep(2)
    fed(spark, tmp_path, "limit", [[("new", 100.0, 100)]], REQUEST, lambda s: limits.rate_limit_stream(s, 1, 2, keep=1.0), sink=sink)
    assert state_rows(spark, checkpoint) < 30


def test_quota_over_micro_batches(spark, tmp_path):
    sink = str(tmp_path / "out")
    batches = [[("a", 2.0, 2), ("a", 1.0, 1)], [("a", 3.0, 3), ("b", 1.0, 4)], [("a", 0.5, 5), ("b", 2.0, 6)]]
    fed(spark, tmp_path, "quota", batches, REQUEST, lambda s: limits.quota_stream(s, 3), sink=sink)
    got = {r["request_id"]: (r["accepted"], r["used"], r["remaining"]) for r in spark.read.parquet(sink).collect()}
    assert got == {1: (True, 1, 2), 2: (True, 2, 1), 3: (True, 3, 0), 4: (True, 1, 2), 5: (False, 3, 0), 6: (True, 2, 1)}


def test_rate_limit_over_arrow_batches(spark):
    """Sessions that go on in the next batch, short ones and a busy one."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [("a", float(i), i) for i in range(40)] + [(f"k{i % 9}", i * 50.0, 100 + i) for i in range(60)] + [(None, 1.0, 1000), (None, 2.0, 1001), (None, 3.0, 1002)]
    got = {r["request_id"]: r["accepted"] for r in limits.rate_limit(spark.createDataFrame(rows, REQUEST), 10, 2).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, recent = {}, {}
    for key, at, number in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        kept = [t for t in recent.get(key, []) if t >= at - 10]
        want[number] = len(kept) < 2
        recent[key] = [*recent.get(key, []), at] if want[number] else recent.get(key, [])
    assert got == want


def test_health_forgets_closed_windows(spark, tmp_path):
    """Three epochs: a window closes, a late row stays out of it, and an epoch that runs again changes nothing."""
    sink = feeds.HealthSink(str(tmp_path / "health"), delay=86_400)
    schema = "id long, started_at timestamp, status string"

    def batch(*rows):
        return spark.createDataFrame([(i, d, s) for i, d, s in rows], "id long, day string, status string").select("id", F.col("day").cast("timestamp").alias("started_at"), "status")

    epochs = [
        batch((1, "2024-01-01 10:00", "failed"), (2, "2024-01-02 10:00", "succeeded"), (3, None, "failed")),
        batch((4, "2024-01-01 11:00", "succeeded"), (5, "2024-01-03 12:00", "running")),
        batch((6, "2024-01-01 12:00", "failed"), (7, "2024-01-02 12:00", "failed"), (8, "2024-01-09 12:00", "failed")),
    ]

    def shown():
        return sorted((str(r["window_start"])[:10], r["jobs"], r["attempted"], r["failed"]) for r in sink.windows(spark).collect())

    for number, rows in enumerate(epochs):
        sink.step(rows, number)
    want = [("2024-01-01", 2, 2, 1), ("2024-01-02", 2, 2, 1), ("2024-01-03", 1, 0, 0), ("2024-01-09", 1, 1, 1)]
    assert shown() == want and [r["id"] for r in sink.late(spark, schema).collect()] == [6]
    sink.step(epochs[2], 2)
    assert shown() == want and [r["id"] for r in sink.late(spark, schema).collect()] == [6]
    # Only the last window is still open, and carried state of old epochs is gone.
    assert spark.read.schema(sink.COUNTS).parquet(f"{sink.folder}/open/epoch=2").count() == 1
    assert not glob.glob(f"{sink.folder}/open/epoch=0")


def test_ridge_weights(spark):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((200, len(LR.FEATURES)))
    weight, target = draw.choice([1.0, 5.0], 200), draw.random(200)
    rows = spark.createDataFrame([(*map(float, r), float(w), float(t)) for r, w, t in zip(x, weight, target, strict=True)], ", ".join(f"{f} double" for f in LR.FEATURES) + ", weight double, target double")
    found = LR.solve(LR.normal_equations(rows.repartition(5)))
    full = np.column_stack((np.ones(200), x))
    ridge = LR.RIDGE * weight.sum() * np.diag([0.0] + [1.0] * len(LR.FEATURES))
    assert found == pytest.approx(np.linalg.solve(full.T @ (weight[:, None] * full) + ridge, full.T @ (weight * target)).tolist(), abs=1e-9)
    assert LR.solve(LR.normal_equations(rows.where("false"))) == [0.0] * (len(LR.FEATURES) + 1)
