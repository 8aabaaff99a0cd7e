"""Continuous discovery over several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.streaming import feeds


def test_discovery_over_micro_batches(spark, tmp_path):
    """A row far behind the others, repeats over micro-batches, a known source, and an epoch that runs twice."""
    source, sink = str(tmp_path / "candidates"), str(tmp_path / "sources")
    batches = [
        [("a", "2024-01-10"), ("a", "2024-01-09"), ("known", "2024-01-10")],
        [("b", "2024-01-20"), ("a", "2024-01-20")],
        [("late", "2024-01-01"), ("b", "2024-01-21"), ("c", "2024-01-21")],
    ]
    url = F.concat(F.lit("https://example.org/training/"), F.col("name")).alias("raw_url")
    frames = [spark.createDataFrame(x, "name string, seen string").select(url, F.col("seen").cast("timestamp").alias("seen_at")) for x in batches]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
    known = spark.createDataFrame([("https://example.org/training/known",)], "canonical_url string")
    step = feeds.append_new(lambda: known, sink)
    epochs = []

    def counted(batch, epoch):
        epochs.append(epoch)
        step(batch, epoch)

    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    feeds.run_to_end(feeds.discovered(stream), str(tmp_path / "checkpoint"), step=counted)
    assert len(epochs) >= 3

    def stored():
        return sorted(r[0].rsplit("/", 1)[1] for r in spark.read.schema("canonical_url string").parquet(sink).select("canonical_url").collect())

    assert stored() == ["a", "b", "c", "late"]
    step(feeds.discovered(frames[2]), epochs[2])
    step(feeds.discovered(frames[0]), epochs[0])
    assert stored() == ["a", "b", "c", "late"]
    again = feeds.append_new(lambda: known, sink, feed="other")
    again(feeds.discovered(frames[0].unionByName(frames[0].limit(1).withColumn("raw_url", F.lit("https://example.org/training/d")))), 0)
    assert stored() == ["a", "b", "c", "d", "late"]
