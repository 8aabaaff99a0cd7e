"""Continuous discovery, crawl health and log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import urls as U


def discovered(candidates: DataFrame) -> DataFrame:
    """Allowed URLs of a stream candidates(raw_url, seen_at), however late they come.

    Repeats and URLs already stored are left out by :func:`append_new` per micro-batch.
    """
    urls = candidates.withColumn("canonical_url", U.safe_canonicalize_url(F.col("raw_url")))
    good = urls.where(F.col("canonical_url").isNotNull() & U.is_allowed_candidate(F.col("canonical_url")))
    return good.select("canonical_url", "seen_at")


def append_new(known_path_reader, sink: str, feed: str = "discovery"):
    """A foreachBatch step: anti join against the known sources and the sink, then write the epoch's own folder.

    A replayed epoch overwrites what it wrote before. Epochs are those of one
    checkpoint, so feeds that share a sink, or start again with a new
    checkpoint, each need a ``feed`` name of their own.
    """
    stored = "canonical_url string, seen_at timestamp, feed string, epoch long"

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("canonical_url").agg(F.min("seen_at").alias("seen_at")).join(known_path_reader(), "canonical_url", "left_anti")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            # Of its own feed only earlier epochs count: a replay must find again what it found first.
            seen = spark.read.schema(stored).parquet(sink).where((F.col("feed") != feed) | (F.col("epoch") < epoch))
            fresh = fresh.join(seen.select("canonical_url"), "canonical_url", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{sink}/feed={feed}/epoch={epoch}")

    return step


def _status_counts(rows: DataFrame, width: str) -> DataFrame:
    status = F.col("status")
    done, failed = F.count_if(status.isin("succeeded", "failed")), F.count_if(status == "failed")
    per = rows.groupBy(F.window("started_at", width).alias("w")).agg(F.count("*").alias("jobs"), done.alias("attempted"), failed.alias("failed"))
    return per.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "jobs", "attempted", "failed")


def _with_rate(counts: DataFrame) -> DataFrame:
    return counts.select("window_start", "jobs", "attempted", "failed", F.round(F.try_divide("failed", "attempted"), 6).alias("failure_rate"))


def crawl_health(jobs: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts and failure rate of crawl jobs per tumbling window of start time."""
    return _with_rate(_status_counts(jobs.where("started_at IS NOT NULL"), width))


class HealthSink:
    """Crawl health of a stream in tables that forget closed windows.

    Each epoch writes folders of its own: ``closed`` windows, which are final,
    ``late`` rows, whose window had closed before, and what carries on to the
    next epoch: the ``open`` windows and the newest start time seen. A window
    closes when that time is ``delay`` seconds past its end. An epoch reads only
    what the one before carried on, so the open part stays as small as the delay,
    and an epoch that runs again writes the same rows over its own.
    """

    COUNTS = "window_start timestamp, window_end timestamp, jobs long, attempted long, failed long"

    def __init__(self, folder: str, width: str = "1 day", delay: int = 86_400):
        self.folder, self.width, self.delay = folder.rstrip("/"), width, delay

    def _at(self, name: str, epoch: int) -> str:
        return f"{self.folder}/{name}/epoch={epoch}"

    def step(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        store = path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before, carried = None, None
        if epoch > 0 and store.exists(path(self._at("newest", epoch - 1))):
            before = spark.read.schema("newest timestamp").parquet(self._at("newest", epoch - 1)).first()["newest"]
            carried = spark.read.schema(self.COUNTS).parquet(self._at("open", epoch - 1))
        rows = batch.where("started_at IS NOT NULL")
        end = F.window("started_at", self.width)["end"]
        shut = F.lit(before).cast("timestamp") - F.make_dt_interval(secs=F.lit(self.delay))
        late = F.coalesce(end <= shut, F.lit(False))
        rows.where(late).write.mode("overwrite").parquet(self._at("late", epoch))
        counts = _status_counts(rows.where(~late), self.width)
        if carried is not None:
            counts = counts.unionByName(carried).groupBy("window_start", "window_end").agg(*[F.sum(n).alias(n) for n in ("jobs", "attempted", "failed")])
        newest = rows.agg(F.greatest(F.max("started_at"), F.lit(before).cast("timestamp")).alias("newest")).first()["newest"]  # one time
        over = F.coalesce(F.col("window_end") <= F.lit(newest).cast("timestamp") - F.make_dt_interval(secs=F.lit(self.delay)), F.lit(False))
        counts.where(over).write.mode("overwrite").parquet(self._at("closed", epoch))
        counts.where(~over).write.mode("overwrite").parquet(self._at("open", epoch))
        # Last: an epoch without it has not run, for the next one.
        spark.createDataFrame([(newest,)], "newest timestamp").coalesce(1).write.mode("overwrite").parquet(self._at("newest", epoch))
        for name in ("open", "newest"):
            store.delete(path(self._at(name, epoch - 2)), True)

    def windows(self, spark: SparkSession) -> DataFrame:
        """Closed windows and those still open."""
        read = spark.read.schema(self.COUNTS + ", epoch int")
        carried = read.parquet(f"{self.folder}/open")
        last = carried.agg(F.max("epoch")).first()[0]
        newest = spark.read.schema("epoch int").parquet(f"{self.folder}/newest").agg(F.max("epoch")).first()[0]
        return _with_rate(read.parquet(f"{self.folder}/closed").unionByName(carried.where(F.col("epoch") == max(last or 0, newest or 0))))

    def late(self, spark: SparkSession, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.folder}/late")


def run_to_end(stream: DataFrame, checkpoint: str, mode: str = "append", sink: str | None = None, fmt: str = "parquet", step=None) -> None:
    """Process everything available and stop.

    Batches without data are left out meanwhile: state that times out by the
    clock would ask for one after the other, and the run would never end.
    """
    spark, key = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if step is not None:
            query = writer.foreachBatch(step).start()
        else:
            query = writer.format(fmt).option("path", sink).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
