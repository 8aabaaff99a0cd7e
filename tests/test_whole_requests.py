"""All requests are listed and split, also those that the service rejects."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from quarrylight.plans import catalog
from quarrylight.sources.corpus import TURN_IDS, TURNS


def test_long_requests_are_listed_and_split(spark, folder, tmp_path):
    for name in ("pages", "documents", "events", "labels", "benchmark"):
        shutil.copyfile(f"{folder}/{name}.parquet", tmp_path / f"{name}.parquet")
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    long = spark.createDataFrame([(900_001, 0, "user", "squat " * 200)], "conv_id long, turn long, role string, text string")
    long.select(*[F.col(c).cast(turns.schema[c].dataType) for c in turns.columns]).write.parquet(str(tmp_path / "conversations.parquet"))
    own = TURN_IDS + 900_001 * TURNS
    listed = {r["query_id"]: r["query"] for r in catalog.QUERIES["table_requests"](spark, str(tmp_path)).collect()}
    assert len(listed[own]) > 1000
    split = {r["query_id"] for r in catalog.QUERIES["query_splits"](spark, str(tmp_path)).collect()}
    assert split == set(listed)
