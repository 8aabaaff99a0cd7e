"""Entries are dealt once to where their lists are stored, and shuffled files go with the step that made them."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import index as IX
from quarrylight.sources import corpus as C

ENTRIES = [(s, d, f"w{(d * k) % 9}", [k, k + 20][: 1 + k % 2]) for s in range(3) for d in range(s, 60, 3) for k in range(1, 7) if (d * k) % 9 not in [(d * j) % 9 for j in range(1, k)]]


@pytest.mark.parametrize("rows", [1, 4, 10_000])
def test_lists_over_batches(rows):
    """A list may go on over any number of batches."""
    table = sorted((s % 2, 0, s, w, d, p) for s, d, w, p in ENTRIES)
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("shard", pa.int32()), ("lexeme", pa.string()), ("doc_id", pa.int64()), ("positions", pa.list_(pa.int32()))])
    batches = pa.table([list(x) for x in zip(*table, strict=True)], schema=schema).to_batches(max_chunksize=rows)
    found = [tuple(r.values()) for b in IX._listed(iter([*batches, batches[0].slice(0, 0)])) for r in b.to_pylist()]
    want: dict = {}
    for b, part, s, w, d, p in table:
        want.setdefault((b, part, s, w), []).append((d, len(p), p))
    assert found == [(*k, *[list(x) for x in zip(*v, strict=True)]) for k, v in want.items()]


def test_dealt_once(spark):
    entries = spark.createDataFrame(ENTRIES, "shard int, doc_id long, lexeme string, positions array<int>").repartition(4)
    found = IX.dealt_postings(entries, 5, 2)
    plain = IX.with_bucket(IX.sharded_postings(entries), 5)
    assert sorted(map(tuple, found.drop("part").select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert len(re.findall(r"Exchange hashpartitioning", found._jdf.queryExecution().executedPlan().toString())) == 1
    assert found.where(F.col("part") != F.pmod("shard", F.lit(2))).count() == 0


def test_nothing_shuffled_is_left(spark, monkeypatch, tmp_path):
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key)
    with C.tidy(spark):
        seen.append(spark.conf.get(key))
        spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count().write.parquet(str(tmp_path / "t"))
    assert seen == ["true"] and spark.conf.get(key) == before
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10
