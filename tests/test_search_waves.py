"""Shards are searched in waves; rows that earlier waves surpass are not looked for, and the lists stay the same."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_search import WORDS, ask, corpus_of, plain_search

from quarrylight.operators import index as IX
from quarrylight.operators import retrieve as R
from quarrylight.operators import shards as SH


def test_every_shard_is_in_one_wave():
    for n in range(1, 200):
        found = R.waves(n)
        assert [i for low, high in found for i in range(low, high)] == list(range(n)) and len(found) <= 5
    assert R.waves(3) == [(0, 3)] and R.waves(47) == [(0, 6), (6, 12), (12, 24), (24, 47)]


@pytest.mark.parametrize("rows", [0, 512])
def test_rows_at_the_floor_stay(monkeypatch, rows):
    """With a floor from any of the wanted rows, what lies at it or above is found, whole and in order; nothing below is."""
    monkeypatch.setattr(SH, "ROWS", rows)
    docs, postings, texts = corpus_of(41, 3000)
    shard, draw = SH.Shard(docs, postings, 512), random.Random(5)
    for _ in range(60):
        a = ask(draw)
        want = plain_search(docs, texts, a, SH.EXPANDED)
        if not want:
            continue
        leads = [i * SH.LEAD + rank for _, rank, i in want]
        for floor in (leads[0], leads[0] + 1, leads[min(7, len(leads) - 1)], leads[len(leads) // 2], leads[-1], 1):
            for limit in (1, 20, 400):
                programs, ranks, intents = shard.search({**a, "floor": floor}, SH.EXPANDED, limit)
                found = list(zip(shard.program_ids[programs].tolist(), ranks.tolist(), intents.tolist(), strict=True))
                assert found == [w for w, lead in zip(want, leads, strict=True) if lead >= floor][:limit]
    assert WORDS


def test_same_lists_from_fewer_rows(spark, corpus):
    before = spark.conf.get("quarrylight.index.shard_docs")
    spark.conf.set("quarrylight.index.shard_docs", "16")
    try:
        assert len(R.waves(IX.shard_count(corpus))) > 2
        every = R.search_shards(corpus.requests, corpus, exact=5, expanded=10, sources=4).localCheckpoint()
        fewer = R.found_in_waves(corpus.requests, corpus, exact=5, expanded=10, sources=4)
        lists = [sorted(map(str, R.expanded_programs(f, 10).collect())) for f in (every, fewer)]
        assert lists[0] == lists[1] and lists[0]
        for leg in (SH.EXACT, SH.SOURCE):
            assert sorted(map(str, every.where(F.col("leg") == leg).collect())) == sorted(map(str, fewer.where(F.col("leg") == leg).collect()))
        n = [f.where(F.col("leg") == SH.EXPANDED).count() for f in (every, fewer)]
        assert n[1] < 0.7 * n[0]
    finally:
        spark.conf.set("quarrylight.index.shard_docs", before)
