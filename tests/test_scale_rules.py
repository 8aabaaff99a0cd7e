"""Results do not depend on partitioning, and hot groups give whole results."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quarrylight.operators import evidence as EV
from quarrylight.operators import labels as L
from quarrylight.operators import retrieve as R
from quarrylight.operators.groups import hashed_position, top_n_by
from quarrylight.streaming import limits as LI


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_search_is_partition_independent(spark, corpus):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows_of(R.search_programs(corpus.requests, corpus, 25)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    assert results[0]


def test_search_invariants(corpus):
    found = R.search_programs(corpus.requests, corpus, 25)
    assert found.groupBy("query_id", "program_id").count().where("count > 1").count() == 0
    late_exact = found.alias("a").join(found.alias("b"), "query_id").where(
        "a.leg = 'exact' AND b.leg = 'expanded' AND a.rank > b.rank"
    )
    assert late_exact.count() == 0


def test_evidence_within_limit(corpus):
    cards = EV.evidence_cards(corpus.requests, corpus)
    over = cards.groupBy("query_id").count().join(corpus.requests, "query_id").where("count > max_sources")
    assert over.count() == 0


def test_top_n_by_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 7).alias("k"), "id", (F.col("id") * 7919 % 5003).alias("v"))
    got = top_n_by(rows, ["k"], [F.desc("v"), F.asc("id")], F.col("k") + 3, ["id"], salts=8)
    want = defaultdict(list)
    for r in rows.collect():
        want[r.k].append((-r.v, r.id))
    expected = {(k, i): n + 1 for k, vs in want.items() for n, (_, i) in enumerate(sorted(vs)[: k + 3])}
    assert {(r.k, r.id): r["rank"] for r in got.collect()} == expected


def test_hashed_position(spark):
    got = {r.id: r.position for r in hashed_position(spark.range(3000), F.col("id")).collect()}
    order = sorted(range(3000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert got == {i: n for n, i in enumerate(order)}


def test_random_negatives(spark):
    items = spark.range(30).withColumnRenamed("id", "item")
    queries = spark.range(6).withColumnRenamed("id", "query_id")
    known = spark.createDataFrame([(q, i) for q in range(6) for i in range(q * 5)], "query_id long, item long")
    got = defaultdict(list)
    for r in L.random_negatives(queries, known, items, "item", 10).collect():
        got[r.query_id].append(r.item)
    for q in range(6):
        free = set(range(30)) - set(range(q * 5))
        assert len(got[q]) == len(set(got[q])) == min(10, len(free))
        assert set(got[q]) <= free


def brute_force(requests, window, most):
    """Every request against all accepted ones of its key."""
    out, accepted = {}, defaultdict(list)
    for key, at, rid in sorted(requests, key=lambda r: (r[0], r[1], r[2])):
        inside = [t for t in accepted[key] if at - t <= window]
        full = len(inside) >= most
        out[rid] = (not full, int(max(1.0, window - (at - min(inside)))) if full else None)
        if not full:
            accepted[key].append(at)
    return out


def test_rate_limit_hot_key(spark):
    requests = [("hot" if i % 3 else f"k{i % 11}", float((i * 37) % 1000) / 2 + (500 if i % 5 else 0), i) for i in range(2000)]
    df = spark.createDataFrame(requests, "key string, at double, request_id long").repartition(7)
    got = {r.request_id: (r.accepted, r.retry_after) for r in LI.rate_limit(df, 10, 3, slice_seconds=25).collect()}
    assert got == brute_force(requests, 10, 3)


def test_quota(spark):
    df = spark.createDataFrame([("a", float(i), i) for i in range(7)] + [("b", 1.0, 99)], "key string, at double, request_id long")
    got = {r.key: (r.used, r.remaining, r.can_ask, r.rejected) for r in LI.quota_usage(df, 5).collect()}
    assert got == {"a": (5, 0, False, 2), "b": (1, 4, True, 0)}
    assert sorted(r.request_id for r in LI.quota_accepted(df, 5).collect()) == [0, 1, 2, 3, 4, 99]
