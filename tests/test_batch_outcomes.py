"""Discovery and re-extract batches, the merged output object, and pools of queries that know very many items."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from quarrylight.operators import discovery as D
from quarrylight.operators import labels as L
from quarrylight.operators import normalize as N
from quarrylight.operators import planning as PL
from quarrylight.operators.groups import numbered

ATTEMPT = "job_id long, attempt int, job_type string, message string, error_type string, invalid boolean"


def test_a_discovery_batch_creates_each_url_once(spark):
    listed = ["https://a.example/x", "https://other.example/y", "https://www.a.example/x/", "https://a.example/pic.png", "https://a.example/known", "https://a.example/z"]
    jobs = spark.createDataFrame(
        [(1, "a.example", json.dumps(listed)), (2, "A.example", "see https://a.example/x and https://a.example/new"), (3, "gone.example", "https://gone.example/1"),
         (4, "a.example", "https://a.example/only-here"), (5, "a.example", None), (6, None, "https://a.example/none")],
        "job_id long, domain string, output string",
    )
    states = spark.createDataFrame([(i, "failed" if i == 4 else "succeeded") for i in range(1, 7)], "job_id long, status string")
    domains = spark.createDataFrame([("a.example",), ("A.example",)], "domain string")
    sources = spark.createDataFrame([("https://a.example/known",)], "canonical_url string")
    for parts in (1, 3, 7):
        rows = D.discover_batch(jobs.repartition(parts), states, domains, sources, cap=3).collect()
        got = {(r["job_id"], r["canonical_url"]): r["outcome"] for r in rows}
        assert got[1, "https://a.example/x"] == "created" and got[2, "https://a.example/x"] == "duplicate"
        assert got[1, "https://other.example/y"] == "off_domain" and got[1, "https://a.example/pic.png"] == "rejected"
        assert got[1, "https://a.example/known"] == "duplicate" and got[2, "https://a.example/new"] == "created"
        assert got[3, "https://gone.example/1"] == "domain_not_found" and got[6, "https://a.example/none"] == "off_domain"
        assert not [k for k in got if k[0] in (4, 5)]
        made = [r["canonical_url"] for r in rows if r["outcome"] == "created"]
        assert len(made) == len(set(made))
        accepted = [r for r in rows if r["job_id"] == 1 and r["outcome"] not in ("off_domain", "rejected")]
        assert len(accepted) == 3
    assert D.discover_batch(jobs.limit(0), states, domains, sources).count() == 0


def test_discovery_attempts_have_no_model_and_no_invalid_results(spark):
    rows = [
        (1, 0, "discover", "slow", "TimeoutError", False), (1, 1, "discover", None, None, False),
        (2, 0, "discover", "schema_invalid", "ValueError", True), (2, 1, "discover", None, None, False),
        (3, 0, "extract", "schema_invalid", "ValueError", True),
    ]
    got = {r["job_id"]: r for r in N.resolve_attempts(spark.createDataFrame(rows, ATTEMPT)).collect()}
    assert (got[1]["status"], got[1]["retry_count"], got[1]["model"], got[1]["error_message"]) == ("succeeded", 1, None, None)
    assert (got[2]["status"], got[2]["error_message"]) == ("failed", "discover failed after 1/3 attempts: schema_invalid")
    assert (got[3]["status"], got[3]["error_message"]) == ("running", "extract attempt 1/3 failed (model=primary): schema_invalid; retrying")


def test_the_merged_object_keeps_nested_values_and_overrides_names(spark):
    payload = {"title": 7, "note": "kept", "deep": {"b": [1, {"c": None}], "a": 2.5}, "programs": [{"name": "Base", "confidence": 0.5, "own": 1}], "claims": "none", "main_text": "old", "text": "t" * 30}
    rows = spark.createDataFrame(
        [(1, 1, "https://a.example", json.dumps(payload)), (2, 1, "https://a.example", "plain words"), (3, 1, "https://a.example", None), (4, 1, "https://a.example", "{}")],
        "document_id long, source_id long, url string, output string",
    )
    got = {r["document_id"]: json.loads(r["structured"]) for r in N.structured_output(N.normalize(rows)).collect()}
    one = got[1]
    assert one["deep"] == payload["deep"] and one["note"] == "kept" and one["text"] == "t" * 30
    assert one["title"] is None and one["claims"] == [] and one["main_text"] == "t" * 30
    assert [p["name"] for p in one["programs"]] == ["Base"] and "own" not in one["programs"][0]
    canonical = {"title", "author", "source_type", "summary", "main_text", "programs", "claims"}
    assert set(got[2]) == set(got[3]) == set(got[4]) == canonical and got[2]["main_text"] == "plain words"


def test_reextract_outcome_counts_what_was_processed(spark):
    queue = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "domain string, source_id long")
    jobs = spark.createDataFrame(
        [(10, 1, None, None, False), (11, 1, "late", "TimeoutError", False), (12, 2, "slow", "TimeoutError", False), (13, 2, "slow", "TimeoutError", False),
         (14, 2, "gone", "ValueError", False), (15, 3, "slow", "TimeoutError", False), (16, 9, None, None, False)],
        "id long, source_id long, message string, error_type string, invalid boolean",
    )
    made = spark.createDataFrame([(1, 100), (2, 200)], "source_id long, document_id long")
    results = PL.reextract_results(queue, jobs, made)
    got = {r["source_id"]: (r["status"], r["document_id"], r["error"]) for r in results.collect()}
    assert got == {1: ("succeeded", 100, None), 2: ("failed", None, "extract failed after 3/3 attempts: gone"), 3: ("queued", None, None), 4: ("queued", None, None)}
    domains = spark.createDataFrame([("a",), ("b",), ("c",)], "domain string")
    active = spark.createDataFrame([("c", 5)], "domain string, crawl_id long")
    totals = {r["domain"]: tuple(r)[1:] for r in PL.reextract_outcome(domains, active, results).collect()}
    assert totals == {"a": (None, 3, 2, 1, 1), "b": (None, 1, 0, 0, 0), "c": (5, 0, 0, 0, 0)}


def walked(queries, known, items, n, seed=42):
    """The ring once more, step by step."""
    digest = lambda key: hashlib.md5(f"{seed}-{key}".encode()).hexdigest()
    ring = sorted(items, key=digest)
    out = set()
    for q in queries:
        place, taken = int(digest(q)[:8], 16), 0
        for step in range(len(ring)):
            item = ring[(place + step) % len(ring)]
            if taken < n and item not in known.get(q, ()):
                taken += 1
                out.add((q, item, taken))
    return out


def test_negatives_of_a_query_that_knows_nearly_everything(spark):
    items = list(range(0, 200_000, 2))
    known = {1: set(items[:-5]), 2: set(items), 3: {0, 2, 7}, 5: set(items[::2])}
    pairs = spark.createDataFrame([(q, i) for q, s in known.items() for i in s], "query_id long, item long")
    pairs = pairs.unionByName(pairs.where("query_id = 3"))
    queries = spark.createDataFrame([(q,) for q in (1, 2, 3, 4, 5)], "query_id long")
    found = L.random_negatives(queries, pairs, spark.createDataFrame([(i,) for i in items], "item long"), "item", 10)
    assert {tuple(r) for r in found.collect()} == walked((1, 2, 3, 4, 5), known, items, 10)
    assert L.random_negatives(queries, pairs, spark.createDataFrame([], "item long"), "item", 10).count() == 0


def test_all_existing_candidates_of_a_hot_query_enter_in_order(spark):
    items = spark.range(100_100).select(F.col("id").alias("item"))
    existing = spark.range(100_000).select(F.lit(1).cast("long").alias("query_id"), (F.col("id") + 50).alias("item"), F.lit("label").alias("candidate_source"))
    retrieved = spark.createDataFrame([(1, 3, 1), (1, 60, 2), (2, 4, 1)], "query_id long, item long, rank long")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    pool = L.candidate_pool(queries, existing, retrieved, items, "item", 10).cache()
    old = pool.where("candidate_source = 'label'")
    assert old.count() == 100_000 and old.where("candidate_no <> item - 49").count() == 0
    sizes = {r["query_id"]: (r["n"], r["last"]) for r in pool.groupBy("query_id").agg(F.count("*").alias("n"), F.max("candidate_no").alias("last")).collect()}
    assert sizes == {1: (100_011, 100_011), 2: (11, 11)}
    # No task numbers the whole group.
    placed = numbered(existing, ["query_id"], "item", F.lit(0.0), F.lit(100_100.0), slices=64)
    assert [r["position"] for r in placed.orderBy("item").collect()] == list(range(100_000))
