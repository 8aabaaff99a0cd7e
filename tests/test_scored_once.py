"""Candidates are scored once, and rows do not carry words on."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarrylight.operators import rerank as RR
from quarrylight.plans import catalog_learning as CL


def test_a_candidate_is_scored_once(spark):
    rows = [(q, i, i + 1, f"term{i % 3} other", ["other", f"term{i % 2}"], 0.1, None) for q in range(6) for i in range(8)]
    found = spark.createDataFrame(rows, "query_id long, program_id long, rank long, query string, words array<string>, text_rank double, confidence double").repartition(3)
    asked = spark.sparkContext.accumulator(0)

    def scorer(candidates):
        def count(batches):
            for b in batches:
                asked.add(b.num_rows)
                yield b

        scored = RR.coverage_scorer(candidates.mapInArrow(count, candidates.schema))
        bad = (F.col("query_id") == 2) & (F.col("program_id") == 5)
        return scored.withColumn("failure", F.when(bad, "inference_error")).withColumn("score", F.when(~bad, F.col("score")))

    out = RR.rerank(found, scorer, 4, depth=6).select("query_id", "program_id", "base_rank", "rank", "mode", "fallback_reason").collect()
    assert asked.value == 6 * 6
    for q in range(6):
        own = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        kept = [i for i in range(6)]
        score = {i: len({f"term{i % 3}", "other"} & {"other", f"term{i % 2}"}) / 2 for i in kept}
        order = kept if q == 2 else sorted(kept, key=lambda i: (-score[i], i))
        assert [r["program_id"] for r in own] == order[:4]
        assert {(r["mode"], r["fallback_reason"]) for r in own} == {("baseline_fallback", "inference_error") if q == 2 else ("reranked", None)}


def test_words_are_not_shuffled_behind_their_join(corpus):
    plan = CL._bootstrap(corpus)._jdf.queryExecution().executedPlan().toString()
    # Between the join with the words and the ranking of each request only narrow rows move.
    assert plan.index("Window") < plan.index("Union") < plan.index("array_intersect")
    assert not re.search(r"Exchange", plan[plan.index("Union") : plan.index("array_intersect")])
