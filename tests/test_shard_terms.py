"""What a shard and its requests cost before anything is searched."""

from __future__ import annotations

import random

import pyarrow as pa
from test_search import ask, corpus_of, plain_search

from quarrylight.operators import retrieve as R
from quarrylight.operators import shards as SH


def test_only_terms_that_are_asked_for_are_put_in_order():
    docs, postings, texts = corpus_of(21, 90)
    shard = SH.Shard(docs, postings, 16)
    assert not dict(shard.terms)
    a = {**ask(random.Random(1)), "exact": ["w1", "w0"]}
    shard.search(a, SH.EXACT, 3)
    assert set(shard.terms) == {"w0", "w1"}
    shard.search({**a, "exact": ["w0", "w2", "none"]}, SH.EXACT, 3)
    assert set(shard.terms) == {"w0", "w1"}


def test_postings_weighed_in_parts(monkeypatch):
    """However many postings are weighed at once, rows and order are the same."""
    docs, postings, texts = corpus_of(22, 120)
    for at_once in (1, 7, 60, sum(len(p[1]) for p in postings)):
        monkeypatch.setattr(SH, "AT_ONCE", at_once)
        shard, draw = SH.Shard(docs, postings, 16), random.Random(3)
        for _ in range(20):
            a = ask(draw)
            for leg in (SH.EXACT, SH.EXPANDED):
                programs, ranks, intents = shard.search(a, leg, 20)
                assert list(zip(shard.program_ids[programs].tolist(), ranks.tolist(), intents.tolist(), strict=True)) == plain_search(docs, texts, a, leg)[:20]
    assert not len(SH.Shard(docs, [], 16).search({**a, "exact": ["w0"]}, SH.EXACT, 5)[0])


def test_steps_are_never_below_the_weights():
    assert (SH.STEPS * SH.STEP >= SH.WEIGHTS - 1e-9).all() and SH.STEPS[:3].tolist() == [0, 4, 5] and SH.STEPS.max() == 7


def test_requests_are_made_by_column():
    draw = random.Random(4)
    rows = [{**ask(draw), "query_id": i} for i in range(50)]
    rows[7] |= {"exact": [], "groups": []}
    kinds = {n: pa.int64() for n in ("query_id", "days_per_week", "intent_days")} | {"exact": pa.list_(pa.string()), "groups": pa.list_(pa.list_(pa.string()))}
    column = pa.array(rows, pa.struct([(n, kinds.get(n, pa.string())) for n in rows[0]]))
    for part in (column, column[3:30], column[7:8], column[:0]):
        assert SH._requests(part) == part.to_pylist()


def test_documents_are_made_by_column():
    docs, _, _ = corpus_of(24, 40)
    texts = {"source_domain", "p_specialization", "p_experience_level", "p_progression_type", "p_split_type"}
    program = pa.struct([(n, pa.float64() if n == "confidence" else pa.string() if n in texts else pa.int64()) for n in next(d for d in docs if d["programs"])["programs"][0]])
    kinds = {"sliced": pa.bool_(), "programs": pa.list_(program)}
    rows = [{**d, "programs": d["programs"] or None} for d in docs]
    column = pa.array(rows, pa.struct([(n, kinds.get(n, pa.string() if n in texts else pa.int64())) for n in docs[0]]))
    for part in (column, column[5:17], column[:0]):
        assert [{**d, "programs": d["programs"] or None} for d in SH._documents(part)] == part.to_pylist()


def test_alike_requests_come_together(corpus):
    """Requests with the same filters follow each other, so the programs that pass them are looked up once a shard."""
    plan = R.search_shards(corpus.requests, corpus, exact=3, expanded=3)._jdf.queryExecution().executedPlan().toString()
    assert "domain" in next(line for line in plan.splitlines() if "Sort [shard" in line)
