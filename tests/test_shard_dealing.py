"""Searches ask no shard in vain, and pass over documents that can't reach a request's last row."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quarrylight.operators import index as IX
from quarrylight.operators import retrieve as R
from quarrylight.operators import shards as SH


def test_all_term_requests_go_where_their_rarest_term_is(spark, corpus):
    asked = R.asks(R.as_asked(corpus.requests))
    wanted = IX.wanted_postings(corpus, asked.select(F.explode("ask.exact").alias("lexeme")))
    at: dict = {}
    for r in wanted.select("shard", "post.lexeme").collect():
        at.setdefault(r["lexeme"], set()).add(r["shard"])
    dealt: dict = {}
    for r in R.routed(asked, wanted).select("shard", "ask.query_id").collect():
        dealt.setdefault(r["query_id"], []).append(r["shard"])
    for r in asked.select("ask.query_id", "ask.exact").collect():
        some = min((at.get(x, set()) for x in r["exact"]), key=len, default=set())
        got = dealt.get(r["query_id"], [])
        assert len(got) == len(some) == len(set(got)) and set(got) in [at.get(x, set()) for x in r["exact"]] + [set()]


def test_poor_documents_are_passed_over(monkeypatch):
    """Documents lie by their weights: once the rich ones fill the list, blocks that can't reach it are not summed."""
    draw, blank = random.Random(3), dict.fromkeys((*SH.FIELDS, "domain"))
    texts = {i: ["w0"] * 9 + ["w1"] * 9 if i % 100 == 7 else [draw.choice(("w0", "w1", "w2"))] for i in range(3000)}
    docs = [{
        "doc_id": i, "source_id": 1, "created": 1, "page_quality": 0, "source_domain": "d", "sliced": False,
        "programs": [{"program_id": i, "confidence": None, "newest": None, **{f"p_{f}": None for f in SH.FIELDS}}],
    } for i in texts]
    postings = []
    for w in ("w0", "w1", "w2"):
        held = [(i, t.count(w)) for i, t in texts.items() if w in t]
        postings.append((w, np.array([i for i, _ in held]), np.array([n for _, n in held]), None))
    shard, seen, plain = SH.Shard(docs, postings, 64), [], SH.summed
    monkeypatch.setattr(SH, "summed", lambda terms, b, low, size: seen.append(size) or plain(terms, b, low, size))
    ask = {"query_id": 1, "exact": ["w0"], "groups": [["w0"], ["w1"]], **blank, "intent_days": None, "intent_experience": None, "intent_split": None}
    programs, _, _ = shard.search(ask, SH.EXPANDED, 20)
    assert shard.program_ids[programs].tolist() == [i for i in texts if i % 100 == 7][:20]
    assert sum(seen) < 100


def test_shared_shards_give_the_same_rows(spark, corpus):
    asked = R.asks(R.as_asked(corpus.requests)).select("ask")
    wanted = IX.wanted_postings(corpus, asked.select(F.explode(F.array_union("ask.exact", F.flatten("ask.groups"))).alias("lexeme")))
    shards = IX.shard_count(corpus)
    dealt = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ask")
    found = [
        sorted(map(str, SH.search_shards(shards, R.shard_documents(corpus), wanted, dealt, exact=3, expanded=4, sources=2, shares=n).collect())) for n in (1, 3)
    ]
    assert found[0] == found[1] and found[0]
