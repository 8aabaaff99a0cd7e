"""Matches and proximity are dealt by document and worked out for all documents of a request at once."""

from __future__ import annotations

import numpy as np
import pytest
from test_search import WORDS, corpus_of

from quarrylight.operators import shards as SH

DOC = (
    "doc_id long, source_id long, created long, page_quality long, source_domain string, sliced boolean, programs array<struct<program_id: long, confidence: double, "
    "newest: long, p_days_per_week: long, p_specialization: string, p_experience_level: string, p_progression_type: string, p_split_type: string>>"
)
ASK = "query_id long, exact array<string>, groups array<array<string>>, days_per_week long, intent_days long, " + ", ".join(
    f"{f} string" for f in (*SH.FIELDS[1:], "domain", "intent_experience", "intent_split")
)


def in_places(texts):
    found = []
    for w in WORDS:
        held = [d for d, t in texts.items() if w in t]
        found.append((w, held, [texts[d].count(w) for d in held], [[k for k, x in enumerate(texts[d]) if x == w] for d in held]))
    return found


@pytest.mark.parametrize("shares", [1, 2, 7])
def test_parts_of_a_shard_find_the_same(spark, shares):
    docs, _, texts = corpus_of(31, 90)
    rows = [(0, tuple(d[f.split()[0]] for f in ("doc_id", "source_id", "created", "page_quality", "source_domain", "sliced")) + ([],)) for d in docs]
    asks = [(0, (i, [WORDS[i % 5], WORDS[-1 - i % 7]][: 1 + i % 2], []) + (None,) * 9) for i in range(40)]
    posts = [(0, p) for p in in_places(texts) if p[1]]
    frames = (
        spark.createDataFrame(rows, f"shard int, doc struct<{DOC}>"),
        spark.createDataFrame(posts, "shard int, post struct<lexeme: string, docs: array<long>, tfs: array<int>, positions: array<array<int>>>").repartition(3),
        spark.createDataFrame(asks, f"shard int, ask struct<{ASK}>"),
    )

    def answered(*parts):
        found = SH.search_shards(*parts, legs=(SH.EXACT,), proximity=True).collect()
        return sorted((r["query_id"], r["leg"], r["doc_id"], r["rank_millionths"] or -1, round(r["proximity"] or 0, 9)) for r in found)

    want = answered(1, *frames)
    assert len(want) > 100 and answered(*SH.divided(1, *frames, shares)) == want
    dealt = SH.divided(1, *frames, shares)[2].selectExpr("size(post.docs) AS n").agg({"n": "sum"}).first()[0]
    assert dealt == sum(len(p[1]) for _, p in posts)


def test_positions_of_all_documents_at_once(monkeypatch):
    docs, postings, texts = corpus_of(32, 120)
    postings = [(w, np.array(at), np.array(tf), where) for w, at, tf, where in in_places(texts) if at]
    shard, calls, plain = SH.Shard(docs, postings, 16), [], SH.nearness
    monkeypatch.setattr(SH, "nearness", lambda terms, places: calls.append(len(places)) or plain(terms, places))
    ask = {"exact": [WORDS[0], WORDS[1]]}
    places, found = shard.proximity(ask)
    assert calls == [len(places)] and len(places) > 10
    # Alike requests are answered once, and any cut of the work gives the same.
    assert shard.proximity({"exact": ask["exact"][::-1]})[1].tolist() == found.tolist() and len(calls) == 1
    for name, value in (("PAIRS", 3), ("COMPARED", 7)):
        monkeypatch.setattr(SH, name, value)
        shard.near.clear()
        assert shard.proximity(ask)[1] == pytest.approx(found.tolist(), abs=1e-12)
