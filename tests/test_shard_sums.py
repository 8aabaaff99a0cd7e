"""The expanded leg ranks only documents whose upper bound reaches the last row, and finds the same rows as a plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_search import WORDS, ask, corpus_of, plain_search

from quarrylight.operators import shards as SH


@pytest.mark.parametrize("rows", [0, 4, 512])
def test_expanded_search_of_a_large_shard(monkeypatch, rows):
    """Terms with and without a row, groups of one term and of several, classes of intents: the best rows, whole and in order."""
    monkeypatch.setattr(SH, "ROWS", rows)
    docs, postings, texts = corpus_of(8, 6000)
    shard, draw = SH.Shard(docs, postings, 512), random.Random(9)
    for _ in range(40):
        a = ask(draw)
        want = plain_search(docs, texts, a, SH.EXPANDED)
        for limit in (1, 50, 3000):
            programs, ranks, intents = shard.search(a, SH.EXPANDED, limit)
            assert list(zip(shard.program_ids[programs].tolist(), ranks.tolist(), intents.tolist(), strict=True)) == want[:limit]


def test_few_documents_are_ranked(monkeypatch):
    docs, postings, texts = corpus_of(10, 200)
    draw = np.random.default_rng(11)
    docs = [{**docs[i % 200], "doc_id": i} for i in range(20_000)]
    held = {w: np.flatnonzero(draw.random(20_000) < share) for w, share in zip(WORDS, np.linspace(0.7, 0.01, len(WORDS)), strict=True)}
    shard = SH.Shard(docs, [(w, at, draw.integers(1, 200, len(at)), None) for w, at in held.items()], 512)
    seen, plain = [], SH.Sums.ranked
    monkeypatch.setattr(SH.Sums, "ranked", lambda self, places: seen.append(len(places)) or plain(self, places))
    a = {"query_id": 1, "exact": [], "groups": [[w] for w in WORDS], **dict.fromkeys((*SH.FIELDS, "domain", "intent_days", "intent_experience", "intent_split"))}
    found, ranks, _ = shard.search(a, SH.EXPANDED, 25)
    assert len(found) == 25 and sum(seen) < 1000
    total = sum(np.bincount(at, SH.WEIGHTS[t], 20_000) for at, t in ((shard.terms[w].places, np.searchsorted(SH.WEIGHTS, shard.terms[w].weights)) for w in WORDS))
    every = np.sort(SH.millionths(total / len(WORDS))[shard.program_doc])[::-1]
    assert ranks.tolist() == every[:25].tolist()


def test_many_terms_do_not_overflow():
    """More terms than fit into 16 bits of steps."""
    words = [f"t{i}" for i in range(400)]
    docs, _, _ = corpus_of(12, 40)
    ids = np.array([d["doc_id"] for d in docs])
    shard = SH.Shard(docs, [(w, ids, np.full(len(ids), 255 - i % 3), None) for i, w in enumerate(words)], 16)
    a = {"query_id": 1, "exact": [], "groups": [[w] for w in words], **dict.fromkeys((*SH.FIELDS, "domain", "intent_days", "intent_experience", "intent_split"))}
    _, ranks, _ = shard.search(a, SH.EXPANDED, 5)
    assert ranks.tolist() == [int(SH.millionths(sum(SH.WEIGHTS[255 - i % 3] for i in range(400)) / 400))] * 5
