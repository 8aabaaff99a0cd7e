"""Shard search, positions, stems and the stored index."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import index as IX
from quarrylight.operators import retrieve as R
from quarrylight.operators import shards as SH
from quarrylight.operators.stems import stems

WORDS = [f"w{i}" for i in range(12)]


def corpus_of(seed: int, n: int):
    """(docs, postings, plain texts): documents of a few words, up to three programs each, six sources."""
    draw = random.Random(seed)
    docs, texts = [], {}
    for i in range(n):
        text = [draw.choice(WORDS[: 2 + i % 11]) for _ in range(draw.randrange(1, 30))]
        texts[i * 3] = text
        programs = [
            {"program_id": i * 10 + k, "confidence": draw.choice([None, 0.2, 0.9]), "newest": draw.choice([None, 5, 7]), "p_days_per_week": draw.choice([None, 3, 4]),
             "p_specialization": draw.choice([None, "bench", "squat"]), "p_experience_level": draw.choice(["beginner", "advanced"]), "p_progression_type": None,
             "p_split_type": draw.choice([None, "full-body"])} for k in range(draw.randrange(0, 4))
        ]
        source = draw.randrange(6)
        docs.append({"doc_id": i * 3, "source_id": source, "created": draw.choice([None, i]), "page_quality": source % 3 - 1, "source_domain": f"d{source % 2}", "sliced": False, "programs": programs})
    postings = []
    for w in WORDS:
        held = [(d, t) for d, t in texts.items() if w in t]
        if held:
            postings.append((w, np.array([d for d, _ in held]), np.array([t.count(w) for _, t in held]), [[k for k, x in enumerate(t) if x == w] for _, t in held]))
    return docs, postings, texts


def ask(draw):
    words = draw.sample(WORDS, draw.randrange(1, 4))
    groups = [[w] for w in draw.sample(WORDS, 2)] + ([draw.sample(WORDS, 2)] if draw.random() < 0.5 else [])
    fields = dict.fromkeys((*SH.FIELDS, "domain"))
    if draw.random() < 0.3:
        fields["days_per_week"] = draw.choice([3, 4, 9])
    if draw.random() < 0.3:
        fields["domain"] = draw.choice(["d0", "d1", "none"])
    return {"query_id": 1, "exact": words, "groups": groups, **fields, "intent_days": draw.choice([None, 3]), "intent_experience": draw.choice([None, "beginner"]), "intent_split": draw.choice([None, "full-body"])}


def plain_rank(text, words):
    return math.floor(sum(0.1 * sum(1 / j**2 for j in range(1, text.count(w) + 1)) / 1.64493406685 for w in words) / len(words) * 1e6 + 0.5)


def plain_search(docs, texts, a, leg):
    words = a["exact"] if leg == SH.EXACT else sorted({w for g in a["groups"] for w in g})
    out = []
    for d in docs:
        text = texts[d["doc_id"]]
        fits = all(w in text for w in words) if leg == SH.EXACT else any(all(w in text for w in g) for g in a["groups"])
        if not fits or (a["domain"] is not None and a["domain"] != d["source_domain"]):
            continue
        for p in d["programs"]:
            if any(a[f] is not None and a[f] != p[f"p_{f}"] for f in SH.FIELDS):
                continue
            intent = sum(points for f, wish, points in SH.INTENTS if a[wish] is not None and a[wish] == p[f"p_{f}"])
            rank = plain_rank(text, words)
            conf = -math.inf if p["confidence"] is None else p["confidence"]
            newest = -math.inf if p["newest"] is None else p["newest"]
            key = (-rank, -d["page_quality"], -conf, -newest) if leg == SH.EXACT else (-intent, -rank, -conf)
            out.append((*key, p["program_id"], rank, intent if leg == SH.EXPANDED else 0))
    return [(r[-3], r[-2], r[-1]) for r in sorted(out)]


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_shard_search_in_blocks(block):
    """Blocks that are passed over hold nothing of the best rows, whatever the limit."""
    docs, postings, texts = corpus_of(1, 150)
    shard, draw = SH.Shard(docs, postings, block), random.Random(2)
    for _ in range(150):
        a = ask(draw)
        for leg in (SH.EXACT, SH.EXPANDED):
            want = plain_search(docs, texts, a, leg)
            for limit in (1, 5, 1000):
                programs, ranks, intents = shard.search(a, leg, limit)
                assert list(zip(shard.program_ids[programs].tolist(), ranks.tolist(), intents.tolist(), strict=True)) == want[:limit]


def test_blocks_are_passed_over(monkeypatch):
    docs, postings, texts = corpus_of(3, 400)
    shard, seen = SH.Shard(docs, postings, 10), []
    plain = SH.Shard.exact
    monkeypatch.setattr(SH.Shard, "exact", lambda self, terms, b: seen.append(b) or plain(self, terms, b))
    a = {**ask(random.Random(1)), "exact": ["w0"], **dict.fromkeys((*SH.FIELDS, "domain"))}
    shard.search(a, SH.EXACT, 3)
    assert 0 < len(seen) < shard.blocks / 2


def test_sources_of_a_shard():
    docs, postings, texts = corpus_of(4, 120)
    docs[0]["sliced"] = True
    for d in docs:
        d["sliced"] = d["source_id"] == docs[0]["source_id"]
    shard, draw = SH.Shard(docs, postings, 16), random.Random(5)
    for _ in range(60):
        a = ask(draw)
        found: dict = {}
        for d in docs:
            text = texts[d["doc_id"]]
            if all(w in text for w in a["exact"]) and (a["domain"] is None or a["domain"] == d["source_domain"]):
                rank, latest = found.get(d["source_id"], (-1, -math.inf))
                found[d["source_id"]] = max(rank, plain_rank(text, a["exact"])), max(latest, -math.inf if d["created"] is None else d["created"])
        order = sorted(found, key=lambda s: (-found[s][0], -(s % 3 - 1), -found[s][1], s))
        own, ranks, _ = shard.sources(a, 2)
        got = shard.source_ids[own].tolist()
        assert got[:2] == order[:2] and set(got) == set(order[:2]) | ({docs[0]["source_id"]} & set(found))
        assert ranks.tolist() == [found[s][0] for s in got]


def test_proximity_of_positions():
    docs, postings, texts = corpus_of(6, 80)
    texts[0] = ["w0", *["x"] * 100, "w1", *["x"] * 300, "w0"]
    postings = [p for p in postings if p[0] not in ("w0", "w1")]
    for w in ("w0", "w1"):
        held = [(d, t) for d, t in texts.items() if w in t]
        postings.append((w, np.array([d for d, _ in held]), np.array([t.count(w) for _, t in held]), [[k for k, x in enumerate(t) if x == w] for _, t in held]))
    shard, draw = SH.Shard(docs, postings, 16), random.Random(7)
    for words in ([["w0", "w1"]] + [draw.sample(WORDS, 3) for _ in range(40)]):
        places, ranks = shard.proximity({"exact": words})
        for d, rank in zip(shard.ids[places].tolist(), ranks.tolist(), strict=True):
            text, left = texts[d], 1.0
            for i, x in enumerate(text):
                for j, y in enumerate(text):
                    if x in words and y in words and x < y and abs(i - j) <= 100:
                        left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(i - j) / 1.5 - 2)))
            assert rank == pytest.approx(1 - left, abs=1e-12)


def test_large_sources_are_sliced(spark):
    keys = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("source_id"))
    placed = SH.place_documents(keys, 1000, 100).collect()
    by = {}
    for r in placed:
        by.setdefault(r["shard"], []).append(r)
    assert {r["sliced"] for r in placed if r["source_id"] == 1} == {True} and not any(r["sliced"] for r in placed if r["source_id"] != 1)
    assert len(by) > 5 and max(map(len, by.values())) < 350


def test_search_is_the_same_in_any_shards(spark, corpus):
    """Shards of other sizes give the same lists; no exchange has a row for each match."""
    before, results = spark.conf.get("quarrylight.index.shard_docs"), []
    for size in ("32", "100000"):
        spark.conf.set("quarrylight.index.shard_docs", size)
        rows = R.search_programs(corpus.requests, corpus, 5).collect()
        seen = R.search_sources(corpus.requests, corpus, 3).collect()
        results.append((sorted(map(str, rows)), sorted(map(str, seen))))
    found = R.search_shards(corpus.requests, corpus, exact=5, expanded=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("quarrylight.index.shard_docs", before)
    assert results[0] == results[1] and results[0][0]
    # Above the worker that answers there is nothing; below it only documents, postings and requests are dealt.
    assert plan.index("MapInArrow") < plan.index("Exchange") and "Aggregate" not in plan[: plan.index("MapInArrow")]
    shards = IX.shard_count(corpus)
    per = found.groupBy("query_id", "leg").count().agg(F.max("count")).first()[0]
    assert per <= 10 * shards


# Pairs of the paper that describes the rules.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll squatting squat squats squat squat squat generalizations gener
oscillators oscil is is a a 5x5 5x5""".split()


def test_published_stems(spark):
    pairs = dict(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))
    found = {r["token"]: r["stem"] for r in stems(spark.createDataFrame([(t,) for t in pairs], "token string")).collect()}
    assert found == pairs


def test_stemmed_index_unites_tokens(spark):
    lists = spark.createDataFrame(
        [(0, "squats", [1, 4], [2, 1], [[3, 9], [5]]), (0, "squatting", [4, 6], [1, 1], [[2], [8]]), (1, "squat", [2], [1], [[1]])],
        "shard int, lexeme string, docs array<long>, tfs array<int>, positions array<array<int>>",
    )
    words = stems(lists.select(F.col("lexeme").alias("token")))
    found = sorted(map(tuple, IX.stemmed_postings(lists, words).collect()))
    assert found == [(0, "squat", [1, 4, 6], [2, 2, 1], [[3, 9], [2, 5], [8]]), (1, "squat", [2], [1], [[1]])]
