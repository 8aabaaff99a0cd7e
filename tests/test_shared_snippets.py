"""Snippets of a text for all its queries, each as by ``with_snippet``; a long text is not joined to every card."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from quarrylight.functions import text as T
from quarrylight.operators import evidence as EV

TEXTS = [
    (1, "start " + "word " * 60 + "Target here " + "tail " * 60), (2, None), (3, "  \t\n "), (4, "short"), (5, "a\x1cb\x1f target   x\x85y\xa0 z　"),
    (6, "İİ ΑΣ Kelvin " * 40 + "target"), (7, "x " * 30_000 + "\U0001f600 Target" + " é" * 400), (8, "retargeted " * 50), (4, "another text of that id, longer " * 20),
    (9, "only" + "​" * 300 + "target"), (11, " \x1c "),
]
QUERIES = ["target of", "a of", "", "zzz", "Kelvin", "KELVIN tail", "here tail start", "wor target", "i̇ an id", "x y z", "text-of-that", *[f"none{i} target" for i in range(150)]]


@pytest.mark.parametrize("partitions", [1, 5])
def test_same_as_by_row(spark, partitions):
    texts = spark.createDataFrame(TEXTS, "id long, text string").repartition(partitions)
    asked = spark.createDataFrame([(i, q) for i in (*range(1, 11), 11) for q in QUERIES] + [(None, "target"), (1, "target of")], "id long, query string")
    found = T.snippets(asked, texts)
    plain = T.with_snippet(asked.distinct().join(texts, "id"), "text", "query").select("id", "query", "snippet")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_cards_do_not_carry_texts(corpus):
    cards = EV.evidence_cards(corpus.requests, corpus)
    plan = cards._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("MapInArrow") == 1
    assert cards.where("snippet <> ''").count() > 0 and cards.where(F.length("snippet") > 226).count() == 0
