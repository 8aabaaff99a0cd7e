"""Index entries come from each document's own row; ids with several texts are united."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from quarrylight.operators import index as IX

ROWS = [(1, "Runs run a run"), (2, ""), (3, "the and"), (4, "one two one"), (4, "two three"), (5, "Boxes, boxes 5"), (4, "one"), (None, "one"), (None, "one two")]


def frames(spark, rows, partitions):
    docs = spark.createDataFrame(rows, "doc_id long, content string").repartition(partitions)
    many = [(i,) for i, n in Counter(i for i, _ in rows).items() if n > 1]
    return docs, spark.createDataFrame(many, "doc_id long")


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("partitions", [1, 4])
def test_entries_of_documents(spark, partitions):
    found = {(r["doc_id"], r["lexeme"]): (r["tf"], list(r["positions"])) for r in IX.postings(*frames(spark, ROWS, partitions)).collect()}
    assert found == {
        (1, "run"): (3, [1, 2, 4]), (4, "one"): (3, [1, 1, 3]), (4, "two"): (2, [1, 2]), (4, "three"): (1, [2]), (None, "one"): (2, [1, 1]), (None, "two"): (1, [2]), (5, "boxe"): (2, [1, 2]), (5, "5"): (1, [3]),
    }


@pytest.mark.parametrize("partitions", [1, 4])
def test_documents_of_tokens(spark, partitions):
    found = {r["token"]: r["n_docs"] for r in IX.document_counts(*frames(spark, ROWS, partitions)).collect()}
    assert found == {"runs": 1, "run": 1, "one": 2, "two": 2, "three": 1, "boxes": 1, "5": 1}
    more = frames(spark, [(i, "plain word") for i in range(9)], partitions)
    assert {tuple(r) for r in IX.document_counts(*more).collect()} == {("plain", 9), ("word", 9)}


def test_no_token_is_shuffled(spark):
    assert shuffles(IX.postings(*frames(spark, ROWS[:4], 1))) == 0
