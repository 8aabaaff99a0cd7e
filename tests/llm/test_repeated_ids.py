"""Ids that come with several texts or vectors, in any partitioning."""

from __future__ import annotations

import hashlib

import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylight.llm.catalog import op6_sentencepiece
from quarrylight.llm.near_dedup import near_duplicates, one_of_each
from quarrylight.llm.neighbours import nearest_neighbours
from quarrylight.llm.substring_dedup import judge_repeats, remove_repeats


def rows():
    a, b, c = cases.sentence(1, 60), cases.sentence(2, 60), cases.sentence(3, 60)
    return [
        (1, f"{a} {cases.sentence(4, 10)}"), (2, f"{a} {cases.sentence(5, 30)}"), (2, cases.sentence(6, 40)), (2, b), (3, f"{b} more"), (4, c),
        (5, c), (5, f"{c} tail"), (5, b), (6, cases.sentence(7, 30)), (6, cases.sentence(8, 30)), (7, None), (7, ""), (7, c), (8, f"{cases.sentence(8, 30)} z"), (2, b),
    ]


def shingles(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 2]) for i in range(len(found) - 1)} or ({tuple(found)} if found else set())


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_near_duplicates_of_all_texts(spark, partitions):
    """An id's texts link it each; none of them stands for the others."""
    sets = [(i, shingles(t)) for i, t in rows()]
    head = {i: i for i, _ in sets}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                head[high] = low
    found = near_duplicates(cases.documents(spark, rows(), partitions), shingle_words=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted((i, len(x), root(i)) for i, x in sets)
    assert root(3) == root(5) == root(4) == root(7) == 2 and root(8) == 6


@pytest.mark.parametrize("partitions", [1, 7])
def test_the_row_that_stays(spark, partitions):
    kept = one_of_each(cases.documents(spark, rows(), partitions), shingle_words=2).collect()
    smallest = {}
    for i, t in rows():
        smallest[i] = min(smallest.get(i, t) or "", t or "") if i in smallest else t
    assert {r["doc_id"]: r["text"] for r in kept} == {i: smallest[i] for i in (1, 2, 6)}


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_repeats_of_all_texts(spark, partitions):
    """An id with a text is a document; an id's documents follow each other by the hashes of their texts."""
    code = {t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64) if t is not None else 42 for _, t in rows()}
    seen, wanted, texts = set(), {}, {}
    for i, t in sorted(set(rows()), key=lambda r: (r[0], code[r[1]])):
        found = (t or "").encode().split()
        gone = [False] * len(found)
        for s in range(len(found) - 19):
            window = tuple(found[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(found, gone, strict=True) if not g)
        wanted[i, t] = (i, len(found), sum(gone), hashlib.sha256(kept).hexdigest())
        texts[i, t] = kept.decode() if any(gone) else t
    docs = cases.documents(spark, rows(), partitions)
    found = judge_repeats(docs, window=20).collect()
    assert sorted(tuple(r) for r in found) == sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == sorted(wanted[r] for r in rows())
    assert sorted((r["doc_id"], r["text"] or "") for r in remove_repeats(docs, window=20).collect()) == sorted((i, texts[i, t] or "") for i, t in rows())


def test_the_vector_of_an_id(spark):
    table = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [5.0, 0.0]), (1, [1.0, 9.0]), (2, [2.0, 2.0]), (20, [0.0, 3.0])]
    for partitions in (1, 4):
        df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(partitions)
        found = nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=2).collect()
        # Of the vectors of an id the smallest counts: (1, 9) for 1, (0, 1) for 20.
        assert sorted(tuple(r) for r in found) == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (20, 1, 1, 9.0), (20, 2, 2, 2.0)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_pieces_of_a_null_text(spark, tmp_path, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.createDataFrame([(1, None), (2, ""), (3, "a word")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        found = {r["doc_id"]: r["n_pieces"] for r in op6_sentencepiece(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert found[1] == found[2] == 0 < found[3]
