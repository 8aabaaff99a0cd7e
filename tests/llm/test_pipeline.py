"""Every stage against a plain version of what it decides, and the stages in turn."""

from __future__ import annotations

import cases
import corpus_pipeline
import pytest
from test_text_operators import plain_components, plain_repeats

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    cases.documents(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 30)] + [(i, 1, 0) for i in range(100, 130)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_in_turn(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, rows = docs.columns, sorted(cases.texts(), key=repr)

    spoken = corpus_pipeline.known_language(spark, docs, tables)
    assert spoken.columns == columns
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert sorted(((r["doc_id"], r["text"]) for r in spoken.collect()), key=repr) == sorted(rows, key=repr)

    good = corpus_pipeline.good_quality(spark, spoken, tables)
    assert good.columns == columns and good.count() == len(rows)  # all labels are good

    apart = corpus_pipeline.without_near_duplicates(spark, good, tables)
    kept = plain_components(rows, 5, 80)
    seen, left = set(), []
    for i, t in rows:
        if i is None or (kept[i][2] and i not in seen):
            seen.add(i)
            left.append((i, t))
    assert sorted(((r["doc_id"], r["text"]) for r in apart.collect()), key=repr) == sorted(left, key=repr)

    short = corpus_pipeline.without_repeats(spark, apart, tables)
    assert short.columns == columns
    cut, texts = plain_repeats(left, 20), dict(left)
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in short.collect() if r["doc_id"] is not None}
    wanted = {i: cut[i][3] if cut[i][1] else texts[i] for i in cut}
    assert found == {i: (t, len(t)) for i, t in wanted.items()}

    pieces = corpus_pipeline.packed(spark, short, tables).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in short.collect()}


def test_run_and_registration(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_dedup", "substring_dedup", "packing"]
    assert entry.queries()["pipeline"](spark, tables).count() > 0
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in entry.queries()}


def test_empty_tables(spark, tables, tmp_path):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0
