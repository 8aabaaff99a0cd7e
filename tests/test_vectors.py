"""Exact values of single operators on small rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import errors as ERR
from quarrylight.functions import intent as I
from quarrylight.functions import payload as P
from quarrylight.functions import text as T
from quarrylight.functions import urls as U
from quarrylight.operators import discovery as D
from quarrylight.operators import evaluate as E
from quarrylight.operators import labels as L
from quarrylight.operators import normalize as N
from quarrylight.sources import artifacts as AR
from quarrylight.sources import ledger as LE


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("HTTPS://Example.COM/Path/?q=1#x", "https://example.com/Path"),
    ("example.com/a/", "https://example.com/a"),
    ("//Example.com", "https://example.com/"),
    ("http://h/a;p/b;q?x", "http://h/a;p/b"),
    ("http://h/a//", "http://h/a/"),
    ("http://User@H:80", "http://user@h:80/"),
    (" https://www.h/\n", "https://www.h/"),
])
def test_canonicalize(spark, raw, want):
    assert one(spark, raw, U.canonicalize_url) == want
    assert one(spark, raw, U.safe_canonicalize_url) == want


@pytest.mark.parametrize("raw", ["mailto:a@b.c", "ftp://h/x", "http://bad host/x", "example.com:8080/x", "", "http:///x", "javascript:void(0)"])
def test_unusable_urls(spark, raw):
    assert one(spark, raw, U.safe_canonicalize_url) is None


@pytest.mark.parametrize("url, allowed", [
    ("https://h/a.PDF", False), ("https://h/a.pdf/", False), ("https://h/a.html", True), ("https://h/.jpg", True),
    ("https://h/tag/x", False), ("https://h/tag", False), ("https://h/tags", True), ("https://h/x/feed/", False), ("https://h/", True),
])
def test_url_policy(spark, url, allowed):
    assert one(spark, url, U.is_allowed_candidate) is allowed


def test_candidate_cap(spark):
    rows = spark.range(40).select(F.col("id").alias("seq"), F.lit("d").alias("domain"), (F.col("id") % 2 == 0).alias("allowed"))
    assert {r.seq for r in D.apply_cap(rows, 3).where("accepted").collect()} == {0, 2, 4}


@pytest.mark.parametrize("output, want", [
    ('["https://a/1","https://a/1/","x https://b/2"]', ["https://a/1", "https://b/2"]),
    ('{"links":["https://c/3"],"urls":["https://a/1"],"other":["https://z/9"]}', ["https://a/1", "https://c/3"]),
    ('see https://a/1 and "https://b/2"', ["https://a/1", "https://b/2"]),
    ('{"urls": "[\\"https://a/1\\"]"}', ["https://a/1"]),
    ('[[[[["https://a/deep"]]]]]', ["https://a/deep"]),
    ("{broken https://a/1", ["https://a/1"]),
    ("nothing", []),
])
def test_candidate_urls(spark, output, want):
    df = spark.createDataFrame([(1, output)], "k long, output string")
    assert [r.canonical_url for r in D.extract_candidates(df, "k").orderBy("pos").collect()] == want


@pytest.mark.parametrize("text, want", [
    ("One. Two.", "One."), ("No end", "No end"), ("    ", None), ("What?  Yes", "What?"), ("e.g.this is one. Two", "e.g.this is one."),
    ("x" * 221, "x" * 220 + "..."), ("Only one.  ", "Only one."), ("A line\nbreak. Next", "A line\nbreak."),
])
def test_first_sentence(spark, text, want):
    assert one(spark, text, T.first_sentence) == want


@pytest.mark.parametrize("text, want", [("4 days", 4), ("train 12x or 3", 3), ("15 then 3", None), ("100", None), ("", None), ("0.5", None)])
def test_days_from_text(spark, text, want):
    assert one(spark, text, T.days_from_text) == want


def test_labels_and_short_text(spark):
    from quarrylight.functions import fixed_values as V

    assert one(spark, "Powerlifting STRENGTH", lambda c: T.enum_label(c, V.SPECIALIZATION)) == "powerlifting"
    assert one(spark, "interpersonal", lambda c: T.enum_label(c, V.PROGRESSION_TYPE)) == "autoregulated"
    assert one(spark, "other", lambda c: T.enum_label(c, V.SPLIT_TYPE)) is None
    assert one(spark, " a   b\n", T.sanitize_short_text) == "a b"
    assert one(spark, "x" * 63 + " yz", T.sanitize_short_text) == "x" * 63


@pytest.mark.parametrize("value, want", [("0.4", 0.4), ("-1", 0.0), ("7", 1.0), ("nan", None), ("inf", 1.0), ("x", None)])
def test_clamp(spark, value, want):
    assert one(spark, value, lambda c: T.clamp_unit(c.try_cast("double"))) == want


def test_bounded_and_lines(spark):
    assert one(spark, "aa bb cc", lambda c: T.bounded(c, 5)) == "aa …"
    assert one(spark, "aaaaaaa", lambda c: T.bounded(c, 5)) == "aaaaa …"
    assert one(spark, "v", lambda c: T.labelled_lines([("a", c), ("b", F.lit("")), ("c", F.lit(3))])) == "a: v\nc: 3"


@pytest.mark.parametrize("token, want", [("queries", "query"), ("aies", "aie"), ("plates", "plate"), ("toes", "toe"), ("bus", "bus"), ("press", "press"), ("squats", "squat")])
def test_stem(spark, token, want):
    assert one(spark, token, T.stem) == want


def test_snippet(spark):
    text = "start " + "word " * 60 + "Target here " + "tail " * 60
    df = spark.createDataFrame([(text, "target of"), (text, "a of"), (None, "x"), ("short", "zzz")], "t string, q string")
    got = [r.snippet for r in T.with_snippet(df, "t", "q").collect()]
    flat = " ".join(text.split())
    at = flat.lower().find("target") - 70
    assert got[0] == "..." + flat[at:at + 220].strip() + "..."
    assert got[1] == flat[:220] + "..."
    assert got[2] is None and got[3] == "short"


def test_intent(spark):
    q = "Post Novice 4–day Full Body bench press"
    row = spark.createDataFrame([(q,)], "v string").select(
        I.expanded_terms(F.col("v")), I.intent_days(F.col("v")), I.intent_experience(F.col("v")), I.intent_split(F.col("v"))
    ).first()
    assert row[0] == ["bench", "bench press", "full-body", "full body", "intermediate", "novice", "4", "day"]
    assert tuple(row)[1:] == (4, "intermediate", "full-body")
    assert one(spark, "full-body two days", I.intent_split) is None
    assert one(spark, "full-body two days", I.intent_days) == 2
    assert one(spark, "first meet", I.intent_experience) == "beginner"


@pytest.mark.parametrize("message, kind, code, group", [
    ("domain already has active crawl", None, "blocked_active_crawl", "blocked"), ("HTTP 429", None, "rate_limited", "retryable"),
    ("", "TimeoutError", "timeout", "retryable"), ("x", "ConnectionError", "retryable_browser_use", "retryable"),
    ("schema_invalid, timeout", None, "timeout", "retryable"), ("boom", "ValueError", "terminal_error", "terminal"),
])
def test_error_codes(spark, message, kind, code, group):
    df = spark.createDataFrame([(message, kind)], "m string, k string")
    c = ERR.error_code(F.col("m"), F.col("k"))
    assert tuple(df.select(c, ERR.error_kind(c)).first()) == (code, group)


def normalized(spark, output, url="https://h/articles/x"):
    df = spark.createDataFrame([(1, 1, url, output)], "document_id long, source_id long, url string, output string")
    return N.normalize(df).first()


def test_normalize_object(spark):
    out = normalized(spark, json.dumps({
        "headline": "H", "byline": "B", "content": "t" * 600, "excerpt": "E",
        "programs": [{"program_name": "P", "days_per_week": True, "confidence": "2"}, {"confidence": 1}, 5],
        "claims": [{"claim": "c", "program_id": "P"}, {}],
    }))
    assert (out.payload_type, out.title, out.author, out.summary) == ("object", "H", "B", "E")
    assert [(p.name, p.days_per_week, p.confidence) for p in out.programs] == [("P", 1, 1.0)]
    assert [(k.raw_text, k.raw_ref) for k in out.claims] == [("c", "P")]
    assert out.parse_confidence == 0.85 and out.warnings == [] and out.validation_errors == []


def test_normalize_other_forms(spark):
    assert normalized(spark, 'ok ```json\n{"title": "T"}\n``` end').title == "T"
    text = normalized(spark, "plain words")
    assert (text.payload_type, text.raw_text, text.validation_errors) == ("string", "plain words", ["schema_invalid"])
    assert normalized(spark, "[1]").payload_type == "list"
    assert normalized(spark, None).payload_type == "NoneType"
    assert normalized(spark, json.dumps({"text": "Summary: " + "x" * 100})).validation_errors == ["low_quality_output"]


def test_inferred_program(spark):
    body = "Run this 4 days. More text follows here."
    out = normalized(spark, json.dumps({"title": " Bench Builder ", "text": body}), "https://h/program-a/x")
    p = out.programs[0]
    assert (p.name, p.days_per_week, p.specialization, p.summary, p.confidence) == ("Bench Builder", 4, "bench", "Run this 4 days.", 0.35)
    assert out.warnings == ["programs_inferred"]
    assert normalized(spark, json.dumps({"text": body}), "https://h/program-a/x").validation_errors == ["low_quality_output", "no_programs_on_program_page"]


def test_claim_links(spark):
    programs = spark.createDataFrame([(11, 1, "Base"), (12, 1, "base ")], "id long, document_id long, name string")
    refs = [(1, "0"), (2, "1"), (3, "2"), (4, "999"), (5, " BASE"), (6, None), (7, "none"), (8, "-1")]
    claims = spark.createDataFrame([(i, 1, r) for i, r in refs], "id long, document_id long, raw_ref string")
    got = {r.id: r.program_id for r in N.link_claims(claims, programs).collect()}
    assert got == {1: 11, 2: 12, 3: 12, 4: None, 5: 12, 6: None, 7: None, 8: None}


def ranked(spark, grades, q=1):
    return spark.createDataFrame([(q, i + 1, g) for i, g in enumerate(grades)], "query_id long, rank long, relevance long")


def test_metrics(spark):
    rows = ranked(spark, [0, 3, 1])
    assert E.ndcg_at_k(rows, 3).first().ndcg == pytest.approx(0.6443, abs=1e-4)
    assert E.ndcg_at_k(ranked(spark, [3, 1, 0]), 3).first().ndcg == 1.0
    assert E.ndcg_at_k(ranked(spark, [0, 0, 0]), 3).first().ndcg == 0.0
    assert E.precision_at_k(ranked(spark, [0, 3, 1, 0, 2]), 10).first().precision == 0.3
    assert E.reciprocal_rank(rows).first().reciprocal_rank == 0.5
    none = spark.createDataFrame([(1, 0)], "query_id long, total_relevant long")
    assert E.recall_at_k(rows, none, 3).first().recall == 0.0


@pytest.mark.parametrize("n, want", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (20, (14, 3, 3))])
def test_split_sizes(spark, n, want):
    rows = L.query_splits(spark.range(n).withColumnRenamed("id", "query_id")).groupBy("split").count().collect()
    sizes = {r.split: r["count"] for r in rows}
    assert tuple(sizes.get(s, 0) for s in ("train", "validation", "test")) == want


def test_ledger_lines(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.txt").write_text('{"run_id":"r1","completed_at":"2024-01-01"}\n\nbroken\n[1]\n{"run_id":"r2","completed_at":"2024-01-02"}\n')
    assert [r.run_id for r in LE.read_recent(spark, str(path), 1).collect()] == ["r2"]
    assert LE.read_recent(spark, str(path), 0).count() == 0


def test_artifact_tree(spark, tmp_path):
    leaf = tmp_path / "sources" / "7" / "crawls" / "9"
    leaf.mkdir(parents=True)
    (leaf / "raw.html").write_text("<p>\nx</p>")
    (leaf / "extracted.json").write_text("{}")
    got = {(r.source_id, r.crawl_id, r.kind): r.body for r in AR.read_tree(spark, str(tmp_path)).collect()}
    assert got == {(7, 9, "html"): "<p>\nx</p>", (7, 9, "json"): "{}"}


def test_payload_days(spark):
    def days(j):
        return one(spark, j, lambda c: P.days_per_week(P.field(F.try_parse_json(c), "d")))

    assert [days(f'{{"d":{x}}}') for x in ("4", "true", "false", "4.0", '"4 days"', "0", "15", "null")] == [4, 1, None, None, 4, None, None, None]
