"""Inputs that the registered fixtures don't hold: absent text, empty filters, deep nesting, busy keys."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import functions as F

from quarrylight.operators import discovery as D
from quarrylight.operators import retrieve as R
from quarrylight.streaming.limits import admitted, rate_limit, two_key_limit


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query string, days_per_week long, specialization string, experience_level string, progression_type string, split_type string, domain string")


def test_absent_text_and_empty_filters_browse(spark, corpus):
    blank, absent = (1, "", None, None, None, None, None, None), (2, None, None, "", "", "", "", None)
    requests = asked(spark, [blank, absent])
    for rows, item in ((R.search_programs(requests, corpus, 5), "program_id"), (R.search_sources(requests, corpus, 5), "source_id")):
        found = {q: [r[item] for r in sorted(rows.where(F.col("query_id") == q).collect(), key=lambda r: r["rank"])] for q in (1, 2)}
        assert len(found[1]) == 5 and found[1] == found[2]


def test_urls_at_any_depth(spark):
    rows = []
    for depth in (1, 4, 5, 12, 300, 5000):
        value = f'"see https://a.example/{depth}"'
        rows.append((depth, "[" * depth + value + "]" * depth))
    text = json.dumps({"links": [json.dumps({"urls": [[[[[[["http://b.example/x"]]]]]]]})], "urls": "http://b.example/first", "other": "http://no.example"})
    rows += [(7, text), (8, None), (9, ""), (10, "[broken https://c.example/y")]
    found = {}
    for r in sorted(D.extract_candidates(spark.createDataFrame(rows, "key long, output string"), "key").collect(), key=lambda r: r["pos"]):
        found.setdefault(r["key"], []).append(r["canonical_url"])
    assert {k: v for k, v in found.items() if k in (1, 4, 5, 12, 300, 5000)} == {d: [f"https://a.example/{d}"] for d in (1, 4, 5, 12, 300, 5000)}
    assert found[7] == ["http://b.example/first", "http://b.example/x"] and found[10] == ["https://c.example/y"]
    assert 8 not in found and 9 not in found


def plain_limit(times, window, most):
    """Every request against all accepted ones."""
    accepted, out = [], []
    for at in times:
        open_ = [t for t in accepted if t >= at - window]
        out.append(len(open_) < most)
        if out[-1]:
            accepted.append(at)
    return out


def test_admission_in_any_cut():
    draw = random.Random(4)
    for window, most in ((10, 3), (5, 1), (60, 20)):
        times = np.array(sorted(draw.choice((draw.uniform(0, 300), float(draw.randrange(300)))) for _ in range(400)))
        wanted = plain_limit(times, window, most)
        for step in (1, 7, 400):
            recent, got = np.zeros(0), []
            for at in range(0, 400, step):
                accepted, wait, recent = admitted(times[at : at + step], recent, window, most)
                got += accepted.tolist()
                assert ((wait >= 1) == ~accepted).all() and (wait <= window).all() and len(recent) <= most
            assert got == wanted


def test_one_busy_key(spark):
    times = [i * 0.05 for i in range(4000)]
    rows = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)] + [(None, 1.0, 5000)], "key string, at double, request_id long")
    got = {r["request_id"]: r["accepted"] for r in rate_limit(rows, 10, 3, slice_seconds=25).where("key IS NOT NULL").collect()}
    assert [got[i] for i in range(4000)] == plain_limit(times, 10, 3)


def test_address_before_user(spark):
    rows = [(i, "ip1" if i % 2 else "ip2", f"u{i % 3}", float(i)) for i in range(60)]
    found = {r["request_id"]: (r["accepted"], r["limited_by"]) for r in two_key_limit(spark.createDataFrame(rows, "request_id long, ip string, user string, at double"), 10, 2, 1).collect()}
    by_ip = {ip: dict(zip([r[0] for r in rows if r[1] == ip], plain_limit([r[3] for r in rows if r[1] == ip], 10, 2), strict=True)) for ip in ("ip1", "ip2")}
    passed = [r for r in rows if by_ip[r[1]][r[0]]]
    by_user = {}
    for u in ("u0", "u1", "u2"):
        own = [r for r in passed if r[2] == u]
        by_user |= dict(zip([r[0] for r in own], plain_limit([r[3] for r in own], 10, 1), strict=True))
    assert found == {r[0]: (by_user.get(r[0], False), "ip" if not by_ip[r[1]][r[0]] else None if by_user[r[0]] else "user") for r in rows}


def test_tables_are_found_again_and_renewed(spark, tmp_path):
    """Another start reads what is there; other input files get other tables."""
    from quarrylight.sources import corpus as C

    folder = str(tmp_path / "in")
    pages = spark.createDataFrame([(i, f"https://a{i}.example/x", "") for i in range(5)], "page_id long, url string, html string")
    pages.write.parquet(f"{folder}/pages.parquet")
    first = C.Corpus(spark, folder)
    assert first.page_urls.count() == 5
    C._WRITTEN.clear()
    again, built = C.Corpus(spark, folder), []
    assert again.home == first.home and again.keep("page_urls", lambda: built.append(1)).count() == 5 and not built
    pages.withColumn("page_id", F.col("page_id") + 100).write.mode("append").parquet(f"{folder}/pages.parquet")
    changed = C.Corpus(spark, folder)
    assert changed.home != first.home and changed.page_urls.count() == 10
