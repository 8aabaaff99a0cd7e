"""URL filter, media store, nearest neighbours and the learned operators."""

from __future__ import annotations

import hashlib
import math
import tarfile
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import language_id, media, mixing, quality
from quarrylight.llm.catalog import URL_ENTRIES, op1_url_filters, op4_quality_classifier, op8_language_id
from quarrylight.llm.language_id import identify
from quarrylight.llm.language_model import STRENGTH, repeated_sum, score_documents
from quarrylight.llm.media import media_columns
from quarrylight.llm.neighbours import nearest_neighbours
from quarrylight.llm.quality import fit_additive, judge_quality
from quarrylight.llm.url_filter import UrlTrie, judge_urls

# -- URL filter


def test_url_verdicts(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q#f", "http://example.net/en", "http://xexample.net/en/1", "https://net/", "https://a.net",
        "http://b.example.com/de/1", "http://example.com.evil/de/1", "http://x.org/fr/?a", "http://org/fr", "ftp://a://b.net/c", "http://é.NET/É", "x://u@h.net:80/a",
        "http://a.org/fr/\nb", "http://a.net/\x00",
    ]
    pages = spark.createDataFrame([(i, u, "r", "v", "h") for i, u in enumerate(urls)] + [(0, None, "r", "v", "h")], "page_id long, url string, rule string, verdict string, host string")
    found = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, URL_ENTRIES).collect()}
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert found[5] == ("example.net", "/en", "net/", "block")
    assert found[6] == ("xexample.net", "/en/1", "net/", "block")
    assert found[8] == ("a.net", "", None, "allow")
    assert found[9][2:] == ("example.com/de/", "block") and found[10][2] is None
    assert found[11][2:] == ("org/fr/", "allow") and found[12][2] is None
    assert found[13] == ("a:", "//b.net/c", None, "allow")
    assert found[14] == ("é.net", "/É", "net/", "block") and found[15][2] is None
    assert found[16][1] == "/fr/\nb"
    assert judge_urls(pages, URL_ENTRIES).count() == len(urls) + 1 and judge_urls(pages.limit(0), URL_ENTRIES).count() == 0


def test_trie_against_all_rules():
    entries = [("block", "a", ""), ("allow", "b.a", "/x"), ("block", "b.a", "/x/y"), ("allow", "c.b.a", "/"), ("block", "b.a", "/xy"), ("allow", "a", "/q/")]
    trie = UrlTrie(entries)
    for host in ("a", "b.a", "c.b.a", "d.c.b.a", "ba", "x", ""):
        for path in ("", "/", "/x", "/xy", "/x/y", "/x/yz/", "/q", "/q/r"):
            fits = [(len(h.split(".")), len(p), h + p, action) for action, h, p in entries if (host == h or host.endswith("." + h)) and path.startswith(p)]
            assert trie.rule(host, path) == (max(fits)[2:] if fits else None), (host, path)
    with pytest.raises(ValueError):
        UrlTrie([("block", "a", "/"), ("allow", "a", "/")])


def test_url_sql(spark, folder):
    from oracle_check import compare, duck, duck_rows, spark_rows

    from quarrylight.llm.catalog import SQL

    assert compare(spark_rows(op1_url_filters(spark, folder)), duck_rows(duck(folder), SQL["op1_url_filters"])) is None


# -- media


def test_media(spark, tmp_path):
    rows = cases.texts()
    found = media_columns(cases.documents(spark, rows), folder=str(tmp_path), shard_bytes=8000).collect()
    assert len(found) == len(rows)
    wanted = Counter()
    for i, text in rows:
        body = (text or "").encode()
        payload = body + b" " * (-len(body) % 192 if body else 192)
        wanted[i, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), media.feature_of(payload), 192, len(payload) // 192] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"], r["width"], r["height"]) for r in found) == wanted
    shards = {}
    for r in found:
        shards.setdefault(r["shard"], []).append(r)
    assert len(shards) > 1
    for path, own in shards.items():
        with tarfile.open(path.removeprefix("file://")) as tar:
            members = {m.offset_data: m for m in tar.getmembers()}
        for r in own:
            assert members[r["offset"]].size == r["media_bytes"] and members[r["offset"]].name == r["media_sha256"] + ".png"
        assert len(members) == len({r["media_sha256"] for r in own})
    assert media_columns(cases.empty(spark)).count() == 0


def test_images_are_lossless_and_standard():
    payload = bytes(range(256)) * 3
    image = media.to_image(payload)
    assert media.samples_of(image) == payload and media.header_of(image[: media.HEADER_BYTES]) == (192, 4, 8)
    with pytest.raises(ValueError):
        media.header_of(b"x" * 33)


# -- nearest neighbours


def test_neighbours(spark):
    draw = np.random.default_rng(3)
    vectors = {i: draw.standard_normal(12) * draw.uniform(0.2, 3) for i in range(600)}
    for i in range(200, 260):
        vectors[i] = vectors[200]
    rows = [(i, x.tolist(), 1, 2) for i, x in vectors.items()]
    odd = [(700, None), (720, []), (740, [0.0] * 12), (760, [float("nan")] * 12), (780, [None] + [1.0] * 11), (800, [float("inf")] * 12), (None, [1.0] * 12)]
    table = spark.createDataFrame([*rows, rows[5], *[(i, x, 1, 2) for i, x in odd]], "vec_id long, embedding array<double>, rank int, score int")
    found = nearest_neighbours(table, F.col("vec_id") % 20 == 0, k=7, block_rows=150, verify_share=0.3).collect()
    hits, by = 0, {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 600, 20))
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 8)) and q not in [r["vec_id"] for r in own]
        assert all(r["score"] == pytest.approx(float(vectors[q] @ vectors[r["vec_id"]])) for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        exact = sorted((i for i in vectors if i != q), key=lambda i: (-round(float((vectors[q] * vectors[i]).sum()), 9), i))[:7]
        hits += len(set(exact) & {r["vec_id"] for r in own})
    assert hits / (7 * len(by)) > 0.95
    few = nearest_neighbours(table.where("vec_id < 4"), F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]
    assert nearest_neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    with pytest.raises(ValueError):
        nearest_neighbours(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), F.lit(True))


@pytest.mark.parametrize("lengths", ["outlier", "log-normal", "extreme"])
def test_neighbours_of_uneven_lengths(spark, lengths):
    """Recall at the registered parameters where one vector is far longer than the others, or all lengths differ."""
    draw = np.random.default_rng(11)
    centres = draw.standard_normal((100, 64))
    vectors = centres[draw.integers(0, 100, 6000)] + 0.7 * draw.standard_normal((6000, 64))
    vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    if lengths == "outlier":
        vectors[7] *= 30
    elif lengths == "log-normal":
        vectors *= np.exp(draw.standard_normal((6000, 1)))
    else:
        vectors[7] *= 1e200
        vectors[8] *= 1e-200
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    by = {}
    for r in nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect():
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 6000, 100))
    hits = 0
    for q, own in by.items():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & {r["vec_id"] for r in own})
        assert all(r["score"] == pytest.approx(float(scores[r["vec_id"]])) for r in own)
    assert hits / (20 * len(by)) > 0.98


# -- language ID


def plain_grams(text):
    counts = Counter()
    run = ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            padded = f" {run} "
            for n in (1, 2, 3):
                counts.update(g for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) != " ")
            run = ""
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], tuple(map(ord, x[0]))))][: language_id.PROFILE], counts


@pytest.mark.parametrize("cells", [1 << 22, 1])
def test_language_profiles(spark, monkeypatch, cells):
    rows = [(i, t) for i, t in cases.texts()]
    docs = cases.documents(spark, rows)
    training, langs = {}, {}
    for k, (i, t) in enumerate(rows):
        lang = ("en", "fr", None)[k % 3]
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 0 and lang and t is not None:
            training.setdefault(lang, Counter()).update(plain_grams(t)[1])
    for lang, counts in training.items():
        langs[lang] = {g: n for n, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], tuple(map(ord, x[0]))))[: language_id.PROFILE])}

    def judged(text):
        own, _ = plain_grams(text)
        if not own:
            return "und", 0.0
        far = {lang: sum(abs(ranks[g] - n) if g in ranks else language_id.PROFILE for n, g in enumerate(own)) for lang, ranks in langs.items()}
        best = min(sorted(far), key=far.get)
        return best, 1 - far[best] / (language_id.PROFILE * len(own))

    found = identify(docs).collect()
    assert len(found) == len(rows)
    wanted = Counter((i, i is None or zlib.crc32(str(i).encode()) % 5 == 0, judged(t)[0], round(judged(t)[1], 9)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in found) == wanted
    monkeypatch.setattr(language_id, "_CELLS", cells)
    grams = language_id.Grams([t.encode() if t else None for _, t in rows])
    for k, (_, t) in enumerate(rows):
        counts = {int(grams.codes[n]): int(c) for n, c in enumerate(grams.counts(k)) if c}
        assert counts == {sum(ord(c) << 21 * (2 - j) for j, c in enumerate(g)): n for g, n in plain_grams(t)[1].items()}
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify(cases.empty(spark)).count() == 0


def test_held_out_languages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = op8_language_id(spark, folder).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


# -- quality


def test_additive_model_learns_a_pair():
    draw = np.random.default_rng(5)
    x = draw.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_additive(x, y)
    assert (0, 1) in model.pairs
    assert ((model.scores(x) > 0.5) == (y == 1)).mean() > 0.9
    one = model.base + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(model.edges, model.tables, x[7], strict=True))
    one += sum(t[np.searchsorted(model.coarse[i], x[7, i], "right"), np.searchsorted(model.coarse[j], x[7, j], "right")] for (i, j), t in model.pairs.items())
    assert model.scores(x[7:8])[0] == pytest.approx(1 / (1 + math.exp(-one)))
    assert fit_additive(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5] and (fit_additive(x, y * 0 + 1).scores(x[:2]) > 0.5).all()


def test_quality(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op4_quality_classifier(spark, folder).join(labels, "doc_id").collect()
    for held in (True, False):
        own = [r for r in rows if r["held_out"] == held]
        assert np.mean([r["predicted"] == r["quality"] for r in own]) > 0.93
    docs = cases.documents(spark)
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 5), (4, 1)], "doc_id long, quality int")
    found = judge_quality(docs, odd).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in judge_quality(docs, odd.limit(0)).collect()} == {0.5}
    assert judge_quality(cases.empty(spark), odd).count() == 0


def test_features_are_defined():
    for _, text in cases.texts():
        found = quality.features(text.encode() if text is not None else None, quality.WordCodes())
        assert len(found) == len(quality.FEATURES) and np.isfinite(found).all()


# -- language model


def test_lm_base_and_counts(spark):
    rows = cases.texts()
    found = score_documents(cases.documents(spark, rows), head_words=20).collect()
    assert len(found) == len(rows)
    counts = Counter()
    tokens = {i: [w.lower() for w in (t or "").encode().split()] + [b""] for i, t in rows}
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    for r in found:
        if r["doc_id"] is not None:
            own = tokens[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert r["score"] < 0 and r["bits_per_byte"] > 0
    whole = {r["doc_id"]: r["score"] for r in score_documents(cases.documents(spark, rows), head_words=10_000).collect()}
    assert all(r["score"] == pytest.approx(whole[r["doc_id"]], rel=1e-4) for r in found if r["doc_id"] is not None)
    assert score_documents(cases.empty(spark)).count() == 0


def test_spelling_probabilities_add_up():
    """Over all next bytes after a beginning the probabilities of the decisions sum to one."""
    counts = np.zeros(mixing.COUNTS, np.float32)
    words = [b"the", b"then", b"cat", b""]
    mixing.add_counts(counts, words, np.array([[5.0, 1], [2, 0], [1, 3], [4, 4]]))
    model = mixing.MixedModel.new(counts)
    model.learn(words * 3, np.array([0, 1] * 6), np.ones(12))
    begun = model.log10([b"th" + bytes([c]) for c in range(256) if c != 32], 2) - model.log10([b"th"], 2)
    del begun
    total = np.zeros(2)
    spelling = mixing.Spellings([bytes([c]) for c in range(256)])
    assert spelling.words == 256
    first = [w for w in (bytes([c]) for c in range(256))]
    for c, row in zip(range(256), model.log10(first, 2), strict=True):
        total += 10 ** (row - _last_byte(model, first[c]))
    assert total == pytest.approx(np.ones(2), abs=1e-6)


def _last_byte(model, word):
    """log10 of the blank after the word: what its last byte's decisions cost."""
    spelling = mixing.Spellings([word])
    last = np.array([i for i, b in zip(spelling.step, mixing.spelled(word), strict=True)][-1:])
    inputs, gates = model._tables()
    out = np.zeros(2)
    for cells, bit in spelling.bits():
        for g in range(2):
            found = [inputs[cells(c, g)][last][0] for c in range(len(mixing.TABLES))]
            gate = gates[cells(len(mixing.TABLES) - 1, g)[last] - mixing.OFFSETS[-2]][0]
            mix = float(model.weights[gate, -1] + sum(w * x for w, x in zip(model.weights[gate], found, strict=False)))
            seen = model._refine(np.array([mix]), spelling.last[last])[2][0]
            plain = 1 / (1 + math.exp(-mix))
            p = plain if abs(mix) >= mixing.LIMIT else (1 - mixing.REFINED_SHARE) * plain + mixing.REFINED_SHARE * seen
            out[g] += math.log10(p if bit[last][0] else 1 - p)
    return out


def test_refined_sum():
    logs = np.log10([[0.1, 0.2], [0.01, 0.3]])
    found = repeated_sum(np.array([3, 1]), logs)
    for w, times in enumerate((3, 1)):
        for g in range(2):
            assert found[w, g] == pytest.approx(sum(math.log10(j + STRENGTH * 10 ** logs[w, g]) for j in range(times)))


def test_lm_beats_its_base_on_held_out_texts(spark):
    held = score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
