"""The conversation trie, fuzzy fingerprints and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylight.llm import fuzzy_dedup, prefix_trie, variants
from quarrylight.llm.common import Scratch
from quarrylight.llm.components import components
from quarrylight.llm.fuzzy_dedup import fingerprint_links, fuzzy_duplicates, segment_keys
from quarrylight.llm.golay import codeword_index, fuzzy_keys
from quarrylight.llm.prefix_trie import conversation_trie, end_digests, insert_all, two_fattest
from quarrylight.llm.variants import group_variants, near_words, neighbour_codes, symbol_of


def joined(links):
    """id -> smallest id reachable."""
    head: dict = {}

    def root(i):
        while head.setdefault(i, i) != i:
            i = head[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        head[y] = x
    return root


# SimHash and Golay keys


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)
    assert (np.bincount(codeword_index(words)) == 2048).all()


@pytest.mark.parametrize("width", [21, 22, 23])
def test_words_within_two_bits_share_a_key(width):
    draw = np.random.default_rng(width)
    a = draw.integers(0, 1 << width, 3000, dtype=np.uint32)
    b = a.copy()
    for _ in range(2):
        b ^= np.left_shift(1, draw.integers(0, width, len(a))).astype(np.uint32)
    keys = [defaultdict(set), defaultdict(set)]
    for held, words in zip(keys, (a, b), strict=True):
        for row, key in zip(*fuzzy_keys(words, width), strict=True):
            held[row].add(key)
    assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


def test_fingerprints_within_two_bits_share_a_key():
    draw = random.Random(5)
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for _ in range(2):
            b ^= 1 << draw.randrange(64)
        rows, keys = segment_keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


@pytest.mark.parametrize("compared", [1, 3, 32])
def test_fingerprint_links(spark, monkeypatch, compared):
    """Small and large buckets link the same fingerprints: clusters, chains of two-bit steps and lone ones."""
    monkeypatch.setattr(fuzzy_dedup, "COMPARED", compared)
    draw, bits = random.Random(1), {0, 2**64 - 1, 1, 2**63}
    for _ in range(6):
        at = draw.getrandbits(64)
        for _ in range(25):
            bits.add(at)
            at ^= 1 << draw.randrange(64) | 1 << draw.randrange(64) if draw.random() < 0.8 else draw.getrandbits(8)
        base = draw.getrandbits(64)
        bits |= {base ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for _ in range(30)}
    rows = [(b - 2**64 if b >= 2**63 else b, k + 1) for k, b in enumerate(sorted(bits))]
    scratch = Scratch(spark, "test")
    links = fingerprint_links(spark.createDataFrame(rows, "bits long, class long").repartition(5), scratch)
    found = {r["node"]: r["component"] for r in components(links, scratch, "links").collect()}
    root = joined((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 2)
    assert {c: found.get(c, c) for _, c in rows} == {c: root(c) for _, c in rows}


def plain_fingerprint(text):
    found = text.encode().lower().split() if text else []
    shingles = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("partitions", [1, 7])
def test_fuzzy_duplicates(spark, partitions):
    rows = [*cases.texts(), (3, None), (2**41, "word"), (2**41, "another text of several words")]
    found = fuzzy_duplicates(cases.documents(spark, rows, partitions)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    named = [p for p in prints if p[0] is not None]
    root = joined([(a, b) for a, x in named for b, y in named if (x ^ y).bit_count() <= 2])
    wanted = sorted((str(i), f"{p:016x}", str(root(i) if i is not None else None)) for i, p in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == wanted


def test_fingerprint_over_runs(monkeypatch):
    monkeypatch.setattr(fuzzy_dedup, "RUN", 7)
    text = cases.sentence(4, 100)
    assert fuzzy_dedup.fingerprint(text.encode(), 3) == plain_fingerprint(text)


def test_no_documents_to_fingerprint(spark):
    assert fuzzy_duplicates(cases.empty(spark)).collect() == []


# Spelling variants


def plain_variants(rows):
    counts: Counter = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out, form = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(around), words[form[w]] if form[w] else None)
    for w in out:
        at = w
        while form[at]:
            at = form[at]
        out[w] = (form[w], at, *out[w])
    return out


def variant_texts():
    draw = random.Random(9)
    base = ["garden", "gardens", "fjärran", "ÉTUDES", "spelling", "aaaaa", "bananas", "x" * 400]
    rows = cases.texts()
    for k in range(160):
        found = []
        for _ in range(30):
            w = draw.choice(base)
            if draw.random() < 0.5:
                at = draw.randrange(len(w) + 1)
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("aexé÷") + w[at:], w[:at] + draw.choice("aexZ") + w[at + 1 :]])
            found.append(w)
        rows.append((1000 + k, draw.choice([" ", "\n", "-", "ſ", "日"]).join(found)))
    return rows


@pytest.mark.parametrize("symbols", [2, variants.SYMBOLS])
def test_variants(spark, symbols):
    rows = variant_texts()
    found = group_variants(cases.documents(spark, rows), symbols=symbols).collect()
    assert {r["word"]: tuple(r)[1:] for r in found} == plain_variants(rows)
    assert len(found) == len({r["word"] for r in found}) > 60


def test_variants_when_counts_are_passed_on_early(spark, monkeypatch):
    monkeypatch.setattr(variants, "COUNTED", 10)
    monkeypatch.setattr(variants, "MADE", 50)
    rows = variant_texts()
    batches = [b for b in variants._counted(iter(cases.documents(spark, rows, 1).selectExpr("cast(doc_id as string) id", "text").toArrow().to_batches()), 5)]
    assert len(batches) > 10
    counts: Counter = Counter()
    for b in batches:
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
            counts[w] += n
    assert {w: n for w, n in counts.items() if n >= 3} == {w: v[2] for w, v in plain_variants(rows).items()}


def test_neighbourhood_holds_every_edit():
    symbols, word = 3, [1, 2, 2, 3, 1]

    def code(letters):
        return int(neighbour_codes(np.array([letters], np.uint8), symbols)[0, 0])

    edits = [word[:i] + word[i + 1 :] for i in range(5)] + [word[:i] + [s] + word[i + 1 :] for i in range(5) for s in (1, 2, 3)]
    edits += [word[:i] + [s] + word[i:] for i in range(6) for s in (1, 2, 3)]
    assert {int(c) for c in neighbour_codes(np.array([word], np.uint8), symbols)[0]} == {code(e) for e in [word, *edits]}


def test_long_chain_of_forms(spark):
    """Each word is twice as frequent as the one before and one edit away; roots are found by doubled paths."""
    chain = ["a" * 5 + "b" * k for k in range(12)]
    rows = spark.createDataFrame([(w, v) for w, v in zip(chain, [*chain[1:], None], strict=True)], "word string, form string")
    found = {r["word"]: r["root"] for r in variants.roots(rows, Scratch(spark, "test")).collect()}
    assert found == dict.fromkeys(chain[:-1], chain[-1])


def test_words_behind_one_reduced_word(spark):
    """Many words of one reduced form: pairs are those one edit apart, once each."""
    alike = [chr(c) for c in range(97, 123) if symbol_of(c, 2) == symbol_of(97, 2)]
    words = sorted({"".join(random.Random(k).choices(alike, k=5)) for k in range(300)})
    pairs = near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), Scratch(spark, "test"), symbols=2).collect()
    wanted = {(a, b) for a in words for b in words if a < b and sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    assert sorted((p["u"], p["v"]) for p in pairs) == sorted(wanted)


def test_no_words(spark):
    assert group_variants(cases.empty(spark)).collect() == []
    assert group_variants(cases.documents(spark, [(1, None), (2, ""), (3, "a b c"), (None, "12345")])).collect() == []
    with pytest.raises(ValueError):
        group_variants(cases.empty(spark), least_ratio=1)


# The conversation trie


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    turns = {c: [(role, text) for _, _, role, _, text in sorted(own)] for c, own in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members, below = defaultdict(list), defaultdict(list)
    for c, way in made.items():
        for d in range(len(way) + 1):
            members[way[:d]].append(c)
    for way in members:
        if way:
            below[way[:-1]].append(way)
    leaves, saved, out = {}, {}, []
    for way in sorted(members, key=len, reverse=True):
        n = len(members[way])
        leaves[way] = sum(leaves[w] for w in below[way]) or 1
        saved[way] = (n - 1) * (len(way[-1][1].encode().split()) if way else 0) + sum(saved[w] for w in below[way])
        ends = ",".join(str(c) for c in sorted(members[way]) if len(made[c]) == len(way))
        parent = min(members[way[:-1]]) if way else None
        out.append((min(members[way]), len(way), parent, n, len(below[way]), leaves[way], saved[way], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk():
    draw, rows = random.Random(3), []
    for c in range(200, 260):
        for t in range(draw.randrange(0, 7)):
            rows.append((c, t, draw.choice(["user", "bot"]), draw.choice(["x", "y z", "", " ", "uné  deux\n", "a\x1cb"])))
    long = [(t, "user", f"w{t} x") for t in range(40)]
    for c in range(1000, 1060):
        if zlib.crc32(str(c).encode()) % 4 == 0:
            rows += [(c, *turn) for turn in long[: draw.randrange(1, 40)]]
    for c in range(2000, 2060):
        rows += [(c, 0, "user", "same"), (c, 1, "bot", "same too")]
    rows += [(None, 1, "user", "x"), (7, None, None, None), (7, None, "user", "q"), (7, 3, "user", None), (7, 3, "user", None), (-5, 1, "user", "below"), (-20, 1, "user", "below")]
    return [*rows, (9, 0, "user", "lone"), (2**40, 0, "user", "word " * 30_000), (2**40 + 1, 0, "user", "word " * 30_000)]


def conversations(spark, rows, partitions=3):
    extra = "n_convs long, depth long, code string, seq long, low int, path string"
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], f"conv_id long, turn long, role string, text string, {extra}").repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 7])
def test_conversation_trie(spark, monkeypatch, partitions):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 32)
    rows = talk()
    assert sorted((tuple(r) for r in conversation_trie(conversations(spark, rows, partitions)).collect()), key=str) == plain_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(9, 0, "user", "x")], [(4, 0, "user", "x"), (5, 0, "user", "x")]])
def test_small_tries(spark, rows):
    assert sorted((tuple(r) for r in conversation_trie(conversations(spark, rows, 1)).collect()), key=str) == plain_trie(rows)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(70) for b in range(a + 1, 70)]
    found = spark.createDataFrame(pairs, "a int, b int").select("a", "b", two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda f: f & -f) for r in found)


def test_insertion_into_a_trie(spark):
    """A trie made in one call is the one made by inserting the second half into that of the first; nodes are branches and ends."""
    draw = random.Random(11)
    ways = sorted({tuple(draw.choice("ab") for _ in range(draw.randrange(1, 30))) for _ in range(120)})

    def codes(way):
        return ["".join(way[: d + 1]).encode() for d in range(len(way))]

    def table(some):
        return spark.createDataFrame([(k, codes(w), [1] * len(w)) for k, w in some], "seq long, codes array<binary>, words array<long>").repartition(3)

    numbered = list(enumerate(ways))
    random.Random(2).shuffle(numbered)
    first = insert_all(table(numbered[:60]), Scratch(spark, "test"))
    both = insert_all(table(numbered[60:]), Scratch(spark, "test"), first)
    whole = insert_all(table(numbered), Scratch(spark, "test"))
    found = [sorted((bytes(r["code"]), r["low"], r["high"], [bytes(c) for c in r["path"]]) for r in t.collect()) for t in (both, whole)]
    prefixes = {w[:d] for w in ways for d in range(1, len(w) + 1)}
    nodes = {p for p in prefixes if p in set(ways) or sum((*p, c) in prefixes for c in "ab") > 1}
    assert found[0] == found[1]
    assert {c for c, *_ in found[0]} == {"".join(p).encode() for p in nodes}
    assert all(path[-1] == code and len(path) == high - low for code, low, high, path in found[0])


def test_digest_of_a_crowded_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 100)
    ids = list(range(-50, 3000, 7))
    members = spark.createDataFrame([(b"k", i) for i in ids] + [(b"l", 3), (b"m", 4)], "last binary, conv_id long").repartition(6)
    ends = spark.createDataFrame([(b"k", -50, len(ids)), (b"l", 3, 1), (b"m", 4, 1)], "last binary, seq long, n long")
    found = {bytes(r["code"]): r["sha"] for r in end_digests(members, ends).collect()}
    assert found == {b"k": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"l": hashlib.sha256(b"3").hexdigest(), b"m": hashlib.sha256(b"4").hexdigest()}
