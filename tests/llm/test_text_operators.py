"""Near-dedup, substring dedup, packing and pieces against plain versions."""

from __future__ import annotations

import hashlib
import zlib

import cases
import numpy as np
import pytest

from quarrylight.llm import near_dedup, packing, substring_dedup
from quarrylight.llm.catalog import tokenizer
from quarrylight.llm.common import Scratch, WordCodes
from quarrylight.llm.components import components
from quarrylight.llm.near_dedup import near_duplicates, one_of_each
from quarrylight.llm.packing import hilbert_keys, pack
from quarrylight.llm.pieces import Pieces, encode_documents
from quarrylight.llm.substring_dedup import judge_repeats, remove_repeats


def words(text):
    return text.encode().split() if text else []


def plain_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        found = [w.lower() for w in words(text)]
        if i is not None:
            sets[i] = {tuple(found[k : k + size]) for k in range(len(found) - size + 1)} or ({tuple(found)} if found else set())
    head = {i: i for i in sets}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = cases.texts()
    found = near_duplicates(cases.documents(spark, rows), shingle_words=size).collect()
    assert len(found) == len(rows)
    wanted = plain_components(rows, size, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None} == wanted
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)] * 2


def test_links_within_a_family(spark, monkeypatch):
    """Members that their smallest one isn't near to still find each other, over several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(25):
        changed = list(base)
        for k in range(i * 2, i * 2 + 3):
            changed[k % 60] = f"c{i // 3}_{k}"
        rows.append((i + 1, " ".join(changed)))
    found = near_duplicates(cases.documents(spark, rows), shingle_words=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == plain_components(rows, 2, 80)


def test_one_of_each(spark):
    docs = cases.documents(spark)
    out = one_of_each(docs, shingle_words=5)
    assert out.columns == docs.columns
    kept = plain_components(cases.texts(), 5, 80)
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, x in kept.items() if x[2])
    assert ids.count(None) == 2
    assert one_of_each(cases.empty(spark)).count() == 0 and near_duplicates(cases.empty(spark)).count() == 0


def test_min_max_values_estimate_similarity():
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 2**63, 1250, np.uint64)
    a, b = near_dedup._multipliers(400)
    one, other = np.sort(pool[:1000]), np.sort(pool[250:])

    def values(x):
        hashed = x[:, None] * a + b
        return np.concatenate([hashed.min(axis=0), hashed.max(axis=0)])

    assert abs((values(one) == values(other)).mean() - 750 / 1250) < 0.06
    assert np.array_equal(near_dedup.bands_of(one, a[:120], b[:120], 40), near_dedup.bands_of(one.copy(), a[:120], b[:120], 40))


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(160, 159), (7, 7)]
    found = dict(components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test"), "t").collect())
    assert {i: found.get(i, i) for i in range(1, 41)} == {i: 1 for i in range(1, 41)}
    assert {found.get(i, i) for i in range(100, 161)} == {100}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test"), "t").count() == 0


def plain_repeats(rows, window):
    seen, out = set(), {}
    done = set()
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        found = words(text)
        if i in done:
            continue
        done.add(i)
        gone = [False] * len(found)
        for s in range(len(found) - window + 1):
            run = tuple(found[s : s + window])
            if run in seen:
                gone[s : s + window] = [True] * window
            seen.add(run)
        kept = [w for w, g in zip(found, gone, strict=True) if not g]
        out[i] = len(found), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()
    return out


def test_repeats(spark):
    rows = cases.texts()
    found = judge_repeats(cases.documents(spark, rows), window=20).collect()
    assert len(found) == len(rows)
    wanted = plain_repeats(rows, 20)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found if r["doc_id"] is not None} == {i: x[:3] for i, x in wanted.items()}
    assert sorted((r["n_words"], r["n_removed"]) for r in found if r["doc_id"] is None) == [(0, 0), (len(cases.BASE), 0)]


@pytest.mark.parametrize("slice_bytes", [200, 1 << 22])
def test_repeats_over_slices(spark, monkeypatch, slice_bytes):
    """A passage in most documents, whichever rows are taken up together."""
    monkeypatch.setattr(substring_dedup.common, "SLICE_BYTES", slice_bytes)
    passage = cases.sentence(9, 30)
    rows = [(i, f"{cases.sentence(300 + i, i % 25)} {passage} {cases.sentence(600 + i, 5)}") for i in range(60)]
    found = judge_repeats(cases.documents(spark, rows, partitions=5), window=20).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == {i: x[:3] for i, x in plain_repeats(rows, 20).items()}


def test_repeats_of_wide_ids(spark):
    """Ids beyond 2^31 either way, as hashed ones are; some are equal in their low 32 bits."""
    passage = cases.sentence(90, 45)
    ids = [-(1 << 63), -(1 << 40) - 9, -(1 << 31) - 1, 4, (1 << 31) + 4, (1 << 32) + 4, (1 << 40) + 4, (1 << 41) + 9, (1 << 63) - 1]
    rows = [(i, f"{cases.sentence(60 + k, 5 + 3 * k)} {passage} {cases.sentence(80 + k, 30)}") for k, i in enumerate(ids)]
    docs = cases.documents(spark, rows, partitions=1)
    wanted = plain_repeats(rows, 20)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in judge_repeats(docs, window=20).collect()} == {i: x[:3] for i, x in wanted.items()}
    assert sum(x[1] for x in wanted.values()) == 45 * (len(ids) - 1)


def test_remove_repeats(spark):
    rows = cases.texts()
    docs = cases.documents(spark, rows)
    out = remove_repeats(docs, window=20)
    assert out.columns == docs.columns
    texts, wanted = dict(rows), plain_repeats(rows, 20)
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            cut = wanted[r["doc_id"]]
            assert r["text"] == (cut[3] if cut[1] else texts[r["doc_id"]])
    assert remove_repeats(cases.empty(spark)).count() == 0 and judge_repeats(cases.empty(spark)).count() == 0


def test_hilbert_curve_visits_neighbours():
    bits, axes = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(spark, size):
    from tokenizers import Tokenizer

    rows = cases.texts()
    path = tokenizer("word_bpe_49k.json")
    found = pack(cases.documents(spark, rows), path, size=size, parts=5).collect()
    whole = Tokenizer.from_file(path)
    ids = [(i, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    assert sum(r["length"] for r in found) == sum(len(x) for _, x in ids)
    known = dict(ids)
    covered = {}
    for r in found:
        if r["doc_id"] is not None:
            piece = known[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(piece) == r["length"] and r["doc_tokens"] == len(known[r["doc_id"]])
            assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
            covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    times = {i: sum(j == i for j, _ in rows) for i in covered}
    assert covered == {i: times[i] * len(known[i]) for i in known if i is not None}
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    lengths = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        lengths.append(at)
    assert all(n == size or n < size and n & (n - 1) == 0 for n in lengths)
    assert pack(cases.empty(spark), path).count() == 0


def test_words_are_encoded_as_in_their_text():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    whole, table = Tokenizer.from_file(path), packing._WordIds(path)
    texts = ["It's a l'été İstanbul ǅ ß ﬁ x y 12,3.5!! #$% a# a#, x1, word.,; ΟΔΟΣ, ΣΑΣ. 日本語。 हिन्दी <|endoftext|>", "", "a, a", "Don't 'll", "É é."]
    for text in texts * 2:
        (ids,) = table.texts([words(text)])
        assert np.frombuffer(ids, table.kind).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces(spark):
    path = tokenizer("piece_bpe_32k.model")
    rows = cases.texts()
    found = encode_documents(cases.documents(spark, rows), path).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"] or "") for r in found) == sorted((i or 0, t or "") for i, t in rows)
    assert all((r["ids"] is None) == (r["decoded"] is None) for r in found)
    assert encode_documents(cases.empty(spark), path).count() == 0


def test_pieces_have_the_best_score():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    pieces, model = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {pieces.names[i]: model.get_score(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}

    def best(word):
        total = [0.0]
        for end in range(1, len(word) + 1):
            total.append(max([total[end - 1] + pieces.penalty] + [total[end - n] + scores[word[end - n : end]] for n in range(1, end + 1) if word[end - n : end] in scores]))
        return total[-1]

    for text in (" ".join(cases.BASE), "  two  blanks", "thhahean ntedin été", "12345"):
        word = "▁" + text.replace(" ", "▁")
        assert sum(model.get_score(int(i)) for i in pieces.encode(text)) == pytest.approx(best(word))
    assert pieces.encode("☃x").tolist()[-1] == model.piece_to_id("x") and pieces.decode(pieces.encode("☃x").tolist()) == "☃x"


def test_word_codes_stay_bounded(monkeypatch):
    from quarrylight.llm import common

    monkeypatch.setattr(common, "CACHE_ENTRIES", 5)
    codes = WordCodes()
    first = codes.of([f"w{i}".encode() for i in range(50)])
    assert len(codes) <= 5 and (first == codes.of([f"w{i}".encode() for i in range(50)])).all()
