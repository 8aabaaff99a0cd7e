"""Token ids of words, also of those that a task has no lasting room for."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from quarrylight.llm import packing as P


@pytest.mark.parametrize("room", [0, 40, 100_000])
def test_word_ids_with_little_room(monkeypatch, room):
    monkeypatch.setattr(P, "HELD_WORDS", room)
    table = P._WordIds(str(public_tokenizers.path("word_bpe_49k.json")))
    for low in (0, 50, 0):
        texts = [" ".join(f"word{i * k} Stem{i}, é{k}!" for i in range(30)) for k in range(low, low + 20)] + [""]
        got = table.texts([x.encode().split() for x in texts])
        for text, ids in zip(texts, got, strict=True):
            want = table.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, table.kind).tolist() == want


def test_distinct_words_are_looked_for_once():
    """What a slice repeats is looked for once; no word is asked for by ``get``."""
    table, asked = P._WordIds(str(public_tokenizers.path("word_bpe_49k.json"))), []
    table.texts([[b"one", b"two"]])
    table.get = lambda *x: asked.append(x)
    table.texts([[b"one", b"two"] * 100])
    assert not asked
