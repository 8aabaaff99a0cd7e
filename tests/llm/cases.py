"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

BASE = "the cat sat on the mat and then it went away to find some other place where it could rest for a while in peace".split()
CLASHING = "n_words long, n_removed long, kept boolean, score double, held_out boolean, row string, id long, found string, component_id long"


def sentence(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice("alba bero cina dole ema fado giro heno ilva juno kela lumo mira nodo".split()) + str(draw.randrange(40)) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    long = sentence(1, 3000)
    passage = sentence(2, 60)
    rows: list[tuple[int | None, str | None]] = [
        (1, " ".join(BASE)), (2, " ".join(BASE)), (3, " ".join([*BASE, "now"])), (4, " ".join(BASE).upper()),
        (5, None), (6, ""), (7, " \t\n "), (8, "word"), (9, "word"), (10, "two words"), (11, "123 456 !!"),
        (12, long), (13, long + " tail"), (14, f"{sentence(3, 30)} {passage} {sentence(4, 10)}"), (15, f"{passage}\n{passage}"),
        (16, "x y " * 40), (17, "été où ça   naïve cœur ☃ 日本"), (18, "nul\x1cin side"), (19, sentence(5, 20)), (20, sentence(5, 19)),
        (None, " ".join(BASE)), (None, None), (21, sentence(6, 40)), (21, sentence(6, 40)),
    ]
    rows += [(100 + i, sentence(50 + i, 25)) for i in range(30)]
    # A group of near copies: one word of the base changed.
    for i in range(12):
        words = sentence(7, 60).split()
        words[i * 5] = f"changed{i}"
        rows.append((200 + i, " ".join(words)))
    return rows


def documents(spark, rows=None, partitions: int = 3):
    """The rows as documents with clashing extra columns."""
    rows = texts() if rows is None else rows
    names = [c.split()[0] for c in CLASHING.split(", ")]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    values = [(i, t, ("en", "fr", None)[k % 3], "src", len(t) if t is not None else None, *[None] * len(names)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(values, schema).repartition(partitions)


def empty(spark):
    return documents(spark, [])
