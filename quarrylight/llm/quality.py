"""Text quality by a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles of the training rows. Boosting goes
round the features in turn, each time adding a small tree over one feature's
bins to that feature's table; then the pairs of features that explain most of
what is left get tables of their own in the same way. A text's score is the
logistic of the sum of one table entry for each feature and pair.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import common
from quarrylight.llm.common import WordCodes, bounded_batches, sequence_codes

#: Labelled rows that are fitted on, about; of more, so many are drawn by a hash of the id.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 32, 8, 6, 200, 80, 0.1, 5.0

FEATURES = (
    "chars", "words", "word_length", "upper", "digits", "marks", "symbols", "bars", "shouts", "wide", "distinct_words",
    "repeated_next", "top_word", "distinct_fours", "words_per_line", "distinct_lines", "stopped_lines", "capital_words",
)
_LOWER, _UPPER, _DIGIT, _MARK, _SYMBOL, _BAR, _SHOUT, _WIDE, _SPACE = range(9)
_KINDS = np.full(256, _MARK, np.uint8)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = _LOWER, _UPPER, _DIGIT, _WIDE
for _chars, _kind in ((b"#$%&*@~^_=+<>\\/{}[]", _SYMBOL), (b"|", _BAR), (b"!", _SHOUT), (bytes(range(33)) + b"\x7f", _SPACE)):
    _KINDS[list(_chars)] = _kind


def features(text: bytes | None, known: WordCodes) -> list[float]:
    """What ``FEATURES`` names, of a whole text; all zero for a text that is null or has no words."""
    found = common.words(text)
    if not found:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=9)
    inked = len(text) - kinds[_SPACE]
    codes = known.of(found)
    _, counts = np.unique(codes, return_counts=True)
    fours = sequence_codes(codes, 4) if len(codes) >= 4 else codes
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(len(text)), np.log1p(len(found)), inked / len(found),
        kinds[_UPPER] / max(1, kinds[_UPPER] + kinds[_LOWER]), kinds[_DIGIT] / inked, kinds[_MARK] / inked, kinds[_SYMBOL] / inked,
        kinds[_BAR] / inked, kinds[_SHOUT] / inked, kinds[_WIDE] / inked,
        len(counts) / len(found), float((codes[1:] == codes[:-1]).mean()) if len(codes) > 1 else 0.0, counts.max() / len(found),
        len(np.unique(fours)) / len(fours), np.log1p(len(found) / len(lines)), len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"?") for x in lines) / len(lines), sum(w[:1].isupper() for w in found) / len(found),
    ]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A step for each bin of a greedy tree with so many leaves over ordered bins with gradient g and weight h."""
    edges = [0, len(g)]
    total_g, total_h = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def worth(low: int, high: int) -> float:
        return (total_g[high] - total_g[low]) ** 2 / (total_h[high] - total_h[low] + SMOOTH)

    while len(edges) <= leaves:
        gains = [
            (worth(low, cut) + worth(cut, high) - worth(low, high), -cut)
            for low, high in zip(edges, edges[1:], strict=False) for cut in range(low + 1, high)
        ]
        if not gains or max(gains)[0] <= 0:
            break
        edges = sorted([*edges, -max(gains)[1]])
    step = np.zeros(len(g))
    for low, high in zip(edges, edges[1:], strict=False):
        step[low:high] = (total_g[high] - total_g[low]) / (total_h[high] - total_h[low] + SMOOTH)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A step for each cell of a tree that splits the first feature once and then each side on the second."""
    best, step = -1.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        sides = [_tree(g[:cut].sum(axis=0), h[:cut].sum(axis=0), 2), _tree(g[cut:].sum(axis=0), h[cut:].sum(axis=0), 2)]
        here = np.vstack([np.tile(sides[0], (cut, 1)), np.tile(sides[1], (len(g) - cut, 1))])
        gain = float((here * g).sum())
        if gain > best:
            best, step = gain, here
    return step


@dataclass
class AdditiveModel:
    """Lookup tables: one per feature over its bins, one per pair over the bins of both."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The score of each row of features, between 0 and 1."""
        total = np.full(len(x), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, i], "right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model for rows of features and labels 0 or 1; without both labels, the constant that was seen (0.5 without any)."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model

    def cuts(column: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))

    count = x.shape[1]
    model.edges, model.coarse = [cuts(x[:, i], BINS) for i in range(count)], [cuts(x[:, i], PAIR_BINS) for i in range(count)]
    binned = [np.searchsorted(model.edges[i], x[:, i], "right") for i in range(count)]
    coarse = [np.searchsorted(model.coarse[i], x[:, i], "right") for i in range(count)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(count):
            g, h = slopes()
            size = len(model.tables[i])
            step = RATE * _tree(np.bincount(binned[i], g, size), np.bincount(binned[i], h, size), 3)
            model.tables[i] += step
            total += step[binned[i]]

    def cells(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = []
    for i in range(count):
        for j in range(i + 1, count):
            step = _pair_tree(cells(i, j, g), cells(i, j, h))
            gains.append((-float((step * cells(i, j, g)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains)[:PAIRS]]
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h = slopes()
            step = RATE * _pair_tree(cells(i, j, g), cells(i, j, h))
            model.pairs[i, j] += step
            total += step[coarse[i], coarse[j]]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordCodes()
    for batch in batches:
        rows = [[float(v) for v in features(x, known)] for x in common.texts(batch)]
        yield pa.record_batch([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """The model of the labelled documents.

    About ``fit_rows`` labelled ids at most, drawn by a hash, are fitted on: a
    broadcast of that many numbers, and that many rows of features on the
    driver. Labels that are null or neither 0 nor 1 are left out; an id with
    both labels counts as 0.
    """
    bounded_batches(docs.sparkSession)
    given = (
        labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    )
    count = given.count()
    drawn = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_rows / max(count, 1))))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), common.text_column(text_column).alias("text"))
    rows = texts.join(F.broadcast(drawn), "id").select("label", "text").mapInArrow(_feature_rows, "label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    y = np.array(rows.column("label").to_pylist(), float)
    # The same model whatever order the rows come in.
    order = np.lexsort((y, *x.T))
    return fit_additive(x[order], y[order])


def quality_score(text: Column, model: AdditiveModel) -> Column:
    """A column of scores from 0 to 1 for a column of texts; higher is likelier of label 1."""

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WordCodes()
        for column in columns:
            rows = [features(x.as_py(), known) for x in column.cast(pa.binary())]
            yield pa.array(model.scores(np.array(rows, float).reshape(len(rows), len(FEATURES))), pa.float64())

    return scored.asNondeterministic()(text.cast("string"))


def judge_quality(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; labels of fold ``held`` are not learned from.

    A row's fold is ``crc32`` of its id as text modulo ``folds``; a row without
    an id counts as held out. Only the text is an input of a score; a null or
    empty text is scored like any other. Repeated rows are each returned, other
    columns are ignored.
    """
    model = fit_quality(docs, labels.where(common.fold(id_column, folds) != held), id_column=id_column, text_column=text_column)
    scored = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(common.fold(id_column, folds) == held, F.lit(True)).alias("held_out"),
        quality_score(F.col(text_column), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
