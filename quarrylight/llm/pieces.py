"""Encoding into the pieces of a SentencePiece vocabulary, and back.

An Aho-Corasick automaton over the pieces reads a word once. Each match that
ends at a position, found along the output links, relaxes the best score of a
segmentation up to there (Viterbi). A character that no piece covers costs a
fixed penalty and becomes its UTF-8 bytes' pieces. Between two characters that
stand side by side in no piece every segmentation has a cut. So texts are cut
there first, always before the blank mark after another character, and what
lies between is segmented by itself and remembered.

The vocabulary file gives pieces and scores; the segmentation is the one of
highest total score. Of equal scores the one whose last piece is longest wins,
and so on backwards.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import CACHE_ENTRIES, bounded_batches

MARK = "▁"
#: Below the lowest score of a piece: what a character costs that no piece covers.
UNKNOWN_COST = 10.0
_WORDS = re.compile(f"{MARK}*[^{MARK}]*")


class Pieces:
    """A vocabulary, its automaton and the remembered words."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.names[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        scores = {
            self.names[i]: (i, model.get_score(i)) for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        if any(MARK in name.lstrip(MARK) for name in scores):
            raise ValueError("a piece goes on over a blank")
        self.penalty = min(score for _, score in scores.values()) - UNKNOWN_COST
        self.automaton = ahocorasick.Automaton()
        for name, (number, score) in scores.items():
            self.automaton.add_word(name, (len(name), number, score))
        self.automaton.make_automaton()
        self.surface = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([self._byte(i)]) if model.is_byte(i) else self.names[i].replace(MARK, " ").encode() for i in range(size)]
        self.pairs = {name[i : i + 2] for name in scores for i in range(len(name) - 1)}
        # Surfaces side by side, for decoding many ids at once.
        self.lengths = np.array([len(x) for x in self.surface], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.body = np.frombuffer(b"".join(self.surface), np.uint8)
        self.words: dict[str, bytes] = {}

    def _byte(self, number: int) -> int:
        return int(self.names[number][1:-1], 16)

    def _spelled(self, character: str) -> list[int]:
        found = [self.bytes.get(b) for b in character.encode("utf-8", "replace")]
        return [self.unknown] if None in found else found

    def segment(self, word: str) -> list[int]:
        """Piece ids of one word in a single pass over it."""
        best, back = [0.0] + [float("-inf")] * len(word), [None] * (len(word) + 1)
        matches = self.automaton.iter(word)
        match = next(matches, None)
        for end in range(1, len(word) + 1):
            # Matches come longest first at each end, so a later equal score is of a shorter piece.
            best[end], back[end] = best[end - 1] + self.penalty, (1, None)
            first = True
            while match is not None and match[0] == end - 1:
                length, number, score = match[1]
                total = best[end - length] + score
                if total > best[end] or (first and total == best[end]):
                    best[end], back[end] = total, (length, number)
                first = False
                match = next(matches, None)
        out, end = [], len(word)
        while end:
            length, number = back[end]
            out.append([number] if number is not None else self._spelled(word[end - 1]))
            end -= length
        return [x for piece in reversed(out) for x in piece]

    def _parts(self, word: str) -> list[str]:
        """The word cut wherever no piece goes on."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def _learned(self, word: str, parts: list[str]) -> bytes:
        """The ids of a word, remembered, from those of its parts."""
        if len(self.words) >= CACHE_ENTRIES:
            self.words.clear()
        if len(parts) == 1:
            ids = np.array(self.segment(word), np.int32).tobytes()
        else:
            ids = b"".join([found if (found := self.words.get(part)) is not None else self._learned(part, [part]) for part in parts])
        self.words[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a text: a blank is put before it, and every blank is the mark. Empty texts have none."""
        if not text:
            return np.zeros(0, np.int32)
        marked = MARK + text.replace(" ", MARK)
        # Single blanks part words by themselves; runs of marks stay with the word after them.
        found = [MARK + x for x in text.split(" ")] if "  " not in text and MARK not in text and text[-1] != " " and text[0] != " " else _WORDS.findall(marked)
        ids = list(map(self.words.get, found))
        if None in ids:
            ids = [x if x is not None else self.words.get(w) or self._learned(w, self._parts(w)) for w, x in zip(found, ids, strict=True)]
        return np.frombuffer(b"".join(ids), np.int32)

    def surfaces(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where those of each end."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.body[places].tobytes(), ends

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of piece ids, without the blank that ``encode`` puts before it."""
        text = self.surfaces(np.asarray(ids, np.int64))[0].decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(text: Column, path: str) -> Column:
    """A column of piece ids (array<int>) for a column of texts; null for null. The vocabulary file must lie at ``path`` on every executor."""

    @F.arrow_udf("array<int>")
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(path)
        for column in columns:
            yield pa.array([None if x is None else pieces.encode(x) for x in column.to_pylist()], pa.list_(pa.int32()))

    return ids(text.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """A column of texts for a column of piece ids; null for null."""

    @F.arrow_udf("string")
    def text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(path)
        for column in columns:
            flat, valid = column.flatten().to_numpy(), column.is_valid().to_pylist()
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
            yield pa.array([pieces.decode(flat[a:b]) if there else None for a, b, there in zip([0, *ends], ends, valid, strict=False)], pa.string())

    return text(ids)


def encode_documents(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row, repeated rows included; both are null for a null text. Other columns are ignored."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), encoded(F.col(text_column), path).alias("ids"))
    return rows.withColumn("decoded", decoded(F.col("ids"), path))
