"""Packing of tokenized documents along a space-filling curve.

A document's token counts are hashed to ``HASHED`` signed coordinates and
projected to a few dimensions; since both steps are linear, one table of token
vectors holds them. The point's place on the Hilbert curve is the sort key, so
neighbours along the curve have like contents. The key range is cut at
quantiles; each part is sorted by itself and starts where the tokens of the
parts before it end, so the cut into sequences runs on through all parts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import common
from quarrylight.llm.common import Scratch

DIMENSIONS, BITS, HASHED, SEED = 4, 10, 1024, 77
#: Low bits of the sort key that come from the document's id: equal documents spread over a key range.
SPREAD_BITS = 63 - DIMENSIONS * BITS


#: Words whose ids a task remembers for good; frequent ones come early. A quarter as many more are held for a while.
HELD_WORDS = 800_000
#: Words that are encoded as one text.
TOGETHER = 512
#: Marks that the tokenizer parts from a word before them.
_TAIL = b".,;:!?"


class _WordIds(dict):
    """Word -> its token ids as little-endian bytes. No token crosses white space, so words can be taken alone.

    New words are encoded many at a time as one text; the ends are found again
    by the vocabulary's word-end mark. Where that doesn't give one end a word,
    each is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.more = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spell(self, words: list[str]) -> list[bytes]:
        ids = np.array(self._encode([" ".join(words)])[0], self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return [self._packed(x) for x in self._encode(words)]
        packed, size, starts = ids.tobytes(), ids.itemsize, [0, *(ends[:-1] * ids.itemsize).tolist()]
        return [packed[a:b] for a, b in zip(starts, (ends * size).tolist(), strict=True)]

    def learn(self, words: set[bytes]) -> None:
        """Adds the ids of the words, and of their stems, while there is room; then to ``more``, which starts anew when it is full."""
        words = list(words)
        stems = [w.rstrip(_TAIL).lower() for w in words]
        letters = {s for s in set(stems) if s.isalpha() or s.decode("utf-8", "replace").isalpha()}
        new = {s: ids for s in letters if (ids := self.get(s, self.more.get(s))) is not None}
        plain = sorted(letters - new.keys())
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            new.update(zip(some, self._spell([s.decode() for s in some]), strict=True))
        tails: dict[bytes, bytes] = {b"": b""}
        odd = []
        for word, stem in zip(words, stems, strict=True):
            if stem not in letters:
                odd.append(word)
                continue
            tail = word[len(stem) :]
            if tail not in tails:
                tails[tail] = self._packed(self._encode([tail.decode()])[0])
            new[word] = new[stem] + tails[tail]
        whole = self._encode([w.decode("utf-8", "replace") for w in odd])
        new.update((w, self._packed(x)) for w, x in zip(odd, whole, strict=True))
        if len(self) + len(new) <= HELD_WORDS:
            self.update(new)
        else:
            if len(self.more) + len(new) > HELD_WORDS // 4:
                self.more.clear()
            self.more.update(new)

    def __missing__(self, word: bytes) -> bytes:
        return self.more[word]

    def texts(self, found: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of words. Each distinct word is looked for once; then all are known."""
        new = {w for w in set().union(*found) if w not in self}
        if not self.more.keys() >= new:
            self.learn(new)
        return [b"".join(map(self.__getitem__, x)) for x in found]


@lru_cache(1)
def _word_ids(path: str) -> _WordIds:
    return _WordIds(path)


@lru_cache(1)
def _token_vectors(vocabulary: int) -> np.ndarray:
    """The projected hashed vector of each token id."""
    draw = np.random.default_rng(SEED)
    cell, sign = draw.integers(0, HASHED, vocabulary), draw.choice((-1.0, 1.0), vocabulary)
    return (draw.standard_normal((HASHED, DIMENSIONS))[cell] * sign[:, None]).astype(np.float32)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative integers below ``2 ** bits``.

    Works down the bit planes: a plane's set bits flip or swap the lower bits
    of the first axis, then the planes are Gray-decoded and interleaved.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for i in range(axes):
            there = (x[i] & plane) != 0
            swap = np.where(there, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(there, low, swap)
            x[i] ^= swap
        plane >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        turn ^= np.where((x[-1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    table = _word_ids(path)
    vectors = _token_vectors(max(table.tokenizer.get_vocab_size(), end_id + 1))
    end = np.array([end_id], table.kind).tobytes()
    for batch in batches:
        for part in common.slices(batch, "text"):
            found = [common.words(x) for x in common.texts(part)]
            ids = [x + end for x in table.texts(found)]
            sizes = np.array([len(x) for x in ids]) // int(table.kind[-1])
            each = vectors[np.frombuffer(b"".join(ids), table.kind)]
            points = np.add.reduceat(each, np.cumsum(sizes) - sizes, axis=0).astype(np.float64) / np.sqrt(sizes)[:, None]
            cells = ((1 << BITS) / (1 + np.exp(-np.clip(points, -30, 30)))).astype(np.int64)
            place = hilbert_keys(np.minimum(cells, (1 << BITS) - 1), BITS)
            rows = np.array(part.column("id").fill_null(-1).to_pylist(), np.int64).view(np.uint64)
            spread = common.mixed(rows) >> np.uint64(64 - SPREAD_BITS)
            yield pa.record_batch(
                [
                    part.column("id"), pa.array((place << SPREAD_BITS) | spread.astype(np.int64)),
                    pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=["id", "place", "tokens", "ids"],
            )


def _parted(batches: Iterator[pa.RecordBatch], cuts: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = np.searchsorted(np.array(cuts, np.int64), batch.column("place").to_numpy(), side="left")
        yield batch.append_column("part", pa.array(part, pa.int64()))


class _Sequences:
    """Where sequences start. All are full but for the last tokens, which are cut at powers of two."""

    def __init__(self, total: int, size: int):
        self.size, self.full = size, total // size
        self.starts, at = [], self.full * size
        for bit in range(total - at, 0, -1):
            if bit & (bit - 1) == 0 and total - at >= bit:
                self.starts.append(at)
                at += bit
        self.starts.append(at)

    def at(self, token: int) -> tuple[int, int, int]:
        """(sequence, offset in it, tokens left in it) of a token's place in the whole order."""
        if token < self.full * self.size:
            return token // self.size, token % self.size, self.size - token % self.size
        i = next(i for i in range(len(self.starts) - 1) if token < self.starts[i + 1])
        return self.full + i, token - self.starts[i], self.starts[i + 1] - token


def _cut(batches: Iterator[pa.RecordBatch], bases: dict[int, int], total: int, size: int, kind: str) -> Iterator[pa.RecordBatch]:
    sequences, at, token = _Sequences(total, size), None, 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        rows: list[tuple] = []
        for part, doc, count, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "tokens", "ids")), strict=True):
            if part != at:
                at, token = part, bases[part]
            wide, start = np.frombuffer(ids, kind).astype("<u4"), 0
            while start < count:
                sequence, offset, left = sequences.at(token)
                length = min(left, count - start)
                rows.append((doc, start, length, zlib.crc32(wide[start : start + length].tobytes()), count, sequence, offset))
                start, token = start + length, token + length
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=names)


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", size: int = 4096,
    end_id: int = 2, parts: int | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """Pieces of all documents in sequences of ``size`` tokens, neighbours along the curve together.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the
    document's ids before the piece, its length, the crc32 of its ids as
    little-endian unsigned 32-bit numbers, the document's ids with ``end_id``,
    and the place. Only the last tokens of the whole order don't fill a
    sequence; they are cut at powers of two, so nothing is padded. A null or
    empty text is its end id alone, a null id stays null, equal rows are packed
    each. ``parts`` key ranges are sorted apart (by default as many as Spark
    has shuffle partitions); only their bounds and token counts reach the driver.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_column).cast("long").alias("id"), common.text_column(text_column).alias("text"))
    tokens = scratch.save(
        source.mapInArrow(partial(_tokenized, path=tokenizer_path, end_id=end_id), "id long, place long, tokens long, ids binary"),
        "tokens", compression="zstd",
    )
    steps = [i / parts for i in range(1, parts)]
    cuts = tokens.agg(F.percentile_approx("place", steps, 10_000).alias("cuts")).first()["cuts"] if steps else []
    cuts = sorted(set(cuts or []))
    sums = (
        tokens.select("place", "tokens").mapInArrow(partial(_parted, cuts=cuts), "place long, tokens long, part long")
        .groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()
    )
    bases, total = {}, 0
    for row in sorted(sums):
        bases[row["part"]], total = total, total + row["tokens"]
    kind = _word_ids(tokenizer_path).kind
    return (
        tokens.mapInArrow(partial(_parted, cuts=cuts), "id long, place long, tokens long, ids binary, part long")
        .repartition(parts, "part").sortWithinPartitions("part", "place", "id")
        .mapInArrow(
            partial(_cut, bases=bases, total=total, size=size, kind=kind),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )
