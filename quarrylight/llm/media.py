"""Payloads as losslessly packed 8-bit images in content-addressed tar shards.

A payload becomes a grey PNG of ``WIDTH`` samples a row. Tasks append these to
tar shards in a shared folder; a member is named by the digest of its bytes and
stored once a shard. Rows carry only (shard, digest, offset, length). Metadata
comes from a range read of a member's first bytes; the samples from a range
read of the member.

A shard's name is new for every attempt of a task, and rows of an attempt that
failed are never committed, so a lost executor leaves at most unused files.
"""

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import common
from quarrylight.llm.common import Scratch

WIDTH, PAD = 192, b" "
#: A shard is closed when it is so long.
SHARD_BYTES = 256 << 20
#: Signature and header chunk: all that metadata needs.
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes) -> bytes:
    """A grey 8-bit PNG of ``WIDTH`` columns whose samples are the payload, a positive multiple of the width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with its filter: none
    plain[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header_of(start: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first bytes of an image."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", start[16:25])


def samples_of(image: bytes) -> bytes:
    """The samples of an image that ``to_image`` made."""
    width, height, _ = header_of(image)
    at, packed = HEADER_BYTES, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            packed.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    plain = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if plain[:, 0].any():
        raise ValueError("a filtered image")
    return plain[:, 1:].tobytes()


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes, blanks appended up to a positive multiple of ``WIDTH``."""
    body = text or b""
    return body + PAD * (-len(body) % WIDTH if body else WIDTH)


class _Shard:
    """A tar file that is being written; what it holds is known by digest."""

    def __init__(self, folder: str):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        self.path = f"{folder}/{uuid.uuid4().hex}.tar"
        self.stream = store.open_output_stream(f"{base}/{self.path.rpartition('/')[2]}")
        self.at, self.held = 0, {}

    def add(self, image: bytes) -> tuple[bytes, int]:
        """(digest, offset of the member's first byte)."""
        digest = hashlib.sha256(image).digest()
        if digest not in self.held:
            entry = tarfile.TarInfo(f"{digest.hex()}.png")
            entry.size = len(image)
            head = entry.tobuf(tarfile.USTAR_FORMAT)
            self.stream.write(head + image + b"\0" * (-len(image) % 512))
            self.held[digest] = self.at + len(head)
            self.at += len(head) + len(image) + -len(image) % 512
        return digest, self.held[digest]

    def close(self) -> None:
        self.stream.write(b"\0" * 1024)
        self.stream.close()


def _stored(batches: Iterator[pa.RecordBatch], folder: str, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    shard = None
    for batch in batches:
        for part in common.slices(batch, "text"):
            rows = []
            for text in common.texts(part):
                image = to_image(payload_of(text))
                shard = shard or _Shard(folder)
                digest, offset = shard.add(image)
                rows.append((len(text or b""), shard.path, digest, offset, len(image)))
                if shard.at >= shard_bytes:
                    shard.close()
                    shard = None
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [part.column("id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                names=["id", "n_bytes", "shard", "digest", "offset", "length"],
            )
    if shard:
        shard.close()


def store_media(docs: DataFrame, folder: str, *, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_bytes, shard, digest, offset, length) for each row; the shards are written to ``folder`` as the rows are read.

    Save the result before reading the shards: reading it twice stores twice.
    ``folder`` is a path or address that all executors reach.
    """
    common.bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("id"), common.text_column(text_column).alias("text"))
    address = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return source.mapInArrow(partial(_stored, folder=address, shard_bytes=shard_bytes), "id long, n_bytes long, shard string, digest binary, offset long, length long")


class _Reader:
    """Range reads of shards; the last one stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            if self.file:
                self.file.close()
            store, base = fs.FileSystem.from_uri(path)
            self.path, self.file = path, store.open_input_file(base)
        found = self.file.read_at(length, offset)
        if len(found) != length:
            raise OSError(f"{path} ends before {offset + length}")
        return found


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for batch in batches:
        found = [header_of(reader.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
        out = batch
        for i, name in enumerate(("width", "height", "sample_bits")):
            out = out.append_column(name, pa.array([x[i] for x in found], pa.int64()))
        yield out


def with_metadata(media: DataFrame) -> DataFrame:
    """``media`` with width, height and sample_bits, from range reads of the headers alone."""
    more = [T.StructField(name, T.LongType()) for name in ("width", "height", "sample_bits")]
    return media.mapInArrow(_headers, T.StructType([*media.schema.fields, *more]))


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples and their shares in eight bands, as text."""
    samples = np.frombuffer(payload, np.uint8)
    total, squares = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
    mean = total / len(samples)
    shares = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    return f"mean={mean:.3f};dev={max(0.0, squares / len(samples) - mean * mean) ** 0.5:.3f};bands={','.join(map(str, shares))}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for batch in batches:
        rows = []
        for shard, offset, length, digest in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
            image = reader.read(shard, offset, length)
            own = hashlib.sha256(image).digest()
            if own != digest:
                raise OSError(f"{shard} at {offset} does not hold {digest.hex()}")
            payload = samples_of(image)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), own.hex(), feature_of(payload)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        out = batch.select(["id", "n_bytes", "width", "height", "shard", "offset"])
        for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            out = out.append_column(name, pa.array([x[i] for x in rows], kind))
        yield out


def media_columns(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height, shard, offset).

    Every text, null as empty, is stored and read back; a member whose bytes
    don't have the digest of its row is an error. Equal texts have equal values
    but for the place, as each task fills shards of its own. Repeated rows are
    each returned, a null id stays null, other columns are ignored. The shards
    stay in ``folder`` (by default one in the shared work folder).
    """
    scratch = Scratch(docs.sparkSession, "media")
    rows = store_media(docs, folder or f"{scratch.folder}/shards", id_column=id_column, text_column=text_column, shard_bytes=shard_bytes)
    stored = scratch.save(rows, "rows")
    read = with_metadata(stored).mapInArrow(
        _read,
        "id long, n_bytes long, width long, height long, shard string, offset long, payload_bytes long, payload_sha256 string, "
        "tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
    return read.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height", "shard", "offset",
    )
