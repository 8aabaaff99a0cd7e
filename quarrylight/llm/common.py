"""What several operators share: words, word codes, slices of Arrow batches, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.session import work_folder

#: Bytes of text that a task takes apart at once. Only memory depends on it.
SLICE_BYTES = 4 << 20
#: Entries of a per-task cache; a full cache is emptied, so memory stays bounded.
CACHE_ENTRIES = 400_000

MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text: ``bytes.split`` parts at just these six bytes."""
    return text.split() if text else []


class WordCodes(dict):
    """word -> 64-bit code, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit codes spread evenly (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


def _sequence(codes: np.ndarray, length: int) -> np.ndarray:
    if length == 1:
        return codes
    n, half = len(codes) - length + 1, length // 2
    part = _sequence(codes, half)
    total = mixed(part[:n] * MIX_A + part[half : half + n])
    return mixed(total * MIX_A + codes[length - 1 :]) if length % 2 else total


def sequence_codes(codes: np.ndarray, length: int, odd: int = 0) -> np.ndarray:
    """A code for each run of ``length`` consecutive words; ``odd`` picks one of many independent codings."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    return mixed(_sequence(codes, length) + np.uint64(odd * int(MIX_C) % 2**64))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0.0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def text_column(name: str = "text") -> Column:
    return F.col(name).cast("string")


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``: the fold by which rows are held out."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def bounded_batches(spark: SparkSession) -> None:
    """At most 1,000 rows in an Arrow batch: long texts then stay within a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, "1000")


class Scratch:
    """Intermediate tables of one call, in the folder that all executors share.

    A later step scans the written table, so a lost executor costs a re-read
    and the lineage stays short. Tables that no later step or result reads are
    removed with ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bounded_batches(spark)
        self.folder = f"{work_folder(spark).rstrip('/')}/quarrylight-llm/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
