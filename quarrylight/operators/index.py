"""The inverted index: postings, and their use as a stored table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.shards import SHARD_DOCS, place_documents
from quarrylight.operators.stems import stems
from quarrylight.session import bound_batches
from quarrylight.sources.corpus import Corpus

#: The layout, unless the session sets ``quarrylight.index.buckets`` and ``quarrylight.index.files``:
#: buckets of lexemes, and files of each bucket by shard. Set both by the bytes of postings a task should read.
BUCKETS, FILES_PER_BUCKET = 64, 1
#: Format of the stored index; another one is another table.
VERSION = 2


def content(docs: DataFrame) -> DataFrame:
    """(doc_id, content): the searchable text of each document."""
    text = T.content_text(F.col("title"), F.col("summary"), F.col("raw_text"))
    return docs.select(F.col("id").alias("doc_id"), text.alias("content"))


def repeated_ids(c: Corpus) -> DataFrame:
    """(doc_id) of the documents whose id comes with several texts, stored: mostly none, so the ids alone are shuffled and not the tokens."""

    def build() -> DataFrame:
        ids = c.document_texts.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"))
        return ids.where("n > 1").select("doc_id")

    return c.keep("repeated_ids", build)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ..., lexeme, tf, positions) of each row by itself: its lexemes in order of place, null where there is none."""
    for batch in batches:
        lists = batch.column("lexemes")
        found, sizes = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        kept = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        code = found.indices.fill_null(0).to_numpy()[kept].astype(np.int64)
        key = row[kept] * (len(found.dictionary) + 1) + code
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        edges = np.append(starts, len(order))
        first = order[starts]
        own, names = pa.array(row[kept][first]), [n for n in batch.schema.names if n != "lexemes"]
        yield pa.record_batch([
            *[batch.column(n).take(own) for n in names], found.dictionary.take(pa.array(code[first])), pa.array(np.diff(edges)),
            pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(pos[kept][order], pa.int32())),
        ], names=[*names, "lexeme", "tf", "positions"])


def postings(docs: DataFrame, repeated: DataFrame, form=T.stem) -> DataFrame:
    """(doc_id, lexeme, tf, positions): the whole index of ``docs(doc_id, content)``, by the ``form`` of each token.

    Positions count all tokens from 1, stop words included. A document's row
    gives its entries, so no token is shuffled; only the rows of ``repeated``
    ids (or none) are united behind. Further columns, which an id has only one
    value of, go along.
    """
    bound_batches(docs.sparkSession)

    more = [c for c in docs.columns if c not in ("doc_id", "content")]

    def entries(rows: DataFrame) -> DataFrame:
        lexemes = F.transform(T.tokens(F.col("content")), lambda t: F.when(~T.is_stop_word(t), form(t)))
        kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in more)
        return rows.select("doc_id", *more, lexemes.alias("lexemes")).mapInArrow(_entries, f"doc_id long{kept}, lexeme string, tf long, positions array<int>")

    if repeated.isEmpty():
        return entries(docs)
    flagged = docs.join(repeated.withColumn("many", F.lit(True)), docs.doc_id.eqNullSafe(repeated.doc_id), "left").select(docs["*"], F.col("many").isNotNull().alias("many"))
    again = entries(flagged.where("many")).groupBy("doc_id", *more, "lexeme").agg(
        F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
    )
    return entries(flagged.where("NOT many")).unionByName(again)


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int"))


def sharded_postings(rows: DataFrame) -> DataFrame:
    """(shard, lexeme, docs, tfs, positions) of entries (shard, doc_id, lexeme, positions): one row for each lexeme of a shard, ordered by document.

    A list is as long as the shard has documents at most, however frequent the lexeme.
    """
    one = F.struct(F.col("doc_id").alias("doc"), F.size("positions").alias("tf"), "positions")
    lists = rows.groupBy("shard", "lexeme").agg(F.array_sort(F.collect_list(one)).alias("list"))
    return lists.select("shard", "lexeme", *[F.col(f"list.{f}").alias(n) for f, n in (("doc", "docs"), ("tf", "tfs"), ("positions", "positions"))])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``sharded_postings`` with their bucket and part, from entries in order of bucket, shard, lexeme and document."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(n)[i].as_py() for n in ("bucket", "shard", "lexeme"))

    def listed(rows: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        ends, first = pa.array(edges.astype(np.int32)), pa.array(edges[:-1])
        rows = rows.slice(0, int(edges[-1]))
        places = pa.concat_arrays([rows.column("positions")])
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.concat_arrays([rows.column("doc_id")]), places.value_lengths(), places)]
        names = ("bucket", "part", "shard", "lexeme")
        return pa.record_batch([*[rows.column(n).take(first) for n in names], *lists], names=[*names, "docs", "tfs", "positions"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if key(held[0], 0) == key(batch, batch.num_rows - 1):
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        codes = [rows.column(n).to_numpy() for n in ("bucket", "shard")] + [rows.column("lexeme").dictionary_encode().indices.to_numpy()]
        edges = np.flatnonzero(np.any([np.diff(x, prepend=x[0] - 1) for x in codes], axis=0))
        yield listed(rows, edges)
        # The last list may go on.
        held = [rows.slice(int(edges[-1]))]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield listed(rows, np.array([0, rows.num_rows]))


def dealt_postings(rows: DataFrame, buckets: int, spread: int) -> DataFrame:
    """(bucket, part, shard, lexeme, docs, tfs, positions): ``sharded_postings`` with entries dealt once, to where their list is stored."""
    bound_batches(rows.sparkSession)
    dealt = with_bucket(rows.select("shard", "doc_id", "lexeme", "positions"), buckets).withColumn("part", F.pmod("shard", F.lit(spread)).cast("int"))
    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "shard", "lexeme", "doc_id")
    return dealt.mapInArrow(_listed, "bucket int, part int, shard int, lexeme string, docs array<long>, tfs array<int>, positions array<array<int>>")


def write_index(table: DataFrame, folder: str, files_per_bucket: int = 1) -> None:
    """Store the sharded postings, one folder per bucket of lexemes, each in ``files_per_bucket`` files by shard; a ``part`` column says that the rows are dealt so."""
    if "part" not in table.columns:
        table = table.repartition("bucket", F.pmod("shard", F.lit(files_per_bucket)))
    table.drop("part").sortWithinPartitions("bucket", "shard", "lexeme").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def shard_docs(c: Corpus) -> int:
    return int(c.spark.conf.get("quarrylight.index.shard_docs", str(SHARD_DOCS)))


def shard_count(c: Corpus) -> int:
    return max(1, -(-c.document_count // shard_docs(c)))


def placed_documents(c: Corpus) -> DataFrame:
    """(id, source_id, created_at, shard, sliced) of every document, stored."""
    size = shard_docs(c)
    return c.keep(f"placed-{size}", lambda: place_documents(c.document_keys.select("id", "source_id", "created_at"), c.document_count, size))


def document_counts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(token, n_docs) of ``docs(doc_id, content)``: each row's distinct tokens are counted before they are shuffled, those of ``repeated`` ids by id."""
    many = repeated.select(F.struct("doc_id").alias("own"))
    own = docs.join(many, docs.doc_id.eqNullSafe(F.col("own.doc_id")), "left").select(
        "own", F.explode(F.array_distinct(T.tokens(F.col("content")))).alias("token")
    )
    seen = own.where(~T.is_stop_word(F.col("token"))).groupBy("token", "own").agg(F.count("*").alias("n"))
    return seen.groupBy("token").agg(F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(1)).alias("n_docs"))


def vocabulary(c: Corpus) -> DataFrame:
    """(token, n_docs, stem) of every distinct non-stop token of the documents, stored: stemming is one job over this table."""

    def build() -> DataFrame:
        return stems(document_counts(content(c.document_bodies), repeated_ids(c)))

    return c.keep("vocabulary", build)


def stemmed_postings(lists: DataFrame, words: DataFrame) -> DataFrame:
    """Sharded postings of tokens, united by stem: one row of each shard and token meets the vocabulary, however often the token occurs."""
    met = lists.join(words.select(F.col("token").alias("lexeme"), "stem"), "lexeme")
    rows = met.select("shard", "stem", F.explode(F.arrays_zip("docs", "tfs", "positions")).alias("x"))
    # Per document of the shard the tokens of a stem are one entry again.
    per = rows.groupBy("shard", "stem", F.col("x.docs").alias("doc")).agg(
        F.sum("x.tfs").cast("int").alias("tf"), F.array_sort(F.flatten(F.collect_list("x.positions"))).alias("positions")
    )
    out = per.groupBy("shard", F.col("stem").alias("lexeme")).agg(F.array_sort(F.collect_list(F.struct("doc", "tf", "positions"))).alias("list"))
    return out.select("shard", "lexeme", *[F.col(f"list.{f}").alias(n) for f, n in (("doc", "docs"), ("tf", "tfs"), ("positions", "positions"))])


def stored_postings(c: Corpus, stemmed: bool = False) -> tuple[DataFrame, int]:
    """The stored index (bucket, shard, lexeme, docs, tfs, positions) and its number of buckets; ``stemmed`` by the vocabulary's stems."""
    buckets = int(c.spark.conf.get("quarrylight.index.buckets", str(BUCKETS)))
    spread = int(c.spark.conf.get("quarrylight.index.files", str(FILES_PER_BUCKET)))

    def build() -> DataFrame:
        # Documents meet their shards before they are taken apart, and entries are dealt once, as they are stored.
        placed = placed_documents(c).select(F.col("id").alias("doc_id"), "shard").distinct()
        bodies, many = content(c.document_bodies).join(placed, "doc_id"), repeated_ids(c)
        if not stemmed:
            return dealt_postings(postings(bodies, many), buckets, spread)
        return with_bucket(stemmed_postings(sharded_postings(postings(bodies, many, lambda t: t)), vocabulary(c)), buckets)

    table = c.keep(
        f"postings-v{VERSION}{'-stemmed' * stemmed}-{shard_docs(c)}-{buckets}-{spread}", build,
        lambda df, path: write_index(df, path, spread),
    )
    return table, buckets


def wanted_postings(c: Corpus, wanted: DataFrame, positions: bool = False, stemmed: bool = False) -> DataFrame:
    """(shard, post) of the lexemes in wanted(lexeme).

    The bucket is a partition column, so the semi join prunes at run time and
    only the buckets of wanted lexemes are read.
    """
    table, buckets = stored_postings(c, stemmed)
    found = table.join(with_bucket(wanted.select("lexeme").distinct(), buckets), ["bucket", "lexeme"], "left_semi")
    return found.select("shard", F.struct("lexeme", "docs", "tfs", *(["positions"] if positions else [])).alias("post"))
