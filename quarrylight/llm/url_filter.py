"""URL filter: a trie over reversed host labels, then path segments, sent to all tasks.

An entry is (action, host, path) with action ``allow`` or ``block``. It fits
its host and every subdomain if the URL's path starts with its path. Of the
fitting entries the one with the longest host wins, then the longest path; an
entry given twice with both actions is an error.
"""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import bounded_batches

#: The trie is broadcast; longer lists are refused.
MAX_ENTRIES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEAD = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, _HEAD, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, _HEAD, 2), F.lit(""))


class UrlTrie:
    """Nodes are [children by label, path root or None]; path nodes are [children by segment, entries by last part]."""

    def __init__(self, entries: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, None]
        count = 0
        for action, host, path in entries:
            count += 1
            if count > MAX_ENTRIES:
                raise ValueError(f"more than {MAX_ENTRIES} entries")
            if action not in ("allow", "block") or not host:
                raise ValueError(f"not an entry: {action!r} {host!r} {path!r}")
            node = self.root
            for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
                node = node[0].setdefault(label, [{}, None])
            node[1] = node[1] or [{}, {}]
            place = node[1]
            *whole, last = path.split("/")
            for segment in whole:
                place = place[0].setdefault(segment, [{}, {}])
            rule = (host + path, action)
            if place[1].setdefault(last, rule) != rule:
                raise ValueError(f"entry given twice: {host}{path}")

    @staticmethod
    def _longest(place: list, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            ends = place[1]
            if ends:
                # A rule's last part need not be a whole segment; its longest fitting beginning counts.
                best = next((ends[segment[:n]] for n in range(len(segment), -1, -1) if segment[:n] in ends), best)
            place = place[0].get(segment)
            if place is None:
                break
        return best

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the entry that decides, or None."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1]:
                best = self._longest(node[1], segments) or best
        return best


def judge_urls(pages: DataFrame, entries: list[tuple[str, str, str]], *, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row, repeated rows included.

    ``rule`` is the deciding entry as text, null if none fits; then ``default``
    is the verdict. A null URL or one without ``://`` has an empty host and
    path and no rule. Other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    trie = spark.sparkContext.broadcast(UrlTrie(entries))

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def ruled(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for host, path in columns:
            found = [trie.value.rule(h, p) or (None, default) for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["rule", "verdict"])

    url = F.col(url_column).cast("string")
    parts = pages.select(F.col(id_column).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = parts.withColumn("found", ruled("host", "path"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
