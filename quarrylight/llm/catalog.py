"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import common
from quarrylight.llm.fuzzy_dedup import fuzzy_duplicates
from quarrylight.llm.language_id import identify
from quarrylight.llm.language_model import score_documents
from quarrylight.llm.media import media_columns
from quarrylight.llm.near_dedup import near_duplicates
from quarrylight.llm.neighbours import nearest_neighbours
from quarrylight.llm.packing import pack
from quarrylight.llm.pieces import encode_documents
from quarrylight.llm.prefix_trie import conversation_trie
from quarrylight.llm.quality import judge_quality
from quarrylight.llm.substring_dedup import judge_repeats
from quarrylight.llm.url_filter import judge_urls
from quarrylight.llm.variants import group_variants

URL_ENTRIES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def tokenizer(name: str) -> str:
    """The path of a public tokenizer file of this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every ``pages`` url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_ENTRIES)


OP1_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict, length(r.host) AS h, length(r.path) AS l
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY h DESC NULLS LAST, l DESC NULLS LAST) = 1
"""


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload, stored in tar shards, read back and described."""
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
    return media_columns(common.documents(spark, sf_dir)).select(*columns)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` over two-word shingles at similarity 0.8."""
    return near_duplicates(common.documents(spark, sf_dir), shingle_words=2, percent=80)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return judge_quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document by the mixing model and by the unigram base."""
    return score_documents(common.documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into pieces and decoded again: counts and digests of both."""
    rows = encode_documents(common.documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.crc32(ids.cast("binary")).alias("ids_crc32"),
        F.length("decoded").cast("long").alias("n_chars"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that a repeated window of 20 words covers."""
    return judge_repeats(common.documents(spark, sf_dir), window=20)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by rank-order profiles."""
    return identify(common.documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4,096 tokens along the curve."""
    return pack(common.documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each of the ``embeddings`` whose id is divisible by 20."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt ``conversations``."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 byte by byte: the table of remainders, folded over the bytes of a string of Latin-1 letters and digits.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) AS r(i))"""


def _crc_sql(value: str) -> str:
    chars = f"list_transform(string_split({value}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)] ELSE [195, ord(ch) - 64] END)"
    folded = f"list_reduce(list_prepend(4294967295::UBIGINT, flatten({chars})::UBIGINT[]), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)::BIGINT]))"
    return f"xor({folded}, 4294967295::UBIGINT)"


OP11_SQL = f"""
WITH {CRC_TABLE},
clean AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT *, md5(length(role) || ':' || role || text) AS code,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS pos
  FROM clean),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, ({_crc_sql("conv_id::VARCHAR")} % 4)::BIGINT AS h
  FROM (SELECT DISTINCT conv_id FROM clean), crc_table),
placed AS (
  SELECT i.conv_id, 0 AS part, t.pos, t.code, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.pos <= i.h
  UNION ALL
  SELECT i.conv_id, 1 AS part, t.pos, t.code, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h),
ways AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(code, '') OVER w AS prefix,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
ends AS (SELECT conv_id, max(depth) AS last FROM ways GROUP BY conv_id),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
  FROM ways JOIN ends USING (conv_id) GROUP BY prefix, depth),
above AS (SELECT n.prefix, p.prefix AS parent FROM nodes n JOIN ways p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT parent AS prefix, count(*) AS n_children FROM above GROUP BY parent),
within AS (
  SELECT w.prefix, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (WHERE c.prefix IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children c USING (prefix) JOIN ways w ON w.conv_id = n.conv_id AND w.depth <= n.depth GROUP BY w.prefix)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(c.n_children, 0)::BIGINT AS n_children, i.n_leaves::BIGINT AS n_leaves, i.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN within i USING (prefix) LEFT JOIN children c USING (prefix) LEFT JOIN above a USING (prefix) LEFT JOIN nodes p ON p.prefix = a.parent
"""


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and the components of those within two bits."""
    return fuzzy_duplicates(common.documents(spark, sf_dir), shingle_words=3)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all ``documents``."""
    return group_variants(common.documents(spark, sf_dir))


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS name, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents),
counted AS (SELECT name, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY name, run),
hashed AS (SELECT run, n, {_crc_sql("name || ':' || run")}::BIGINT AS h FROM counted, crc_table),
damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS p(i)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.rest),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS form, max(near_n) AS form_n FROM near GROUP BY word),
judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form,
    CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
led AS (
  SELECT word, word AS at, form AS next FROM judged
  UNION ALL SELECT l.word, l.next, j.form FROM led l JOIN judged j ON j.word = l.next WHERE l.next IS NOT NULL)
SELECT j.word, j.form, l.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN led l ON l.word = j.word AND l.next IS NULL
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_media_columns": op2_media_columns,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {"op1_url_filters": OP1_SQL, "op11_conversation_trie": OP11_SQL, "op13_spelling_variants": OP13_SQL}
