"""Corpus tables derived from the raw driver tables.

Every table is a map, an equality join or a hash aggregate over ``pages``,
``documents``, ``events``, ``labels``, ``benchmark`` and ``conversations``;
nothing is collected and no row order of the input matters.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, cached_property, wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrylight.functions import text as T
from quarrylight.functions import urls as U
from quarrylight.functions.errors import error_code
from quarrylight.session import work_folder

SLUGS = (
    "program-a", "template", "how-to-lift", "category", "tag",
    "author", "shop", "blog/best-list", "articles", "product-category",
)
TITLE_THEMES = (
    "Bench Press Program", "Novice Squat Template", "Powerlifting Meet Prep", "Hypertrophy Block",
    "Beginner Full Body", "Low Volume Deadlift", "Injury Return Guide", "Home Gym Equipment",
    "Competition Peaking", "Intermediate Upper Lower", "Minimal Time Strength", "Advanced Conjugate Wave",
)
HINTS = (
    "", "bench press", "", "post novice 4 day full body", "", "first meet prep", "", "",
    "limited time two days", "", "advanced squat peaking", "injury", "", "beginner deadlift upper lower",
    "", "powerbuilding – 3-day", "home gym", "", "minimum effective dose",
)
PROGRAM_THEMES = ("Builder", "Base", "Peak", "Volume", "Prep", "Return", "Starter")
SPECIALIZATIONS = ("bench", "squat", "deadlift", "powerlifting", "hypertrophy", "strength", "general", None)
LEVELS = ("beginner", "intermediate", "advanced", None)
PROGRESSIONS = ("linear", "undulating", "autoregulated", "block", "conjugate", None)
SPLITS = ("full-body", "upper-lower", "push-pull-legs", "body-part", None)
ERROR_MESSAGES = (
    "crawl failed: domain already has active crawl",
    "Failed to resolve host",
    "HTTP 429 Too Many Requests",
    "HTTP 401 Unauthorized",
    "job did not complete within 300s",
    "schema_invalid",
    "low_quality_output, no_programs_on_program_page",
    "no_programs_on_program_page",
    "Source not found",
    "Event loop is closed",
    "value too long for type character varying(64)",
    "duplicate key value violates unique constraint",
    "not null violation",
    "violates foreign key",
    "connection reset",
    "unexpected end of stream",
    "X_BROWSER_USE_API_KEY is required",
    "X_DATABASE_URL is required",
)
ERROR_TYPES = ("ConnectionError", "ValueError", "TimeoutError", "RuntimeError", "HTTPError")

# Payload forms; "#" stands for the document id and "@" for its text.
PAYLOAD_OBJECT = (
    '{"title":"Doc # Bench Guide","author":"Coach A","source_type":"  blog   post ","text":"@","summary":"About #.",'
    '"raw_html":"<p>#</p>","programs":[{"name":"Block #","coach_name":"","days_per_week":#,"specialization":"Bench focus",'
    '"experience_level":"expert","progression_type":"Wave loading","split_type":"push pull legs","summary":"S #","confidence":0.8},'
    '{"title":"  ","coach":"Ann","days_per_week":null,"confidence":2}],'
    '"claims":[{"claim_type":"volume","text":"10 sets","normalized_value":"10","confidence":"0.4","program_id":0},{"type":"  "}]}'
)
PAYLOAD_OBJECT_BARE = '{"title":"Doc # Squat","text":"@","programs":[],"claims":[]}'
PAYLOAD_ALIASES = (
    '{"page_title":"Page #","byline":"By #","type":"a source type that is much longer than the sixty-four characters kept for it",'
    '"content":"@","description":"Described","programs":[{"program_name":"Alt #","coach":"Bo","focus":"General strength",'
    '"experience":"Novice lifters","progression":"interpersonal","split":"Body-Part","description":"D","days_per_week":"12 or 3 days"}],'
    '"claims":[{"type":"frequency","claim":"twice","normalized":"2","program_id":"alt #"}]}'
)
PAYLOAD_ALIASES_BARE = '{"headline":" Head # ","body":"@","excerpt":" ","claims":[{"type":"intensity","program_id":1.5}]}'
PAYLOAD_ODD = (
    '{"title":7,"headline":"  Odd #  ","text":"   ","markdown":"@","programs":[5,"x",{},{"confidence":0.9},'
    '{"name":"A","days_per_week":true,"confidence":true},{"name":"B","days_per_week":4.0,"confidence":"nan"},'
    '{"name":"C","days_per_week":"0.5","confidence":-1},{"name":"D","days_per_week":15,"confidence":"1.7"},'
    '{"name":"E","confidence":[1]},{"name":"F #","days_per_week":"4 days","confidence":" 0.5 "}],"claims":"none"}'
)


def pick(index: Column, values) -> Column:
    """Element ``index`` (0-based) of a short constant list; None stays NULL."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def day(literal: str) -> Column:
    return F.lit(literal).cast("timestamp")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * 1_000_000)


#: Request ids of conversation turns: above all item ids, room for so many turns each; ids of requests without text lie above those.
TURN_IDS, TURNS, BLANK_IDS = 1 << 52, 1 << 24, 1 << 54
#: Longest query that the service takes.
MAX_QUERY = 400

@cache
def _code_version() -> str:
    """A digest of this library's source: other code may derive other tables."""
    package = Path(__file__).parents[1]
    digest = hashlib.md5()
    for file in sorted(package.rglob("*.py")):
        if "llm" not in file.relative_to(package).parts:
            digest.update(file.read_bytes())
    return digest.hexdigest()[:12]


_WRITTEN: dict[str, StructType] = {}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table goes when the table is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)



def stored(build):
    """A table that is written on first use and read back from then on.

    Later jobs scan a Parquet table instead of repeating the derivation, and a
    lost executor costs a re-read, not a re-computation.
    """

    @wraps(build)
    def table(self: Corpus) -> DataFrame:
        return self.keep(build.__name__.strip("_"), lambda: build(self))

    return cached_property(table)


class Corpus:
    """The corpus tables of one data folder.

    Tables live in the shared work folder, one set for each state of the input
    files and of this library's code, so a later session finds what an earlier
    one has written, and changed input gets new tables.
    """

    TABLES = ("pages", "documents", "events", "labels", "benchmark", "conversations")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.home = f"{work_folder(spark)}/quarrylight/{_code_version()}/{self._input_state()}"

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _input_state(self) -> str:
        """A digest of the folder's address and of name, length and time of its tables' files."""
        state = hashlib.md5(self.folder.encode())
        for table in self.TABLES:
            path = f"{self.folder}/{table}.parquet"
            store = self._files(path)
            if store.exists(self._path(path)):
                for f in store.listStatus(self._path(path)):
                    state.update(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()};".encode())
        return state.hexdigest()[:16]

    def keep(self, name: str, build, write=None) -> DataFrame:
        """Write ``build()`` once under ``name`` and return a scan of it."""
        path = f"{self.home}/{name}"
        if path not in _WRITTEN:
            store = self._files(path)
            if not store.exists(self._path(f"{path}/_SUCCESS")):
                # Written aside and then renamed: a table is there as a whole or not at all.
                aside, df = f"{path}-{uuid.uuid4().hex[:12]}", build()
                with tidy(self.spark):
                    if write:
                        write(df, aside)
                    else:
                        df.write.parquet(aside)
                if not store.rename(self._path(aside), self._path(path)):
                    store.delete(self._path(aside), True)
            _WRITTEN[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_WRITTEN[path]).parquet(path)

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        """Write an intermediate result that several later steps read.

        The steps start from a table instead of repeating the work, its real
        size decides their joins, and a lost executor loses nothing.
        """
        path = f"{self.home}/stage/{label}-{uuid.uuid4().hex[:12]}"
        with tidy(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def raw(self, name: str) -> DataFrame:
        """A raw table. Its splits are the tasks, unless ``quarrylight.input.partitions`` asks for a number:
        for tables in one file of one row group, as in tests, which would be one task."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        width = self.spark.conf.get("quarrylight.input.partitions", None)
        return df.repartition(int(width)) if width else df

    @cached_property
    def page_count(self) -> int:
        """One number: the pages that documents and events are dealt to in turn."""
        return max(1, self.raw("pages").count())

    @cached_property
    def document_count(self) -> int:
        """One number, from the stored table's file footers."""
        return self.documents.count()

    # -- urls ---------------------------------------------------------------
    @cached_property
    def candidates(self) -> DataFrame:
        """Raw candidate URLs: (page_id, pos, raw_url), before canonicalization."""
        url, pid = F.col("url"), F.col("page_id")
        host = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
        head = F.regexp_extract(url, r"^(https?)://", 1)
        tail = F.regexp_extract(url, r"^https?://[^/?#]*(.*)$", 1)
        path = F.regexp_extract(tail, r"^([^?#]*)", 1)
        slug = pick(pid % 10, SLUGS)
        main = F.concat(head, F.lit("://"), host, F.lit("/"), slug, tail)
        plain = F.regexp_replace(path, r"/+$", "")
        copy = F.concat(head, F.lit("://"), F.upper(host), F.lit("/"), slug, plain, F.lit("/?utm=1"))
        asset = F.concat(head, F.lit("://"), host, F.lit("/files/item-"), pid, F.lit(".PDF?dl=1"))
        odd = (
            F.when(pid % 4 == 0, F.concat(F.lit("mailto:desk@"), host))
            .when(pid % 4 == 1, F.concat(F.lit("ftp://"), host, F.lit("/feed")))
            .when(pid % 4 == 2, F.concat(F.lit("  "), host, F.lit("/feed/latest;v=2 ")))
            .otherwise(F.concat(F.lit("http://bad host/"), pid))
        )
        rows = F.array_compact(
            F.array(
                F.struct(F.lit(0).alias("pos"), main.alias("raw_url")),
                F.when(pid % 25 == 0, F.struct(F.lit(1).alias("pos"), copy.alias("raw_url"))),
                F.when(pid % 10 == 3, F.struct(F.lit(2).alias("pos"), asset.alias("raw_url"))),
                F.when(pid % 5 == 4, F.struct(F.lit(3).alias("pos"), odd.alias("raw_url"))),
            )
        )
        return self.raw("pages").select("page_id", F.inline(rows))

    @stored
    def page_urls(self) -> DataFrame:
        """(page_id, canonical_url, host, domain) of the main URL of each page."""
        main = self.candidates.where("pos = 0").select(
            "page_id", U.canonicalize_url(F.col("raw_url")).alias("canonical_url")
        )
        host = U.netloc(F.col("canonical_url"))
        return main.select(
            "page_id", "canonical_url", host.alias("host"),
            F.regexp_replace(host, r"^(?:www|m|blog)\.", "").alias("domain"),
        )

    @stored
    def domains(self) -> DataFrame:
        ids = self.page_urls.groupBy("domain").agg(F.min("page_id").alias("id"))
        return ids.select(
            "id", "domain", (F.col("id") % 5 != 0).alias("allowlisted"), (F.col("id") % 7 == 0).alias("paused"),
            F.when(F.col("id") % 3 == 0, "seeded").alias("notes"),
        )

    @stored
    def page_sources(self) -> DataFrame:
        """(page_id, source_id, domain): the source each page belongs to."""
        firsts = self.page_urls.groupBy("canonical_url").agg(F.min("page_id").alias("source_id"))
        return self.page_urls.join(firsts, "canonical_url").select("page_id", "source_id", "domain")

    @stored
    def sources(self) -> DataFrame:
        base = self.page_urls.groupBy("canonical_url", "domain").agg(F.min("page_id").alias("id"))
        latest = self.documents.groupBy("source_id").agg(
            F.max("id").alias("latest"), F.max_by("title", "id").alias("title")
        )
        sid = F.col("id")
        status = F.when(sid % 10 < 2, "pending").when(sid % 10 == 2, "failed").otherwise("succeeded")
        dom = self.domains.select(F.col("id").alias("domain_id"), "domain")
        crawled = F.when((status != "pending") & (sid % 11 != 0), plus_seconds(day("2024-01-30"), -86400 * (sid % 40)))
        return (
            base.join(dom, "domain")
            .join(latest, base.id == latest.source_id, "left")
            .select(
                "id", F.col("canonical_url").alias("url"), "canonical_url", "domain_id",
                pick(sid % 4, ("article", "program", "forum", None)).alias("source_type"),
                F.when(status != "pending", F.col("title")).alias("title"),
                F.when(sid % 3 == 0, F.concat(F.lit("Coach "), sid % 17)).alias("author"),
                status.alias("status"), crawled.alias("last_crawled_at"),
                F.when(status != "pending", F.col("latest")).alias("latest_document_id"),
                plus_seconds(day("2023-12-01"), sid * 60).alias("created_at"),
            )
        )

    # -- documents and their children ---------------------------------------
    def _described(self) -> DataFrame:
        """Raw documents with all that follows from their own row; no join, so texts stay where they are."""
        doc = F.col("doc_id")
        body = F.col("text")
        words = F.regexp_replace(F.regexp_extract(body, r"^\s*(\S+(?:\s+\S+){0,5})", 1), r"\s+", " ")
        theme = F.when(doc % 10 == 0, F.concat(pick(F.floor(doc / 10) % 12, TITLE_THEMES), F.lit(" ")))
        title = F.concat(F.coalesce(theme, F.lit("")), words)
        summary = F.when(doc % 4 != 3, T.first_sentence(body))
        size = F.length(T.strip(body))
        tier = F.when(size >= 2000, 0.3).when(size >= 500, 0.2).when(size >= 120, 0.1).otherwise(0.0)
        score = (
            F.lit(0.2) + F.when(title != "", 0.15).otherwise(0.0) + tier
            + F.when(summary.isNotNull(), 0.05).otherwise(0.0)
            + F.when(doc % 3 > 0, 0.2).otherwise(0.0)
            + F.when((doc % 3 > 0) | (doc % 4 == 0), 0.05).otherwise(0.0)
        )
        created = plus_seconds(day("2024-01-01"), doc * 3600)
        return self.raw("documents").select(
            doc.alias("id"), F.pmod(F.floor(doc / 4), F.lit(self.page_count)).alias("page_id"),
            F.when(doc % 13 != 0, doc).alias("crawl_job_id"),
            F.when(doc % 5 != 0, plus_seconds(created, -86400 * (doc % 30 + 1))).alias("published_at"),
            body.alias("raw_text"), title.alias("title"), summary.alias("summary"),
            F.when(doc % 17 != 0, F.round(score, 6)).alias("parse_confidence"),
            created.alias("created_at"),
        )

    @property
    def document_texts(self) -> DataFrame:
        """(id, raw_text): a scan of the raw table. Texts join what was selected by id, at the end."""
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"))

    @property
    def document_bodies(self) -> DataFrame:
        """(id, title, summary, raw_text) of every document: a map over the raw table."""
        return self._described().select("id", "title", "summary", "raw_text")

    @stored
    def documents(self) -> DataFrame:
        """Documents without their texts: only ids and short columns meet the pages."""
        docs = self._described().drop("raw_text")
        return docs.join(self.page_sources.select("page_id", "source_id"), "page_id").drop("page_id")

    @property
    def document_keys(self) -> DataFrame:
        """Documents without their text."""
        return self.documents.select("id", "source_id", "crawl_job_id", "created_at")

    @stored
    def programs(self) -> DataFrame:
        doc, i = F.col("document_id"), F.col("i")
        k = doc + i
        base = self.documents.select(
            F.col("id").alias("document_id"), F.col("summary").alias("doc_summary"),
            F.col("title").alias("doc_title"), F.col("created_at").alias("doc_created"),
        ).where(doc % 3 > 0)
        rows = base.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), doc % 3)))
        lead = F.regexp_extract("doc_title", r"^(\S+(?: \S+){0,2})", 1)
        theme = F.when(doc % 6 == 2, F.lit("Builder")).otherwise(pick(k % 7, PROGRAM_THEMES))
        return rows.select(
            (doc * 10 + i).alias("id"), "document_id",
            F.when(k % 10 != 9, F.concat(lead, F.lit(" "), theme)).alias("name"),
            F.when(k % 4 == 0, F.concat(F.lit("Coach "), k % 23)).alias("coach_name"),
            F.when(k % 4 != 0, (2 + k % 5)).alias("days_per_week"),
            pick(k % 8, SPECIALIZATIONS).alias("specialization"),
            pick(k % 4, LEVELS).alias("experience_level"),
            pick(k % 6, PROGRESSIONS).alias("progression_type"),
            pick(k % 5, SPLITS).alias("split_type"),
            F.when(k % 6 != 5, F.col("doc_summary")).alias("summary"),
            F.when(k % 9 != 0, ((doc * 7 + i) % 101) / 100).alias("confidence"),
            plus_seconds(F.col("doc_created"), i * 3600).alias("created_at"),
        )

    @stored
    def claim_refs(self) -> DataFrame:
        """Extracted claims with their unresolved program reference."""
        base = self.documents.select(F.col("id").alias("document_id"), "title", "summary")
        doc, pos = F.col("document_id"), F.col("pos")
        n = doc % 3
        total = n + F.when(doc % 4 == 0, 1).otherwise(0)
        rows = base.where(total > 0).withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), total)))
        k = doc + pos
        named = F.concat(F.regexp_extract("title", r"^(\S+(?: \S+){0,2})", 1), F.lit(" Builder"))
        ref = (
            F.when(k % 5 == 0, (pos - 1).cast("string"))
            .when(k % 5 == 1, n.cast("string"))
            .when(k % 5 == 2, F.concat(F.lit(" "), F.lower(named), F.lit(" ")))
            .when(k % 5 == 3, F.lit("999"))
        )
        return rows.select(
            (doc * 10 + pos).alias("id"), "document_id", "pos", ref.alias("raw_ref"),
            pick(k % 4, ("volume", "frequency", "intensity", None)).alias("claim_type"),
            F.when(k % 7 != 0, F.col("summary")).alias("raw_text"),
            F.when(k % 3 == 0, F.concat(k % 20, F.lit(" sets"))).alias("normalized_value"),
            F.when(k % 8 != 0, (k % 101) / 100).alias("confidence"),
        )

    @stored
    def payloads(self) -> DataFrame:
        """(document_id, source_id, url, output): raw extraction output as text.

        The forms rotate: object, alternate keys, fenced block, list, plain
        text and scalars, object with odd field types.
        """
        doc = F.col("document_id")
        src = self.sources.select(F.col("id").alias("source_id"), "url")
        keys = self.document_keys.join(src, "source_id").select("id", "source_id", "url")
        texts = T.plain_texts(self.document_texts.withColumnRenamed("raw_text", "text"))
        docs = texts.join(keys, "id").withColumnRenamed("id", "document_id")
        plain = F.col("plain")
        body = F.when(doc % 11 == 0, "Short.").when(doc % 7 == 0, F.concat(F.lit("Summary: "), plain)).otherwise(plain)

        def filled(template: str) -> Column:
            """Put the document id for ``#`` and its text for ``@``."""
            parts = []
            for i, piece in enumerate(template.split("@")):
                if i:
                    parts.append(body)
                for j, bit in enumerate(piece.split("#")):
                    if j:
                        parts.append(doc.cast("string"))
                    parts.append(F.lit(bit))
            return F.concat(*parts)

        first = F.when(doc % 3 == 0, filled(PAYLOAD_OBJECT_BARE)).otherwise(filled(PAYLOAD_OBJECT))
        wrapped = F.concat(F.lit('"'), F.replace(filled(PAYLOAD_OBJECT_BARE), F.lit('"'), F.lit('\\"')), F.lit('"'))
        output = (
            F.when(doc % 12 == 6, wrapped)
            .when(doc % 6 == 0, first)
            .when(doc % 12 == 1, filled(PAYLOAD_ALIASES))
            .when(doc % 12 == 7, filled(PAYLOAD_ALIASES_BARE))
            .when(doc % 6 == 2, F.concat(F.lit("Here it is\n```json\n"), filled(PAYLOAD_OBJECT), F.lit("\n```\nDone")))
            .when(doc % 6 == 3, F.concat(F.lit("["), filled(PAYLOAD_OBJECT), F.lit("]")))
            .when(doc % 30 == 4, "42").when(doc % 30 == 10, "true").when(doc % 30 == 16, "null")
            .when(doc % 90 == 22, "1.5").when(doc % 90 == 52, F.lit(None).cast("string"))
            .when(doc % 6 == 4, body)
            .otherwise(filled(PAYLOAD_ODD))
        )
        return docs.select("document_id", "source_id", "url", output.alias("output"))

    # -- crawling -----------------------------------------------------------
    @stored
    def crawl_jobs(self) -> DataFrame:
        ev, kind = F.col("event_id"), F.col("event_type")
        jobs = self.raw("events").select(
            "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"),
            F.pmod(F.floor(ev / 40), F.lit(self.page_count)).alias("page_id"),
        )
        urls = self.page_sources.join(self.page_urls.select("page_id", "canonical_url"), "page_id")
        discover = kind == "signup"
        status = (
            F.when(kind == "error", "failed")
            .when((kind == "view") & (ev % 50 == 0), "running")
            .when(discover & (ev % 40 == 0), "pending")
            .otherwise("succeeded")
        )
        started = F.when(ev % 97 != 0, F.col("ts"))
        failed = kind == "error"
        return jobs.join(urls, "page_id").select(
            ev.alias("id"), F.when(discover, "discover").otherwise("extract").alias("job_type"),
            F.when(~discover, F.col("source_id")).alias("source_id"),
            F.when(discover, F.concat(F.lit("https://"), F.col("domain")))
            .otherwise(F.col("canonical_url")).alias("target_url"),
            status.alias("status"), (ev % 3).alias("retry_count"),
            F.when(ev % 6 != 0, F.col("value") / 100).alias("cost"),
            started.alias("started_at"),
            F.when(status.isin("succeeded", "failed"), plus_seconds(started, ev % 600)).alias("completed_at"),
            F.when(failed, pick(ev % 18, ERROR_MESSAGES)).alias("error_message"),
            F.when(failed, pick(ev % 5, ERROR_TYPES)).alias("error_type"),
        )

    @cached_property
    def policy_files(self) -> DataFrame:
        """(body): policy documents, one JSON object per domain that has one."""
        i = F.col("id")
        rows = self.domains.where(i % 8 != 7)
        rules = (
            F.when(i % 6 == 1, '"admission_min_succeeded_sources": 2.0,')
            .when(i % 6 == 2, F.concat(F.lit('"admission_max_recent_failure_rate": 0.2, "admission_recent_crawl_window": '), i % 4, F.lit(",")))
            .when(i % 6 == 3, '"admission_min_avg_parse_confidence": 0.7, "stale_after_days": 9,')
            .when(i % 6 == 4, '"admission_max_zero_program_rate": 0.3, "admission_min_succeeded_sources": null,')
            .when(i % 6 == 5, '"admission_min_succeeded_sources": 1, "admission_max_recent_failure_rate": 0.9, '
                  '"admission_min_avg_parse_confidence": 0.1, "admission_max_zero_program_rate": 0.99, "admission_recent_crawl_window": 5,')
            .otherwise("")
        )
        limit = F.when(i % 3 == 0, F.concat(F.lit('"per_domain_limit": '), i % 4, F.lit(","))).otherwise("")
        seeds = F.when(i % 5 == 0, F.lit("[]")).otherwise(
            F.concat(F.lit('["https://'), F.col("domain"), F.lit('/start", 5, " https://'), F.col("domain"), F.lit('/more "]'))
        )
        body = F.concat(
            F.lit('{" '), F.upper("domain"), F.lit(' ": {'), rules, limit, F.lit('"seed_urls": '), seeds, F.lit('}, "note": "text"}')
        )
        return rows.select(body.alias("body"))

    @stored
    def run_items(self) -> DataFrame:
        """Items of crawl runs (100 crawl jobs to a run)."""
        j = F.col("id")
        docs = self.documents.select("crawl_job_id", F.col("id").alias("document_id"), "parse_confidence")
        made = self.programs.groupBy("document_id").agg(F.count("*").alias("made"))
        src = self.sources.select(F.col("id").alias("source_id"), "domain_id")
        dom = self.domains.select(F.col("id").alias("domain_id"), "domain")
        jobs = self.crawl_jobs.join(src.join(dom, "domain_id").drop("domain_id"), "source_id", "left")
        jobs = jobs.join(docs, jobs.id == docs.crawl_job_id, "left").join(made, "document_id", "left")
        gate = (F.col("job_type") == "discover") & (j % 3 == 0)
        kind = (
            F.when(gate, "domain_gate").when(F.col("job_type") == "discover", "discover")
            .when(j % 2 == 0, "extract_pending").otherwise("refresh_empty")
        )
        status = (
            F.when(gate | ((F.col("status") == "failed") & (j % 7 == 0)), "blocked")
            .when(F.col("status").isin("failed", "succeeded"), F.col("status")).otherwise("skipped")
        )
        code = (
            F.when(gate, F.when(j % 2 == 0, "blocked_active_crawl").otherwise("blocked_domain_paused"))
            .when(status == "skipped", "dry_run")
            .when(status.isin("failed", "blocked"), error_code(F.col("error_message"), F.col("error_type")))
        )
        good = status == "succeeded"
        extract = F.col("job_type") == "extract"
        host = F.regexp_extract("target_url", "^https?://([^/]*)", 1)
        return jobs.select(
            F.floor(j / 100).alias("run_id"), j.alias("item_id"), kind.alias("item_type"), F.when(extract, kind).alias("mode"),
            F.when(extract, F.col("domain")).when(j % 4 != 0, host).alias("domain"), status.alias("status"), code.alias("error_code"),
            F.when(good & extract, F.coalesce("made", F.lit(0))).alias("program_count"),
            F.when(good & extract, F.col("parse_confidence")).alias("parse_confidence"),
            "retry_count", F.col("cost").alias("cost_usd"), F.coalesce("started_at", "completed_at").alias("at"),
        )

    # -- requests and labels ------------------------------------------------
    @cached_property
    def _request_base(self) -> DataFrame:
        bench = self.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
        turns = self.raw("conversations").where("role = 'user'").select(
            (TURN_IDS + F.col("conv_id") * TURNS + F.col("turn")).alias("query_id"), "text"
        )
        q = F.col("query_id")
        query = F.trim(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), pick(q % 19, HINTS)))
        both = bench.unionByName(turns)
        # Some come once more without any text, to browse.
        blank = both.where(q % 29 == 0).select((q + BLANK_IDS).alias("query_id"), F.lit(None).cast("string").alias("text"))
        query = F.when(q >= BLANK_IDS, "").otherwise(query)
        return both.unionByName(blank).select(
            "query_id", query.alias("query"),
            F.when(q % 12 == 8, 2 + q % 5).alias("days_per_week"),
            F.when(q % 24 == 10, "strength").alias("specialization"),
            F.when(q % 24 == 14, "beginner").alias("experience_level"),
            F.when(q % 48 == 18, "linear").alias("progression_type"),
            F.when(q % 48 == 22, "full-body").alias("split_type"),
            F.lit(None).cast("string").alias("domain"),
            pick(q % 4, ("8", "4", "1", "12")).cast("int").alias("max_sources"),
            pick(q % 3, ("20", "5", "25")).cast("int").alias("max_programs"),
            pick(q % 5, ("8", "3", "8", "25", "1")).cast("int").alias("max_evidence"),
        )

    @stored
    def asked(self) -> DataFrame:
        """A batch of search requests: whole benchmark items and user turns.

        Every fourth request is limited to one domain.
        """
        q = F.col("query_id")
        home = self.page_urls.select(F.col("page_id").alias("home"), F.col("domain").alias("home_domain"))
        base = self._request_base
        base = base.repartition(self.spark.sparkContext.defaultParallelism, "query_id")
        r = base.withColumn("home", F.when(q % 4 == 1, q % 50))
        return r.join(home, "home", "left").select(
            *[F.col("home_domain").alias("domain") if c == "domain" else c for c in base.columns]
        )

    @property
    def requests(self) -> DataFrame:
        """The requests that the service takes: longer queries are rejected as a whole, none is shortened."""
        return self.asked.where(F.length("query") <= MAX_QUERY)

    @cached_property
    def grades(self) -> DataFrame:
        """(document_id, relevance 0..3) from the quality and toxicity labels."""
        good, toxic = F.col("quality") == 1, F.col("toxic") == 1
        grade = F.when(good & ~toxic, 3).when(good, 2).when(~toxic, 1).otherwise(0)
        return self.raw("labels").select(F.col("doc_id").alias("document_id"), grade.alias("relevance"))
