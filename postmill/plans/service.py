"""The application's calls as Python: ingestion runs, search, detail, statistics and ranking."""

from __future__ import annotations

import threading
from concurrent.futures import Future
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import schemas
from postmill.functions.text import content_hash, title_key
from postmill.operators import cluster, embed, search, snapshot
from postmill.operators.embed import Embedder
from postmill.session import cut, scratch
from postmill.sources.boards import from_json_column
from postmill.sources.documents import read_documents
from postmill.sources.embedding_api import ServiceError
from postmill.sources.http import poll
from postmill.state import VersionedTable

_ONE_RUN = threading.Lock()


class Unavailable(RuntimeError):
    """Ranking was asked for without an embedder."""


class NotFound(LookupError):
    pass


def problem(e: Exception) -> tuple[int, str] | None:
    """Status and text that a web layer answers a call's error with; None for what it should not have caught."""
    if isinstance(e, NotFound):
        return 404, f"no posting {e}"
    if isinstance(e, Unavailable):
        return 503, str(e)
    if isinstance(e, ServiceError):
        return 502, f"Upstream API returned {e.status}"
    if isinstance(e, ValueError):
        return 400, str(e)
    return None


def normalized_postings(jobs: DataFrame) -> DataFrame:
    """Normalized jobs (company_id, arrival and the columns of ``schemas.NORMALIZED``) as snapshot rows: title
    key and content hash added, of repeated ids the last one kept.
    """
    rows = jobs.withColumn("normalized_title", title_key(F.col("title"), F.col("location"))).withColumn("content_hash", content_hash(F.col("title"), F.col("location"), F.col("department"), F.col("description")))
    return snapshot.last_per_key(rows.select(*snapshot.KEY, "arrival", *snapshot.OVERWRITTEN, "posted_at"), snapshot.KEY, "arrival").drop("arrival")


def payload_jobs(polled: DataFrame) -> DataFrame:
    """Normalized jobs of board payloads (company_id, source, payload, error)."""
    good = polled.where(F.col("error").isNull() & F.col("payload").isNotNull())
    parts = [from_json_column(good.where(F.col("source") == s).select("company_id", "payload"), "payload", s) for s in schemas.SOURCES]
    return parts[0].unionByName(parts[1])


@dataclass
class PostingService:
    """State lives in three versioned tables below ``folder``, which all executors share."""

    spark: SparkSession
    folder: str
    embedder: Embedder | None = None
    threshold: float = 0.7
    shingle: int = 4
    min_titles: int = 3
    embed_limit: int | None = None
    concurrency: int = 8
    keep_versions: int = 3  # of each table; readers of older ones fail

    def __post_init__(self):
        make = lambda name, schema: VersionedTable(self.spark, f"{self.folder}/{name}", schema)
        self.company_table, self.posting_table, self.run_table = make("companies", schemas.COMPANIES), make("postings", schemas.POSTINGS), make("runs", schemas.RUNS)

    def companies(self, enabled_only: bool = False) -> DataFrame:
        rows = self.company_table.read()
        return (rows.where("enabled") if enabled_only else rows).orderBy("name")

    def add_company(self, name: str, source: str, board_token: str) -> DataFrame:
        if source not in schemas.SOURCES:
            raise ValueError(f"unknown source {source}")
        if not name.strip() or not board_token.strip():
            raise ValueError("name and token must not be blank")
        new = self.spark.createDataFrame([(name, source, board_token)], "name string, source string, board_token string")
        self.company_table.write(snapshot.add_companies(self.company_table.read(), new))
        return self.company_table.read().where((F.col("source") == source) & (F.col("board_token") == board_token.strip()))

    def next_run(self) -> int:
        return (self.run_table.read().agg(F.max("id")).head()[0] or 0) + 1

    def finished(self, run_id: int) -> bool:
        return not self.run_table.read().where((F.col("id") == run_id) & F.col("finished_at").isNotNull()).isEmpty()

    @staticmethod
    def ingestion_running() -> bool:
        return _ONE_RUN.locked()

    def run_ingestion(self, jobs: DataFrame, polls: DataFrame, run_at, run_id: int | None = None) -> DataFrame | None:
        """One run: merge, deduplicate, embed, count. Returns its row, or None if another run is going on.

        jobs: company_id, arrival and normalized columns of all boards read. polls: (company_id, error) of all
        boards tried. run_at: the run's time. run_id: that of a run that broke off and is done again. A run that
        breaks off leaves its row without finished_at; what it had committed stays, and the next run does the rest.
        """
        if not _ONE_RUN.acquire(blocking=False):
            return None
        try:
            with scratch():
                self._run(jobs, polls, run_at, run_id := run_id or self.next_run())
            for t in (self.posting_table, self.company_table, self.run_table):
                t.vacuum(self.keep_versions)
            return self.run_table.read().where(F.col("id") == run_id)
        finally:
            _ONE_RUN.release()

    def _run(self, jobs: DataFrame, polls: DataFrame, run_at, run_id: int) -> None:
        at = F.lit(run_at).cast("timestamp")
        polls = cut(polls.select("company_id", "error"))
        self.run_table.write(snapshot.start_run(self.run_table.read(), run_id, at))
        ok = polls.where(F.col("error").isNull())
        merged = cut(snapshot.merge(self.posting_table.read(), normalized_postings(jobs), ok, at))
        counters = snapshot.poll_counters(merged, jobs, polls).head().asDict()
        state = merged.drop("change")
        links = cut(cluster.deduplicate(state, self.threshold, self.shingle, self.min_titles))
        counters["duplicates_found"] = links.count()
        self.posting_table.write(snapshot.replace_links(state, links))
        self.company_table.write(snapshot.record_polls(self.company_table.read(), polls, at))
        counters["postings_embedded"] = 0
        try:
            counters["postings_embedded"] = self.embed_pending()
        except Exception as e:  # embedding is tried again by the next run
            print(f"embedding failed: {e}")
        self.run_table.write(snapshot.finish_run(self.run_table.read(), run_id, F.current_timestamp(), counters))

    def embed_pending(self) -> int:
        """Embeds and saves; returns how many. What requests brought is saved before one that failed is an error."""
        with scratch():
            postings = self.posting_table.read()
            tried = cut(embed.attempted(postings, self.company_table.read(), self.embedder, self.embed_limit))
            got = tried.where(F.col("error").isNull())
            n = got.count()
            if n:
                self.posting_table.write(snapshot.save_embeddings(postings, got))
            failed = tried.where(F.col("error").isNotNull()).select("error").head()
        if failed:
            raise RuntimeError(f"{failed[0]} ({n} embeddings were saved)")
        return n

    def search(self, **options) -> DataFrame:
        return search.search(self.posting_table.read(), self.company_table.read(), **options)

    def job_detail(self, posting_id: int) -> DataFrame:
        found = search.job_detail(self.posting_table.read(), self.company_table.read(), posting_id)
        if found.isEmpty():
            raise NotFound(posting_id)
        return found

    def stats(self) -> tuple[DataFrame, DataFrame]:
        """Counts, and the last five runs."""
        counts = search.stats(self.posting_table.read(), self.company_table.read()).withColumn("ingestion_running", F.lit(self.ingestion_running()))
        return counts, search.recent_runs(self.run_table.read())

    def match(self, text: str, limit: int = 25, location: str | None = None, over_fetch: bool = False) -> DataFrame:
        if not text or not text.strip():
            raise ValueError("the text must not be blank")
        if not 1 <= limit <= 500:
            raise ValueError("limit must be from 1 to 500")
        if self.embedder is None:
            raise Unavailable("ranking needs an embedder")
        query = [float(x) for x in self.embedder([text], "query")[0]]
        return search.match(self.posting_table.read(), self.company_table.read(), query, limit, location, over_fetch)

    def match_document(self, path: str, limit: int = 25, location: str | None = None, content_type: str | None = None) -> DataFrame:
        """Ranking by the text of an uploaded file, a PDF by its suffix or content type; the limit is clamped."""
        text = "\n".join(r.text for r in read_documents(self.spark, path, content_type).select("text").collect())  # the caller's one file
        if not text.strip():
            raise ValueError("no text could be read from the file")
        return self.match(text, search.clamped(limit)[0], location)

    def ingest_boards(self, templates: dict[str, str], run_at, timeout: float = 30) -> DataFrame | None:
        """Polls the boards of all enabled companies, ``concurrency`` at once, and runs an ingestion over what they list."""
        with scratch():
            polled = cut(poll(self.spark, self.company_table.read(), templates, timeout, self.concurrency))
            return self.run_ingestion(payload_jobs(polled), polled.select("company_id", "error"), run_at)

    def start_ingestion(self, templates: dict[str, str], run_at, timeout: float = 30) -> Future | None:
        """``ingest_boards`` in the background; None if a run is going on. ``stats`` tells whether one is."""
        if self.ingestion_running():
            return None
        out: Future = Future()

        def work() -> None:
            try:
                out.set_result(self.ingest_boards(templates, run_at, timeout))
            except Exception as e:
                out.set_exception(e)

        threading.Thread(target=work, daemon=True).start()
        return out

    def postings_ranked(self) -> DataFrame:
        return search.postings_ranked(self.posting_table.read())


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row, in column ``value``."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def seed_companies(spark: SparkSession, csv_path: str) -> DataFrame:
    """The first table of companies from a CSV file with name, source, board_token; an unknown source is an error."""
    rows = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "source", "board_token")])).option("header", True).csv(csv_path)
    if unknown := rows.where(~F.coalesce(F.col("source").isin(*schemas.SOURCES), F.lit(False))).select("name", "source").head():
        raise ValueError(f"unknown source {unknown.source} of {unknown.name}")
    return snapshot.add_companies(spark.createDataFrame([], schemas.COMPANIES), rows)
