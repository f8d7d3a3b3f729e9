import datetime as dt
import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from postmill import schemas, session
from postmill.operators import embed
from postmill.operators.embed import word_counts
from postmill.plans.schedule import Schedule, next_time
from postmill.plans.service import NotFound, PostingService, Unavailable, problem, seed_companies
from postmill.sources.embedding_api import ServiceError
from postmill.state import Conflict, VersionedTable
from postmill.streaming import boards as stream

T0 = dt.datetime(2026, 1, 1)
JOBS = "company_id long, arrival long, external_id string, title string, location string, department string, url string, description string, posted_at timestamp"
BACKEND = "Design and operate backend services in Java with databases queues and careful monitoring across many teams " * 4
SALES = "Visit customers prepare offers negotiate contracts and report the pipeline to the regional office every week " * 4


def job(company, i, title, text, posted=None):
    return (company, i, f"x{i}", title, "Graz", None, "u", text, posted)


def test_two_runs(spark, tmp_path):
    s = PostingService(spark, str(tmp_path / "app"), word_counts)
    assert s.add_company("Acme", "GREENHOUSE", " acme ").head().id == 1
    assert s.add_company("Bolt", "LEVER", "bolt").head().id == 2
    assert s.add_company("Acme Inc", "GREENHOUSE", "acme").head().name == "Acme Inc" and s.companies().count() == 2
    with pytest.raises(ValueError):
        s.add_company("x", "OTHER", "x")
    jobs = [job(1, 1, "Sr. Backend Engineer", BACKEND, T0), job(1, 2, "Senior Backend Engineer - Remote", BACKEND), job(1, 3, "Sales", SALES), job(2, 4, "Sales", SALES), job(2, 4, "Sales Lead", SALES)]
    polls = spark.createDataFrame([(1, None), (2, None)], "company_id long, error string")
    run = s.run_ingestion(spark.createDataFrame(jobs, JOBS), polls, T0).head()
    assert (run.companies_polled, run.companies_failed, run.postings_seen, run.postings_new, run.postings_closed, run.duplicates_found, run.postings_embedded) == (2, 0, 5, 4, 0, 1, 3)
    assert run.finished_at is not None
    top = s.match("backend services in Java", 10).collect()
    assert top[0].title == "Sr. Backend Engineer" and len(top) == 3 and s.postings_ranked().head()[0] == 3
    first = next(r.id for r in s.posting_table.read().collect() if r.external_id == "x1")
    assert [d.title for d in s.job_detail(first).head().duplicates] == ["Senior Backend Engineer - Remote"]
    polls = spark.createDataFrame([(1, None), (2, "timeout")], "company_id long, error string")
    run = s.run_ingestion(spark.createDataFrame(jobs[:2], JOBS), polls, T0 + dt.timedelta(days=1)).head()
    assert (run.postings_new, run.postings_closed, run.companies_failed, run.postings_embedded) == (0, 1, 1, 0)
    counts, runs = s.stats()
    assert counts.head().open_postings == 3 and counts.head().duplicate_rate == 0.333 and runs.count() == 2
    assert {r.name: r.last_poll_error for r in s.companies().collect()} == {"Acme Inc": None, "Bolt": "timeout"}
    assert s.search(q="sales").count() == 1
    with pytest.raises(NotFound):
        s.job_detail(4711)
    with pytest.raises(ValueError):
        s.match(" ")
    with pytest.raises(ValueError):
        s.match("x", 501)
    with pytest.raises(Unavailable):
        PostingService(spark, str(tmp_path / "app")).match("x")


def test_a_batch_that_comes_again_is_one_run(spark, tmp_path, monkeypatch):
    s = PostingService(spark, str(tmp_path / "app"))
    s.company_table.write(spark.createDataFrame([(1, "A", "GREENHOUSE", "a", True, None, None)], schemas.COMPANIES))
    payload = json.dumps({"jobs": [{"id": 1, "title": "T", "absolute_url": "u", "content": "x"}]})
    batch = spark.createDataFrame([(1, "GREENHOUSE", payload, None, T0)], stream.PAYLOADS)
    run = stream.ingest_batch(s, "inbox")
    # the run breaks off after it has merged
    with monkeypatch.context() as m:
        m.setattr(s, "embed_pending", lambda: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run(batch, 0)
    assert [(r.id, r.finished_at) for r in s.run_table.read().collect()] == [(1, None)]
    run(batch, 0)
    first = s.run_table.read().head()
    assert first.id == 1 and first.finished_at is not None and s.posting_table.read().count() == 1
    stream.ingest_batch(s, "inbox")(batch, 0)
    assert s.run_table.read().collect() == [first]
    stream.ingest_batch(s, "inbox")(batch, 1)
    stream.ingest_batch(s, "other")(batch, 0)
    assert sorted(r.id for r in s.run_table.read().collect()) == [1, 2, 3]


def test_what_requests_brought_is_saved(spark, tmp_path):
    """One request fails; the postings of the others keep their vectors and only its own are tried again."""

    def picky(texts, role):
        if any("poison" in t for t in texts):
            raise ConnectionError("refused")
        return word_counts(texts)

    s = PostingService(spark, str(tmp_path / "app"), picky)
    s.company_table.write(spark.createDataFrame([(1, "A", "LEVER", "a", True, None, None)], schemas.COMPANIES))
    polls = spark.createDataFrame([(1, None)], "company_id long, error string")
    jobs = [job(1, i, f"Title number {i}", "poison" if i == 2 else f"text {i}") for i in range(5)]
    run = s.run_ingestion(spark.createDataFrame(jobs, JOBS), polls, T0).head()
    assert run.finished_at is not None and run.postings_embedded == 0
    s.embedder = word_counts
    assert s.embed_pending() == 5
    s.posting_table.write(s.posting_table.read().withColumn("embedding_hash", F.lit(None).cast("string")))
    s.embedder = picky
    tried = embed.attempted(s.posting_table.read().coalesce(1), s.company_table.read(), picky, batch=1).collect()
    assert {r.error for r in tried} == {None, "refused"} and any(r.embedding for r in tried)
    with pytest.raises(RuntimeError, match="refused"):
        s.embed_pending()
    with pytest.raises(Exception, match="refused"):
        embed.embed_pending(s.posting_table.read(), s.company_table.read(), picky).collect()


def test_background_run_schedule_and_problems(spark, tmp_path, monkeypatch):
    s = PostingService(spark, str(tmp_path / "app"))
    s.company_table.write(spark.createDataFrame([(1, "A", "LEVER", "a", True, None, None)], schemas.COMPANIES))
    go, at = threading.Event(), []
    monkeypatch.setattr(s, "_run", lambda jobs, polls, run_at, run_id: (at.append(run_at), go.wait(60)))
    running = s.start_ingestion({"LEVER": "http://127.0.0.1:9/{token}"}, T0)
    while not at:
        time.sleep(0.05)
    assert s.stats()[0].head().ingestion_running and s.start_ingestion({}, T0) is None
    go.set()
    running.result(60)
    assert not s.stats()[0].head().ingestion_running
    times = iter([T0, T0 + dt.timedelta(hours=5, minutes=59, seconds=59.9), T0 + dt.timedelta(hours=5, minutes=59, seconds=59.9), T0 + dt.timedelta(hours=6)])
    done, errors = threading.Event(), []

    def ingest(templates, run_at):
        at.append(run_at)
        if len(at) == 2:
            raise ValueError("down")
        done.set()

    monkeypatch.setattr(s, "ingest_boards", ingest)
    schedule = Schedule(s, {}, failed=errors.append, now=lambda: next(times, T0 + dt.timedelta(hours=7))).start()
    assert done.wait(30)
    schedule.stop(10)
    assert at[1:] == [T0, T0 + dt.timedelta(hours=6)] and [str(e) for e in errors] == ["down"]
    assert next_time(T0, dt.timedelta(hours=6)) == T0 + dt.timedelta(hours=6)
    assert problem(ServiceError(429, "slow")) == (502, "Upstream API returned 429") and problem(Unavailable("no")) == (503, "no")
    assert problem(NotFound(7))[0] == 404 and problem(ValueError("blank"))[0] == 400 and problem(OSError()) is None


def test_a_version_is_written_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), StructType([StructField("a", LongType())]))
    one = lambda n: spark.createDataFrame([(n,)], "a long")
    assert t.read().count() == 0 and t.write(one(1)) == 1 and t.write(one(2)) == 2
    # a writer that read version 1 comes too late
    with pytest.raises(Conflict):
        t.write(one(9), expect=1)
    assert t.read().head().a == 2 and t.read(1).head().a == 1
    for n in range(3, 7):
        t.write(one(n))
    t.vacuum(2)
    assert t.version() == 6 and t.read().head().a == 6 and t.read(5).head().a == 5
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("data")]) == 2


def test_cut_tables_go_with_their_scope(spark):
    with session.scratch():
        inner = session.cut(spark.range(3))
        assert inner.count() == 3
    assert inner._cut_path not in session._live
    outer = session.cut(spark.range(3))
    assert outer.count() == 3
    session.release(outer)
    assert outer._cut_path not in session._live


def test_small_scans_are_spread(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(1000).coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path).where("id > 9").select((F.col("id") + 1).alias("n"))
    out = session.spread(scan)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and out.count() == 990
    for other in (spark.range(5).coalesce(1), scan.groupBy("n").count(), scan.join(scan, "n")):
        assert session.spread(other) is other
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        large = spark.read.parquet(path)  # beyond what opening a file per core costs
        assert session.spread(large) is large
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stream_of_payloads(spark, tmp_path):
    board = lambda *ids: json.dumps({"jobs": [{"id": i, "title": f"Job {i}", "absolute_url": "u", "updated_at": "2025-01-01T00:00:00Z", "content": f"text {i}"} for i in ids]})
    s = PostingService(spark, str(tmp_path / "app"))
    s.company_table.write(spark.createDataFrame([(1, "A", "GREENHOUSE", "a", True, None, None), (2, "B", "LEVER", "b", True, None, None)], schemas.COMPANIES))
    inbox = tmp_path / "in"
    inbox.mkdir()
    row = lambda c, source, payload, error, at: json.dumps({"company_id": c, "source": source, "payload": payload, "error": error, "polled_at": at})
    lever = json.dumps([{"id": "l1", "text": "L", "hostedUrl": "u", "createdAt": 0, "descriptionPlain": "d"}])
    (inbox / "1.json").write_text("\n".join([row(1, "GREENHOUSE", board(1, 2), None, "2026-01-01T00:00:00Z"), row(2, "LEVER", lever, None, "2026-01-01T00:00:00Z")]))
    stream.start(s, str(inbox), str(tmp_path / "cp")).awaitTermination(180)
    assert s.posting_table.read().count() == 3
    (inbox / "2.json").write_text("\n".join([row(1, "GREENHOUSE", board(2, 3), None, "2026-01-02T00:00:00Z"), row(2, "LEVER", None, "down", "2026-01-02T00:00:00Z")]))
    stream.start(s, str(inbox), str(tmp_path / "cp")).awaitTermination(180)
    assert {r.external_id: r.closed_at is None for r in s.posting_table.read().collect()} == {"1": False, "2": True, "3": True, "l1": True}
    assert s.run_table.read().count() == 2


def test_seed(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("name,source,board_token\nA,LEVER,a\nB,GREENHOUSE,b\n")
    assert {(r.name, r.id) for r in seed_companies(spark, str(tmp_path / "seed.csv")).collect()} == {("B", 1), ("A", 2)}
    (tmp_path / "bad.csv").write_text("name,source,board_token\nA,LEVER,a\nC,NONE,c\n")
    with pytest.raises(ValueError, match="NONE of C"):
        seed_companies(spark, str(tmp_path / "bad.csv"))
