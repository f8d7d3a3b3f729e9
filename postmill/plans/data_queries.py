"""Queries of the general data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import incremental, snapshot_diff
from postmill.session import scratch_folder, table

_KEY = r"lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.replay(table(spark, sf_dir, "posting_feed"), table(spark, sf_dir, "ingestion_runs"))


def p1_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the live consumer, run by run."""
    return incremental.consumed(table(spark, sf_dir, "posting_feed"), table(spark, sf_dir, "ingestion_runs"), scratch_folder(spark, "consumer"))


P1_SQL = """
WITH done AS (SELECT id FROM ingestion_runs WHERE finished_at IS NOT NULL),
owned AS (SELECT f.posting_id, f.content_hash, f.last_seen_at, f.seq, (SELECT min(d.id) FROM done d WHERE d.id >= f.run_id) AS run
  FROM posting_feed f WHERE f.posting_id IS NOT NULL AND f.run_id IS NOT NULL AND f.last_seen_at IS NOT NULL),
best AS (SELECT run, posting_id, content_hash, last_seen_at, seq FROM owned WHERE run IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run, posting_id ORDER BY last_seen_at DESC, seq DESC) = 1),
state AS (SELECT d.id AS run, b.posting_id, b.content_hash FROM done d JOIN best b ON b.run <= d.id
  QUALIFY row_number() OVER (PARTITION BY d.id, b.posting_id ORDER BY b.last_seen_at DESC, b.seq DESC) = 1),
prev AS (SELECT id, lag(id) OVER (ORDER BY id) AS before FROM done)
SELECT CAST(s.run AS BIGINT) AS run_id, CAST(s.posting_id AS BIGINT) AS posting_id FROM state s JOIN prev p ON p.id = s.run
LEFT JOIN state o ON o.run = p.before AND o.posting_id = s.posting_id
WHERE o.posting_id IS NULL OR o.content_hash IS DISTINCT FROM s.content_hash
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshot_diff.board_changes(table(spark, sf_dir, "board_snapshots"), table(spark, sf_dir, "board_polls"))
    return found.select(F.col("run_id").cast("long").alias("run_id"), F.col("company_id").cast("long").alias("company_id"), "external_id", "change_kind")


FIELDS = ("content_hash", "title", "location", "department", "url", "posted_at")


def p6_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of changed records that differs, also those that the content hash does not cover."""
    found = snapshot_diff.board_changes(table(spark, sf_dir, "board_snapshots"), table(spark, sf_dir, "board_polls"), FIELDS)
    return found.where("change_kind = 'changed'").select("run_id", "company_id", "external_id", F.concat_ws(",", "changed_fields").alias("fields"))


_P6_ROWS = f"""
WITH polls AS (SELECT company_id, run_id, lag(run_id) OVER (PARTITION BY company_id ORDER BY run_id) AS before
  FROM board_polls WHERE poll_error IS NULL),
snap AS (SELECT s.run_id, s.company_id, {_KEY.format(c="s.external_id")} AS external_id, {_KEY.format(c="s.content_hash")} AS content_hash,
    s.title, s.location, s.department, s.url, s.posted_at
  FROM board_snapshots s JOIN polls p ON p.company_id = s.company_id AND p.run_id = s.run_id
  WHERE {_KEY.format(c="s.external_id")} <> ''
  QUALIFY row_number() OVER (PARTITION BY s.run_id, s.company_id, {_KEY.format(c="s.external_id")} ORDER BY s.arrival_seq DESC) = 1)
"""
P6_SQL = (
    _P6_ROWS
    + """
SELECT CAST(p.run_id AS BIGINT) AS run_id, CAST(p.company_id AS BIGINT) AS company_id, n.external_id, CASE WHEN o.external_id IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM polls p JOIN snap n ON n.company_id = p.company_id AND n.run_id = p.run_id
LEFT JOIN snap o ON o.company_id = p.company_id AND o.run_id = p.before AND o.external_id = n.external_id
WHERE p.before IS NOT NULL AND (o.external_id IS NULL OR o.content_hash IS DISTINCT FROM n.content_hash)
UNION ALL
SELECT p.run_id, p.company_id, o.external_id, 'removed' FROM polls p JOIN snap o ON o.company_id = p.company_id AND o.run_id = p.before
LEFT JOIN snap n ON n.company_id = p.company_id AND n.run_id = p.run_id AND n.external_id = o.external_id
WHERE n.external_id IS NULL
"""
)
P6_FIELDS_SQL = (
    _P6_ROWS
    + "SELECT * FROM (SELECT n.run_id, n.company_id, n.external_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN o.{f} IS DISTINCT FROM n.{f} THEN '{f}' END" for f in sorted(FIELDS))
    + """) AS fields
FROM polls p JOIN snap n ON n.company_id = p.company_id AND n.run_id = p.run_id
JOIN snap o ON o.company_id = p.company_id AND o.run_id = p.before AND o.external_id = n.external_id) WHERE fields <> ''
"""
)

QUERIES = {"p1_found": p1_found, "p1_consumed": p1_consumed, "p6_found": p6_found, "p6_changed_fields": p6_changed_fields}
SQL = {"p1_found": P1_SQL, "p1_consumed": P1_SQL, "p6_found": P6_SQL, "p6_changed_fields": P6_FIELDS_SQL}
