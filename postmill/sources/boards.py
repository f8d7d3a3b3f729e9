"""Board payloads to normalized jobs.

One payload per board: an object with ``jobs`` or an array at the top. Both are read with a declared schema,
exploded with the position that settles repeated ids, and projected to one shape before they are united.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import schemas
from postmill.functions.html_text import escaped_html_to_text, html_parts_to_text
from postmill.functions.text import normalize_whitespace, strip

NORMALIZED = tuple(schemas.NORMALIZED.fieldNames())


def offset_timestamp(c: Column) -> Column:
    """An ISO-8601 time with offset as an instant; what can't be read is null."""
    return F.try_to_timestamp(c)


def greenhouse_jobs(jobs: DataFrame) -> DataFrame:
    """Normalized jobs of rows shaped like a job of the first board kind; other columns are kept."""
    keep = [c for c in jobs.columns if c not in schemas.GREENHOUSE_JOB.fieldNames()]
    return jobs.select(
        *keep,
        F.col("id").cast("string").alias("external_id"),
        strip(F.col("title")).alias("title"),
        F.col("location.name").alias("location"),
        F.get("departments", F.lit(0))["name"].alias("department"),
        F.col("absolute_url").alias("url"),
        escaped_html_to_text("content").alias("description"),
        offset_timestamp(F.coalesce("first_published", "updated_at")).alias("posted_at"),
    )


def lever_postings(postings: DataFrame) -> DataFrame:
    """Normalized jobs of rows shaped like a posting of the second board kind; other columns are kept."""
    keep = [c for c in postings.columns if c not in schemas.LEVER_POSTING.fieldNames()]
    blank = F.lit("")
    contents = html_parts_to_text(F.transform("lists", lambda l: l["content"]))
    parts = F.zip_with(F.col("lists"), contents, lambda l, t: F.concat(F.lit("\n\n"), F.coalesce(l["text"], blank), F.lit("\n"), t))
    description = F.concat(F.coalesce("descriptionPlain", blank), F.coalesce(F.array_join(parts, ""), blank), F.when(F.col("additionalPlain").isNotNull(), F.concat(F.lit("\n\n"), "additionalPlain")).otherwise(blank))
    return postings.select(
        *keep,
        F.col("id").alias("external_id"),
        strip(F.col("text")).alias("title"),
        F.col("categories.location").alias("location"),
        F.coalesce("categories.team", "categories.department").alias("department"),
        F.col("hostedUrl").alias("url"),
        normalize_whitespace(description).alias("description"),
        F.timestamp_millis("createdAt").alias("posted_at"),
    )


def read_greenhouse(spark: SparkSession, path: str) -> DataFrame:
    """Boards stored as JSON files; a missing job list is empty. Columns: file, arrival and the normalized ones."""
    boards = spark.read.schema(schemas.GREENHOUSE_BOARD).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    return greenhouse_jobs(boards.select("file", F.posexplode("jobs").alias("arrival", "j")).select("file", "arrival", "j.*"))


def read_lever(spark: SparkSession, path: str) -> DataFrame:
    """Boards stored as JSON arrays."""
    rows = spark.read.schema(schemas.LEVER_POSTING).option("multiLine", True).json(path)
    return lever_postings(rows.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("arrival"), "*"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"GREENHOUSE": read_greenhouse, "LEVER": read_lever}


def read_boards(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All boards of all sources as one DataFrame; an unknown source is an error."""
    out = None
    for source, path in paths.items():
        if source not in READERS:
            raise ValueError(f"no reader for source {source}")
        part = READERS[source](spark, path).withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no boards given")
    return out


def from_json_column(rows: DataFrame, payload: str, source: str) -> DataFrame:
    """Normalized jobs of payloads held in a string column; other columns are kept, with ``arrival``."""
    keep = [c for c in rows.columns if c != payload]
    if source == "GREENHOUSE":
        parsed = rows.select(*keep, F.from_json(payload, schemas.GREENHOUSE_BOARD)["jobs"].alias("_p"))
        project = greenhouse_jobs
    elif source == "LEVER":
        parsed = rows.select(*keep, F.from_json(payload, "array<" + schemas.LEVER_POSTING.simpleString() + ">").alias("_p"))
        project = lever_postings
    else:
        raise ValueError(f"no reader for source {source}")
    return project(parsed.select(*keep, F.posexplode("_p").alias("arrival", "_j")).select(*keep, "arrival", "_j.*"))
