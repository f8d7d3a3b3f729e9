"""Lines that a company repeats under many titles, and their removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROLE_TEXT = 300  # below this much text of its own a posting is compared by its whole description


def lines(postings: DataFrame) -> DataFrame:
    """(id, company_id, normalized_title, pos, line): lines without spaces at the ends, empty ones left out."""
    rows = postings.select("id", "company_id", "normalized_title", F.posexplode(F.split("description", "\n", -1)).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''")


def boilerplate(postings: DataFrame, min_titles: int = 3) -> DataFrame:
    """(company_id, line_hash) of lines of open postings that stand under at least min_titles titles."""
    open_lines = lines(postings.where(F.col("closed_at").isNull())).select("company_id", F.md5("line").alias("line_hash"), "normalized_title")
    # different rows first: they are combined before the shuffle, so a line of very many postings is no hot key
    titles = open_lines.distinct().groupBy("company_id", "line_hash").agg(F.count("normalized_title").alias("n"))
    return titles.where(F.col("n") >= min_titles).select("company_id", "line_hash")


def stripped(postings: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, role_text): kept lines, trimmed, each with a line end.

    The description of a company without boilerplate lines stays as it is.
    """
    ls = lines(postings).withColumn("line_hash", F.md5("line"))
    kept = ls.join(hashes, ["company_id", "line_hash"], "left_anti").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: F.concat(s["line"], F.lit("\n"))), "").alias("kept"))  # at most a posting's lines
    some = hashes.select("company_id").distinct().withColumn("some", F.lit(True))
    out = postings.select("id", "company_id", "description").join(some, "company_id", "left").join(kept, "id", "left")
    return out.select("id", F.when(F.col("some"), F.coalesce("kept", F.lit(""))).otherwise(F.col("description")).alias("role_text"))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", ""))


def compared_text(postings: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, text) by which postings are compared: the role text, or the description if that is too short."""
    roles = stripped(postings, hashes)
    return postings.select("id", "description").join(roles, "id").select("id", F.when(utf16_length(F.col("role_text")) < MIN_ROLE_TEXT, F.col("description")).otherwise(F.col("role_text")).alias("text"))
