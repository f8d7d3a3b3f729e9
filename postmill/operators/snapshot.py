"""Merging full board snapshots into the table of postings.

Parquet has no MERGE: a merge is one full outer join of the state with the snapshot and a projection that
decides per column. The result is a new version of the table (see ``postmill.state``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.schemas import COUNTERS
from postmill.session import cut

KEY = ["company_id", "external_id"]
#: what a snapshot overwrites in a posting that exists
OVERWRITTEN = ["title", "normalized_title", "location", "department", "url", "description", "content_hash"]


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same key the one of the greatest order (later rows of a snapshot win).

    An aggregate with map-side combination, so a key with very many rows does not meet in one task.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*")


def merge(state: DataFrame, snapshot: DataFrame, polled: DataFrame, run_at: Column) -> DataFrame:
    """The new state and, in column ``change``, what became of each posting.

    state: postings with columns as in ``schemas.POSTINGS``. snapshot: one row per key with company_id,
    external_id, the overwritten columns and posted_at. polled: company_id of the boards read successfully;
    an empty successful board closes all of its postings, a failed one closes none, and rows of boards that
    are not in ``polled`` are left aside.

    change: 'created', 'seen', 'reopened', 'closed', or null for what was not touched. A posting that is seen
    keeps its id, first sighting, links and embedding; its first known posted_at stays; it is open again. A
    posting that is missing is closed and loses its link. New ids follow the largest id, in key order.
    """
    read = polled.select("company_id").distinct()
    snap = snapshot.join(read, "company_id", "left_semi").select(*KEY, *[F.col(c).alias(f"s_{c}") for c in [*OVERWRITTEN, "posted_at"]], F.lit(True).alias("s_there"))
    # the state's rows of read boards, marked; the list of boards is joined, not collected
    old = state.join(read.withColumn("_read", F.lit(True)), "company_id", "left")
    both = old.join(snap, KEY, "full_outer")
    there, known = F.coalesce("s_there", F.lit(False)), F.col("id").isNotNull()
    missing = known & ~there & F.coalesce("_read", F.lit(False)) & F.col("closed_at").isNull()
    change = F.when(there & ~known, "created").when(there & F.col("closed_at").isNotNull(), "reopened").when(there, "seen").when(missing, "closed")
    out = {c: F.col(c) for c in state.columns}
    out |= {c: F.when(there, F.col(f"s_{c}")).otherwise(F.col(c)) for c in OVERWRITTEN}
    out["posted_at"] = F.when(there, F.coalesce("posted_at", "s_posted_at")).otherwise(F.col("posted_at"))
    out["first_seen_at"] = F.coalesce("first_seen_at", run_at)
    out["last_seen_at"] = F.when(there, run_at).otherwise(F.col("last_seen_at"))
    out["closed_at"] = F.when(there, F.lit(None).cast("timestamp")).when(missing, run_at).otherwise(F.col("closed_at"))
    out["canonical_id"] = F.when(missing, F.lit(None).cast("long")).otherwise(F.col("canonical_id"))
    # written: the rows with id and the new ones are read apart
    merged = cut(both.select(*[out[c].alias(c) for c in state.columns], change.alias("change")))
    return with_new_ids(merged, state)


def with_new_ids(merged: DataFrame, state: DataFrame) -> DataFrame:
    """Rows without id get ids after the largest, in key order.

    The new rows are sorted over all partitions; each partition's offset is the number of new rows before
    it, so ids are dense although nothing is numbered in one task.
    """
    new = cut(merged.where(F.col("id").isNull()).repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()))
    counts = new.groupBy("_part").agg(F.count("*").alias("_c"), F.min("_n").alias("_low"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    top = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = new.join(F.broadcast(before), "_part").crossJoin(F.broadcast(top))  # one row per partition; one row
    rest = [c for c in merged.columns if c != "id"]
    numbered = numbered.select((F.col("_top") + F.col("_before") + F.col("_n") - F.col("_low") + 1).alias("id"), *rest).select(*merged.columns)
    return merged.where(F.col("id").isNotNull()).unionByName(numbered)


def poll_counters(merged: DataFrame, snapshot_rows: DataFrame, polls: DataFrame) -> DataFrame:
    """One row of run counters: boards read and failed, rows seen (repeats too), created and closed.

    polls: (company_id, error), error null for boards that were read; only those count.
    """
    ok = polls.where(F.col("error").isNull()).select("company_id").distinct()
    seen = snapshot_rows.join(ok, "company_id", "left_semi").agg(F.count("*").cast("int").alias("postings_seen"))
    changes = merged.agg(F.count_if(F.col("change") == "created").cast("int").alias("postings_new"), F.count_if(F.col("change") == "closed").cast("int").alias("postings_closed"))
    boards = polls.agg(F.count_if(F.col("error").isNull()).cast("int").alias("companies_polled"), F.count_if(F.col("error").isNotNull()).cast("int").alias("companies_failed"))
    return boards.crossJoin(seen).crossJoin(changes)  # one row each


def start_run(runs: DataFrame, run_id: int, at: Column) -> DataFrame:
    """The runs with one more that has begun; a run of that number is begun anew."""
    counters = [F.lit(0).alias(c) for c in COUNTERS]
    row = runs.sparkSession.range(1).select(F.lit(run_id).cast("long").alias("id"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), *counters)
    return runs.where(F.col("id") != run_id).unionByName(row)


def finish_run(runs: DataFrame, run_id: int, at: Column, counters: dict[str, int]) -> DataFrame:
    """The runs with one of them finished; counters that are not given are 0."""
    own = F.col("id") == run_id
    counted = [F.when(own, F.lit(int(counters.get(c, 0)))).otherwise(F.col(c)).cast("int").alias(c) for c in COUNTERS]
    return runs.select("id", "started_at", F.when(own, at).otherwise(F.col("finished_at")).alias("finished_at"), *counted)


def replace_links(postings: DataFrame, links: DataFrame) -> DataFrame:
    """All canonical links replaced by (id, canonical_id)."""
    return postings.drop("canonical_id").join(links.select("id", F.col("canonical_id").cast("long").alias("canonical_id")), "id", "left").select(*postings.columns)


def save_embeddings(postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Embeddings and their hashes replaced for the ids in (id, embedding, embedding_hash)."""
    new = vectors.select("id", F.col("embedding").alias("_e"), F.col("embedding_hash").alias("_h"), F.lit(True).alias("_new"))
    both = postings.join(new, "id", "left")
    changed = {"embedding": F.when(F.col("_new"), F.col("_e")).otherwise(F.col("embedding")), "embedding_hash": F.when(F.col("_new"), F.col("_h")).otherwise(F.col("embedding_hash"))}
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in postings.columns])


def add_companies(companies: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (name, source, board_token) on source and stripped token: a known board gets the name and is
    enabled again, a new one gets the next id in (source, token) order.
    """
    from postmill.functions.text import strip

    given = last_per_key(new.select("name", "source", strip(F.col("board_token")).alias("board_token")).withColumn("_o", F.monotonically_increasing_id()), ["source", "board_token"], "_o").drop("_o")
    both = companies.join(given.withColumnRenamed("name", "_name"), ["source", "board_token"], "full_outer")
    top = companies.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = F.col("id").isNull()
    # companies are a short list; only the new ones are numbered
    numbered = both.crossJoin(F.broadcast(top)).withColumn("_rn", F.row_number().over(Window.partitionBy(fresh).orderBy("source", "board_token")))
    out = {"id": F.when(fresh, F.col("_top") + F.col("_rn")).otherwise(F.col("id")), "name": F.coalesce("_name", "name"), "enabled": F.when(F.col("_name").isNotNull(), F.lit(True)).otherwise(F.col("enabled"))}
    return numbered.select(*[out.get(c, F.col(c)).alias(c) for c in companies.columns])


def record_polls(companies: DataFrame, polls: DataFrame, run_at: Column) -> DataFrame:
    """Time and error (null for success) of the boards in (company_id, error)."""
    p = polls.select(F.col("company_id").alias("id"), F.col("error").alias("_error"), F.lit(True).alias("_polled"))
    both = companies.join(p, "id", "left")
    out = {"last_polled_at": F.when(F.col("_polled"), run_at).otherwise(F.col("last_polled_at")), "last_poll_error": F.when(F.col("_polled"), F.col("_error")).otherwise(F.col("last_poll_error"))}
    return both.select(*[out.get(c, F.col(c)).alias(c) for c in companies.columns])
