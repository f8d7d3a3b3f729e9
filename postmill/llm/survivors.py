"""Best representative of each duplicate group, by iterative truth discovery.

Records of a group make claims (field, value). Two things are estimated in turn: the *value* of each group and
field, the one of highest support, and the *reliability* of each source, the share of its claims that agree
with the chosen values (drawn towards PRIOR by PRIOR_CLAIMS claims). A claim is a vote that weighs as much as
its source is reliable.

A claim backs its own value. In an *ordered* field, whose claims have a rank, it also backs every value that
ranks above its own, as a record with a shorter text backs the longer one; a value's support is then the
running sum of the votes in the order of the ranks. So the preference among the values of a field and the
reliability of their sources are one vote; where the field has an order it prevails, as every vote is positive.

Rounds go on until no choice changes, and they end: both steps raise the same function of choices and
reliabilities, the sum of the supports chosen less (n + PRIOR_CLAIMS) r^2 / 2 - PRIOR_CLAIMS PRIOR r over the
sources of n claims and reliability r, which is strictly concave in r, so no choice comes back once it was left.

Groups of any size are pre-aggregated by value and source before the shuffle. The running sums are taken in
slices of a range sort, which are as large as a partition, and a slice's sum of what lies below it is added;
no group is gathered in a task.

Edge cases: null and unusable values make no claim; a field without claims gives no row; a null rank is below
all others; ties go to the higher rank, then to the smallest record id; groups of one record are no groups;
links to absent records still tie together those that share them; repeated records count once; extra columns
are ignored.
"""

from __future__ import annotations

import logging
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.components import components
from postmill.session import cut, release

PRIOR = 0.8  # reliability before any vote
PRIOR_CLAIMS = 2.0  # claims that the prior is worth
FIELD = ["group_id", "field_name"]
_log = logging.getLogger(__name__)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def linked_groups(records: DataFrame, id_col: str, link_col: str) -> DataFrame:
    """(group_id, id) of the records tied together by links in either direction, two at least."""
    edges = records.where(F.col(link_col).isNotNull() & (F.col(link_col) != F.col(id_col))).select(F.col(id_col).alias("a"), F.col(link_col).alias("b"))
    parts = components(edges, "a", "b")
    inside = parts.join(records.select(F.col(id_col).alias("node")).distinct(), "node", "left_semi")
    heads = inside.groupBy("component").agg(F.min("node").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return inside.join(heads, "component").select("group_id", F.col("node").alias("id"))


def ballot(claims: DataFrame) -> DataFrame:
    """(group_id, field_name, rank, value, source, n, id, slice): the claims counted by value and source.

    An ordered field's values are its ranks (records of one rank back the same values), others' ranks are null.
    ``slice`` numbers the partition of a range sort by rank.
    """
    rank = F.col("rank") if "rank" in claims.columns else F.lit(None).cast("long").alias("rank")
    rows = claims.where(F.col("value").isNotNull()).select(*FIELD, rank, "value", "source", "id")
    # written, as the range sort reads it twice
    counted = cut(rows.groupBy(*FIELD, "rank", "value", "source").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")))
    # source and id end the key, so that a rank of very many sources may be cut too
    return counted.repartitionByRange(*FIELD, "rank", "value", "source", "id").withColumn("slice", F.spark_partition_id())


def supports(votes: DataFrame, weights: DataFrame) -> DataFrame:
    """(group_id, field_name, rank, value, id, support) of every value; votes as from ``ballot``."""
    weighed = votes.join(weights, "source").groupBy(*FIELD, "rank", "value", "slice").agg(F.sum(F.col("n") * F.col("reliability")).alias("own"), F.min("id").alias("id"))
    ordered = F.col("rank").isNotNull()
    inside = Window.partitionBy(*FIELD, ordered, "slice").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the slices of a field: one row per partition at most
    totals = weighed.where(ordered).groupBy(*FIELD, "slice").agg(F.sum("own").alias("total"))
    below = totals.withColumn("below", F.sum("total").over(Window.partitionBy(*FIELD).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).where(F.col("below").isNotNull()).drop("total")
    summed = weighed.withColumn("run", F.when(ordered, F.sum("own").over(inside)).otherwise(F.col("own"))).join(below, [*FIELD, "slice"], "left")
    support = F.when(ordered, F.col("run") + F.coalesce("below", F.lit(0.0))).otherwise(F.col("run"))
    # a value cut by slices: of an ordered field its last part has all votes, of others the parts are added
    parts = summed.select(*FIELD, "rank", "value", "id", support.alias("support")).groupBy(*FIELD, "rank", "value")
    return parts.agg(F.min("id").alias("id"), F.max("support").alias("most"), F.sum("support").alias("all")).select(*FIELD, "rank", "value", "id", F.when(F.col("rank").isNotNull(), F.col("most")).otherwise(F.col("all")).alias("support"))


def discover(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth discovery over claims (group_id, field_name, id, source, value, rank), rank (null if there is no such
    column) null in fields without an order and a long in ordered ones, where value must follow from it.

    Returns (group_id, field_name, value, id, support) with the smallest id that claims the value, and
    (source, reliability).
    """
    votes = cut(ballot(claims))
    weights = votes.select("source").distinct().withColumn("reliability", F.lit(PRIOR))
    chosen = used = None
    for round_ in count(1):
        # rounded, so that sums in another order give the same choice
        best = F.max(F.struct(F.round("support", 9).alias("support"), F.col("rank"), (-F.col("id")).alias("_id"), "value")).alias("b")
        now = cut(supports(votes, weights).groupBy(*FIELD).agg(best).select(*FIELD, F.col("b.value").alias("value"), (-F.col("b._id")).alias("id"), F.col("b.support").alias("support")))
        moved = None if chosen is None else now.join(chosen.select(*FIELD, F.col("value").alias("old")), FIELD).where("value <> old").count()
        if chosen is not None:
            release(chosen)
        chosen = now
        _log.info("round %d: %s choices changed", round_, "all" if moved is None else moved)
        if moved == 0:
            release(votes)
            return chosen, weights
        right = votes.join(chosen.select(*FIELD, F.col("value").alias("true_value")), FIELD)
        hit = F.sum(F.when(F.col("value") == F.col("true_value"), F.col("n")).otherwise(0))
        weights = cut(right.groupBy("source").agg(((hit + PRIOR * PRIOR_CLAIMS) / (F.sum("n") + PRIOR_CLAIMS)).alias("reliability")))
        if used is not None:
            release(used)
        used = weights
    raise AssertionError


def usable_label(c: Column) -> Column:
    """Not null, not blank and no placeholder."""
    return F.coalesce(~F.upper(stripped(c)).isin("", "N/A", "-", "TBD"), F.lit(False))


def posting_members(postings: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per member of a linked group with its usable values."""
    members = linked_groups(postings, "id", "canonical_id")
    until = runs.agg(F.max_by("started_at", "id").alias("until"))
    text = F.length(stripped(F.col("description")))
    rows = postings.select("id", "company_id", "description", "location", "department", "posted_at").join(members, "id").crossJoin(F.broadcast(until))  # one row by construction
    posted = F.when((F.col("posted_at") >= F.lit("2015-01-01 00:00:00 UTC").cast("timestamp")) & (F.col("posted_at") <= F.col("until")), F.col("posted_at"))
    source = F.coalesce(F.col("company_id").cast("long"), F.lit(-1))  # unknown companies are one source
    return rows.select("group_id", "id", source.alias("source"), F.when(text > 0, text).alias("text_length"), F.when(usable_label(F.col("location")), F.col("location")).alias("location"), F.when(usable_label(F.col("department")), F.col("department")).alias("department"), posted.alias("posted"))


def _claims(rows: DataFrame, fields: list[tuple[str, Column, Column]]) -> DataFrame:
    """(group_id, id, source, field_name, value, rank) of the fields (name, value, rank), null values left out."""
    stacked = F.array(*[F.struct(F.lit(name).alias("field_name"), value.cast("string").alias("value"), rank.cast("long").alias("rank")) for name, value, rank in fields])
    return rows.select("group_id", "id", "source", F.explode(stacked).alias("c")).select("group_id", "id", "source", "c.*").where("value is not null")


def surviving_values(postings: DataFrame, runs: DataFrame) -> DataFrame:
    """(group_id, field_name, posting_id) with the fields' orders: longest description, location and
    department of the latest posting, earliest date."""
    seconds = F.unix_micros("posted")
    latest = F.coalesce(seconds, F.lit(-(2**62)))  # members without a date come last
    ranks = [
        ("description", F.col("text_length")),
        ("location", F.when(F.col("location").isNotNull(), latest)),
        ("department", F.when(F.col("department").isNotNull(), latest)),
        ("posted_at", -seconds),
    ]
    # what is chosen is a place in the order; the smallest id of those who hold it survives
    chosen, _ = discover(_claims(posting_members(postings, runs), [(name, rank, rank) for name, rank in ranks]))
    return chosen.select("group_id", "field_name", F.col("id").alias("posting_id"))


def discovered_values(postings: DataFrame, runs: DataFrame) -> DataFrame:
    """(group_id, field_name, posting_id): location and department by votes of the companies as sources."""
    fields = [(f, F.lower(stripped(F.col(f))), F.lit(None)) for f in ("location", "department")]
    chosen, _ = discover(_claims(posting_members(postings, runs), fields))
    return chosen.select("group_id", "field_name", F.col("id").alias("posting_id"))
