"""What changed between full snapshots.

Every snapshot row is unpivoted into signed cells (key, field, value): +1 in its own snapshot and -1 in the
one that follows, plus one key-presence marker of the same signs. Grouped sums over (snapshot, key, field,
value) cancel what two consecutive snapshots share; what is left classifies the key: a presence of +1 is
'added', of -1 'removed', and 0 with left-over cells is 'changed' in exactly the fields that have them.

Edge cases: a null value is a value of its own; rows with a null or empty key are left aside; of rows
repeated within a snapshot the one with the greatest order counts; a snapshot without rows removes all keys
of its scope; the first snapshot of a scope gives no rows; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_key(c: Column) -> Column:
    """Trimmed (all white space) and in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def changes(rows: DataFrame, snapshots: DataFrame, scope: str, snapshot: str, key: str, order: str, fields: list[str]) -> DataFrame:
    """(snapshot, scope, key, change_kind, changed_fields) between consecutive snapshots of each scope.

    rows: one row per listed record, with the columns scope, snapshot, key, order and fields.
    snapshots: (scope, snapshot) of those that count, also those without rows.
    Values travel as 64-bit hashes. Both aggregations combine before the shuffle where rows repeat, so a
    record sent very often in one snapshot does not concentrate on a task.
    """
    w = Window.partitionBy(scope).orderBy(snapshot)  # over the list of snapshots, not their rows
    chain = snapshots.select(scope, snapshot).distinct().select(scope, snapshot, F.lag(snapshot).over(w).isNotNull().alias("_later"), F.lead(snapshot).over(w).alias("_next"))
    values = [F.xxhash64(F.lit(i), F.col(f).isNull(), F.col(f)).alias(f"_v{i}") for i, f in enumerate(fields)]
    kept = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).select(scope, snapshot, key, order, *values)
    kept = kept.groupBy(scope, snapshot, key).agg(F.max(F.struct(order, *[f"_v{i}" for i in range(len(fields))])).alias("_r"))
    cells = F.array(F.struct(F.lit(-1).alias("field"), F.lit(0).cast("long").alias("value")), *[F.struct(F.lit(i).alias("field"), F.col(f"_r._v{i}").alias("value")) for i in range(len(fields))])
    sides = F.array(F.struct(F.when(F.col("_later"), F.col(snapshot)).alias("at"), F.lit(1).alias("sign")), F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign")))
    signed = kept.join(chain, [scope, snapshot]).select(scope, key, F.explode(sides).alias("s"), cells.alias("cells"))
    signed = signed.where(F.col("s.at").isNotNull()).select(scope, key, F.col("s.at").alias(snapshot), F.col("s.sign").alias("sign"), F.explode("cells").alias("c"))
    sums = signed.groupBy(scope, key, snapshot, F.col("c.field").alias("field"), F.col("c.value").alias("value")).agg(F.sum("sign").alias("n")).where("n <> 0")
    presence = F.sum(F.when(F.col("field") == -1, F.col("n")).otherwise(0))
    names = F.array(*[F.lit(f) for f in fields])
    out = sums.groupBy(scope, key, snapshot).agg(presence.alias("p"), F.array_sort(F.collect_set(F.when(F.col("field") >= 0, F.element_at(names, F.col("field") + 1)))).alias("changed_fields"))
    kind = F.when(F.col("p") > 0, "added").when(F.col("p") < 0, "removed").otherwise("changed")
    return out.select(snapshot, scope, key, kind.alias("change_kind"), F.when(F.col("p") == 0, F.col("changed_fields")).alias("changed_fields"))


def board_changes(board_snapshots: DataFrame, board_polls: DataFrame, fields: tuple[str, ...] = ("content_hash",)) -> DataFrame:
    """``changes`` of the boards between successful polls; ids and hashes are compared trimmed, in lower case."""
    polls = board_polls.where(F.col("poll_error").isNull()).select("company_id", "run_id")
    compared = [canonical_key(F.col(f)).alias(f) if f == "content_hash" else F.col(f) for f in fields]
    rows = board_snapshots.select("company_id", "run_id", canonical_key(F.col("external_id")).alias("external_id"), "arrival_seq", *compared)
    return changes(rows, polls, "company_id", "run_id", "external_id", "arrival_seq", list(fields))
