"""Processing only new or changed records.

Both forms below follow one method: a run rereads the feed from the oldest transaction that was still
open at the last run (so nothing that committed late is skipped) and removes the overlap by an anti-join
of (key, version) pairs against the ledger of pairs already processed (so nothing is repeated).

``replay``       the history of all runs at once, as one plan without driver loops.
``FeedConsumer`` the live form: one call per run, ledger and state in a shared folder, committed atomically.
``consumed``     the history of all runs by the live form.

Edge cases: feed rows with null key, null run or null time are left aside; a null content hash is a value
like any other (null differs from every string, equals null); empty feeds or runs give an empty result;
repeated rows are one row; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.state import Marks


def successful_runs(runs: DataFrame) -> DataFrame:
    """(run, open_from): successful runs, each with the oldest transaction open at the run before it.

    Transactions are the ingestion runs. When the last successful run p was handed on, every run after
    the success before p was still open (p itself and those that broke off), so rereading starts there.
    """
    done = runs.where(F.col("finished_at").isNotNull()).select(F.col("id").alias("run")).distinct()
    w = Window.orderBy("run")  # the runs: one short row per ingestion run
    return done.select("run", F.coalesce(F.lag("run", 1).over(w), F.lit(-(2**62))).alias("prev"), F.coalesce(F.lag("run", 2).over(w), F.lit(-(2**62))).alias("open_from"))


def version(seq: Column, content_hash: Column, seen: Column) -> Column:
    """The version part of a (key, version) pair: everything that tells two deliveries of a key apart."""
    return F.xxhash64(seq, F.coalesce(content_hash, F.lit("\0")), seen)


def replay(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, posting_id): what each successful run must hand on as new or changed.

    One row of a key and run survives the pre-aggregation (map-side), so a hot key never holds more rows
    than there are runs in the following window.
    """
    done = successful_runs(runs)
    rows = feed.where(F.col("posting_id").isNotNull() & F.col("run_id").isNotNull() & F.col("last_seen_at").isNotNull()).select(
        "posting_id", "run_id", "seq", "content_hash", "last_seen_at", version(F.col("seq"), F.col("content_hash"), F.col("last_seen_at")).alias("version")
    )
    # what each run rereads: the join is on a few run numbers, resolved once per distinct run_id
    spans = rows.select("run_id").distinct().join(done, (F.col("run_id") > F.col("open_from")) & (F.col("run_id") <= F.col("run")))
    spans = spans.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("run", "prev"))).alias("rereads"))
    reread = rows.join(spans, "run_id").withColumn("r", F.explode("rereads")).select("*", "r.run", "r.prev").drop("r", "rereads")
    # the ledger: pairs that a run takes as its own, that is those that no earlier run has read
    ledger = reread.groupBy("posting_id", "version").agg(F.min("run").alias("done_in"))
    fresh = reread.join(ledger.where(F.col("done_in").isNotNull()).select(F.col("posting_id").alias("k"), F.col("version").alias("v"), "done_in"), (F.col("posting_id") == F.col("k")) & (F.col("version") == F.col("v")) & (F.col("done_in") < F.col("run")), "left_anti")
    newest = fresh.groupBy("posting_id", "run").agg(F.max(F.struct("last_seen_at", "seq", "content_hash")).alias("top"))
    w = Window.partitionBy("posting_id").orderBy("run")
    state = newest.withColumn("state", F.max("top").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    state = state.withColumn("before", F.lag("state").over(w))
    changed = F.col("before").isNull() | ~F.col("state.content_hash").eqNullSafe(F.col("before.content_hash"))
    return state.where(changed).select(F.col("run").cast("long").alias("run_id"), F.col("posting_id").cast("long").alias("posting_id"))


class FeedConsumer:
    """Hands on new and changed postings run by run.

    A run *stages* what it hands on, and ``acknowledge`` commits it once the caller has taken it. Until then every
    ``run`` and ``pending`` gives the same staged rows again, also after a crash, and reads nothing new. A run that
    dies while it stages leaves an unnamed directory behind and the next one starts from the last commit.

    Order of reading: first the largest sequence number seen, then the open transactions, then the rows, which are
    written once; state and ledger come from these written rows. A transaction that the list of open ones lacks has
    ended before it, so its rows are among those read, or begins after it, so its rows have larger numbers than
    any seen before. The next run therefore rereads from the oldest open transaction or from just after the
    largest number seen, whichever is less. Nothing is skipped, whenever a transaction commits, and the ledger takes
    out what was read already.

    ``folder`` (shared by all executors) holds one directory per run with the rows handed on, the keys' new states
    and the ledger's new pairs. States are kept as a base and the changes since; after COMPACT runs they are merged
    into a new base, so a run writes in proportion to what it reads. The ledger keeps only pairs from the place
    where the next run rereads; older ones can't be read again.
    """

    COMPACT = 8

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._staged, self._commits = Marks(spark, folder, "staged"), Marks(spark, folder, "commit")

    def committed(self) -> dict:
        """The last commit: its number, the state's and the ledger's folders, and where the next run rereads from."""
        n = self._commits.last()
        if not n:
            return {"n": 0, "states": [], "ledgers": [], "reread_from": None}
        return json.loads(self._staged.content(n))

    def pending(self) -> DataFrame | None:
        """(posting_id, change_kind) staged and not acknowledged, if there is such a run."""
        n = self._commits.last() + 1
        return self._rows(n) if n in self._staged.numbers() else None

    def _rows(self, n: int) -> DataFrame:
        return self.spark.read.schema("posting_id long, change_kind string").parquet(f"{self.folder}/{json.loads(self._staged.content(n))['dir']}/changes")

    def acknowledge(self) -> None:
        """Commits the staged run; ``Conflict`` if another consumer did."""
        n = self._commits.last() + 1
        if n not in self._staged.numbers():
            raise RuntimeError("nothing is staged")
        self._commits.put(n, "")

    def run(self, feed: DataFrame, open_seqs: DataFrame | None = None) -> DataFrame:
        """Stages what arrived since the last run and returns (posting_id, change_kind) of it.

        feed: all rows visible, read anew at each use. open_seqs: one column ``seq`` with the first sequence number
        of each transaction still open; None if there are never any.
        """
        if (again := self.pending()) is not None:
            return again
        last = self.committed()
        seen_before = feed.agg(F.max("seq")).head()[0]
        oldest_open = open_seqs.agg(F.min("seq")).head()[0] if open_seqs is not None else None
        starts = [x for x in (oldest_open, seen_before + 1 if seen_before is not None else None) if x is not None]
        start = min(starts) if starts else last["reread_from"]
        here = f"version-{last['n'] + 1:012d}-{uuid.uuid4().hex}"
        rows = feed.where(F.col("posting_id").isNotNull() & F.col("last_seen_at").isNotNull()).select(F.col("posting_id").cast("long").alias("posting_id"), F.col("seq").cast("long").alias("seq"), "content_hash", "last_seen_at", version(F.col("seq"), F.col("content_hash"), F.col("last_seen_at")).alias("version"))
        if last["reread_from"] is not None:
            rows = rows.where(F.col("seq") >= last["reread_from"])
        ledger = [self._read(x) for x in last["ledgers"]]
        for part in ledger:
            rows = rows.join(part.select("posting_id", "version"), ["posting_id", "version"], "left_anti")
        rows = self._written(rows.distinct(), f"{here}/ledger")
        top = rows.groupBy("posting_id").agg(F.max(F.struct("last_seen_at", "seq", "content_hash")).alias("top"))
        states = [self._read(x) for x in last["states"]]
        if states:
            # only the states of keys that were read now
            keys = rows.select("posting_id").distinct()
            old = _newest(states[0] if len(states) == 1 else _all(states), keys).withColumnRenamed("top", "old")
            moved = top.join(old, "posting_id", "left").where(F.col("old").isNull() | (F.col("top") > F.col("old")))
        else:
            moved = top.withColumn("old", F.lit(None).cast(top.schema["top"].dataType))
        kind = F.when(F.col("old").isNull(), "new").when(~F.col("old.content_hash").eqNullSafe(F.col("top.content_hash")), "changed")
        moved = self._written(moved.select("posting_id", "top", kind.alias("change_kind")), f"{here}/moved")
        moved.where(F.col("change_kind").isNotNull()).select("posting_id", "change_kind").write.parquet(f"{self.folder}/{here}/changes")
        folders = [*last["states"], f"{here}/moved"]
        if len(folders) > self.COMPACT:
            self._written(_newest(_all([*states, moved])), f"{here}/state")
            folders = [f"{here}/state"]
        # ledgers whose pairs all lie before the place to reread from can't meet a row again
        kept = [x for x, part in zip(last["ledgers"], ledger) if start is None or not part.where(F.col("seq") >= start).isEmpty()]
        self._staged.put(last["n"] + 1, json.dumps({"n": last["n"] + 1, "dir": here, "states": folders, "ledgers": [*kept, f"{here}/ledger"], "reread_from": start}))
        return self._rows(last["n"] + 1)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def _all(states: list[DataFrame]) -> DataFrame:
    out = states[0].select("posting_id", "top")
    for s in states[1:]:
        out = out.unionByName(s.select("posting_id", "top"))
    return out


def _newest(states: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(posting_id, top): each key's newest state, of the given keys if any are."""
    rows = states.select("posting_id", "top")
    if keys is not None:
        rows = rows.join(keys, "posting_id", "left_semi")
    return rows.groupBy("posting_id").agg(F.max("top").alias("top"))


def consumed(feed: DataFrame, runs: DataFrame, folder: str) -> DataFrame:
    """(run_id, posting_id) as ``replay`` gives them, by one FeedConsumer run for each successful ingestion run.

    The feed's transactions are the ingestion runs: at a successful run those up to it are visible, later ones
    open. The loop is over the short list of ingestion runs.
    """
    spark, out = feed.sparkSession, None
    consumer = FeedConsumer(spark, folder)
    rows = feed.where(F.col("run_id").isNotNull())
    for r in sorted(r.run for r in successful_runs(runs).select("run").collect()):
        later = rows.where(F.col("run_id") > r).groupBy("run_id").agg(F.min("seq").alias("seq"))
        part = consumer.run(rows.where(F.col("run_id") <= r), later).select(F.lit(r).cast("long").alias("run_id"), "posting_id")
        consumer.acknowledge()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "run_id long, posting_id long")
