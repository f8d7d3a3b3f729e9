import datetime as dt
import random

import pytest

from postmill.operators.incremental import FeedConsumer, consumed, replay
from postmill.state import Conflict

FEED = "seq long, run_id long, posting_id long, content_hash string, last_seen_at timestamp, run long"
RUNS = "id long, started_at timestamp, finished_at timestamp"
T0 = dt.datetime(2026, 1, 1)


def brute(feed, runs):
    done = sorted(r[0] for r in runs if r[2] is not None)
    state, out = {}, set()
    for i, run in enumerate(done):
        before = {k: v[2] for k, v in state.items()}
        low = done[i - 1] if i else -(10**18)
        for seq, run_id, key, h, seen, _ in feed:
            if None not in (run_id, key, seen) and low < run_id <= run and (key not in state or (seen, seq) > state[key][:2]):
                state[key] = (seen, seq, h)
        out |= {(run, k) for k, v in state.items() if k not in before or before[k] != v[2]}
    return out


def test_replay_equals_brute_force(spark):
    rng = random.Random(5)
    runs = [(i, T0, T0 if rng.random() < 0.6 else None) for i in range(1, 12)]
    feed = [(s, rng.randint(0, 12), rng.choice([None, *range(15)]), rng.choice(["a", "b", None]), rng.choice([None, *(T0 + dt.timedelta(minutes=m) for m in range(9))]), 1) for s in range(400)]
    feed += feed[:50]
    got = replay(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS))
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["run_id", "posting_id"] and len(rows) == len(set(rows)) and set(rows) == brute(feed, runs)


def test_replay_of_nothing(spark):
    feed, runs = spark.createDataFrame([], FEED), spark.createDataFrame([(1, T0, None)], RUNS)
    assert replay(feed, runs).count() == 0
    assert replay(spark.createDataFrame([(1, 1, 1, "a", T0, 1)], FEED), runs).count() == 0


def taken(consumer, *args):
    """What a caller gets who takes the rows and says so."""
    out = sorted((r.posting_id, r.change_kind) for r in consumer.run(*args).collect())
    consumer.acknowledge()
    return out


def test_consumer_neither_skips_nor_repeats(spark, tmp_path, monkeypatch):
    feed = [(1, 1, 7, "a", T0, 1), (2, 1, 8, "a", T0, 1)]
    make = lambda: FeedConsumer(spark, str(tmp_path / "state"))
    df = lambda: spark.createDataFrame(feed, FEED)
    open_ = lambda *n: spark.createDataFrame([(x,) for x in n], "seq long")
    # a transaction that began at 3 is open at the first run
    assert taken(make(), df(), open_(3)) == [(7, "new"), (8, "new")]
    # its row commits late, with a smaller number than rows already read
    feed += [(5, 2, 7, "b", T0 + dt.timedelta(hours=1), 1)]
    assert taken(make(), df(), open_(3)) == [(7, "changed")]
    feed += [(3, 2, 9, "x", T0, 1), (6, 2, 7, "b", T0 + dt.timedelta(hours=2), 1)]
    # a run that dies before it has staged changes nothing
    consumer = make()
    monkeypatch.setattr(consumer._staged, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        consumer.run(df())
    assert make().pending() is None
    assert taken(make(), df()) == [(9, "new")]
    assert taken(make(), df()) == []
    # older content comes back under a later time
    feed += [(7, 3, 7, "a", T0 + dt.timedelta(hours=3), 1)]
    assert taken(make(), df()) == [(7, "changed")]


def test_consumer_dies_between_staging_and_delivery(spark, tmp_path):
    make = lambda: FeedConsumer(spark, str(tmp_path / "state"))
    feed = [(1, 1, 7, "a", T0, 1)]
    make().run(spark.createDataFrame(feed, FEED))
    # nobody has taken the rows: they are given again, and only they
    feed += [(2, 1, 8, "a", T0, 1)]
    assert [r.posting_id for r in make().pending().collect()] == [7]
    assert taken(make(), spark.createDataFrame(feed, FEED)) == [(7, "new")]
    assert make().pending() is None and taken(make(), spark.createDataFrame(feed, FEED)) == [(8, "new")]
    with pytest.raises(RuntimeError, match="nothing"):
        make().acknowledge()


def test_a_transaction_commits_between_the_list_and_the_read(spark, tmp_path):
    """Rows lie in files; each reading of the feed sees those there at that moment."""
    folder = tmp_path / "feed"
    put = lambda *rows: spark.createDataFrame(list(rows), FEED).coalesce(1).write.mode("append").parquet(str(folder))
    put((1, 1, 7, "a", T0, 1), (4, 1, 8, "a", T0, 1))
    consumer = FeedConsumer(spark, str(tmp_path / "state"))

    class Open:
        """An open list that is read while a transaction of numbers 5 and 6 commits and one of number 7 begins."""

        def agg(self, *columns):
            put((5, 2, 9, "x", T0, 1), (6, 2, 7, "b", T0 + dt.timedelta(hours=1), 1))
            return spark.createDataFrame([(2,)], "seq long").agg(*columns)

    feed = lambda: spark.read.schema(FEED).parquet(str(folder))
    got = taken(consumer, feed(), Open())
    put((2, 2, 10, "late", T0, 1), (7, 3, 11, "y", T0, 1))
    got += taken(consumer, feed(), spark.createDataFrame([], "seq long"))
    got += taken(consumer, feed(), spark.createDataFrame([], "seq long"))
    state = {}
    for key, kind in got:
        assert kind == ("changed" if key in state else "new")
        state[key] = state.get(key, 0) + 1
    assert set(state) == {7, 8, 9, 10, 11} and state[8] == state[9] == state[10] == state[11] == 1


def test_many_runs_are_compacted_and_two_consumers_conflict(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(FeedConsumer, "COMPACT", 2)
    rng = random.Random(1)
    runs = [(i, T0, T0 if i != 3 else None) for i in range(1, 8)]
    feed = [(s, rng.randint(1, 7), rng.randrange(6), rng.choice(["a", "b", None]), T0 + dt.timedelta(minutes=rng.randrange(9)), 1) for s in range(120)]
    feed += feed[:10]
    got = consumed(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS), str(tmp_path / "s"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(feed, runs)
    a, b = FeedConsumer(spark, str(tmp_path / "s")), FeedConsumer(spark, str(tmp_path / "s"))
    assert len(a.committed()["states"]) <= 2
    a.run(spark.createDataFrame(feed, FEED))
    monkeypatch.setattr(b, "pending", lambda: None)  # it looked before a had staged
    with pytest.raises(Conflict):
        b.run(spark.createDataFrame(feed, FEED))


def test_consumer_starts_empty(spark, tmp_path):
    consumer = FeedConsumer(spark, str(tmp_path / "s"))
    assert taken(consumer, spark.createDataFrame([], FEED)) == []
    assert taken(consumer, spark.createDataFrame([(1, 1, 7, "a", T0, 1)], FEED)) == [(7, "new")]
