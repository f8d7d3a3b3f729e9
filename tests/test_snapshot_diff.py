import random

from postmill.operators.snapshot_diff import board_changes, changes

ROWS = "company_id long, run_id long, external_id string, arrival_seq long, content_hash string, title string, change_kind string"
POLLS = "company_id long, run_id long, poll_error string"


def brute(rows, polls):
    clean = lambda s: s if s is None else s.strip().lower()
    out = set()
    for c in {p[0] for p in polls}:
        runs = sorted({p[1] for p in polls if p[0] == c and p[2] is None})
        snap = {}
        for r in runs:
            best = {}
            for co, ru, ext, seq, h, _, _ in rows:
                if (co, ru) == (c, r) and clean(ext) and (clean(ext) not in best or seq > best[clean(ext)][0]):
                    best[clean(ext)] = (seq, clean(h))
            snap[r] = {k: v[1] for k, v in best.items()}
        for a, b in zip(runs, runs[1:]):
            out |= {(b, c, k, "added") for k in snap[b].keys() - snap[a].keys()} | {(b, c, k, "removed") for k in snap[a].keys() - snap[b].keys()}
            out |= {(b, c, k, "changed") for k in snap[a].keys() & snap[b].keys() if snap[a][k] != snap[b][k]}
    return out


def test_changes_equal_brute_force(spark):
    rng = random.Random(2)
    polls = [(c, r, "failed" if rng.random() < 0.2 else None) for c in (1, 2, 3) for r in range(1, 8)]
    rows = [(rng.choice([1, 1, 2, 3, None]), rng.randint(1, 8), rng.choice([" a", "A ", "b", "c\t", "d", "", None]), s, rng.choice(["x", "X ", "y", None]), "t", "q") for s in range(300)]
    got = board_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(polls, POLLS))
    found = [(r.run_id, r.company_id, r.external_id, r.change_kind) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, polls)


def test_changed_fields_and_empty_snapshots(spark):
    rows = [(1, 1, "a", 1, "h", "t", ""), (1, 1, "b", 2, "h", None, ""), (1, 2, "a", 3, "h", "u", ""), (1, 2, "b", 4, "h", None, "")]
    polls = [(1, 1, None), (1, 2, None), (1, 3, None)]
    got = board_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(polls, POLLS), ("content_hash", "title")).collect()
    assert {(r.run_id, r.external_id, r.change_kind, tuple(r.changed_fields or ())) for r in got} == {(2, "a", "changed", ("title",)), (3, "a", "removed", ()), (3, "b", "removed", ())}


def test_nothing(spark):
    rows, polls = spark.createDataFrame([], ROWS), spark.createDataFrame([], POLLS)
    assert board_changes(rows, polls).count() == 0
    assert changes(rows, polls.select("company_id", "run_id"), "company_id", "run_id", "external_id", "arrival_seq", ["title"]).count() == 0


def test_a_record_sent_very_often(spark):
    rows = [(1, 1, "a", s, str(s), "t", "") for s in range(500)] + [(1, 2, "a", 1000, "499", "t", "")]
    assert board_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame([(1, 1, None), (1, 2, None)], POLLS)).count() == 0
