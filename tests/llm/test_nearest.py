import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import nearest

SCHEMA = "id long, embedding array<float>, vector string, class string"


def brute(rows, k, dim):
    good = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    ids = np.array(sorted(good))
    if len(ids) == 0:
        return {}
    m = np.stack([good[i] for i in ids])
    m /= np.linalg.norm(m, axis=1)[:, None]
    sims = np.round(m @ m.T, 9)
    out = {}
    for n, i in enumerate(ids):
        order = [j for j in np.lexsort((ids, -sims[n])) if j != n][:k]
        out[int(i)] = [int(ids[j]) for j in order]
    return out


def result(spark, rows, k=3, dim=8, **options):
    df = nearest.neighbours(spark.createDataFrame(rows, SCHEMA), "id", "embedding", k, dim, **options)
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r.place)):
        out.setdefault(r.id, []).append(r.nbr)
    return out


@pytest.mark.parametrize("min_blocks", [1, 3])
def test_equals_brute_force(spark, min_blocks):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist(), "x", "y") for i in range(300)]
    rows += [(1000, None, "", ""), (1001, [1.0] * 7, "", ""), (1002, [0.0] * 8, "", ""), (1003, [float("nan")] + [1.0] * 7, "", ""), (1004, [float("inf")] + [1.0] * 7, "", ""), (1005, [None] + [1.0] * 7, "", ""), (None, [1.0] * 8, "", "")]
    assert result(spark, rows, min_blocks=min_blocks) == brute(rows, 3, 8)


def test_copies_and_ties(spark):
    r = np.random.default_rng(2)
    v, w = r.normal(size=8).tolist(), r.normal(size=8).tolist()
    rows = [(i, v, "", "") for i in range(40, 0, -1)] + [(100 + i, w, "", "") for i in range(2)] + [(200 + i, r.normal(size=8).tolist(), "", "") for i in range(20)] + [(5, v, "", "")]
    assert result(spark, rows) == brute(rows, 3, 8)


def test_few_and_none(spark):
    assert result(spark, []) == {}
    assert result(spark, [(1, [1.0] * 8, "", "")]) == {}
    assert result(spark, [(1, [1.0] * 8, "", ""), (2, [1.0] * 7 + [-1.0], "", "")]) == {1: [2], 2: [1]}
    found = nearest.found(spark.createDataFrame([(2, [1.0] * 8, "", ""), (1, [2.0] * 8, "", "")], SCHEMA), "id", "embedding", 5, 8)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


def test_bounds_hold():
    r = np.random.default_rng(3)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (r.normal(size=(50, 64)), r.normal(size=(60, 64))))
    qa, sa, ea, na = nearest.quantise(a)
    qb, sb, eb, nb = nearest.quantise(b)
    approx = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb
    assert (np.abs(a @ b.T - approx) <= na[:, None] * eb + ea[:, None] + 1e-9).all()


def test_usable(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), (None,), ([1.0],)], "v array<float>")
    assert [r[0] for r in df.select(nearest.usable(F.col("v"), 2)).collect()] == [True, False, False, False]
