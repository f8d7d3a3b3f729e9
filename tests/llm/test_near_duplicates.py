import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import near_duplicates as N

SCHEMA = "id long, title string, description string, rep string, block string"


def shingle_set(text, k):
    w = re.findall(N.WORD, (text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, threshold, k):
    docs = sorted({(r[0], r[1], r[2]) for r in rows if r[1] is not None})
    sets = [shingle_set(d[2], k) for d in docs]
    out = set()
    for x in range(len(docs)):
        for y in range(x + 1, len(docs)):
            a, b = sets[x], sets[y]
            if docs[x][1] == docs[y][1] and docs[x][0] < docs[y][0] and a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                out.add((docs[x][0], docs[y][0]))
    return out


@pytest.mark.parametrize("threshold, k, base", [(0.7, 4, 12), (0.8, 5, 12), (0.7, 4, -5)])
def test_equals_brute_force(spark, threshold, k, base, monkeypatch):
    """Also with words as they are in blocks of 2^17 times the size."""
    monkeypatch.setattr(N, "exact_bits", lambda c: F.greatest(F.ceil(F.log2(c)).cast("int") - (base + 1), F.lit(0)))
    rng = random.Random(k)
    rows = []
    for g in range(12):
        text = [f"w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(8):
            words = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                p = rng.randrange(len(words))
                words[p : p + 1] = rng.choice([[], ["new"], ["x", "y"], [words[p].upper()]])
            rows.append((len(rows), f"t{g % 5}", ", ".join(words), "r", "b"))
    rows += [(500, "t0", None, "", ""), (501, "t0", "a b", "", ""), (502, "t0", "", "", ""), (503, None, rows[0][2], "", ""), (504, "", "C++ and C# at home here", "", ""), (505, "", "c++ AND c# at home here", "", "")]
    rows += rows[:5]
    got = [tuple(r) for r in N.pairs(spark.createDataFrame(rows, SCHEMA), "id", "title", "description", threshold=threshold, shingle=k).collect()]
    want = brute(rows, threshold, k)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want) and (504, 505) in got


def test_copies_cost_linear_work(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, "t", text, "", "") for i in range(60)] + [(100, "t", text + " more", "", "")]
    near, members = N.links(spark.createDataFrame(rows, SCHEMA), "id", "title", "description")
    assert [(r.rep_a, r.rep_b) for r in near.collect()] == [(0, 100)] and members.count() == 61
    assert N.pairs(spark.createDataFrame(rows, SCHEMA), "id", "title", "description").count() == 61 * 60 // 2


def test_a_block_of_very_many_classes(spark):
    """21,000 different texts under one title: pairs barely above the threshold are found."""
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(10_500):
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        other = list(words)
        at = rng.randrange(20, 40)
        other[at : at + 6] = [f"n{i}"] * rng.randint(1, 6)
        a, b = shingle_set(" ".join(words), 4), shingle_set(" ".join(other), 4)
        if len(a & b) >= 0.7 * len(a | b):
            want.add((2 * i, 2 * i + 1))
        rows += [(2 * i, "t", " ".join(words), "", ""), (2 * i + 1, "t", " ".join(other), "", "")]
    near, _ = N.links(spark.createDataFrame(rows, SCHEMA).repartition(8), "id", "title", "description", threshold=0.7, shingle=4)
    got = {(r.rep_a, r.rep_b) for r in near.collect()}
    assert len(want) > 5000 and got <= want and len(got) >= 0.997 * len(want)


def test_nothing(spark):
    assert N.pairs(spark.createDataFrame([], SCHEMA), "id", "title", "description").count() == 0


def test_words_needed(spark):
    assert [N.words_needed(0.7, e) for e in (0, 2, 6)] == [5, 9, 21] and len(N.half_ball()) == 13
    sizes = [2, 8192, 8193, 30_000, 500_000]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(N.exact_bits(F.col("n"))).collect()] == [0, 0, 1, 2, 6]


def test_shingle_sets_and_sketch():
    texts = ["a b c d e", None, "", "a b c", "A  b,C d-e", "x " * 10000]
    sets = N.shingle_sets(texts, 4)
    assert [len(s) for s in sets] == [2, 0, 0, 0, 2, 1] and (sets[0] == sets[4]).all()
    f = N._factors(N.SKETCH)
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 400, dtype=np.uint64)
    apart = []
    for _ in range(60):
        b = a.copy()
        b[:71] = r.integers(0, 2**63, 71, dtype=np.uint64)  # similarity 0.7
        x = N.sketch(a, f) ^ N.sketch(b, f)
        apart.append(sum(int(v).bit_count() if v >= 0 else int(v + 2**64).bit_count() for v in x.tolist()))
        a = r.permutation(b)
    assert abs(np.mean(apart) / 128 - 0.15) < 0.03 and max(apart) <= N.HAMMING
