import random

import pytest

from postmill.llm import leakage as L

SCHEMA = "doc_id long, text string, doc string, item string"
ITEMS = "item_id long, text string, i string, t string"


def naive(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1]))
        prev = cur
    return min(prev)


def test_distance_equals_the_table():
    rng = random.Random(0)
    for _ in range(2000):
        p, t = ([rng.choice("abcd") for _ in range(n)] for n in (rng.randint(1, 14), rng.randint(0, 20)))
        assert L.best_distance(p, t) == naive(p, t)


def brute(docs, items, window, budget):
    out = set()
    for d, text, *_ in docs:
        for i, item, *_ in items:
            a, b = L.words(text), L.words(item)
            if any(naive(b[s : s + window], a) <= budget for s in range(len(b) - window + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_equals_brute_force(spark, budget):
    rng = random.Random(budget)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 11, 12, 13, 30]))), "", "") for i in range(12)] + [(50, None, "", ""), (51, "", "", "")]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(20)]
        source = rng.choice(items[:12])[1].split()
        s = rng.randint(0, max(0, len(source) - 12))
        part = source[s : s + rng.choice([10, 11, 12, 14])]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.randrange(len(part))
            part[p : p + 1] = rng.choice([[], ["new"], [part[p], "ins"]])
        words[7:7] = part
        docs.append((d, rng.choice([" ", ", ", " - "]).join(words).upper(), "", ""))
    docs += [(900, None, "", ""), (901, "", "", ""), docs[0]]
    got = [tuple(r) for r in L.leaks(spark.createDataFrame(docs, SCHEMA), "doc_id", "text", spark.createDataFrame(items, ITEMS), "item_id", "text", 12, budget).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, 12, budget)


def test_eleven_words_are_no_case_and_blocks(spark):
    item = " ".join(f"x{i}" for i in range(40))
    items = spark.createDataFrame([(i, item if i == 3 else f"{i} " * 40, "", "") for i in range(9)], ITEMS)
    docs = spark.createDataFrame([(1, " ".join(f"X{i}" for i in range(5, 16)), "", ""), (2, "a " + ", ".join(f"x{i}" for i in range(28, 40)) + " b", "", ""), (3, "filler " * 20000 + item, "", "")], SCHEMA)
    for size in (8_000_000, 200):
        assert {tuple(r) for r in L.leaks(docs, "doc_id", "text", items, "item_id", "text", block_chars=size).collect()} == {(2, 3), (3, 3)}


def test_a_piece_of_very_many_items():
    """A common beginning stands in all items; equal surroundings are compared once."""
    common = "these six words begin every item"
    own = [" ".join(f"w{i % 50}x{j}" for j in range(20)) for i in range(2000)]
    matcher = L.Matcher([(i, f"{common} {t}") for i, t in enumerate(own)], 12, 0)
    assert matcher.leaks(f"{common} and no more of it than that, so nothing leaks here") == set()
    assert matcher.leaks(f"said {common} {own[7]}") == {i for i in range(2000) if i % 50 == 7}


def test_nothing(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert L.leaks(docs, "doc_id", "text", items, "item_id", "text").count() == 0
    with pytest.raises(ValueError):
        L.Matcher([(1, "a b c")], 2, 1)
