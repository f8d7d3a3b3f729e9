import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import repeated_lines as R

SCHEMA = "id long, company_id long, title string, description string, doc string, source string"


def brute(rows, least):
    keys, seen = {}, []
    for i, c, t, d, *_ in rows:
        for n, line in enumerate((d or "").split("\n"), 1):
            k = "".join(ch for ch in line.lower() if ch.isalnum())
            if k:
                keys.setdefault((c, k), set()).add(t)
                seen.append((i, n, c, k))
    return {(i, n) for i, n, c, k in seen if len(keys[c, k]) >= least}


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    lines = ["Apply now", "APPLY  now!", "apply\tnow -", "- - -", "", "Benefits: 5 days", "Unique", "Ünï cödé", "über uns", "ÜBER UNS"]
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "b", "c", "", None]), rng.choice([None, "", "\n".join(rng.choice([*lines, f"line {rng.randint(0, 60)}"]) for _ in range(rng.randint(1, 9)))]), "x", "y") for i in range(200)]
    rows += rows[:20]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = R.repeated_lines(spark.createDataFrame(rows, SCHEMA), "id", "company_id", "title", "description", 3)
        found = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(found) == len(set(found)) and set(found) == brute(rows, 3)


def longest(rows, least):
    """The longest block of at least ``least`` titles at each line, by comparing all of them."""
    spans, docs = {}, {}
    for i, c, t, d, *_ in rows:
        docs[i] = c, ["".join(ch for ch in line.lower() if ch.isalnum()) for line in d.split("\n")]
        ls = docs[i][1]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if not ls[b - 1]:
                    break
                spans.setdefault((c, tuple(ls[a:b])), set()).add(t)
    out = {}
    for i, (c, ls) in docs.items():
        for a in range(len(ls)):
            n = max((b - a for b in range(a + 1, len(ls) + 1) if "" not in ls[a:b] and len(spans[c, tuple(ls[a:b])]) >= least), default=0)
            if n:
                out[i, a + 1] = n
    return out


def test_longest_blocks_equal_brute_force(spark):
    rng = random.Random(3)
    blocks = [[f"block {b} {j}" for j in range(n)] for b, n in enumerate((1, 2, 3, 4, 5, 7, 16, 19, 20, 21, 37, 70))]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 4)):
            block = rng.choice(blocks)
            a = rng.randint(0, len(block) // 3)
            lines += rng.choice([block, block[a:], block[: len(block) - a], ["--"], [f"own {i} {rng.random()}"], ["same"] * rng.randint(1, 6)])
        rows.append((i, rng.choice([1, 1, 2]), rng.choice("abcdef"), "\n".join(lines), "", ""))
    want = longest(rows, 3)
    df = R.identified(spark.createDataFrame(rows, SCHEMA), "id", "company_id", "title", "description")
    assert {(r.doc, r.line_no): r.length for r in R.longest_blocks(R.cut(df), 3).collect()} == want
    outer = {(r.doc, r.line_no): r.length for r in R.repeated_blocks(spark.createDataFrame(rows + rows[:9], SCHEMA), "id", "company_id", "title", "description", 3).collect()}
    assert outer == {(i, a): n for (i, a), n in want.items() if want.get((i, a - 1), 0) - 1 < n}
    assert max(want.values()) > 64


def test_chunk_names_stop_at_breaks():
    ids = np.arange(1, 41, dtype=np.uint64)
    there = np.ones(40, bool)
    there[20] = False
    names, ok = R.chunk_names(ids, there, 2)
    assert len(names) == 25 and ok.tolist() == [a + 16 <= 20 or a > 20 for a in range(25)]
    assert len(set(names.tolist())) == 25 and len(R.chunk_names(ids[:3], there[:3], 1)[0]) == 0


def test_equal_suffixes_are_spread(spark):
    rows = [(i, 1, f"t{i % 3}", "Same line", "", "") for i in range(20_000)]
    df = R.identified(spark.createDataFrame(rows, SCHEMA), "id", "company_id", "title", "description").select("*", F.lit(None).cast("array<struct<line:bigint,length:bigint,prefix:bigint>>").alias("at"))
    array = df.mapInArrow(R._suffixes(0), R._SUFFIX)
    sizes = [r["count"] for r in array.repartitionByRange(8, "source", "prefix", *R.CHUNKS, "doc", "line_no").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]
    assert R.wide_intervals(array, 3).count() == 1


def test_a_line_in_every_document(spark):
    rows = [(i, 1, f"t{i % 50}", "Same line\nown %d" % i, "", "") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    lines = R.repeated_lines(df, "id", "company_id", "title", "description", 3)
    assert lines.count() == 3000 and {r.line_no for r in lines.collect()} == {1}
    out = R.stripped(df, "id", "description", lines)
    assert {r.id: r.description for r in out.collect()} == {i: f"own {i}" for i in range(3000)}


def test_stripping_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, 1, "a", " x \n\n y\r\nz", "", ""), (2, 1, "a", None, "", "")], SCHEMA)
    lines = spark.createDataFrame([(1, 4)], "doc long, line_no long")
    assert {r.id: r.description for r in R.stripped(df, "id", "description", lines).collect()} == {1: " x \n\n y\r", 2: None}


def test_nothing(spark):
    assert R.repeated_lines(spark.createDataFrame([], SCHEMA), "id", "company_id", "title", "description").count() == 0
