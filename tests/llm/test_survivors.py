import datetime as dt
import random

import pytest

from postmill.llm import survivors as S

T = lambda y: dt.datetime(y, 1, 1)
SCHEMA = "id long, canonical_id long, company_id long, description string, location string, department string, posted_at timestamp, group_id string, source string"
RUNS = "id long, started_at timestamp, finished_at timestamp"


def post(i, c=None, description="", location=None, department=None, posted=None, company=1):
    return (i, c, company, description, location, department, posted, "x", "y")


def found(spark, rows, f=S.surviving_values):
    runs = spark.createDataFrame([(1, T(2020), None), (2, T(2025), None)], RUNS)
    return {(r.group_id, r.field_name): r.posting_id for r in f(spark.createDataFrame(rows, SCHEMA), runs).collect()}


def test_fields_from_the_best_member(spark):
    rows = [
        post(1, description="short", location="Graz", posted=T(2024)),
        post(2, 1, description="  long text \u00a0", location=" tbd ", department="Ops", posted=T(2014)),
        post(3, 2, description="long text", location="Linz", posted=T(2025)),
        post(4, 3, description=" \n", location="Wels", department="n/a", posted=T(2026)),
        post(5, 4, department="-"),
        post(9, 9, description="alone"),
        post(10, description="no group"),
        post(20, 21), post(21, 20),
        post(30, 99, description="a"), post(31, 99, description="a"),
    ]
    assert found(spark, rows + rows[:2]) == {(1, "description"): 2, (1, "location"): 3, (1, "department"): 2, (1, "posted_at"): 1, (30, "description"): 30}


def test_members_without_date_come_last(spark):
    rows = [post(1, location="A"), post(2, 1, location="B"), post(3, 1, location="C", posted=T(2016)), post(4, 1, department="D"), post(5, 1, department="E", posted=T(2099))]
    assert found(spark, rows) == {(1, "location"): 3, (1, "department"): 4, (1, "posted_at"): 3}


def test_nothing(spark):
    assert found(spark, []) == {} and found(spark, [post(1), post(2)]) == {}


def test_a_large_group(spark):
    rows = [post(0, description="x")] + [post(i, 0, description="x" * (i % 7)) for i in range(1, 2000)]
    assert found(spark, rows) == {(0, "description"): 6}


def test_reliable_sources_outvote(spark):
    # source r is right in the groups that the others settle; u is wrong there
    claims = []
    for g in range(6):
        claims += [(g, "f", 10 * g + 1, "r", "good"), (g, "f", 10 * g + 2, "s", "good"), (g, "f", 10 * g + 3, "t", "good"), (g, "f", 10 * g + 4, "u", "bad"), (g, "f", 10 * g + 5, "v", "bad")]
    claims += [(99, "f", 990, "u", "wrong"), (99, "f", 991, "r", "right"), (98, "f", 980, "u", None), (98, "f", 981, "v", "only")]
    df = spark.createDataFrame(claims, "group_id long, field_name string, id long, source string, value string")
    chosen, weights = S.discover(df)
    by = {r.group_id: (r.value, r.id) for r in chosen.collect()}
    # two equal votes at first, decided by the sources' reliability
    assert by[99] == ("right", 991) and by[0] == ("good", 1) and by[98] == ("only", 981)
    w = {r.source: r.reliability for r in weights.collect()}
    assert w["r"] > 0.9 > 0.5 > w["u"]
    assert found(spark, [post(1, location="Graz"), post(2, 1, location="graz ", company=2), post(3, 1, location="Linz", company=3)], S.discovered_values) == {(1, "location"): 1}


def plain_loop(claims):
    """The same estimates by plain loops over all claims."""
    rows = {(g, f, i, s): (v, r) for g, f, i, s, v, r in claims if v is not None}
    weight = {k[3]: S.PRIOR for k in rows}
    fields = {k[:2] for k in rows}
    chosen = None
    while True:
        now = {}
        for field in fields:
            own = [(i, s, v, r) for (g, f, i, s), (v, r) in rows.items() if (g, f) == field]
            best = []
            for v, r in {(v, r) for _, _, v, r in own}:
                backing = [s for _, s, v2, r2 in own if (v2 == v if r is None else r2 <= r)]
                best.append((round(sum(weight[s] for s in backing), 9), r or 0, -min(i for i, _, v2, _ in own if v2 == v), v))
            now[field] = max(best)
        if chosen is not None and all(now[f][3] == chosen[f][3] for f in fields):
            return {f: (b[3], -b[2]) for f, b in now.items()}, weight
        chosen = now
        for s in weight:
            own = [v == chosen[k[:2]][3] for k, (v, _) in rows.items() if k[3] == s]
            weight[s] = (sum(own) + S.PRIOR * S.PRIOR_CLAIMS) / (len(own) + S.PRIOR_CLAIMS)


@pytest.mark.parametrize("seed", range(3))
def test_discovery_equals_plain_loops(spark, seed):
    rng = random.Random(seed)
    honest = {f"s{i}": rng.random() for i in range(7)}
    claims = []
    for i in range(400):
        g, source = rng.randrange(25), rng.choice(list(honest))
        claims.append((g, "free", i, source, "true" if rng.random() < honest[source] else rng.choice("abc"), None))
        rank = rng.randrange(4)
        claims.append((g, "ordered", i, source, rng.choice([str(rank), None]), rank))
    df = spark.createDataFrame(claims, "group_id long, field_name string, id long, source string, value string, rank long")
    chosen, weights = S.discover(df.union(df.limit(30)))
    want, weight = plain_loop(claims)
    assert {(r.group_id, r.field_name): (r.value, r.id) for r in chosen.collect()} == want
    assert {r.source: round(r.reliability, 6) for r in weights.collect()} == {s: round(w, 6) for s, w in weight.items()}
    # an ordered field is decided by its order, whoever claims it
    best = {}
    for g, f, i, _, v, r in claims:
        if f == "ordered" and v is not None:
            best[g] = max(best.get(g, (-1, 0)), (r, -i))
    assert {g: v for (g, f), v in want.items() if f == "ordered"} == {g: (str(r), -i) for g, (r, i) in best.items()}


def test_a_rank_cut_over_slices_has_all_votes(spark):
    # one group, two ranks, very many sources: every slice of the range sort holds a part of a rank
    claims = [(1, "f", i, f"s{i}", str(i % 2), i % 2) for i in range(3000)]
    df = spark.createDataFrame(claims, "group_id long, field_name string, id long, source string, value string, rank long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert S.ballot(df).select("slice").distinct().count() > 1
        (row,) = S.discover(df)[0].collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (row.value, row.id) == ("1", 1)
