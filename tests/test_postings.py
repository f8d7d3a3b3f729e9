import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill import schemas
from postmill.operators import boilerplate, cluster, embed, search, snapshot
from postmill.state import VersionedTable

T0, T1 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)


def posting(id_, company=1, **given):
    row = {f.name: None for f in schemas.POSTINGS.fields} | {"id": id_, "company_id": company, "external_id": f"e{id_}", "title": "T", "normalized_title": "t", "url": "u", "description": "", "content_hash": "h", "first_seen_at": T0, "last_seen_at": T0}
    return tuple((row | given).values())


def postings(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.POSTINGS)


SNAP = "company_id long, external_id string, title string, normalized_title string, location string, department string, url string, description string, content_hash string, posted_at timestamp"


def test_merge(spark):
    state = postings(
        spark,
        posting(1, canonical_id=9, embedding=[1.0], embedding_hash="h", posted_at=None),
        posting(2, closed_at=T0, posted_at=T0),
        posting(3, canonical_id=1),
        posting(4, company=2),
        posting(5, company=3),
        posting(6, company=4, closed_at=T0),
    )
    snap = spark.createDataFrame(
        [(1, "e1", "New", "new", "L", "D", "u2", "d2", "h2", T1), (1, "e2", "T", "t", None, None, "u", "", "h", T1), (1, "z9", "Z", "z", None, None, "u", "", "h", None), (1, "a0", "A", "a", None, None, "u", "", "h", None), (2, "e77", "failed board", "f", None, None, "u", "", "h", None)], SNAP
    )
    # company 2 failed, company 3 was read and is empty
    merged = snapshot.merge(state, snap, spark.createDataFrame([(1,), (3,), (4,)], "company_id long"), F.lit(T1))
    by = {r.external_id: r for r in merged.collect()}
    assert {k: r.change for k, r in by.items()} == {"e1": "seen", "e2": "reopened", "e3": "closed", "e4": None, "e5": "closed", "e6": None, "z9": "created", "a0": "created"}
    assert (by["e1"].title, by["e1"].posted_at, by["e1"].canonical_id, by["e1"].embedding, by["e1"].first_seen_at, by["e1"].last_seen_at) == ("New", T1, 9, [1.0], T0, T1)
    assert by["e2"].closed_at is None and by["e2"].posted_at == T0
    assert by["e3"].closed_at == T1 and by["e3"].canonical_id is None
    assert by["e4"].closed_at is None and by["e5"].closed_at == T1 and by["e6"].closed_at == T0
    assert (by["a0"].id, by["z9"].id) == (7, 8) and by["a0"].first_seen_at == T1
    counters = snapshot.poll_counters(merged, snap, spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, None)], "company_id long, error string")).head()
    assert tuple(counters) == (3, 1, 4, 2, 2)
    again = snapshot.merge(merged.drop("change"), snap, spark.createDataFrame([(1,), (3,), (4,)], "company_id long"), F.lit(T1))
    assert {r.change for r in again.collect()} == {"seen", None}


def test_last_per_key_and_empty_merge(spark):
    rows = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "b", 1, None)], "company_id long, external_id string, arrival long, title string")
    assert {tuple(r) for r in snapshot.last_per_key(rows, ["company_id", "external_id"], "arrival").select("external_id", "title").collect()} == {("a", "y"), ("b", None)}
    none = snapshot.merge(postings(spark), spark.createDataFrame([], SNAP), spark.createDataFrame([], "company_id long"), F.lit(T1))
    assert none.count() == 0


def test_links_and_embeddings(spark):
    p = postings(spark, posting(1, canonical_id=5), posting(2), posting(3, embedding=[1.0], embedding_hash="o"))
    links = snapshot.replace_links(p, spark.createDataFrame([(2, 1)], "id long, canonical_id long"))
    assert {r.id: r.canonical_id for r in links.collect()} == {1: None, 2: 1, 3: None}
    saved = snapshot.save_embeddings(p, spark.createDataFrame([(2, [2.0], "n")], "id long, embedding array<float>, embedding_hash string"))
    assert {r.id: (r.embedding, r.embedding_hash) for r in saved.collect()} == {1: (None, None), 2: ([2.0], "n"), 3: ([1.0], "o")}


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), schemas.COMPANIES)
    assert t.read().count() == 0
    row = lambda i: (i, "n", "LEVER", f"b{i}", True, None, None)
    t.write(spark.createDataFrame([row(1)], schemas.COMPANIES))
    t.write(t.read().unionByName(spark.createDataFrame([row(2)], schemas.COMPANIES)))
    assert t.read().count() == 2 and t.read(1).count() == 1
    with pytest.raises(RuntimeError):
        t.write(t.read(), expect=1)
    t.write(t.read().where("id = 1"))
    t.vacuum(1)
    assert [r.id for r in t.read().collect()] == [1]


def greedy(rows, threshold, k):
    """rows: (id, block, rank, text)."""
    import re

    def sets(t):
        w = [x for x in re.split(r"[^\w+#]+", t.lower()) if x]
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    links, led = {}, {}
    for i, block, _, t in sorted(rows, key=lambda r: (r[1], r[2])):
        s = sets(t)
        for j, o in led.setdefault(block, []):
            if (not s and not o) or len(s & o) / max(1, len(s | o)) >= threshold - 1e-12 and s & o:
                links[i] = j
                break
        else:
            led[block].append((i, s))
    return links


def test_clusters_equal_greedy_leaders(spark):
    rng = random.Random(3)
    rows = []
    for block in "pqr":
        base = [[rng.choice("abcdefghij") for _ in range(30)] for _ in range(3)]
        for n in range(25):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(30)] = rng.choice("klmn")
            rows.append((len(rows), block, rng.randint(0, 10**6), " ".join(words)))
    rows += [(900, "p", 2, ""), (901, "p", 3, " "), (902, "p", 4, "a b"), (903, "p", 9, "a b"), (904, "q", 1, rows[30][3]), (905, "q", 10**7, rows[30][3])]
    df = spark.createDataFrame(rows, "id long, block string, rank long, text string")
    got = {r.id: r.canonical_id for r in cluster.cluster(df, 0.7, 2).collect()}
    assert got == greedy(rows, 0.7, 2)


def test_chain_is_not_a_component(spark):
    words = [f"w{i}" for i in range(40)]
    a, b, c = words[:20], words[3:23], words[6:26]
    rows = [(1, "x", 1, " ".join(a)), (2, "x", 2, " ".join(b)), (3, "x", 3, " ".join(c))]
    got = {r.id: r.canonical_id for r in cluster.cluster(spark.createDataFrame(rows, "id long, block string, rank long, text string"), 0.6, 2).collect()}
    assert got == {2: 1}
    assert cluster.cluster(spark.createDataFrame([], "id long, block string, rank long, text string")).count() == 0


def test_boilerplate_is_stripped_before_comparing(spark):
    words = lambda seed, n: " ".join(random.Random(seed).choice("alpha beta gamma delta kappa sigma omega theta".split()) + str(random.Random(seed * 1000 + i).randint(0, 99)) for i in range(n))
    notice = words(1, 200)  # much longer than the roles
    role, other = words(2, 60), words(3, 60)
    rows = [posting(i, normalized_title=t, description=f"{notice}\n{d}") for i, t, d in ((1, "a", role), (2, "a", other), (3, "b", words(4, 60)), (4, "c", words(5, 60)))]
    # the same role with two different long notices: alike only without them
    rows += [posting(5, normalized_title="a", description=f"{notice}\n{role}\n"), posting(6, normalized_title="a", description=role)]
    p = postings(spark, *rows)
    hashes = boilerplate.boilerplate(p, 3)
    assert hashes.count() == 1
    texts = {r.id: r.text for r in boilerplate.compared_text(p, hashes).collect()}
    assert texts[1] == role + "\n" and len(texts[1]) >= 300
    got = {r.id: r.canonical_id for r in cluster.deduplicate(p).collect()}
    assert got == {5: 1, 6: 1}  # 2 shares only the notice with 1
    short = postings(spark, *[posting(i, normalized_title=t, description=f"{notice}\nshort") for i, t in ((1, "a"), (2, "b"), (3, "c"))])
    assert {r.text for r in boilerplate.compared_text(short, boilerplate.boilerplate(short)).collect()} == {f"{notice}\nshort"}
    plain = postings(spark, posting(1, description="  x \n\n y"))
    assert boilerplate.stripped(plain, boilerplate.boilerplate(plain)).head().role_text == "  x \n\n y"


def test_dedup_order_dates_then_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    p = postings(spark, posting(1, description=text), posting(2, description=text, posted_at=T1), posting(3, description=text, posted_at=T0), posting(4, description=text, closed_at=T0))
    assert {r.id: r.canonical_id for r in cluster.deduplicate(p).collect()} == {1: 3, 2: 3}


COMPANIES = [(1, "Acme", "LEVER", "a", True, None, None), (2, "Bolt", "LEVER", "b", True, None, None)]


def test_search(spark):
    c = spark.createDataFrame(COMPANIES, schemas.COMPANIES)
    p = postings(
        spark,
        posting(1, title="100% Remote", posted_at=T0, location="Graz"),
        posting(2, title="1000 Remote", posted_at=T1, location=None),
        posting(3, title="a\\b", company=2),
        posting(4, title="Remote", canonical_id=1),
        posting(5, title="Remote", closed_at=T0),
        posting(6, company=99),
    )
    ids = lambda **o: [r.id for r in search.search(p, c, **o).collect()]
    assert ids() == [2, 1, 3] and ids(q=" ") == [2, 1, 3]
    assert ids(include_duplicates=True) == [2, 1, 3, 4]
    assert ids(q="100% r") == [2, 1] and ids(q="a\\b") == [3] and ids(q="100\\%") == [1]
    assert ids(location="gra") == [1] and ids(company_id=2) == [3]
    assert ids(limit=0) == [2] and ids(limit=1, offset=1) == [1] and ids(offset=-4, limit=9999) == [2, 1, 3]
    assert [r.id for r in search.by_ids(p, c, [5, 1]).collect()] and search.by_ids(p, c, []).count() == 0
    d = search.job_detail(p, c, 4).head()
    assert d.id == 4 and [x.id for x in d.duplicates] == [4]
    assert [x.id for x in search.job_detail(p, c, 1).head().duplicates] == [4]
    assert search.job_detail(p, c, 77).count() == 0
    assert [r.id for r in search.duplicates_of(p, c, 1).collect()] == [4]
    s = search.stats(p, c).head()
    assert (s.companies, s.open_postings, s.duplicates, s.canonical_postings, s.embedded, s.closed, s.duplicate_rate) == (2, 5, 1, 4, 0, 1, 0.2)
    assert search.stats(postings(spark), c).head().duplicate_rate == 0.0


def test_match(spark):
    c = spark.createDataFrame(COMPANIES, schemas.COMPANIES)
    p = postings(
        spark,
        posting(1, embedding=[1.0, 0.0], location="Graz, AT"),
        posting(2, embedding=[1.0, 1.0], location="Remote"),
        posting(3, embedding=[0.0, 0.0]),
        posting(4, embedding=[1.0, 0.0, 0.0]),
        posting(5, embedding=[1.0, 0.0], canonical_id=1),
        posting(6, embedding=[2.0, 0.0], closed_at=T0),
        posting(7, embedding=[float("nan"), 1.0]),
    )
    got = search.match(p, c, [1.0, 0.0], 10).collect()
    assert [(r.id, r.score) for r in got[:3]] == [(1, 1.0), (2, 0.7071), (3, 0.0)] and got[3].id == 7
    assert [r.id for r in search.match(p, c, [1.0, 0.0], 10, location="REMOTE").collect()] == [2]
    assert [r.id for r in search.match(p, c, [1.0, 0.0], 10, location="a%t", over_fetch=True).collect()] == []
    assert search.postings_ranked(p).head()[0] == 5


def test_embedding(spark):
    c = spark.createDataFrame(COMPANIES, schemas.COMPANIES)
    p = postings(spark, posting(1, title="T", location="L", department="D", description="x"), posting(2, embedding=[1.0], embedding_hash="h"), posting(3, embedding=[1.0], embedding_hash="old"), posting(4, canonical_id=1), posting(5, closed_at=T0))
    work = {r.id: r.text for r in embed.pending_work(p, c).collect()}
    assert work == {1: "T at Acme\nLocation: L\nTeam: D\n\nx", 3: "T at Acme\n\n"}
    assert [r.id for r in embed.pending_work(p, c, 1).collect()] == [1]
    out = embed.embed_pending(p, c, lambda texts, role: np.array([[len(t)] for t in texts])).collect()
    assert {r.id: (r.embedding, r.embedding_hash) for r in out} == {i: ([float(len(t))], "h") for i, t in work.items()}
    assert embed.embed_pending(p, c, None).count() == 0
    with pytest.raises(Exception, match="embeddings for"):
        embed.embed_pending(p, c, lambda texts, role: np.zeros((0, 1))).collect()
    assert embed.java_hash("hello") == 99162322 and embed.java_hash("polygenelubricants") == -(2**31)
    waits, calls = [], []

    def flaky(texts, role):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return np.ones((len(texts), 1))

    assert embed.retrying(flaky, lambda e: True, sleep=waits.append)(["a"], "query").shape == (1, 1) and waits == [2.0, 4.0]
    with pytest.raises(ConnectionError):
        embed.retrying(lambda t, r: (_ for _ in ()).throw(ConnectionError()), lambda e: False)(["a"], "query")
    assert embed.retryable_status(429) and embed.retryable_status(503) and not embed.retryable_status(404)


@pytest.mark.parametrize("few", [(), (985,)])
def test_drifting_chain_of_500_settles(spark, few):
    """Each node resembles only the one before it: every second leads."""
    nodes = spark.range(500).select(F.col("id").alias("node"), F.col("id").alias("rank"))
    pairs = spark.range(499).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.leader for r in cluster.leaders(nodes, pairs, *few).collect()}
    assert got == {i: i - 1 if i % 2 else None for i in range(500)}


def test_match_all_answers_every_query(spark):
    rng = random.Random(5)
    c = spark.createDataFrame(COMPANIES, schemas.COMPANIES)
    p = postings(spark, *[posting(i, embedding=[rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(40)], posting(50, embedding=[1.0, 0.0]), posting(51, embedding=[float("nan")] * 3))
    queries = [(0, [1.0, 0.5, 0.0]), (100, [0.0, -1.0, 2.0]), (200, [0.0, 0.0, 0.0]), (300, [1.0, 1.0])]
    got = search.match_all(p, c, spark.createDataFrame(queries, "query_id long, vector array<float>"), 6, block_rows=10).collect()
    finite = p.where("id <> 51")
    for q, v in queries:
        want = [(r.score, r.id) for r in search.match(finite, c, v, 6).collect()]
        assert sorted((-r.score, r.id) for r in got if r.query_id == q) == sorted((-s, i) for s, i in want)
