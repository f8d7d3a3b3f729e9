"""Leader clustering of near-duplicates within blocks.

In rank order (earliest posting first) each record becomes a duplicate of the first leader it resembles, or
a leader itself. Set-based: leaders are the lexicographically first maximal independent set of the
similarity graph, and a duplicate's leader is its neighbour of smallest rank among them. The graph comes
from an exact similarity join with prefix filtering: two sets of similarity t share one of the first
n - ceil(t n) + 1 shingles in any common order, so only those are joined. Leaders are then settled in
rounds, each a join and an aggregate; nothing is gathered per block. What is open after a few rounds, as long
chains are, is split into connected components, and those of a bounded number of links are settled at once, each
in a task; the rounds go on for larger ones.

Records of equal sets in a block are one node (their earliest), so groups of copies cost linear work.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import shingles
from postmill.operators.boilerplate import boilerplate, compared_text
from postmill.operators.components import components
from postmill.session import cut, release


def candidates(postings: DataFrame) -> DataFrame:
    """Open postings whose (company_id, normalized_title) occurs more than once."""
    open_ = postings.where(F.col("closed_at").isNull())
    groups = open_.groupBy("company_id", "normalized_title").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return open_.join(groups, ["company_id", "normalized_title"], "left_semi")


def similar_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), rank of a before b: pairs of nodes of one block with similarity >= threshold.

    nodes: (node, block, rank, set), sets not empty.
    """
    n = F.size("set")
    prefix = F.greatest(F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1, F.lit(1))
    each = nodes.select("node", "block", "rank", n.alias("n"), F.explode("set").alias("token"))
    # rare shingles come first: of a block's common ones few are among the first, and single ones meet nobody
    often = each.groupBy("block", "token").agg(F.count("*").alias("f")).where("f > 1")
    ranked = each.join(often, ["block", "token"], "left").groupBy("node", "block", "rank", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "token"))).alias("all"))
    first = ranked.select("node", "block", "rank", "n", F.explode(F.filter(F.slice("all", F.lit(1), prefix), lambda x: x["f"] > 1)).alias("t"))
    tokens = cut(first.select("node", "block", "rank", "n", F.col("t.token").alias("token")))
    a, b = tokens.alias("a"), tokens.alias("b")
    sizes = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(threshold) - F.lit(1e-9)
    # ranks are structs of time and id: a total order
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.rank") < F.col("b.rank")) & sizes).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    sets = nodes.select("node", "set")
    both = met.join(sets.withColumnRenamed("node", "a").withColumnRenamed("set", "x"), "a").join(sets.withColumnRenamed("node", "b").withColumnRenamed("set", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= (F.size("x") + F.size("y") - common) * F.lit(threshold) - F.lit(1e-9)).select("a", "b")


def _settled(links: list[tuple]) -> dict:
    """Whether each open node leads. links: (node, earlier neighbour, None if that is open, else True if it
    leads), and (node, None, None) for every open node.
    """
    waits, later, leads = {n: 0 for n, _, _ in links}, defaultdict(list), {}
    for node, other, o in links:
        if o:
            leads[node] = False
        elif other is not None:
            waits[node] += 1
            later[other].append(node)
    ready = [n for n in waits if n in leads or not waits[n]]
    while ready:
        node = ready.pop()
        lead = leads.setdefault(node, True)
        for n in later.pop(node, ()):
            waits[n] -= 1
            if n not in leads and (lead or not waits[n]):
                leads[n] = not lead
                ready.append(n)
    return leads


def _settle(table: pa.Table) -> pa.Table:
    """(node, leads) of a component's links (component, node, other, o)."""
    done = _settled(list(zip(*(table.column(c).to_pylist() for c in ("node", "other", "o")))))
    return pa.table({"node": pa.array(done.keys(), pa.int64()), "leads": pa.array(done.values(), pa.bool_())})


def _small_components(links: DataFrame, few: int) -> DataFrame:
    """(node, leads) of the nodes in components of at most ``few`` links. links: (node, other, o) as ``_settled`` has."""
    open_ = links.where("o is null")
    parts = components(open_.select("node", F.coalesce("other", "node").alias("other")), "node", "other").withColumnRenamed("node", "n")
    each = links.join(parts, links.node == parts.n).select("component", "node", "other", "o")
    small = each.groupBy("component").agg(F.count("*").alias("c")).where(F.col("c") <= few).select("component")
    return each.join(small, "component", "left_semi").groupBy("component").applyInArrow(_settle, "node long, leads boolean")


def leaders(nodes: DataFrame, pairs: DataFrame, few: int = 200_000) -> DataFrame:
    """(node, leader): the first leader that each node resembles, null for leaders.

    A node is settled once all its earlier neighbours are: it is a leader if none of them is one. Each round
    settles one node at least; every fourth one also settles the components of at most ``few`` links.
    """
    ranks = nodes.select("node", "rank")
    before = cut(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    touched = before.select("node").union(before.select("other")).distinct()
    state = cut(touched.select("node", F.lit(None).cast("boolean").alias("leads")))
    for done in count(1):
        seen = before.join(state.select(F.col("node").alias("other"), F.col("leads").alias("o")), "other")
        votes = seen.groupBy("node").agg(F.bool_or("o").alias("any"), F.count_if(F.col("o").isNull()).alias("waiting"))
        now = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("any", F.lit(False)), F.lit(False)).when(F.coalesce("waiting", F.lit(0)) == 0, F.lit(True))
        old, state = state, cut(state.join(votes, "node", "left").select("node", now.alias("leads")))
        release(old)
        open_ = state.where("leads is null").select("node")
        if open_.isEmpty():
            break
        if done % 4 == 0:
            others = state.where("leads is null or leads").select(F.col("node").alias("other"), F.col("leads").alias("o"))
            links = before.join(open_, "node").join(others, "other").select("node", "other", "o")
            links = cut(links.union(open_.select("node", F.lit(None).cast("long").alias("other"), F.lit(None).cast("boolean").alias("o"))))
            found = cut(_small_components(links, few))
            old, state = state, cut(state.join(found.withColumnRenamed("leads", "l"), "node", "left").select("node", F.coalesce("leads", "l").alias("leads")))
            for x in (old, links, found):
                release(x)
    lead = state.where("leads").select(F.col("node").alias("other")).join(ranks.withColumnRenamed("node", "other"), "other")
    first = before.join(lead, "other").groupBy("node").agg(F.min_by("other", "rank").alias("leader"))
    # neighbours of a leader that come before it are no leaders; its later ones can't be its leader
    return nodes.select("node").join(first, "node", "left").select("node", "leader")


def cluster(rows: DataFrame, threshold: float = 0.7, shingle: int = 4) -> DataFrame:
    """(id, canonical_id) of the duplicates. rows: (id, block, rank, text), block any, rank orderable."""
    # an empty set resembles only empty sets; a mark of its own makes that so
    sets = F.when(F.size("s") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_sort("s"))
    hashed = cut(rows.select("id", F.xxhash64("block").alias("block"), "rank", shingles(F.coalesce("text", F.lit("")), shingle).alias("s")).select("id", "block", "rank", sets.alias("set")))
    keyed = hashed.withColumn("same", F.struct(F.xxhash64("set"), F.xxhash64(F.lit(1), "set")))  # 128 bits
    nodes = cut(keyed.groupBy("block", "same").agg(F.min_by(F.struct("id", "set"), "rank").alias("r"), F.min("rank").alias("rank")).select("block", "same", F.col("r.id").alias("node"), "rank", F.col("r.set").alias("set")))
    found = leaders(nodes, similar_pairs(nodes, threshold))
    chosen = nodes.select("block", "same", "node").join(found, "node")
    return keyed.select("id", "block", "same").join(chosen, ["block", "same"]).where((F.col("id") != F.col("node")) | F.col("leader").isNotNull()).select("id", F.coalesce("leader", "node").alias("canonical_id"))


def deduplicate(postings: DataFrame, threshold: float = 0.7, shingle: int = 4, min_titles: int = 3) -> DataFrame:
    """(id, canonical_id) of the duplicates among open postings of equal company and title key; the earliest
    posting leads, unknown dates come last, ids break ties.
    """
    chosen = candidates(postings)
    texts = compared_text(chosen, boilerplate(postings, min_titles))
    rank = F.struct(F.coalesce(F.unix_micros("posted_at"), F.lit(2**62)).alias("at"), F.col("id").alias("id"))
    rows = chosen.select("id", F.struct("company_id", "normalized_title").alias("block"), rank.alias("rank")).join(texts, "id")
    return cluster(rows, threshold, shingle)
