"""Connected components of a large undirected graph as DataFrame rounds.

Every round each node takes the smallest label among itself and its neighbours and then its label's label
(a pointer jump), so chains shrink geometrically. A node with very many edges only sends its label along
them and receives one partially aggregated minimum; nothing is gathered per node or component.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import cut, release


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node id of each node's component, for all nodes of ``edges``.

    Null ends are left aside; an edge of a node with itself makes the node a component; repeated edges count
    once. Every round but the last lowers a label, and a label is never less than its component's smallest id, so
    the rounds end; the label a node hears of at a distance doubles with every jump.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).distinct()
    both = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("component")))
    for _ in count():
        sent = both.join(labels, both.x == labels.node).groupBy(F.col("y").alias("node")).agg(F.min("component").alias("heard"))
        hooked = labels.join(sent, "node").select("node", F.col("component").alias("before"), F.least("component", "heard").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        # the labels' labels of the round before: still a node of the same component, never larger
        old, labels = labels, cut(hooked.join(jump, "component").select("node", "before", F.least("component", "further").alias("component")))
        release(old)
        if labels.where("before <> component").isEmpty():
            release(both)
            return labels.select("node", "component")
    raise AssertionError
