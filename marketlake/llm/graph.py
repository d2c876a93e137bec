"""Connected components of an edge table, without gathering any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable.

    Each round takes the smallest label of all neighbours, hands it to the former label too, in one
    grouping, and then follows labels one step, so paths shorten by doubling. Every round is written to
    the shared folder. Only sums and minima meet at a node, so a hub does no harm.
    """
    # An edge given twice makes no other minimum.
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        own, other = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        named = both.join(other, "b").join(own, "a")
        # A node and the node it is called after both hear what each neighbour is called now.
        heard = named.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("lb").alias("label")), F.struct(
            F.col("la").alias("node"), F.col("lb").alias("label")))).alias("o")).select("o.node", "o.label")
        hooked = materialize(heard.union(labels).groupBy("node").agg(F.min("label").alias("label")), "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        following = hooked.join(up, "label").select("node", F.least("label", "further").alias("label"))
        following = materialize(following, "labels")
        changed = following.withColumnRenamed("label", "new").join(labels, "node").where("new <> label").limit(1).count()
        labels = following
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
