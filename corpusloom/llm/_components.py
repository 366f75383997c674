"""Pairs of a bucket's members, and connected components of links by least labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Members of a bucket that one task pairs with others.
BLOCK = 256


def leaders(member: DataFrame, least: bool = True) -> DataFrame:
    """(key, leader, met): the leaders of every bucket of member (key, node, ...), as structs of its columns without the key.

    The member that meets most others over all its buckets, as what others were copied
    from stands in more of their buckets than they do in each other's (`met`
    counts these), and the least member unless `least` is false.
    """
    own = F.struct("node", *(c for c in member.columns if c not in ("key", "node")))
    sizes = member.groupBy("key").agg(F.count("*").alias("_size"))
    met = member.join(sizes, "key").groupBy("node").agg(F.sum("_size").alias("_met"))
    found = member.join(met, "node").groupBy("key").agg(F.min(own).alias("_l"), F.max(F.struct("_met", own.alias("_own"))).alias("_h"))
    return found.select("key", F.explode(F.array_distinct(F.array("_l", "_h._own"))).alias("leader") if least else F.col("_h._own").alias("leader"), F.col("_h._met").alias("met"))


def cross_pairs(member: DataFrame) -> DataFrame:
    """(a, b): every two members (key, node, label) of a bucket that have different labels, a < b, each pair once.

    Members outside the bucket's largest label meet all others, so that what is linked
    already is not paired with itself; large buckets are split.
    """
    sizes = member.groupBy("key", "label").agg(F.count("*").alias("_n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("_n", "label")).alias("_most"), F.count("*").alias("_labels"), F.ceil(F.sum("_n") / BLOCK).alias("_blocks")).where("_labels > 1")
    dealt = materialize(member.join(most, "key").withColumn("_minor", F.col("label") != F.col("_most.label")))
    left = dealt.where("_minor").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"), F.col("node").alias("a"), F.col("label").alias("_la"))
    right = dealt.select("key", F.pmod(F.xxhash64("node"), "_blocks").alias("_block"), F.col("node").alias("b"), F.col("label").alias("_lb"), "_minor")
    met = left.join(right, ["key", "_block"]).where("_la <> _lb and (not _minor or a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, files: int = 0) -> DataFrame:
    """(node, label) for every node of edges (a, b); the label is the least node of the component.

    A node that is linked only to itself is a component of its own; without edges
    there are no rows; ids are not null. Each round takes the least label among a node and its neighbours (a partial
    aggregate, so a hub is summed where its rows are) and then the label's own label.
    files: of each table that is written on the way (0: one for each task).
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), files)
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), files)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = materialize(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "m").alias("new"), F.col("label").alias("old")), files)
        own = lower.select(F.col("node").alias("new"), F.col("new").alias("next"))
        jumped = materialize(lower.join(own, "new").select("node", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("moved")), files)
        if jumped.where("moved").isEmpty():
            return labels
        labels = jumped.select("node", "label")
