"""Single-linkage clusters of codes within a radius."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import hamming
from sigloom.operators.storage import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (u, v): each round every node joins the least
    of its neighbours and itself, by a hash that changes with the round, and edges are
    redrawn between what they joined, until none is left. By hashes a good share of the
    nodes goes each round, on chains too, where the order of ids would take one off a
    round. Nothing of size reaches the driver."""

    def tidy(e: DataFrame) -> DataFrame:
        return checkpointed(e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    labels = checkpointed(nodes.select("node", F.col("node").alias("root")))
    edges = tidy(edges)
    turn = 0
    while not edges.isEmpty():
        turn += 1
        low, own = (F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to")) for c in ("v", "at"))
        up = edges.union(edges.select("v", "u")).groupBy(F.col("u").alias("at")).agg(F.min(low).alias("low"))
        up = checkpointed(up.select("at", F.least("low", own)["to"].alias("to")))
        labels = checkpointed(labels.join(up, F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root")))
        half = edges.join(up, F.col("u") == F.col("at")).select(F.col("to").alias("u"), "v")
        edges = tidy(half.join(up, F.col("v") == F.col("at")).select("u", F.col("to").alias("v")))
    return labels


def cluster_by_radius(codes: DataFrame, radius: int) -> DataFrame:
    """(idx, component) of rows (idx, hi, lo); a component is named by its least idx.
    Equal codes are one node, so copies cost no edges. A null code is alone."""
    known = codes.where("hi is not null and lo is not null")
    nodes = checkpointed(known.groupBy("hi", "lo").agg(F.min("idx").alias("node")))
    side = nodes.select("hi", "lo")
    pairs = hamming.code_pairs(side, side, radius).where("distance > 0") if radius else None
    if pairs is None:
        rooted = nodes.withColumn("root", F.col("node"))
    else:
        a = nodes.select(F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo"), F.col("node").alias("u"))
        b = nodes.select(F.col("hi").alias("r_hi"), F.col("lo").alias("r_lo"), F.col("node").alias("v"))
        labels = components(pairs.join(a, ["l_hi", "l_lo"]).join(b, ["r_hi", "r_lo"]).where("u < v").select("u", "v"))
        rooted = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    out = codes.join(rooted.join(least, "root").select("hi", "lo", "component"), ["hi", "lo"], "left")
    return out.select("idx", F.coalesce("component", "idx").alias("component"))


def groups(members: DataFrame) -> DataFrame:
    """(component, members): the members of each component in order."""
    return members.groupBy("component").agg(F.array_sort(F.collect_list("idx")).alias("members"))
