"""Centrality of many graphs at once by joins over edges: PageRank, components, betweenness. A group of edges is a graph of its own.

Every step is a join and an aggregate over all groups, so neither a group nor a graph is one task's; ``written`` stores a table
between steps, which ends lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import basics

Written = Callable[[DataFrame], DataFrame]
#: Rounds that are planned together before they are written.
TOGETHER = 10


def simple(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, src, dst, weight): one edge a direction, weights summed, no loops."""
    return edges.where("src <> dst").groupBy(*group, "src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("weight"))


def nodes(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, n): every node that has an edge, and the nodes of its graph."""
    found = edges.select(*group, F.explode(F.array("src", "dst")).alias("node")).distinct()
    return found.join(found.groupBy(*group).agg(F.count("*").alias("n")), group)


def page_ranks(edges: DataFrame, group: list[str], written: Written, damping: float = 0.85, rounds: int = 100, tol: float = 1e-10) -> DataFrame:
    """(group, node, n, rank): weighted PageRank of every graph; the mass of nodes without edges out goes to all nodes alike.

    Ends when no rank has moved by ``tol`` in a round, looked at every ``TOGETHER`` rounds, or after ``rounds``.
    """
    e = simple(edges, group)
    all_nodes = written(nodes(e, group))
    total = e.groupBy(*group, "src").agg(F.sum("weight").alias("total"))
    shares = e.join(total, [*group, "src"]).select(*group, "src", F.col("dst").alias("node"), (F.col("weight") / F.col("total")).alias("share"))
    loose = all_nodes.join(total.select(*group, F.col("src").alias("node")), [*group, "node"], "left_anti").select(*group, F.col("node").alias("src"), F.lit(1.0) / F.col("n"))
    spread = loose.toDF(*group, "src", "share").join(all_nodes.select(*group, "node"), group).select(*group, "src", "node", "share")
    keep = all_nodes.select(*group, F.col("node").alias("src"), "node", F.lit(0.0).alias("share"))  # nodes without edges in stay
    shares = written(shares.unionByName(spread).unionByName(keep))
    ranks = all_nodes.select(*group, "node", "n", (1.0 / F.col("n")).alias("rank"))
    done = 0
    while done < rounds:
        for _ in range(min(TOGETHER, rounds - done)):
            before = ranks
            flow = ranks.select(*group, F.col("node").alias("src"), "n", "rank").join(shares, [*group, "src"])
            flow = flow.groupBy(*group, "node").agg(F.max("n").alias("n"), F.sum(F.col("rank") * F.col("share")).alias("flow"))
            ranks = flow.select(*group, "node", "n", ((1 - damping) / F.col("n") + damping * F.col("flow")).alias("rank"))
            done += 1
        old = before.select(*group, "node", F.col("rank").alias("old"))
        ranks = written(ranks.join(old, [*group, "node"]).withColumn("moved", F.abs(F.col("rank") - F.col("old"))))
        if not (ranks.agg(F.max("moved")).first()[0] or 0.0) >= tol:
            break
        ranks = ranks.drop("old", "moved")
    return ranks.select(*group, "node", "n", "rank")


def components(edges: DataFrame, group: list[str], written: Written) -> DataFrame:
    """(group, node, root): the smallest node that each is linked to over edges of either direction.

    Labels take the least of their neighbours' labels and then the label of their label, so the rounds grow with the logarithm
    of a path's length in most graphs; they end when no label changes.
    """
    both = simple(edges, group).select(*group, F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select(*group, "e.*")
    both = written(both.distinct())
    labels = written(both.groupBy(*group, F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
    while True:
        near = both.join(labels.select(*group, F.col("node").alias("dst"), "root"), [*group, "dst"]).groupBy(*group, F.col("src").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, [*group, "node"]).select(*group, "node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(*group, F.col("node").alias("mid"), F.col("root").alias("far"))
        step = written(step.join(jump, [*group, "mid"]).select(*group, "node", "old", F.least("mid", "far").alias("root")))
        if step.where("root <> old").isEmpty():
            return step.select(*group, "node", "root")
        labels = step.select(*group, "node", "root")


def betweenness(edges: DataFrame, group: list[str], written: Written) -> DataFrame:
    """(group, node, n, score): the share of shortest paths between other nodes that lead through each; an edge's weight, above 0, is its length.

    Distances of all pairs double their reach in a round; shortest paths are counted edge by edge until none grows; then every
    pair meets the nodes between its ends. That is n^2 rows a graph, and n^3 in the last join, for graphs of a few dozen nodes.
    """
    e = written(simple(edges, group))
    all_nodes = nodes(e, group)
    far = e.select(*group, F.col("src").alias("s"), F.col("dst").alias("t"), F.col("weight").alias("d"))
    while True:
        left, right = far.select(*group, "s", F.col("t").alias("m"), F.col("d").alias("a")), far.select(*group, F.col("s").alias("m"), "t", F.col("d").alias("b"))
        longer = left.join(right, [*group, "m"]).where("s <> t").select(*group, "s", "t", (F.col("a") + F.col("b")).alias("d"))
        new = written(far.unionByName(longer).groupBy(*group, "s", "t").agg(F.min("d").alias("d")))
        size = lambda x: x.agg(F.count("*"), F.sum("d")).first()
        grown = size(new) != size(far)
        far = new
        if not grown:
            break
    hops = e.select(*group, F.col("src").alias("u"), F.col("dst").alias("t"), "weight")
    paths = far.join(e.select(*group, F.col("src").alias("s"), F.col("dst").alias("t"), "weight"), [*group, "s", "t"]).where("abs(weight - d) <= 1e-9").select(*group, "s", "t", F.lit(1.0).alias("k"))
    counted = paths = written(paths)
    near = far.select(*group, "s", F.col("t").alias("u"), F.col("d").alias("du"))
    while not paths.isEmpty():
        more = paths.withColumnRenamed("t", "u").join(near, [*group, "s", "u"]).join(hops, [*group, "u"]).join(far, [*group, "s", "t"])
        paths = written(more.where("abs(du + weight - d) <= 1e-9").groupBy(*group, "s", "t").agg(F.sum("k").alias("k")))
        counted = counted.unionByName(paths)
    whole = written(counted.groupBy(*group, "s", "t").agg(F.sum("k").alias("k")).join(far, [*group, "s", "t"]))
    first = whole.select(*group, "s", F.col("t").alias("node"), F.col("k").alias("ka"), F.col("d").alias("da"))
    second = whole.select(*group, F.col("s").alias("node"), "t", F.col("k").alias("kb"), F.col("d").alias("db"))
    through = first.join(second, [*group, "node"]).where("s <> t").join(whole, [*group, "s", "t"]).where("abs(da + db - d) <= 1e-9")
    through = through.groupBy(*group, "node").agg(F.sum(F.col("ka") * F.col("kb") / F.col("k")).alias("x"))
    rest = (F.col("n") - 1) * (F.col("n") - 2)
    score = F.coalesce("x", F.lit(0.0)) / F.when(F.col("n") > 2, rest).otherwise(1)
    return all_nodes.join(through, [*group, "node"], "left").select(*group, "node", "n", score.alias("score"))


def summary(edges: DataFrame, group: list[str], written: Written) -> DataFrame:
    """A row per graph: PageRank's greatest and spread, hub dominance, betweenness' greatest, mean and centralisation, the share of the largest component, density."""
    ranks = page_ranks(edges, group, written).groupBy(*group).agg(F.max("rank").alias("pagerank_max"), F.stddev_pop("rank").alias("pagerank_std"), (F.max("rank") / F.avg("rank")).alias("hub_dominance"))
    paths = betweenness(edges, group, written).groupBy(*group).agg(F.max("score").alias("betweenness_max"), F.avg("score").alias("betweenness_mean"))
    parts = components(edges, group, written).groupBy(*group, "root").agg(F.count("*").alias("c")).groupBy(*group).agg((F.max("c") / F.sum("c")).alias("largest_component"))
    both = ranks.join(paths, group).join(parts, group).join(basics(edges, group).select(*group, "n_nodes", "n_edges", "total_weight", "density", "reciprocity"), group)
    return both.withColumn("centralization", F.col("betweenness_max") - F.col("betweenness_mean"))
