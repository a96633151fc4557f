"""Graphs per group: relational metrics as aggregates, path metrics per group in Python.

A group is one match and team: a few dozen nodes, whatever the number of groups.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "n_nodes long, n_edges long, betweenness_mean double, betweenness_max double, pagerank_max double, pagerank_std double, "
FIELDS += "largest_component double, modularity double, n_communities long, "
FIELDS += "hub_dominance double, weighted_density double, passes_per_player double, edges_per_player double, centralization double"


def built(edges: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, src, dst, weight) of a graph that is built edge by edge: of equal edges the last by ``order`` gives the weight; loops go."""
    return edges.where("src <> dst").groupBy(*group, "src", "dst").agg(F.max_by("weight", order).alias("weight"))


def degrees(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, degree, centrality) of distinct directed edges: edges in and out, as a share of the other nodes; 1 in a graph of one node."""
    ends = edges.select(*group, F.explode(F.array("src", "dst")).alias("node")).groupBy(*group, "node").agg(F.count("*").alias("degree"))
    nodes = ends.groupBy(*group).agg(F.count("*").alias("__n"))
    share = F.when(F.col("__n") > 1, F.col("degree") / (F.col("__n") - 1)).otherwise(1.0)
    return ends.join(nodes, group).select(*group, "node", "degree", share.alias("centrality"))


def basics(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, n_nodes, n_edges, total_weight, weight_per_edge, density, reciprocity, degree_mean) of directed edges (src, dst, weight)."""
    e = edges.where("src <> dst").groupBy(*group, "src", "dst").agg(F.sum("weight").alias("weight"))
    nodes = e.select(*group, F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy(*group).agg(F.count("*").alias("n_nodes"))
    pairs = e.groupBy(*group, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.count("*").alias("ways"), F.sum("weight").alias("weight"))
    per = pairs.groupBy(*group).agg(
        F.sum("ways").alias("n_edges"), F.count("*").alias("n_pairs"), F.sum("weight").alias("total_weight"),
        F.sum(F.when(F.col("ways") == 2, 2).otherwise(0)).alias("two_way"),
    )
    n = F.col("n_nodes")
    return per.join(nodes, group).select(
        *group, "n_nodes", "n_edges", "total_weight", (F.col("total_weight") / F.col("n_edges")).alias("weight_per_edge"),
        (2 * F.col("n_pairs") / (n * (n - 1))).alias("density"), (F.col("two_way") / F.col("n_edges")).alias("reciprocity"),
        (F.col("n_edges") / (n * (n - 1))).alias("degree_mean"),
    )


def clustering(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, clustering): mean over nodes of closed pairs of neighbours, undirected and unweighted."""
    und = edges.where("src <> dst").select(*group, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = und.unionByName(und.select(*group, F.col("b").alias("a"), F.col("a").alias("b")))
    deg = both.groupBy(*group, F.col("a").alias("node")).agg(F.count("*").alias("k"))
    x, y = both.select(*group, F.col("a").alias("node"), F.col("b").alias("p")), both.select(*group, F.col("a").alias("node"), F.col("b").alias("q"))
    wedges = x.join(y, [*group, "node"]).where("p < q")
    closed = wedges.join(und.select(*group, F.col("a").alias("p"), F.col("b").alias("q")), [*group, "p", "q"]).groupBy(*group, "node").agg(F.count("*").alias("t"))
    per = deg.join(closed, [*group, "node"], "left").withColumn("c", F.when(F.col("k") < 2, 0.0).otherwise(2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))))
    return per.groupBy(*group).agg(F.avg("c").alias("clustering"))


def betweenness(nodes: list, out: dict) -> dict:
    """Normalised betweenness of a directed graph, the weight of an edge as its length."""
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        far, paths, before, done, order = {s: 0.0}, {s: 1.0}, {s: []}, set(), []
        heap, tick = [(0.0, 0, s)], 0
        while heap:
            d, _, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for w, length in out.get(v, {}).items():
                through = d + length
                if w not in far or through < far[w] - 1e-12:
                    far[w], paths[w], before[w] = through, paths[v], [v]
                    tick += 1
                    heapq.heappush(heap, (through, tick, w))
                elif w not in done and abs(through - far[w]) <= 1e-12:
                    paths[w] += paths[v]
                    before[w].append(v)
        load = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                load[v] += paths[v] / paths[w] * (1 + load[w])
            if w != s:
                score[w] += load[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else x for v, x in score.items()}


def pagerank(nodes: list, out: dict, damping: float = 0.85, tol: float = 1e-6, rounds: int = 100) -> dict:
    """Weighted PageRank; nodes without edges out share their mass."""
    n = len(nodes)
    rank = dict.fromkeys(nodes, 1.0 / n)
    for _ in range(rounds):
        loose = damping * sum(rank[v] for v in nodes if not out.get(v)) / n
        new = dict.fromkeys(nodes, (1 - damping) / n + loose)
        for v, to in out.items():
            total = sum(to.values())
            for w, x in to.items():
                new[w] += damping * rank[v] * x / total
        moved = sum(abs(new[v] - rank[v]) for v in nodes)
        rank = new
        if moved < n * tol:
            break
    return rank


def communities(nodes: list, und: dict) -> tuple[list[set], float]:
    """Greedy modularity merging on undirected weights, ties by the smallest pair; and the modularity reached."""
    m = sum(und.values())
    groups = {i: {v} for i, v in enumerate(sorted(nodes))}
    at = {v: i for i, s in groups.items() for v in s}
    deg = dict.fromkeys(groups, 0.0)
    link: dict[tuple[int, int], float] = {}
    for (a, b), w in und.items():
        deg[at[a]] += w
        deg[at[b]] += w
        link[tuple(sorted((at[a], at[b])))] = link.get(tuple(sorted((at[a], at[b]))), 0.0) + w
    while link and m:
        gain, pair = max(((w / m - deg[i] * deg[j] / (2 * m * m), (-i, -j)) for (i, j), w in link.items()), default=(0.0, None))
        if gain <= 1e-12:
            break
        i, j = -pair[0], -pair[1]
        groups[i] |= groups.pop(j)
        deg[i] += deg.pop(j)
        moved: dict[tuple[int, int], float] = {}
        for (a, b), w in link.items():
            a, b = (i if a == j else a), (i if b == j else b)
            if a != b:
                moved[tuple(sorted((a, b)))] = moved.get(tuple(sorted((a, b))), 0.0) + w
        link = moved
    where = {v: i for i, s in groups.items() for v in s}
    inside = sum(w for (a, b), w in und.items() if where[a] == where[b])
    q = inside / m - sum((d / (2 * m)) ** 2 for d in deg.values()) if m else 0.0
    return list(groups.values()), q


def components(nodes: list, und: dict) -> list[set]:
    near: dict = {v: set() for v in nodes}
    for a, b in und:
        near[a].add(b)
        near[b].add(a)
    found, seen = [], set()
    for v in sorted(nodes):
        if v not in seen:
            part, todo = set(), [v]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo.extend(near[x] - part)
            seen |= part
            found.append(part)
    return found


def _metrics(group: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["src"] != pdf["dst"]]
        out: dict = {}
        und: dict = {}
        for a, b, w in zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["weight"].tolist()):
            out.setdefault(a, {})[b] = out.get(a, {}).get(b, 0.0) + float(w)
            und[min(a, b), max(a, b)] = und.get((min(a, b), max(a, b)), 0.0) + float(w)
        nodes = sorted({*pdf["src"].tolist(), *pdf["dst"].tolist()})
        if not nodes:
            return pd.DataFrame(columns=[*group, *(f.split()[0] for f in FIELDS.split(", "))])
        between, rank = betweenness(nodes, out), pagerank(nodes, out)
        parts, q = communities(nodes, und)
        ranks, n, m = pd.Series(list(rank.values())), len(nodes), sum(map(len, out.values()))
        total = sum(sum(near.values()) for near in out.values())
        row = {c: pdf[c].iloc[0] for c in group} | {
            "n_nodes": len(nodes), "n_edges": sum(map(len, out.values())), "betweenness_mean": sum(between.values()) / len(nodes),
            "betweenness_max": max(between.values()), "pagerank_max": ranks.max(), "pagerank_std": ranks.std(ddof=0),
            "largest_component": max(map(len, components(nodes, und))) / len(nodes), "modularity": q, "n_communities": len(parts),
            "hub_dominance": ranks.max() / ranks.mean(), "weighted_density": total / (n * (n - 1)), "passes_per_player": total / n, "edges_per_player": m / n,
            "centralization": max(between.values()) - sum(between.values()) / n,
        }
        return pd.DataFrame([row])

    return run


def path_metrics(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, betweenness, PageRank, components, modularity) of each group's graph."""
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select(*group).schema)
    return edges.groupBy(*group).applyInPandas(_metrics(group), f"{keys}, {FIELDS}")


def feature_matrix(edges: DataFrame, sides: DataFrame, group: list[str], label: str) -> DataFrame:
    """A row for every one of ``sides`` (group, label): its graph's relational and path metrics, zeros where it has no edge."""
    paths = path_metrics(edges, group).drop("n_nodes", "n_edges")
    both = basics(edges, group).join(paths, group)
    return sides.select(*group, label).join(both, group, "left").na.fill(0, [c for c in both.columns if c not in group])
