"""Centrality by joins against plain walks over each graph."""

import random

import pytest

from touchline.operators import centrality, graph
from touchline.sources.shared import written


def made(seed):
    draw, rows = random.Random(seed), []
    for g in range(5):
        size = [2, 3, 6, 9, 12][g]
        rows += [(g, draw.randrange(size), draw.randrange(size), float(draw.randint(1, 4))) for _ in range(size * 2)]
    rows += [(7, i, i + 1, 1.0) for i in range(20)] + [(8, 1, 2, 2.0), (8, 3, 4, 1.0), (8, 5, 5, 1.0), (9, 4, 4, 1.0)]  # a chain, two parts, loops only
    return rows


def plain(rows):
    """{group: (nodes, edges out, undirected weights)}"""
    out = {}
    for g, a, b, w in rows:
        if a != b:
            nodes, far, und = out.setdefault(g, (set(), {}, {}))
            nodes |= {a, b}
            far.setdefault(a, {})[b] = far.get(a, {}).get(b, 0.0) + w
            und[min(a, b), max(a, b)] = und.get((min(a, b), max(a, b)), 0.0) + w
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_walks(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "g int, src int, dst int, weight double").repartition(3)
    want, put = plain(rows), written(spark)
    ranks = {(r.g, r.node): r.rank for r in centrality.page_ranks(df, ["g"], put).collect()}
    paths = {(r.g, r.node): r.score for r in centrality.betweenness(df, ["g"], put).collect()}
    parts = {(r.g, r.node): r.root for r in centrality.components(df, ["g"], put).collect()}
    every = {(g, v) for g, (nodes, _, _) in want.items() for v in nodes}
    assert set(ranks) == set(paths) == set(parts) == every
    for g, (nodes, far, und) in want.items():
        rank = graph.pagerank(sorted(nodes), far, tol=1e-13, rounds=500)
        score = graph.betweenness(sorted(nodes), far)
        root = {v: min(c) for c in graph.components(sorted(nodes), und) for v in c}
        for v in nodes:
            assert ranks[g, v] == pytest.approx(rank[v], abs=1e-7) and paths[g, v] == pytest.approx(score[v], abs=1e-9) and parts[g, v] == root[v]
    assert centrality.page_ranks(df.where("false"), ["g"], put).count() == centrality.components(df.where("false"), ["g"], put).count() == centrality.betweenness(df.where("false"), ["g"], put).count() == 0


def test_summary_has_a_row_a_graph(spark):
    df = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 2, 3, 1.0), ("b", 1, 2, 1.0)], "g string, src int, dst int, weight double")
    got = {r.g: r for r in centrality.summary(df, ["g"], written(spark)).collect()}
    assert (got["a"].betweenness_max, got["a"].largest_component, got["a"].n_nodes) == (0.5, 1.0, 3) and got["a"].centralization == pytest.approx(0.5 - 0.5 / 3)
    assert got["b"].betweenness_max == 0.0 and got["b"].hub_dominance == pytest.approx(2 * got["b"].pagerank_max)
