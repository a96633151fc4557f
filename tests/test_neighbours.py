"""Neighbours, silhouettes and p-values against brute force and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import special
from touchline.operators import clusters, neighbours, ordered, ranks, resampling
from touchline.sources.shared import written


def brute(x, keys, k):
    out = {}
    for i, key in enumerate(keys):
        d = np.sqrt(((x[i] - x) ** 2).sum(axis=1))
        out[key] = sorted((d[j], keys[j]) for j in range(len(x)) if j != i)[:k]
    return out


@pytest.mark.parametrize("n,dims,block,pivots", [(400, 3, 30, 16), (300, 1, 7, 1), (200, 2, 1000, 40), (3, 2, 2, 5)])
def test_nearest_equal_all_pairs(spark, n, dims, block, pivots):
    draw = np.random.default_rng(n)
    x = np.round(draw.normal(size=(n, dims)) * [1000 if i % 2 else 1 for i in range(dims)], 1)  # ties
    x[: n // 4] = x[0]  # a group of equal rows
    df = spark.createDataFrame([(i * 3, list(map(float, v))) for i, v in enumerate(x)], "k long, v array<double>").repartition(3)
    got = {r.k: [(m.distance, m.key) for m in r.neighbours] for r in neighbours.nearest(df, "k", "v", 4, block, pivots).collect()}
    assert got == {k: [(d, j) for d, j in v] for k, v in brute(x, [i * 3 for i in range(n)], 4).items()}


def test_nearest_of_none_or_one(spark):
    df = spark.createDataFrame([("a", [1.0])], "k string, v array<double>")
    assert neighbours.nearest(df, "k", "v", 3).first().neighbours == [] and neighbours.nearest(df.where("false"), "k", "v", 3).count() == 0


def test_nearest_of_20000_rows(spark):
    """Cells are cut and rows go to few blocks; every 500th row is compared with all."""
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(size=(10_000, 4)), draw.normal(size=(10_000, 4)) * 0.01 + 5])
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"k": range(len(x)), "v": x.tolist()}))
    got = {r.k: [m.key for m in r.neighbours] for r in neighbours.nearest(df, "k", "v", 5).where("k % 500 = 0").collect()}
    for k in range(0, len(x), 500):
        d = ((x[k] - x) ** 2).sum(axis=1)
        d[k] = np.inf
        assert got[k] == np.argsort(d, kind="stable")[:5].tolist()


def test_cells_are_packed_into_few_groups():
    """A row is sent to at most as many groups as there are: these don't grow with the cells."""
    draw = np.random.default_rng(2)
    size = draw.integers(0, 9000, size=256)
    size[7] = 200_000
    rows = neighbours._group_rows(int(size.sum()), 2000)
    first, parts, groups = neighbours._packed_cells(size, draw.normal(size=(256, 64)), rows)
    held = np.zeros(groups)
    for c in range(256):
        held[first[c] : first[c] + parts[c]] += size[c] / parts[c]
    assert held.max() <= rows and held.sum() == pytest.approx(size.sum()) and groups <= 3 * neighbours.COPIES


@pytest.mark.parametrize("n", [400, 120_000, 1_200_000])
def test_silhouettes_send_a_table_to_few_groups(n):
    """Every block is sent to each group: 24 copies of the table until groups are as large as a task may hold, not one a block."""
    assert -(-n // neighbours._group_rows(n, 1)) <= neighbours.COPIES and neighbours._group_rows(10**9, 1000) == neighbours.GROUP_ROWS


def test_silhouettes_equal_all_pairs(spark):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(size=(60, 5)) + c for c in (0, 1, 6)] + [np.zeros((3, 5))])
    label = [0] * 60 + [1] * 60 + [2] * 60 + [3, 4, 4]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i, c in enumerate(label):
        means = {g: d[i, [l == g for l in label]].sum() / max(1, label.count(g) - (g == c)) for g in set(label)}  # noqa: E741
        b = min(v for g, v in means.items() if g != c)
        want.append(0.0 if label.count(c) == 1 else (b - means[c]) / max(means[c], b) if max(means[c], b) else 0.0)
    df = spark.createDataFrame([(i, c, list(map(float, v))) for i, (v, c) in enumerate(zip(x, label))], "k int, c int, v array<double>")
    for block in (13, 1000):
        got = {r.k: (r.c, r.silhouette) for r in neighbours.silhouettes(df, "k", "v", "c", block).collect()}
        assert {k: c for k, (c, _) in got.items()} == dict(enumerate(label))
        assert [got[i][1] for i in range(len(x))] == pytest.approx(want, abs=1e-9)
    assert [r.silhouette for r in neighbours.silhouettes(df.where("c = 1"), "k", "v", "c", 50).collect()] == [0.0] * 60


def values(spark, rows, names, expr):
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    return [r[0] for r in df.select(expr).collect()]


def test_log_gamma(spark):
    xs = [0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 100.5, 12345.6]
    got = values(spark, [(x,) for x in xs], ["x"], special.log_gamma(F.col("x")))
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)


def test_incomplete_gamma_against_closed_forms(spark):
    rows = [(float(df), x) for df in (2, 4, 10, 40) for x in (0.0, 0.01, 1.0, 5.0, 30.0, 120.0, 400.0)]
    got = values(spark, rows, ["df", "x"], special.chi2_p(F.col("x"), F.col("df")))
    want = [math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(int(df) // 2)) for df, x in rows]
    assert got == pytest.approx(want, abs=1e-9) and got == pytest.approx(want, rel=1e-7)
    odd = [(1.0, x) for x in (0.001, 0.5, 3.841458820694124, 20.0)]
    assert values(spark, odd, ["df", "x"], special.chi2_p(F.col("x"), F.col("df"))) == pytest.approx([math.erfc(math.sqrt(x / 2)) for _, x in odd], abs=1e-9)


def test_incomplete_beta_against_closed_forms(spark):
    rows = [(a, x) for a in (0.5, 1.0, 3.0, 50.0) for x in (0.0, 0.001, 0.3, 0.5, 0.9, 0.9999, 1.0)]
    assert values(spark, rows, ["a", "x"], special.beta_i(F.col("a"), F.lit(1.0), F.col("x"))) == pytest.approx([x**a for a, x in rows], abs=1e-9)
    assert values(spark, rows, ["a", "x"], special.beta_i(F.lit(1.0), F.col("a"), F.col("x"))) == pytest.approx([1 - (1 - x) ** a for a, x in rows], abs=1e-9)
    ts = (0.0, 0.1, -1.0, 2.5, 40.0)
    assert values(spark, [(t,) for t in ts], ["t"], special.t_p(F.col("t"), F.lit(1.0))) == pytest.approx([1 - 2 / math.pi * math.atan(abs(t)) for t in ts], abs=1e-9)
    assert values(spark, [(t,) for t in ts], ["t"], special.t_p(F.col("t"), F.lit(2.0))) == pytest.approx([1 - abs(t) / math.sqrt(2 + t * t) for t in ts], abs=1e-9)
    # so many pairs that t is all but normal
    assert values(spark, [(t,) for t in ts], ["t"], special.t_p(F.col("t"), F.lit(1e8))) == pytest.approx([math.erfc(abs(t) / math.sqrt(2)) for t in ts], abs=1e-7)


def test_rank_tests_by_hand(spark):
    rows = [(1.0, 2.0, "a"), (2.0, 1.0, "a"), (3.0, 4.0, "b"), (4.0, 3.0, "b"), (4.0, 5.0, "c"), (None, 9.0, "c")]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    m = ranks.spearman_matrix(df.withColumn("z", F.lit(1.0)), ["x", "y", "z"]).collect()
    x, y = [1, 2, 3, 4.5, 4.5], [2, 1, 4, 3, 5]
    rho = np.corrcoef(x, y)[0, 1]
    t = abs(rho) * math.sqrt(3 / (1 - rho**2))
    p = 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + t / math.sqrt(3) / (1 + t * t / 3))  # three degrees of freedom
    assert (m[0].n, m[0].rho, m[0].p) == (5, pytest.approx(rho), pytest.approx(p, abs=1e-9)) and m[1].rho is None and m[1].p is None
    k = ranks.kruskal(df, "x", "g").first()
    h = (12 / 30 * (9 / 2 + 7.5**2 / 2 + 4.5**2) - 18) / (1 - 6 / 120)
    assert (k.h, k.df, k.p) == (pytest.approx(h), 2, pytest.approx(math.exp(-h / 2)))
    c = ranks.chi_square(spark.createDataFrame([("u", "p")] * 8 + [("u", "q")] * 2 + [("v", "q")] * 6, "a string, b string"), "a", "b").first()
    assert (c.chi2, c.df) == (pytest.approx(9.6), 1) and c.p == pytest.approx(math.erfc(math.sqrt(4.8)))


def test_synthetic_rows_of_a_large_class(spark):
    """More minority rows than a block: neighbours are those of the whole class."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 2))
    df = spark.createDataFrame([(i, 1, *map(float, v)) for i, v in enumerate(x)], "k int, y int, a double, b double")
    near = brute(x, list(range(300)), 2)
    out = resampling.synthetic(df, "y", 1, "k", ["a", "b"], neighbours=2, block_rows=20).where("synthetic").collect()
    assert len(out) == 300
    for r in out:
        p = np.array([r.a, r.b])
        ends = [x[j] for _, j in near[r.k]]
        assert any(abs(np.linalg.norm(p - x[r.k]) + np.linalg.norm(p - e) - np.linalg.norm(x[r.k] - e)) < 1e-9 for e in ends)
    with pytest.raises(ValueError):
        resampling.synthetic(df.withColumn("a", F.lit(None).cast("double")), "y", 1, "k", ["a", "b"])


@pytest.mark.parametrize("reach,block", [(0.0, 50), (1.5, 9), (100.0, 40)])
def test_within_equals_all_pairs(spark, reach, block):
    draw = np.random.default_rng(8)
    x = np.round(draw.normal(size=(150, 2)) * 3, 0)
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "k int, v array<double>").repartition(4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {r.k: [m.key for m in r.neighbours] for r in neighbours.within(df, "k", "v", reach, block, 12).collect()}
    assert got == {i: sorted((j for j in range(150) if j != i and d[i, j] <= reach), key=lambda j: (d[i, j], j)) for i in range(150)}


@pytest.mark.parametrize("eps", [None, 0.6])
def test_density_equals_the_walk(spark, eps):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(size=(60, 2)) * 0.5, draw.normal(size=(50, 2)) * 0.3 + 4, draw.uniform(-6, 9, size=(25, 2))])
    df = spark.createDataFrame([("g", i * 2, list(map(float, v))) for i, v in enumerate(draw.permutation(x))], "g string, k int, v array<double>").repartition(3)
    want = {r.k: r.cluster for r in clusters.dbscan(df, "g", "k", "v", eps=eps, least=4, quantile=0.7).collect()}
    got = {r.k: r.cluster for r in clusters.density(df, "k", "v", written(spark), eps=eps, least=4, quantile=0.7).collect()}
    assert got == want and len(set(want.values())) > 2
    assert clusters.density(df.where("false"), "k", "v", written(spark)).count() == 0
    assert ordered.quantiles(df.withColumn("x", F.col("v")[0]), "x", [0.25, 0.7]) == pytest.approx(np.quantile(x[:, 0], [0.25, 0.7]).tolist())
