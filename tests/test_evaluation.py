"""Folds, calibration and quantiles against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import evaluation, learning, ordered


def greedy(sizes, k):
    held, count = [0] * k, [0] * k
    for n in sorted(sizes, reverse=True):
        f = held.index(min(held))
        held[f], count[f] = held[f] + n, count[f] + 1
    return held, count


def test_deal_of_the_histogram_equals_the_deal_of_groups():
    for seed in range(300):
        draw = random.Random(seed)
        sizes = [draw.choice([1, 1, 1, 2, 3, 7, draw.randint(1, 60)]) for _ in range(draw.randint(1, 80))]
        k = draw.randint(1, 7)
        hist = [(n, sizes.count(n)) for n in set(sizes)]
        found = evaluation.dealt_largest_first(hist, k)
        held = [sum(n * take[f] for (n, _), take in zip(hist, found)) for f in range(k)]
        assert all(sum(take) == m for (_, m), take in zip(hist, found))
        assert (held, [sum(take[f] for take in found) for f in range(k)]) == greedy(sizes, k)
    # a billion groups of one size cost no more than one
    many, one = evaluation.dealt_largest_first([(3, 10**9 + 1), (1000, 1)], 4)
    held = [3 * a + 1000 * b for a, b in zip(many, one)]
    assert sum(many) == 10**9 + 1 and sum(one) == 1 and max(held) - min(held) <= 3


@pytest.mark.parametrize("label", [None, "y"])
def test_balanced_folds(spark, label):
    draw = random.Random(5)
    groups = {g: draw.choice([1, 1, 2, 2, 3, 5, 40]) for g in [None, *range(120)]}
    rows = [(g, draw.random() < (0.7 if (g or 0) % 2 else 0.1)) for g, n in groups.items() for _ in range(n)]
    df = spark.createDataFrame([(g, int(y), "x") for g, y in rows], "g long, y int, fold string").repartition(5)
    got = evaluation.with_balanced_fold(df, "g", 4, label).collect()
    assert len(got) == len(rows) and {r.fold for r in got} == {0, 1, 2, 3}
    assert len({(r.g, r.fold) for r in got}) == len(groups)
    size = [sum(r.fold == f for r in got) for f in range(4)]
    assert max(size) - min(size) <= 40
    if label:
        share = [sum(r.y for r in got if r.fold == f) / size[f] for f in range(4)]
        assert max(share) - min(share) < 0.08
    again = evaluation.with_balanced_fold(df.repartition(3), "g", 4, label).collect()
    assert {(r.g, r.fold) for r in again} == {(r.g, r.fold) for r in got}
    assert evaluation.with_balanced_fold(df.where("false"), "g", 4, label).count() == 0


def test_held_out_season(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "season string, x int")
    train, test = evaluation.held_out(df, "season", "a")
    assert {r.x for r in train.collect()} == {2, 3} and [r.x for r in test.collect()] == [1]
    assert evaluation.held_out(df, "season", "z") is None and evaluation.held_out(test, "season", "a") is None


def test_calibration_that_helps_is_kept(spark):
    """Few scores, each of many rows, the true rate their square."""
    rows = spark.range(6000).select("id", ((F.col("id") % 10 + 1) / 10.0).alias("s"))
    rows = rows.withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(10_000)) < F.col("s") * F.col("s") * 10_000).cast("int"))
    model, before, after = learning.calibrated(rows, "y", "s", "id")
    assert model is not None and after < 0.9 * before
    # scores that are the rates already: nothing is to be gained beyond noise, and a worse result is refused
    same = rows.withColumn("s", F.col("s") * F.col("s"))
    model, before, after = learning.calibrated(same, "y", "s", "id")
    assert (model is not None) == (after < before) and abs(after - before) < 0.002


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 50 + [1.0, 9.0], list(map(float, range(101))), [0.1 * (i * i % 37) for i in range(400)], [-1e9, 0.0, 0.0, 1e9]])
def test_quantile_bins_keep_ties(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for bins in (1, 4, 10):
        edges = ordered.quantile_edges(df, "v", bins)
        want = np.unique(np.quantile(values, np.arange(bins + 1) / bins))
        assert edges == pytest.approx(want.tolist(), rel=1e-12, abs=1e-6)
        got = {r.v: r.b for r in df.select("v", ordered.quantile_bin(F.col("v"), edges).alias("b")).collect()}
        assert got.pop(None) is None
        assert got == {v: 1 + sum(e < v for e in edges[1:-1]) for v in values}
    assert ordered.quantile_edges(df.where("v IS NULL"), "v", 10) == []
