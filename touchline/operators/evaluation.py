"""Evaluation: folds by group, leave-one-season-out, metrics from scored rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Fits that are submitted at once; the scheduler deals their tasks over the same executors.
AT_ONCE = 4


def side_by_side(work: Callable, items: Iterable) -> list:
    """``work`` of every item in order. Independent fits share the cluster instead of waiting for each other's last task."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(work, items))


def with_fold(rows: DataFrame, group: str, k: int) -> DataFrame:
    """Fold 0 to k - 1 by the digest of the group (0 for null): no group is in two folds, and reruns agree."""
    digest = F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 15), 16, 10).cast("long")
    return rows.withColumn("fold", F.coalesce(F.pmod(digest, F.lit(k)), F.lit(0)).cast("int"))


def dealt_largest_first(sizes: list[tuple[int, int]], k: int) -> list[list[int]]:
    """Groups of each size that each of ``k`` folds takes. ``sizes``: (size, groups of that size).

    As if the groups came one by one, the largest first, each to the fold of fewest rows, the first of equal ones. Groups of one
    size go together: the folds are filled up to a common level, found by bisection, and the last few in order.
    """
    held, out = [0] * k, {}
    for size, n in sorted(sizes, reverse=True):
        # the rounds that every fold could be given so that no more than n groups are used below a level
        taken = lambda level: [max(0, -(-(level - h) // size)) for h in held]
        low, high = min(held), max(held) + size * (n + 1)
        while low < high:  # the highest level that n groups can fill
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(taken(middle)) <= n else (low, middle - 1)
        take = taken(low)
        for _ in range(n - sum(take)):
            fold = min(range(k), key=lambda f: (held[f] + take[f] * size, f))
            take[fold] += 1
        held = [h + t * size for h, t in zip(held, take)]
        out[size] = take
    return [out[size] for size, _ in sizes]


def dealt_by_label(sizes: list[tuple[int, int, int]], k: int) -> list[list[int]]:
    """Groups of each kind that each of ``k`` folds takes. ``sizes``: (rows, positive rows, groups of that kind).

    Kinds whose two counts lie farthest apart come first. Whole rounds go to all folds alike; each group that is left goes to the fold that makes
    the shares of both labels most alike over the folds, then to the one of fewest rows.
    """
    rows, pos = sum(n * m for n, _, m in sizes), sum(p * m for _, p, m in sizes)
    of = (max(1, rows - pos), max(1, pos))
    held = [[0, 0] for _ in range(k)]
    out: dict = {}

    def spread(fold: int, negative: int, positive: int) -> float:
        total = 0.0
        for i, add in enumerate((negative, positive)):
            shares = [(h[i] + (add if f == fold else 0)) / of[i] for f, h in enumerate(held)]
            mean = sum(shares) / k
            total += math.sqrt(sum((x - mean) ** 2 for x in shares) / k)
        return total

    for n, p, m in sorted(sizes, key=lambda s: (-abs(s[0] - 2 * s[1]), -s[0], -s[1])):
        take = [m // k] * k
        for h in held:
            h[0], h[1] = h[0] + (m // k) * (n - p), h[1] + (m // k) * p
        for _ in range(m % k):
            fold = min(range(k), key=lambda f: (round(spread(f, n - p, p), 12), sum(held[f]), f))
            take[fold] += 1
            held[fold][0], held[fold][1] = held[fold][0] + n - p, held[fold][1] + p
        out[n, p] = take
    return [out[n, p] for n, p, _ in sizes]


def with_balanced_fold(rows: DataFrame, group: str, k: int, label: str | None = None) -> DataFrame:
    """Fold 0 to k - 1 of each row: whole groups, dealt largest first; with a ``label`` of 0 and 1 so that its share is alike, too.

    Only the histogram of group sizes is dealt in one task: sizes that differ are no more than the root of twice the rows. Groups of one
    size are ranked by the digest of their key, through counts by its first byte, so a common size isn't one task. A null group is a group.
    """
    positive = F.sum(F.col(label)).cast("long") if label else F.lit(0).cast("long")
    groups = rows.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"), F.coalesce(positive, F.lit(0).cast("long")).alias("__p"))
    groups = groups.withColumn("__d", F.md5(F.coalesce(F.col("__g").cast("string"), F.lit("")))).withColumn("__b", F.substring("__d", 1, 2))
    per = groups.groupBy("__n", "__p", "__b").agg(F.count("*").alias("__c"))

    def deal(pdf):
        kinds = list(zip(pdf["__n"].tolist(), pdf["__p"].tolist(), pdf["__m"].tolist()))
        found = dealt_by_label(kinds, k) if label else dealt_largest_first([(n, m) for n, _, m in kinds], k)
        ends = [[sum(take[: f + 1]) for f in range(k)] for take in found]
        return pdf[["__n", "__p"]].assign(__ends=ends)

    sizes = per.groupBy("__n", "__p").agg(F.sum("__c").alias("__m"))
    plan = sizes.withColumn("__one", F.lit("all")).groupBy("__one").applyInPandas(deal, "__n long, __p long, __ends array<long>")
    ahead = Window.partitionBy("__n", "__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("__n", "__p", "__b", F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__at"))
    inside = Window.partitionBy("__n", "__p", "__b").orderBy("__d", "__g")
    ranked = groups.withColumn("__i", F.row_number().over(inside)).join(offsets, ["__n", "__p", "__b"]).join(plan, ["__n", "__p"])
    rank = F.col("__at") + F.col("__i")
    folds = ranked.select("__g", F.size(F.filter("__ends", lambda e: e < rank)).cast("int").alias("fold"))
    return rows.drop("fold").join(folds, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def held_out(rows: DataFrame, season: str, test) -> tuple[DataFrame, DataFrame] | None:
    """(training rows, rows of the season ``test``), or None where either is empty. Rows without a season are training rows."""
    test_rows, train = rows.where(F.col(season) == test), rows.where(~F.col(season).eqNullSafe(F.lit(test)))
    return None if test_rows.isEmpty() or train.isEmpty() else (train, test_rows)


def seasons(rows: DataFrame, season: str, least_rows: int = 30, positive: str | None = None, least_positive: int = 5) -> Iterator[tuple[object, DataFrame, DataFrame]]:
    """(season, training rows, held-out rows) of every season that is large enough. There are a few dozen seasons."""
    pos = F.sum(F.col(positive)) if positive else F.lit(least_positive)
    fit = rows.groupBy(season).agg(F.count("*").alias("n"), pos.alias("p")).where((F.col("n") >= least_rows) & (F.col("p") >= least_positive))
    for r in fit.orderBy(season).select(season).collect():
        yield r[0], rows.where(F.col(season) != r[0]), rows.where(F.col(season) == r[0])


def cross_validated(rows: DataFrame, k: int, fit: Callable[[DataFrame], object]) -> DataFrame:
    """Out-of-fold predictions: each fold scored by a model fitted on the others."""
    return scored_by_parts([(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)) for i in range(k)], fit)


def scored_by_parts(parts: list[tuple[DataFrame, DataFrame]], fit: Callable[[DataFrame], object]) -> DataFrame:
    """Held-out rows of every (training rows, held-out rows), scored by a model fitted on the training rows."""
    return reduce(DataFrame.unionByName, [fit(train).transform(test) for train, test in parts])


def binary(rows: DataFrame, y: str, p: str, threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """Precision, recall, F1, balanced accuracy, Brier and log loss; divisions by zero give 0. A row counts ``weight`` times."""
    hit, w = F.col(p) >= threshold, F.col(weight) if weight else F.lit(1.0)
    n = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    mean = lambda x: F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    a = rows.agg(
        n(hit & (F.col(y) == 1)).alias("tp"), n(hit & (F.col(y) == 0)).alias("fp"), n(~hit & (F.col(y) == 1)).alias("fn"), n(~hit & (F.col(y) == 0)).alias("tn"),
        mean(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"), mean(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("logloss"),
    )
    safe = lambda x, m: F.when(m > 0, x / m).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return a.select("tp", "fp", "fn", "tn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), ((safe(tp, tp + fn) + safe(tn, tn + fp)) / 2).alias("balanced_accuracy"), "brier", "logloss")


def simple_silhouette(rows: DataFrame, vector: str, cluster: str) -> float:
    """Silhouette by squared distances (the library's), on an ML vector column."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol=vector, predictionCol=cluster).evaluate(rows)
