"""Estimators and feature preparation on MLlib; what the library lacks is said in README."""

from __future__ import annotations

import math
from functools import reduce
from itertools import groupby, pairwise

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .evaluation import cross_validated, side_by_side, with_fold

CALIBRATION_FOLDS = 3
#: Values whose ranks a task may hold.
FEW_VALUES = 250_000
#: Bins of a number in a tree, as many as MLlib's trees have, and the quantiles that they are made of.
BINS, GRID = 32, 2_000


def kmeans(rows: DataFrame, vector: str, k: int, seed: int, restarts: int = 1) -> DataFrame:
    """Rows with ``cluster`` from the best of ``restarts`` seeded fits, a few side by side; the first of equal ones."""
    data = rows.withColumn("__v", array_to_vector(F.col(vector)))
    fits = side_by_side(lambda i: KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="cluster").fit(data), range(restarts))
    return min(fits, key=lambda m: m.summary.trainingCost).transform(data).drop("__v")


def gaussian_mixture(rows: DataFrame, vector: str, ks: range, seed: int, least_share: float = 0.03):
    """(model, table of (k, bic)): the smallest BIC among fits without tiny components, or among all."""
    data = rows.withColumn("__v", array_to_vector(F.col(vector)))
    n = data.count()
    d = data.select(F.size(vector)).first()[0]

    def one(k: int) -> tuple:
        m = GaussianMixture(k=k, seed=seed, featuresCol="__v").fit(data)
        free = k - 1 + k * d + k * d * (d + 1) / 2
        return free * math.log(n) - 2 * m.summary.logLikelihood, min(m.summary.clusterSizes) / n >= least_share, k, m

    fits = side_by_side(one, ks)
    best = min([f for f in fits if f[1]] or fits, key=lambda f: f[0])
    return best[3], [(f[2], f[0]) for f in fits]


def one_hot(column: str) -> list:
    return [StringIndexer(inputCol=column, outputCol=f"{column}__x", handleInvalid="keep"), OneHotEncoder(inputCol=f"{column}__x", outputCol=f"{column}__o")]


def features(numeric: list[str], categorical: list[str] = (), scale: str = "standard") -> list:
    """Stages: median imputer, scaler, one-hot of known categories (unknown ones get a bucket of their own)."""
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric]), VectorAssembler(inputCols=[f"{c}__i" for c in numeric], outputCol="__n")]
    scaler = RobustScaler(inputCol="__n", outputCol="__s", withCentering=True) if scale == "robust" else StandardScaler(inputCol="__n", outputCol="__s", withMean=True)
    stages.append(scaler)
    for c in categorical:
        stages += one_hot(c)
    return [*stages, VectorAssembler(inputCols=["__s", *[f"{c}__o" for c in categorical]], outputCol="features")]


def thresholds(values: list[float], bins: int = BINS) -> list[float]:
    """Bounds between at most ``bins`` bins of a sorted sample, by the rule of MLlib's trees: all middles of few values, else strides of equal weight."""
    counts = [(v, len(list(same))) for v, same in groupby(values)]
    middles = [(a + b) / 2 for (a, _), (b, _) in pairwise(counts)]
    if len(middles) < bins:
        return middles
    out, seen, stride = [], 0, len(values) / bins
    for middle, (_, n), (_, following) in zip(middles, counts, counts[1:]):
        seen, target = seen + n, (len(out) + 1) * stride
        if abs(seen - target) < abs(seen + following - target):
            out.append(middle)
    return out


def cells(folded: DataFrame, k: int, numeric: list[str], categorical: list[str], label: str) -> list[tuple[DataFrame, DataFrame]]:
    """[(training, held-out)] of each fold: one row, a cell, for all rows that a tree can't tell apart, ``weight`` their number.

    A tree knows a number by its bin only, so weighted cells give the tree of the rows. All rows are counted, and bounds of bins are
    quantiles of all training rows of the fold (off by one in ``GRID`` at most), where MLlib takes them from some 10,000 sampled rows; a missing
    number is the median. Bins count from 1, as MLlib estimates how often a 0 occurs. ``features`` has the bins and one-hot categories.
    """
    put, tasks = written(folded.sparkSession), 2 * folded.sparkSession.sparkContext.defaultParallelism
    numbers = [F.col(c).cast("double") for c in numeric]
    rows = put(folded.select("fold", label, *categorical, *[F.when(~F.isnan(x), x).alias(c) for c, x in zip(numeric, numbers)])).coalesce(tasks)  # larger tasks meet a cell more often
    grid = [i / GRID for i in range(GRID + 1)]
    keys = ["held_out", label, *categorical, *numeric]

    def one(i: int) -> tuple[DataFrame, DataFrame]:
        bins = []
        for c, values in zip(numeric, rows.where(F.col("fold") != i).approxQuantile(numeric, grid, 1 / GRID)):
            x = F.coalesce(c, F.lit(values[GRID // 2] if values else 0.0))
            bins.append(reduce(lambda n, bound, x=x: n + (x > bound).cast("int"), thresholds(values), F.lit(1)).cast("double").alias(c))
        coded = rows.select((F.col("fold") == i).alias("held_out"), label, *categorical, *bins)
        counted = put(coded.groupBy(*keys).agg(F.count("*").cast("double").alias("weight")))
        encoders = [s for c in categorical for s in one_hot(c)]
        training = counted.where("NOT held_out")
        model = Pipeline(stages=[*encoders, VectorAssembler(inputCols=[*numeric, *[f"{c}__o" for c in categorical]], outputCol="features")]).fit(training)
        return model.transform(training), model.transform(counted.where("held_out"))

    return side_by_side(one, range(k))


def fitted(rows: DataFrame, stages: list, estimator) -> PipelineModel:
    return Pipeline(stages=[*stages, estimator]).fit(rows)


def with_class_weight(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) by a join with the class counts (a row per class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)


def components(rows: DataFrame, vector: str, k: int):
    return PCA(k=k, inputCol=vector, outputCol="pca").fit(rows)


def component_report(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(component, share, cumulated, column_name, loading) of the first ``k`` principal components of standardised columns, nulls as 0.

    The sign of a component is that of its largest loading, made positive; a constant column has no loading.
    """
    data = VectorAssembler(inputCols=columns, outputCol="__n").transform(rows.na.fill(0, columns).select(*[F.col(c).cast("double").alias(c) for c in columns]))
    data = StandardScaler(inputCol="__n", outputCol="__s", withMean=True).fit(data).transform(data)
    model = PCA(k=k, inputCol="__s", outputCol="pca").fit(data)
    shares, axes = model.explainedVariance.toArray().tolist(), model.pc.toArray()
    out, total = [], 0.0
    for i, share in enumerate(shares):
        total += share
        axis = axes[:, i]
        sign = 1.0 if axis[abs(axis).argmax()] >= 0 else -1.0
        out += [(i + 1, share, total, c, float(sign * x)) for c, x in zip(columns, axis)]
    return rows.sparkSession.createDataFrame(out, "component int, share double, cumulated double, column_name string, loading double")


def calibrated(rows: DataFrame, label: str, score: str, group: str):
    """Isotonic calibration, kept only if it lowers the Brier score out of fold; (model of all rows or None, before, after).

    Folds are whole groups (``group`` may be a row's key): the model that judges a row knows other rows of its score, and none of its group.
    """
    data = rows.select(F.col(score).alias("features"), F.col(label).cast("double").alias("label"), F.col(group).alias("group"))
    judged = cross_validated(with_fold(data, "group", CALIBRATION_FOLDS), CALIBRATION_FOLDS, IsotonicRegression().fit)
    brier = lambda df, c: df.agg(F.avg(F.pow(F.col(c) - F.col("label"), F.lit(2.0)))).first()[0]
    before, after = brier(data, "features"), brier(judged, "prediction")
    return (IsotonicRegression().fit(data) if after < before else None), before, after


def _rank_correlations(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Rank correlations of the columns, nulls as 0; 0 for a constant column.

    Values are counted and ranked, and one pass sums all pairs: rows are not sorted. Ranks of few values are broadcast; a column
    of more than ``FEW_VALUES`` is joined by a shuffle.
    """
    from .ranks import average_ranks

    # shuffled once for each column of many values
    ranked = whole = rows.na.fill(0, columns).select(*[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    kept = []
    try:
        for i in range(len(columns)):
            ranks = average_ranks(whole, f"__v{i}").select(F.col("value").alias(f"__w{i}"), F.col("rank").alias(f"__r{i}")).persist()
            kept.append(ranks)
            ranks = F.broadcast(ranks) if ranks.count() <= FEW_VALUES else ranks.hint("merge")
            ranked = ranked.join(ranks, F.col(f"__v{i}") == F.col(f"__w{i}")).drop(f"__v{i}", f"__w{i}")
        pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
        spread = [F.stddev_pop(f"__r{i}") for i in range(len(columns))]
        found = ranked.agg(*spread, *[F.covar_pop(f"__r{i}", f"__r{j}") for i, j in pairs]).first()
    finally:
        for ranks in kept:
            ranks.unpersist()
    m = [[1.0] * len(columns) for _ in columns]
    for (i, j), r in zip(pairs, found[len(columns) :]):
        both = (found[i] or 0.0) * (found[j] or 0.0)
        m[i][j] = m[j][i] = r / both if both > 0 else 0.0
    return m


def collinear(rows: DataFrame, columns: list[str], priority: list[str] = (), limit: float = 0.9) -> list[str]:
    """Columns to drop: greedily one of each pair over ``limit`` in rank correlation, the one of lower priority."""
    m = _rank_correlations(rows, columns)
    rank = {c: i for i, c in enumerate([*priority, *[c for c in columns if c not in priority]])}
    pairs = sorted(((abs(m[i][j]), a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j), key=lambda p: (-p[0], p[1], p[2]))
    gone: list[str] = []
    for r, a, b in pairs:
        if r > limit and a not in gone and b not in gone:
            gone.append(max(a, b, key=lambda c: rank[c]))
    return gone


def collinear_in_order(rows: DataFrame, columns: list[str], limit: float = 0.9) -> list[str]:
    """Columns to keep: in list order, each drops the later ones over ``limit`` in rank correlation with it."""
    m = _rank_correlations(rows, columns)
    kept: list[int] = []
    for j in range(len(columns)):
        if all(abs(m[i][j]) <= limit for i in kept):
            kept.append(j)
    return [columns[j] for j in kept]
