"""Rank statistics of whole tables: correlation matrices with p-values, Kruskal and chi-square tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .ordered import cumulated


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(value, rank) of each distinct value of a column, ties at their mean; nulls have none."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return cumulated(counts, "value", ["n"]).select("value", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"))


def spearman_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, rho, p) of every pair of columns, over the rows where no column is null. Each column is ranked once, and one pass sums all pairs.

    A constant column has no correlation (null).
    """
    whole = rows.select(*columns).dropna()
    ranked = whole
    for c in columns:
        ranks = average_ranks(whole, c).select(F.col("value").alias(f"__v_{c}"), F.col("rank").alias(f"__r_{c}"))
        ranked = ranked.join(ranks, F.col(c) == F.col(f"__v_{c}"))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    spread = {c: F.stddev_pop(f"__r_{c}").alias(f"__s_{c}") for c in columns}
    found = ranked.agg(F.count("*").alias("n"), *spread.values(), *[F.covar_pop(f"__r_{a}", f"__r_{b}").alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    both = lambda a, b: F.col(f"__s_{a}") * F.col(f"__s_{b}")
    rho = lambda i, a, b: F.when(both(a, b) > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(f"{i}") / both(a, b))))
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("n"), rho(i, a, b).alias("rho")) for i, (a, b) in enumerate(pairs)])
    return found.select(F.inline(each)).withColumn("p", special.correlation_p(F.col("rho"), F.col("n")))


def kruskal(rows: DataFrame, value: str, group: str) -> DataFrame:
    """One row (h, df, p) of the Kruskal test, corrected for ties; h and p are null if all values are equal or none is there."""
    per = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).alias("value"), F.col(group).alias("g")).agg(F.count("*").alias("m"))
    counts = per.groupBy("value").agg(F.sum("m").alias("n"))
    ranked = cumulated(counts, "value", ["n"]).select("value", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"), "n")
    ties = ranked.agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("t"))  # one row
    groups = per.join(ranked.select("value", "rank"), "value").groupBy("g").agg(F.sum(F.col("rank") * F.col("m")).alias("r"), F.sum("m").alias("m"))
    n = F.sum("m").cast("double")
    h = groups.agg(F.when(n > 0, 12.0 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("m")) - 3.0 * (n + 1)).alias("h"), n.alias("n"), (F.count("*") - 1).alias("df"))
    cube = F.col("n") * F.col("n") * F.col("n") - F.col("n")
    corrected = F.when((cube > 0) & (F.col("t") < cube), F.col("h") / (1.0 - F.col("t") / cube))
    return h.crossJoin(F.broadcast(ties)).select(corrected.alias("h"), "df").withColumn("p", special.chi2_p(F.col("h"), F.col("df")))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (chi2, df, p) of the test of independence of two columns; pairs that don't occur count with their expectation."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))  # one row
    # every pair of categories: sum of n^2 / e - t needs the occurring ones only
    seen = cells.join(left, "a").join(right, "b")
    x = seen.agg(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("na") * F.col("nb").cast("double"))).alias("s"))
    size = left.agg(F.count("*").alias("ka")).crossJoin(right.agg(F.count("*").alias("kb"))).crossJoin(total).crossJoin(x)  # one row each
    return size.select((F.col("t") * F.col("s") - F.col("t")).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df")).withColumn("p", special.chi2_p(F.col("chi2"), F.col("df")))
