"""Queries on ranks of whole tables. Counts of distinct values are numbered by ranges, so no task gets all rows; their SQL is that of ``texts``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import cumulated, quantile_bin, quantile_edges
from ..sources.readers import run_sql, table
from .texts import _SCORED

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _ranks(counts: DataFrame, value: str) -> DataFrame:
    """(value, rank) of (value, n): the average rank of a value's rows."""
    return cumulated(counts, value, ["n"]).select(value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"))


@query
def pearson_spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    rank = lambda c, to: _ranks(rows.groupBy(c).agg(F.count("*").alias("n")), c).withColumnRenamed("rank", to)
    both = rows.join(rank("x", "rx"), "x").join(rank("y", "ry"), "y")
    return both.agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))


@query
def kruskal_h(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("v"), F.col("l_returnflag").alias("g")).agg(F.count("*").alias("n"))
    ranks = _ranks(per.groupBy("v").agg(F.sum("n").alias("n")), "v")
    groups = per.join(ranks, "v").groupBy("g").agg(F.sum(F.col("rank") * F.col("n")).alias("total"), F.sum("n").alias("m"))
    n = F.sum("m").cast("double")
    return groups.agg(F.round(12.0 / (n * (n + 1)) * F.sum(F.col("total") * F.col("total") / F.col("m")) - 3.0 * (n + 1), 4).alias("h"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """(s, n, p): rows and positives of every distinct score."""
    rows = run_sql(spark, d, _SCORED.replace("least(1.0,", "least(1.0D,").replace("documents d", "{documents} d").replace("labels l", "{labels} l"))
    return rows.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("p"))


@query
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    p, n = F.sum("p").cast("double"), F.sum("n").cast("double")
    return cumulated(_scores(spark, d), "s", ["n"]).agg(F.round((F.sum(rank * F.col("p")) - p * (p + 1) / 2) / (p * (n - p)), 6).alias("auc"))


def _from_the_top(spark: SparkSession, d: str) -> DataFrame:
    """(p, tp, seen, total) of every distinct score as a threshold."""
    c = _scores(spark, d)
    sums = c.agg(F.sum("n").cast("double").alias("all"), F.sum("p").cast("double").alias("total"))
    return cumulated(c, "s", ["n", "p"]).crossJoin(F.broadcast(sums)).select(
        F.col("p").cast("double").alias("p"), (F.col("total") - F.col("before_p")).alias("tp"), (F.col("all") - F.col("before_n")).alias("seen"), "total"
    )


@query
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _from_the_top(spark, d).agg(F.round(F.expr("sum(p / total * tp / seen)"), 6).alias("average_precision"))


@query
def recall_at_precision(spark: SparkSession, d: str) -> DataFrame:
    return _from_the_top(spark, d).agg(
        F.round(F.expr("max(CASE WHEN tp / seen >= 0.1D THEN tp / total END)"), 6).alias("recall_at_p10"),
        F.round(F.expr("max(CASE WHEN tp / total >= 0.8D THEN tp / seen END)"), 6).alias("precision_at_r80"),
    )


@query
def decile_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Bins of equal numbers of rows by price, equal prices in one. Rows are neither sorted nor shuffled."""
    rows = table(spark, d, "lineitem").select("l_extendedprice", F.col("l_discount").alias("s"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    bucket = quantile_bin(F.col("l_extendedprice"), quantile_edges(rows, "l_extendedprice", 10))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("observed"))


@query
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    mean = F.broadcast(rows.agg(F.avg("y").alias("m")))
    return rows.crossJoin(mean).agg(
        F.round(F.expr("1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m))"), 6).alias("r2"), F.round(F.expr("avg(abs(y - p))"), 3).alias("mae"),
        F.round(F.expr("sqrt(avg((y - p) * (y - p)))"), 3).alias("rmse"),
    )
