"""Data quality: schema conformance, column profiles, model cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the same type in other systems' catalogues.
ALIASES = {"integer": "int", "long": "bigint", "text": "string", "varchar": "string", "double precision": "double", "bool": "boolean"}


def conformance(rows: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(column_name, finding): missing, type mismatch or stale columns."""
    have = dict(rows.dtypes)
    plain = lambda t: ALIASES.get(t.lower(), t.lower())
    found = [(c, "missing") for c in expected if c not in have]
    found += [(c, "type mismatch") for c, t in expected.items() if c in have and plain(have[c]) != plain(t)]
    found += [(c, "stale") for c in have if c not in expected]
    return rows.sparkSession.createDataFrame(found, "column_name string, finding string")


def profile(rows: DataFrame) -> DataFrame:
    """(column_name, type, n_rows, n_null, n_distinct, least, greatest) of every column, in one pass."""
    parts = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(t).alias("type"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(c).isNull().cast("long")).alias("n_null"),
            F.count_distinct(c).alias("n_distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest"),
        )
        for c, t in rows.dtypes if not t.startswith(("map", "variant"))
    ]
    return rows.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def samples(rows: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The first ``n`` values in order: a report's examples."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(n)


def card(spark: SparkSession, key: str, version: str, task: str, algorithm: str, metrics: dict, n_train: int) -> DataFrame:
    """One row of the model registry; upsert it by (model_key, version)."""
    import json

    row = spark.createDataFrame([(key, version, task, algorithm, json.dumps(metrics), n_train)], "model_key string, version string, task string, algorithm string, m string, n_train_rows int")
    return row.withColumn("metrics", F.parse_json("m")).withColumn("trained_at", F.current_timestamp()).drop("m")


#: The formats of date columns in the order in which they are tried, and the share of a column's rows that one must parse.
COLUMN_FORMATS, COLUMN_SHARE = ("MMM d, yyyy", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy"), 0.8


def date_formats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column the place of the first format that parses more than COLUMN_SHARE of all rows (nulls count as rows), -1 if none does."""
    parsed = lambda c, f: F.try_to_date(F.col(c), f).isNotNull().cast("int")
    rates = rows.agg(*[F.array(*[F.avg(parsed(c, f)) for f in COLUMN_FORMATS]).alias(c) for c in columns])
    return rates.select(*[(F.array_position(F.transform(c, lambda r: F.coalesce(r > COLUMN_SHARE, F.lit(False))), True) - 1).cast("int").alias(c) for c in columns])


def with_dates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with text columns as dates: by the column's one format, whatever other formats a value would fit; without one, each value by the first that parses it."""
    chosen = date_formats(rows, columns).select(*[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.crossJoin(F.broadcast(chosen))  # one row

    def parsed(c: str):
        out = F.coalesce(*[F.try_to_date(F.col(c), f) for f in COLUMN_FORMATS])
        for i, f in enumerate(COLUMN_FORMATS):
            out = F.when(F.col(f"__{c}") == i, F.try_to_date(F.col(c), f)).otherwise(out)
        return out

    return joined.select(*[parsed(c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def date_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, format, null_share): the format of each column, null where values were parsed one by one, and the share of rows without a date after it."""
    names = F.array(*[F.lit(f) for f in COLUMN_FORMATS])
    chosen = date_formats(rows, columns).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.get(names, F.col(c)).alias("format")) for c in columns])))
    shares = with_dates(rows.select(*columns), columns).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    shares = shares.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_share")) for c in columns])))
    return chosen.join(F.broadcast(shares), "column_name")  # a row per column


def profile_full(rows: DataFrame, n_samples: int = 5) -> DataFrame:
    """(column_name, type, n_rows, n_null, null_percent, n_distinct, least, greatest, mean, samples) of every column but maps.

    Typed extremes and means come from one pass without a shuffle of rows; distinct values and the first ``n_samples`` in order of their
    text from a second, over (column, value) pairs that are pre-aggregated, so no column's values meet in one task before.
    """
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    cols = [(c, t) for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    null = F.lit(None)
    parts = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(t).alias("type"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias("n_null"),
            F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest"), (F.avg(c) if t.startswith(numeric) else null).cast("double").alias("mean"),
        )
        for c, t in cols
    ]
    one = rows.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c, _ in cols])).alias("x")).select("x.c", "x.v").where("v IS NOT NULL")
    values = pairs.distinct()
    counts = values.groupBy(F.col("c").alias("__c")).agg(F.count("*").alias("n_distinct"))
    first = values.withColumn("__s", F.pmod(F.xxhash64("v"), F.lit(32)))
    for by in (["c", "__s"], ["c"]):  # the first of each of 32 parts, then of those
        first = first.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy("v"))).where(F.col("__i") <= n_samples)
    samples = first.groupBy(F.col("c").alias("__d")).agg(F.array_sort(F.collect_list("v")).alias("samples"))
    share = F.when(F.col("n_rows") > 0, F.round(F.col("n_null") * 100.0 / F.col("n_rows"), 2)).otherwise(0.0)
    out = one.join(counts, F.col("column_name") == F.col("__c"), "left").join(samples, F.col("column_name") == F.col("__d"), "left")
    return out.select("column_name", "type", "n_rows", "n_null", share.alias("null_percent"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "least", "greatest", "mean", F.coalesce("samples", F.array()).alias("samples"))
