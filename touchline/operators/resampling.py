"""Balancing of training rows: under-sampling and synthetic minority rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import nearest

BLOCK_ROWS = 2000


def undersampled(rows: DataFrame, label: str, key: str, buckets: int = 256) -> DataFrame:
    """As many rows of every class as the smallest has: those whose md5 of ``key`` is smallest (ties by ``key``).

    Ranks come from counts per leading hash byte and a row number inside the byte, so a large class isn't one task.
    """
    order = F.md5(F.col(key).cast("string"))
    r = rows.withColumn("__h", order).withColumn("__b", F.substring("__h", 1, 2))
    per = r.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col(label).alias("__l"), F.col("__b").alias("__o"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    least = per.groupBy(label).agg(F.sum("__n").alias("__n")).agg(F.min("__n").alias("__least"))
    ranked = r.withColumn("__i", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)))
    # classes times 256 rows, and one row
    joined = ranked.join(F.broadcast(offsets), (F.col(label) == F.col("__l")) & (F.col("__b") == F.col("__o"))).join(F.broadcast(least))
    return joined.where(F.col("__at") + F.col("__i") <= F.col("__least")).select(rows.columns)


def drawn(key: Column, copy: Column, seed: int, part: int) -> Column:
    """32 bits for a copy of a row, the same on every run and in every engine that has md5."""
    text = F.md5(F.concat_ws(":", key.cast("string"), copy.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(text, 1 + 8 * part, 8), 16, 10).cast("long")


def synthetic(rows: DataFrame, label: str, minority, key: str, numeric: list[str], copies: int = 1, neighbours: int = 5, seed: int = 42, block_rows: int = BLOCK_ROWS, written=lambda df: df) -> DataFrame:
    """(key, label, numeric.., synthetic): the rows, and ``copies`` synthetic rows for each row of the minority class.

    A synthetic row lies on the line from a row to one of its ``neighbours`` nearest minority rows (exact, ties by key), both drawn by the
    digest of key, copy and seed. A class of one row repeats it. Nulls in numeric columns are refused; ``key`` tells rows apart.
    ``written`` may store the minority rows, the steps of their search and its result, which are read more than once.
    """
    few = rows.where(F.col(label) == minority).select(key, label, *[F.col(c).cast("double").alias(c) for c in numeric])
    if not few.where(" OR ".join(f"`{c}` IS NULL" for c in numeric)).isEmpty():
        raise ValueError("numeric columns of minority rows must not be null")
    few = written(few.withColumn("__v", F.array(*numeric)))
    near = written(nearest(few, key, "__v", neighbours, block_rows, written=written).select(F.col(key).alias("__k"), F.col("neighbours.key").alias("__near")))
    each = few.join(near, F.col(key) == F.col("__k")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    pick = F.when(F.size("__near") > 0, drawn(F.col(key), F.col("__copy"), seed, 0) % F.greatest(F.size("__near"), F.lit(1)))
    each = each.withColumn("__to", F.get("__near", pick.cast("int"))).withColumn("__u", drawn(F.col(key), F.col("__copy"), seed, 1) / F.lit(float(1 << 32)))
    ends = few.select(F.col(key).alias("__e"), F.col("__v").alias("__w"))
    each = each.join(ends, F.col("__to") == F.col("__e"), "left")
    line = [(F.col(c) + F.col("__u") * (F.coalesce(F.col("__w")[i], F.col(c)) - F.col(c))).alias(c) for i, c in enumerate(numeric)]
    made = each.select(key, label, *line, F.lit(True).alias("synthetic"))
    return rows.select(key, label, *[F.col(c).cast("double").alias(c) for c in numeric]).withColumn("synthetic", F.lit(False)).unionByName(made)
