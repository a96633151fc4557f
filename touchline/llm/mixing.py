"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 %
of all words; a target stops at twice its source's words and the excess is reshared by
weight until none is above. As every target is ``min(cap, level * weight)``, one level
found on the sources ordered by ``cap / weight`` gives the result of all rounds.

Each source is then taken in whole documents: whole passes while the target holds one,
and for the remaining budget a count per document length. The budget is spread over the
lengths in proportion, the rest goes to the longest documents until ``DP_WORDS`` are left,
and a bounded-knapsack dynamic programme (a bit set of reachable sums) fits those words.
Which documents of a length are taken follows a seeded hash, so reruns agree.

Only (source, length) counts reach Python, grouped by source: a source of any size is as
many rows as it has distinct lengths. Ranks inside a (source, length) come from counts
per hash bucket and a row number inside the bucket, so a hot length isn't one task.
Texts are read once and never shuffled by ``taken``.

Edge cases: a null or empty text has size 0 and takes nothing; sources without words have
target 0; repeated rows are separate documents; an empty table gives an empty result;
extra columns are ignored by ``taken`` and kept by ``mixed``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
SEED = 17
DP_WORDS = 1 << 15
BUCKETS = 1024


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row per source goes through one task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])[((F.row_number().over(order) - 1) % len(weights)).cast("int")]
    rows = totals.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(cap))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    budget = F.sum("source_size").over(every) * F.lit(share)
    rows = rows.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))
    rows = rows.withColumn("level", F.min(free).over(every)["level"])
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int, dp_words: int = DP_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come nearest to ``budget`` without exceeding it.

    Exact whenever the words left after the proportional part are within ``dp_words``;
    the proportional part itself leaves copies of every length to the programme.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or total <= 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left > dp_words and lengths[i]:
            more = min(counts[i] - take[i], max(0, (left - dp_words // 2) // lengths[i]))
            take[i] += more
            left -= more * lengths[i]
    # a part is 1, 2, 4, ... copies of a length; reach has a bit for each sum made so far
    mask = (1 << (left + 1)) - 1
    reach, parts = 1, []
    for i in order:
        spare, chunk = counts[i] - take[i], 1
        while lengths[i] and spare and lengths[i] * chunk <= left and not reach >> left & 1:
            k = min(chunk, spare)
            parts.append((reach, i, k))
            reach |= reach << (lengths[i] * k) & mask
            spare -= k
            chunk *= 2
    at = reach.bit_length() - 1
    for before, i, k in reversed(parts):
        if not before >> at & 1:
            take[i] += k
            at -= lengths[i] * k
    return take


def _fitted(rows: pa.Table) -> pa.Table:
    size, target = rows["source_size"][0].as_py(), rows["target"][0].as_py()
    passes = min(2, int(target / size + 1e-9)) if size else 0
    budget = int(target - passes * size + 1e-6) if size else 0
    picks = fit(rows["size"].to_pylist(), rows["n"].to_pylist(), budget)
    rows = rows.select(["source", "size", "n", "source_size", "target"])
    return rows.append_column("passes", pa.array([passes] * len(picks), pa.int32())).append_column("picks", pa.array(picks, pa.int64()))


def taken(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """(id, th, size, source_size, target, copies, taken) of every row; th is the hash of its text."""
    slim = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.expr(f"regexp_count(CAST(`{text_col}` AS STRING), '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long").alias("size"),
    )
    slim = slim.withColumn("order", F.xxhash64(F.lit(seed), "id", "th"))
    slim = stored(spark, slim.withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int")), "mixing")
    hist = slim.groupBy("source", "size").agg(F.count("*").alias("n"))
    share = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    share = share.select(F.col("source").alias("__s"), "source_size", "target")
    joined = hist.join(share, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    plan = joined.groupBy("source").applyInArrow(
        _fitted, "source string, size long, n long, source_size long, target double, passes int, picks long"
    )
    plan = stored(spark, plan, "mixing")
    names = {c: F.col(c).alias(f"__{c}") for c in ("source", "size", "bucket")}
    same = lambda *cols: [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols]
    per = slim.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the plan meets the buckets, BUCKETS rows of a length at most; rows meet their bucket only
    plan = plan.select(names["source"], names["size"], "source_size", "target", "passes", "picks")
    per = per.join(plan, same("source", "size")).select(
        *[F.col(c).alias(f"__{c}") for c in ("source", "size", "bucket")], "offset", "source_size", "target", "passes", "picks"
    )
    inside = Window.partitionBy("source", "size", "bucket").orderBy("order", "id", "th")
    ranked = slim.withColumn("at", F.row_number().over(inside))
    out = ranked.join(per, same("source", "size", "bucket")).withColumn("rank", F.col("offset") + F.col("at"))
    out = out.withColumn("copies", F.col("passes") + (F.col("rank") <= F.col("picks")).cast("int"))
    return out.select("id", "th", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The mix: every row of ``docs`` as often as it is taken, 0 to 2 times, all its columns."""
    picks = stored(spark, taken(spark, docs, id_col, text_col, **kw).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("copies").alias("__copies")), "mixing")
    rows = docs.withColumn("__own", F.col(id_col)).withColumn("__ownth", F.xxhash64(text_col))
    same = lambda x: rows["__own"].eqNullSafe(x["__id"]) & (rows["__ownth"] == x["__th"])
    again = picks.groupBy("__id", "__th").agg(F.count("*").alias("n")).where("n > 1").select("__id", "__th")
    joined = rows.join(picks.where("__copies > 0"), same(picks))
    if not again.isEmpty():  # rows equal in id and text share their copies in turn
        turn = Window.partitionBy("__id", "__th").orderBy("__copies")
        turns = picks.join(again.select(F.col("__id").alias("__i"), F.col("__th").alias("__t")), F.expr("__id <=> __i AND __th = __t"), "left_semi")
        turns = turns.withColumn("__turn", F.row_number().over(turn)).where("__copies > 0")
        own = Window.partitionBy("__own", "__ownth").orderBy(F.lit(0))
        repeated = rows.join(again, same(again), "left_semi").withColumn("__n", F.row_number().over(own))
        repeated = repeated.join(turns, F.expr("__own <=> __id AND __ownth = __th AND __n = __turn"))
        joined = rows.join(again, same(again), "left_anti").join(picks.where("__copies > 0"), same(picks)).unionByName(repeated.drop("__n", "__turn"))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taken(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")
