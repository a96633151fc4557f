"""Ordered analytics: strictly point-in-time windows, streaks and as-of lookups.

"Before" is strict: rows of the same day never see each other. No correlated ORDER BY ..
LIMIT is used anywhere: Spark may order it wrongly if the key isn't projected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_number(c: str | Column) -> Column:
    return F.datediff(F.col(c) if isinstance(c, str) else c, F.lit("1970-01-01").cast("date"))


def running_total(keys: list[str], order: list[str], value: str | Column) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def prior_days(keys: list[str], day: Column, days: int) -> Window:
    """Frame of the ``days`` days before, the day itself excluded."""
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, -1)


def all_prior_days(keys: list[str], day: Column) -> Window:
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)


def with_last_before(rows: DataFrame, keys: list[str], day: str, tie: str, value: str, n: int, out: str) -> DataFrame:
    """Rows with ``out``: the values of the last ``n`` rows strictly before the day, latest first; ties inside a day by ``tie``.

    A day holds at most ``n`` values and a frame at most ``n`` days, whatever an entity's number of rows.
    """
    latest = Window.partitionBy(*keys, day).orderBy(F.col(tie).desc())
    days = rows.select(*keys, day, F.col(value).alias("__v"), F.row_number().over(latest).alias("__r")).where(F.col("__r") <= n)
    days = days.groupBy(*keys, day).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda r: r["__v"]).alias("__vs"))
    frame = Window.partitionBy(*keys).orderBy(day).rowsBetween(-n, -1)
    last = days.select(*keys, day, F.slice(F.flatten(F.reverse(F.collect_list("__vs").over(frame))), 1, n).alias(out))
    return rows.join(last, [*keys, day], "left")


def count_windows(rows: DataFrame, keys: list[str], at: str, minutes: str, started: str, n: int) -> DataFrame:
    """Sums over the ``n`` appearances before each, 0 where there are none, and the run of starts that ends just before it.

    ``at`` numbers an entity's appearances from 1; ``started`` is 1 or 0.
    """
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-n, -1)
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    stop = F.max(F.when(F.col(started) == 0, F.col(at))).over(before)
    return rows.select(
        *keys, at, zero(F.sum(started).over(w)).alias(f"starts_last{n}"), F.count(F.when(F.col(minutes) >= 90, 1)).over(w).alias(f"full90_last{n}"),
        zero(F.round(F.avg(minutes).over(w), 6)).alias(f"minutes_last{n}"), zero(F.max(minutes).over(w)).alias(f"minutes_max{n}"),
        zero(F.round(F.avg(1.0 - F.col(started)).over(w), 6)).alias(f"sub_share{n}"), (F.col(at) - 1 - zero(stop)).alias("starts_in_a_row"),
    )


def mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return F.when(F.size(values) > 0, total / F.size(values))


def days_since(keys: list[str], day: Column, event_day: Column) -> Column:
    """Days since the last event strictly before; null if none."""
    return day - F.max(event_day).over(all_prior_days(keys, day))


def with_streak(rows: DataFrame, keys: list[str], order: list[str], flag: str, out: str = "streak_before") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(upto))
    run = Window.partitionBy(*keys, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.sum(F.col(flag).cast("int")).over(run))
    return rows.withColumn(out, F.coalesce(F.lag("__run").over(w), F.lit(0))).drop("__island", "__run")


def with_calendar_streak(rows: DataFrame, keys: list[str], day: str, played: str, gap: int = 45, out: str = "streak_before") -> DataFrame:
    """Appearances in a row on a calendar, seen before the row.

    An absence or a gap of over ``gap`` days starts a run; the row after a gap counts 0 itself,
    yet the run's sum goes on behind it, so two played rows after a gap show 0, then 2.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    rows = rows.withColumn("__gap", F.coalesce(F.datediff(F.col(day), F.lag(day).over(w)) > gap, F.lit(False)))
    rows = rows.withColumn("__island", F.sum((F.col("__gap") | ~F.col(played)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "__island").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.when(F.col("__gap"), 0).otherwise(F.sum(F.col(played).cast("int")).over(run)))
    return rows.withColumn(out, F.coalesce(F.lag("__run").over(w), F.lit(0))).drop("__gap", "__island", "__run")


def asof_other(rows: DataFrame, group: str, side: str, order: str, values: list[str], default: float = 0.0) -> DataFrame:
    """Each row with the other side's latest ``values`` at or before its order key (``opp_*``), by one union and one window.

    Rows of the other side at the same key count. A group has two sides; more sides see the last row of any other.
    """
    mine = rows.select(group, side, order, *values)
    pairs = mine.select(group, side).distinct()
    other = pairs.alias("a").join(pairs.alias("b"), (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{side}") != F.col(f"b.{side}")))
    other = other.select(F.col(f"a.{group}").alias(group), F.col(f"a.{side}").alias("__for"), F.col(f"b.{side}").alias(side))
    seen = mine.join(other, [group, side]).select(group, F.col("__for").alias(side), order, F.lit(0).alias("__own"), F.struct(*values).alias("__v"))
    own = mine.select(group, side, order, F.lit(1).alias("__own"), F.lit(None).cast(seen.schema["__v"].dataType).alias("__v"), *values)
    both = seen.unionByName(own, allowMissingColumns=True)
    w = Window.partitionBy(group, side).orderBy(order, "__own").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__own = 1")
    return both.select(group, side, order, *values, *[F.coalesce(F.col("__last")[v], F.lit(default)).alias(f"opp_{v}") for v in values])


def latest_before(rows: DataFrame, events: DataFrame, key: str, at: str, value: str, out: str, buckets: int = 64) -> DataFrame:
    """``rows`` with ``out``: the ``value`` of the latest event of the same key strictly before ``at`` (whole numbers; null if none).

    Events of one key and number must agree. A key's events are cut into ``buckets`` spans of ``at``: a bucket's last one is what
    later buckets see of it, so a key that holds most rows is that many tasks.
    """
    span = events.agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))  # one row
    bucket = F.expr(f"CAST(least({buckets - 1}, greatest(0, ({at} - __lo) div greatest((__hi - __lo) div {buckets} + 1, 1))) AS INT)")
    dealt = lambda df: df.join(F.broadcast(span), how="left").withColumn("__b", F.coalesce(bucket, F.lit(0))).drop("__lo", "__hi")
    e = dealt(events.select(key, at, F.struct(F.col(value).alias("v")).alias("__v")))
    last = e.groupBy(key, "__b").agg(F.max_by("__v", at).alias("__last"))
    # of each bucket of a key that rows are in: the last event of the buckets before it
    r = dealt(rows)
    wanted = r.select(key, "__b").distinct().join(last, [key, "__b"], "full")
    ahead = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = wanted.withColumn("__ahead", F.last("__last", ignorenulls=True).over(ahead)).select(F.col(key).alias("__k"), F.col("__b").alias("__kb"), "__ahead")
    both = r.withColumn("__v", F.lit(None).cast(e.schema["__v"].dataType)).withColumn("__own", F.lit(0)).unionByName(e.withColumn("__own", F.lit(1)), allowMissingColumns=True)
    inside = Window.partitionBy(key, "__b").orderBy(at, "__own").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("__in", F.last("__v", ignorenulls=True).over(inside)).where("__own = 0")
    seen = seen.join(wanted, F.expr(f"{key} <=> __k AND __b = __kb"), "left")
    return seen.withColumn(out, F.coalesce("__in", "__ahead")["v"]).select(*rows.columns, out)


def average_rank(value: str | Column, keys: list[str] = (), descending: bool = False) -> Column:
    """Rank with ties at their mean."""
    c = F.col(value) if isinstance(value, str) else value
    by = Window.partitionBy(*keys).orderBy(c.desc() if descending else c.asc())
    return F.rank().over(by) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0


def cumulated(counts: DataFrame, value: str, sums: list[str], ranges: int | None = None) -> DataFrame:
    """``counts`` (a row per distinct value) with before_x, the sum of each column x over smaller values.

    Values are dealt to as many ranges as the session has partitions, by approximate quantiles (one short row, the only thing
    broadcast), summed by range, and cumulated inside each: only the sums of the ranges meet in one task.
    """
    ranges = ranges or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = counts.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("__marks"))
    dealt = counts.crossJoin(F.broadcast(marks)).withColumn("__range", F.size(F.filter(F.coalesce("__marks", F.array()), lambda m: m < F.col(value)))).drop("__marks")
    per = dealt.groupBy(F.col("__range").alias("__at")).agg(*[F.sum(x).alias(f"__{x}") for x in sums])
    ahead = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__at", *[F.coalesce(F.sum(f"__{x}").over(ahead), F.lit(0)).alias(f"__{x}") for x in sums])
    inside = Window.partitionBy("__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({f"before_{x}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums})
    joined = within.join(F.broadcast(per), F.col("__range") == F.col("__at"))
    return joined.withColumns({f"before_{x}": F.col(f"before_{x}") + F.col(f"__{x}") for x in sums}).drop("__range", "__at", *[f"__{x}" for x in sums])


def quantiles(rows: DataFrame, value: str, at: list[float], accuracy: int = 100_000) -> list[float]:
    """The exact interpolated quantiles of a numeric column; nulls don't count, no values give no quantiles.

    Approximate quantiles, whose places are off by one in ``accuracy`` at most, bracket each place. One more scan counts the rows
    between the brackets and, value by value, those inside: a few rows in ``accuracy`` are ordered, and no more are shuffled. The driver
    gets two numbers a quantile.
    """
    v = rows.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n = v.count()
    if not n:
        return []
    off = 2.0 / accuracy + 2.0 / n
    marks = v.agg(F.percentile_approx("v", [*[max(0.0, q - off) for q in at], *[min(1.0, q + off) for q in at]], accuracy).alias("m")).first().m
    # approximate quantiles at the ends needn't be the extremes
    brackets = [(-math.inf if q - off <= 0 else lo, math.inf if q + off >= 1 else hi) for q, lo, hi in zip(at, marks[: len(at)], marks[len(at) :])]
    bounds = sorted({b for pair in brackets for b in pair if math.isfinite(b)})
    span, inside = F.lit(0), F.lit(False)
    for b in bounds:
        span = span + (F.col("v") > F.lit(b)).cast("int")
    for lo, hi in brackets:
        inside = inside | ((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi)))
    near = v.select(span.alias("at"), F.when(inside, F.col("v")).alias("v")).groupBy("at", "v").agg(F.count("*").alias("n"))
    # rows before each value: those of earlier spans (a row a span, all that is broadcast) and of smaller values in its own
    spans = near.groupBy("at").agg(F.sum("n").alias("__n"))
    spans = spans.select(F.col("at").alias("__at"), F.coalesce(F.sum("__n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("at").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("b", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(spans), F.col("at") == F.col("__at"))
    places = [(n - 1) * q for q in at]
    wanted = sorted({p for h in places for p in (int(h), min(int(h) + 1, n - 1))})
    before = F.col("b") + F.col("__ahead")
    hit = [(before <= p) & (before + F.col("n") > p) for p in wanted]
    found = near.where("v IS NOT NULL").select("v", F.filter(F.array(*[F.when(c, p) for c, p in zip(hit, wanted)]), lambda x: x.isNotNull()).alias("p"))
    value_at = {p: r.v for r in found.where(F.size("p") > 0).collect() for p in r.p}
    return [value_at[int(h)] + (value_at[min(int(h) + 1, n - 1)] - value_at[int(h)]) * (h - int(h)) for h in places]


def quantile_edges(rows: DataFrame, value: str, bins: int, accuracy: int = 100_000) -> list[float]:
    """The exact quantiles 0, 1 / bins .. 1 of a column, equal ones once."""
    return sorted(set(quantiles(rows, value, [i / bins for i in range(bins + 1)], accuracy)))


def quantile_bin(value: Column, edges: list[float]) -> Column:
    """The bin from 1 that a value is in: above its lower edge and up to its upper one, the least value in the first. Equal values share one."""
    out = F.lit(1)
    for e in edges[1:-1]:
        out = out + (value > F.lit(e)).cast("int")
    return F.when(value.isNotNull(), out)
