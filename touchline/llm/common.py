"""Shared pieces of the training-data operators: shared-folder tables and components.

Every table written here goes to the folder in ``spark.checkpoint.dir``, which all
executors share, so a lost executor costs a re-read and never a lost result.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that meets more than one in HOT_SHARE rows is hot: its rows are dealt to SALTS keys.
HOT_SHARE, SALTS = 1000, 32
#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. A cluster must name one; a single process (tests) gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="touchline-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back: lineage ends here."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bound the Arrow batches that Python workers and the JVM hold, for this session: whole texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow`` that leaves no idle memory: a worker process outlives its task, and waits beside those of other stages."""

    def wrapped(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())  # other pools keep what they once had
        try:
            yield from run(batches)
        finally:
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def shingle_hashes(text: str | None, size: int, seed: int):
    """XXH64 of each shingle of ``size`` words of the text (A-Z lower-cased), repeats included; of the whole sequence if that is shorter."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if size == 3 and len(words) > 3:
        hashes = [digest(a + b" " + b + b" " + c, seed) for a, b, c in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + size]), seed) for i in range(max(1, len(words) - size + 1))]
    return np.array(hashes, dtype="<u8"), len(words)


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_for(spark: SparkSession, least: int = 8) -> int:
    """Partition count for slim intermediate tables: the session's shuffle setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(keyed: DataFrame, total: int) -> DataFrame | None:
    """The keys of ``keyed`` (a stored table) that meet more than one in HOT_SHARE of ``total`` rows; None if there are none."""
    hot = keyed.where(F.col("__n") * HOT_SHARE > F.lit(total)).select(F.col("__key").alias("__hot"), F.lit(SALTS).alias("__salts"))
    return None if hot.isEmpty() else hot


def met(rows: DataFrame, key: str, by: list[str], keyed: DataFrame, total: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``keyed`` where ``key`` equals ``__key`` (null equals null): one row a key, with the rows that it meets in ``__n``.

    ``total`` is no less than the sum of ``__n``, so fewer than HOT_SHARE keys are hot and their list is broadcast. Rows
    of a hot key are salted by a hash of ``by``, and ``keyed`` has a copy of that key for every salt. ``keyed`` is written
    once, or where it is wide its stored ``counts`` (__key, __n) are read; without a hot key it is a plain join.
    """
    if counts is None:
        counts = keyed = stored(rows.sparkSession, keyed, "met")
    hot = hot_keys(counts, total)
    if hot is None:
        return rows.join(keyed.drop("__n"), F.col(key).eqNullSafe(F.col("__key")), how).drop("__key")
    salts = F.coalesce("__salts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left")
    dealt = dealt.withColumn("__salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("__hot", "__salts")
    copies = keyed.join(F.broadcast(hot), F.col("__key").eqNullSafe(F.col("__hot")), "left")
    copies = copies.withColumn("__copy", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__hot", "__salts", "__n")
    return dealt.join(copies, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__copy")), how).drop("__key", "__salt", "__copy")


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges``: (u long, v long), self loops allowed. Returns (node long, root long) for
    every node that has an edge to another node; ``root`` is the smallest node reachable.
    Minima are pre-aggregated before their shuffle and joined back with a hub's rows
    salted (``met``), so its neighbours are never gathered in one task; each round is
    written to the shared folder. The rounds needed grow with the logarithm of the longest chain; a graph
    that hasn't settled after ``max_rounds`` raises instead of returning a part.
    """
    e = stored(
        spark,
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "cc",
    )
    last = None
    for _ in range(max_rounds):
        total = 2 * e.count()
        # large star: the larger neighbours of u move to the smallest of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("__key")).agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("__n"))
        big = met(both.where("v > u"), "u", ["v"], low, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u itself, move to the smallest of them
        low = big.groupBy(F.col("u").alias("__key")).agg(F.min("v").alias("m"), F.count("*").alias("__n"))
        small = met(big, "u", ["v"], low, total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select(F.col("__key").alias("u"), F.col("m").alias("v"))
        )
        e = stored(spark, small.where("u <> v").distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
    raise RuntimeError(f"components haven't settled in {max_rounds} rounds")


def one_of_each(spark: SparkSession, docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` of each class, all its columns: that with the smallest id, null last, then the smallest text hash.

    ``found``: (id long, th long, class long) for every row, th the xxhash64 of the text. Rows are told apart by id and
    text together; of rows equal in both one stays.
    """
    found = stored(spark, found, "classes")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    first = found.groupBy(F.col("class").alias("__key")).agg(F.min(row).alias("first"), F.count("*").alias("__n"))
    lost = met(found, "class", ["id", "th"], first, found.count()).where(row != F.col("first")).select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
    equal = lambda x: docs[id_col].cast("long").eqNullSafe(x["__id"]) & (F.xxhash64(docs[text_col]) == x["__th"])
    again = found.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.count("*").alias("n")).where("n > 1").select("__id", "__th")
    kept = docs.join(lost, equal(lost), "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(again, equal(again), "left_semi")
    once = once.groupBy(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__th")).agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return kept.join(again, equal(again), "left_anti").select(docs.columns).unionByName(once.select("__row.*"))
