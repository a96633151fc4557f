"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ
in at most three bits differ in at most one bit in one of the segments, so they agree
in that segment once the differing bit is a wildcard. Each distinct fingerprint is
indexed under its 64 one-wildcard segment variants, equality of variants finds the
candidates, and their whole distance is verified (``grouped`` for classes, ``links`` for
all pairs).

``keep_similar`` decides by the similarity of five-word shingles instead of three bits. Three
bits find few of the pairs at 0.8 (about ten bits differ there), and signatures for ten bits
would be a thousand rows a text, so the signatures' candidates are completed by ``neardup``.

Copies (equal fingerprints) collapse to one row before the join; rows rejoin their
fingerprint at the end. Plan: one Python pass over the texts, then JVM joins on longs.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero and
is linked like any other; fewer words than a shingle give one shingle of all words;
a null ``id`` never becomes a class id unless all rows of the class have none; repeated
rows are rows of one class, of which ``keep_first`` keeps one; an empty table gives an
empty result; extra columns are ignored by ``components`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import neardup
from .common import bounded_batches, connected_components, lean, met, one_of_each, parts_for, shingle_hashes, stored

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
BITS_AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash over the word shingles, repeats included."""
    hashes, words = shingle_hashes(text, shingle, SEED)
    return majority(hashes) if words else 0


def majority(h) -> int:
    """The number whose bits are those set in over half of the hashes."""
    import numpy as np

    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), BITS_AT_ONCE):
        part = h[i : i + BITS_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            signed = pa.array([p - (1 << 64) if p >> 63 else p for p in prints], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), signed], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id long, fp long): the signed fingerprint of every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lean(_fingerprints(shingle)), "id long, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """(fp, key) of each distinct fingerprint, 64 rows: segment number, wildcard position and the segment without that bit in one long."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(F.col("fp"), 32)
    keys = []
    for seg, value in ((0, low), (1, high)):
        for p in range(32):
            keep = 0xFFFFFFFF & ~(1 << p)
            keys.append(value.bitwiseAND(F.lit(keep)).bitwiseOR(F.lit((seg * 32 + p) << 32)))
    # dealt out first: 64 times the rows aren't made in the few tasks that slim fingerprints fit
    dealt = prints.select("fp").distinct().repartition(parts_for(prints.sparkSession), "fp")
    return dealt.select("fp", F.explode(F.array(*keys)).alias("key"))


def placed(prints: DataFrame) -> DataFrame:
    """(key, fp, before) of fingerprints that share a variant key with another; ``before`` is the next smaller one there."""
    at = Window.partitionBy("key").orderBy("fp")
    out = variants(prints).withColumn("before", F.lag("fp").over(at)).withColumn("after", F.lead("fp").over(at))
    return out.where("before IS NOT NULL OR after IS NOT NULL").drop("after")


def grouped(spark: SparkSession, prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node long, root long) of every fingerprint linked to another by ``max_bits`` (3 at most) differing bits or fewer.

    A group of n near copies gives n links, not all pairs: within a variant key first each
    fingerprint and the next smaller one are compared; then only pairs of different
    components are, in the keys that still hold several.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard find 3 differing bits at most")
    near = stored(spark, placed(prints), "simhash")
    chain = near.where(f"bit_count(fp ^ before) <= {max_bits}").select(F.col("before").alias("u"), F.col("fp").alias("v"))
    linked = connected_components(spark, chain)
    named = near.join(linked, near["fp"] == linked["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("c"))
    several = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    named = stored(spark, named.join(several, "key"), "simhash")
    a, b = named.alias("a"), named.alias("b")
    across = a.join(b, F.expr(f"a.key = b.key AND a.c < b.c AND bit_count(a.fp ^ b.fp) <= {max_bits}"))
    across = stored(spark, across.select(F.col("a.c").alias("u"), F.col("b.c").alias("v")).distinct(), "simhash")
    if across.isEmpty():
        return linked
    return connected_components(spark, linked.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(across))


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u long, v long): each pair of distinct fingerprints at 1 to ``max_bits`` (3 at most) differing bits, once.

    All pairs are listed, for callers that want them; classes come from ``grouped``. A pair is
    reported at the low segment when that differs in at most one bit, else at the high one,
    and at the differing position, or 0 if the segment is equal.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard find 3 differing bits at most")
    keyed = variants(prints)
    a, b = keyed.alias("a"), keyed.alias("b")
    diff = "(a.fp ^ b.fp)"
    low_bits, high_bits = f"({diff} & 4294967295)", f"shiftrightunsigned({diff}, 32)"
    place = "shiftright(a.key, 32)"
    bit = "(CASE WHEN {x} = 0 THEN 0 ELSE bit_count({x} - 1) END)"  # position of a single bit
    one_place = (
        f"CASE WHEN bit_count({low_bits}) <= 1 THEN {place} = {bit.format(x=low_bits)} "
        f"ELSE {place} = 32 + {bit.format(x=high_bits)} END"
    )
    on = F.expr(f"a.key = b.key AND a.fp < b.fp AND bit_count({diff}) <= {max_bits} AND {one_place}")
    return a.join(b, on).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def components(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """(id long, fp long, class_id long) for every row; class_id: smallest id reachable over links, itself included."""
    bounded_batches(spark)
    rows = stored(spark, fingerprints(docs, id_col, text_col, shingle), "simhash")
    own = rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("__n"))
    roots = grouped(spark, own, max_bits)
    named = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "first", "__n", F.coalesce("root", "fp").alias("root"))
    named = stored(spark, named, "simhash")
    # equal fingerprints and large classes may hold a third of all rows: both joins deal such keys out
    least = named.groupBy(F.col("root").alias("__key")).agg(F.min("first").alias("class_id"), F.count("*").alias("__n"))
    by_print = met(named.withColumnRenamed("__n", "n"), "root", ["fp"], least, named.count()).select(F.col("fp").alias("__key"), F.col("n").alias("__n"), "class_id")
    return met(rows, "fp", ["id"], by_print, rows.count()).select("id", "fp", "class_id")


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of each class, that with the smallest id, all its columns; decided row by row, with or without an id (``one_of_each``)."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    of = components(spark, slim, "th", "text", **kw).select(F.col("id").alias("th"), F.col("class_id").alias("class")).distinct()
    return one_of_each(spark, docs, slim.select("id", "th").join(of, "th"), id_col, text_col)


def keep_similar(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles, chosen as in ``keep_first``."""
    return one_of_each(spark, docs, neardup.classes(spark, docs, id_col, text_col, majority, placed), id_col, text_col)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class_id").alias("component_id")
    )
