"""Near copies by the similarity of their word shingles: fingerprints and minima find pairs, exact Jaccard decides them.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of
0.8 or more; classes are the components of the links. Candidates are texts whose fingerprints
share a deletion-variant signature, and, as those find few pairs at 0.8, texts whose sets
share a band of minima. A set has 128 minima in 32 bands of
four; a pair at 0.8 shares no band with a probability of (1 - 0.8^4)^32 = 5e-8, and less
above. Shingles that no other candidate has bound a set's overlap with any other; sets with
over a fifth of such shingles leave. Sets that share a band are compared whole: first each
with the one before it and the first one of the band's bucket, those of fewest shingles of
their own first; then, of the sets in buckets that still hold several components, the pairs of
different components that prefixes and positions allow (``prefixes``). A large group of near
copies so takes a star and a chain, not all pairs.

Equal sets collapse to one row (by a 64-bit digest) before the bands are joined. Whole sets
are built only for texts that share a band with another.

Edge cases: words are those of ``simhash``; a text of fewer words than a shingle is one
shingle of all its words, a null or empty one or one of white space only is one empty
shingle; repeated rows, null and repeated ids are decided row by row (``one_of_each``); an
empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, lean, met, shingle_hashes, stored

SEED = 42
SHINGLE_WORDS = 5
SIMILAR = (4, 5)  # a Jaccard similarity of 4/5
BANDS, BAND_ROWS = 32, 4
SHINGLES_AT_ONCE = 1 << 11


def shingles(text: str | None, size: int = SHINGLE_WORDS):
    """Sorted distinct 64-bit hashes of the word shingles."""
    import numpy as np

    return np.unique(shingle_hashes(text, size, SEED)[0])


class Sketcher:
    """(digest, size, band keys) of a set."""

    def __init__(self):
        import numpy as np

        draw = np.random.default_rng(SEED)
        self.times = draw.integers(0, 1 << 64, (BANDS * BAND_ROWS, 1), dtype=np.uint64) | np.uint64(1)
        self.plus = draw.integers(0, 1 << 64, (BANDS * BAND_ROWS, 1), dtype=np.uint64)

    def __call__(self, found) -> tuple[int, int, list[int]]:
        import numpy as np
        import xxhash

        least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, dtype=np.uint64)
        for i in range(0, len(found), SHINGLES_AT_ONCE):
            least = np.minimum(least, (self.times * found[i : i + SHINGLES_AT_ONCE] + self.plus).min(axis=1))
        step = BAND_ROWS * 8
        data = least.tobytes()
        keys = [xxhash.xxh64_intdigest(data[i * step : (i + 1) * step], i) for i in range(BANDS)]
        return xxhash.xxh64_intdigest(found.tobytes(), SEED), len(found), keys


def _signed(values):
    import numpy as np

    return np.array(values, dtype=np.uint64).view(np.int64)


def _sketches(bits: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sketch = Sketcher()
        for b in batches:
            out, prints = [], []
            for t in b.column(2):
                hashes, _ = shingle_hashes(t.as_py(), SHINGLE_WORDS, SEED)
                prints.append(bits(hashes))
                out.append(sketch(np.unique(hashes)))
            keys = pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(out) + 1, BANDS), pa.int32()), pa.array(_signed([r[2] for r in out]).reshape(-1)))
            cols = [b.column(0), b.column(1), pa.array(_signed([r[0] for r in out])), pa.array([r[1] for r in out], pa.int64()), pa.array(_signed(prints)), keys]
            yield pa.RecordBatch.from_arrays(cols, ["id", "th", "s", "n", "fp", "keys"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(shingles(t.as_py())) for t in b.column(1)], pa.list_(pa.int64()))], ["s", "all"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets are similar enough. A set of very many pairs is dealt out with them (``met``).

    ``pairs`` is a stored table: it is read once for each side's counts.
    """
    counted = lambda x: stored(pairs.sparkSession, pairs.groupBy(F.col(x).alias("__key")).agg(F.count("*").alias("__n")), "near")
    of_u, of_v, total = counted("u"), counted("v"), pairs.count()
    side = lambda counts, name: counts.join(sets, F.col("__key") == F.col("s")).select("__key", "__n", F.col("all").alias(name))
    both = "size(array_intersect(__a, __b))"
    # both / (a + b - both) >= p / q
    on = f"{both} * {sum(SIMILAR)} >= {SIMILAR[0]} * (size(__a) + size(__b))"
    first = met(pairs, "u", ["v"], side(of_u, "__a"), total, counts=of_u)
    return met(first, "v", ["u"], side(of_v, "__b"), total, counts=of_v).where(on).select("u", "v")


def prefixes(sets: DataFrame) -> DataFrame:
    """(u, v) of ``sets`` (s, all, n, c) of different c that may be similar enough, by prefix and position.

    Shingles are put in order of frequency. Two sets at the similarity share one of the first
    n/5 + 1 of each, and behind their first shared one there is room for the others that
    they share. Frequent shingles are in few prefixes, so few pairs come from a large group.
    """
    low, high = SIMILAR
    each = sets.select("s", "n", "c", F.explode("all").alias("h"))
    often = each.groupBy(F.col("h").alias("__h")).agg(F.count("*").alias("df")).where("df > 1")
    by = each.join(often, F.col("h") == F.col("__h")).groupBy("s").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("by"))
    # shingles of one set alone come first in the order: the others start behind them
    by = by.withColumn("own", F.expr("n - size(by)")).withColumn("left", F.expr(f"n - ceil(n * {low} / {high}) + 1 - own")).where("left > 0")
    first = by.select("s", "n", "c", "own", F.posexplode(F.expr("slice(by, 1, CAST(left AS INT))"))).select("s", "n", "c", (F.col("own") + F.col("pos")).alias("p"), F.col("col.h").alias("h"))
    a, b = first.alias("a"), first.alias("b")
    on = f"a.h = b.h AND a.c < b.c AND least(a.n - a.p, b.n - b.p) * {low + high} >= {low} * (a.n + b.n)"
    return a.join(b, F.expr(on)).select(F.least("a.s", "b.s").alias("u"), F.greatest("a.s", "b.s").alias("v")).distinct()


def classes(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, bits: Callable, placed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id long, th long, class long) for every row; th is the xxhash64 of the text, class names the component.

    ``bits`` makes a fingerprint of shingle hashes, ``placed`` finds fingerprints next to each other under a signature.
    """
    bounded_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    rows = stored(spark, slim.mapInArrow(lean(_sketches(bits)), "id long, th long, s long, n long, fp long, keys array<long>"), "near")
    own = rows.groupBy("s").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("rows"))
    own = stored(spark, own, "near")
    # by signatures: one set of each fingerprint beside one of the next, and of the same fingerprint each beside the first
    first = own.groupBy("fp").agg(F.min("s").alias("s"), F.min("th").alias("th"))
    beside = placed(own).where("before IS NOT NULL").select("fp", "before").distinct()
    beside = beside.join(first, "fp").join(first.select(F.col("fp").alias("before"), F.col("s").alias("s0"), F.col("th").alias("th0")), "before")
    same = own.select("fp", "s", "th").join(first.select("fp", F.col("s").alias("s0"), F.col("th").alias("th0")), "fp").where("s <> s0")
    signed = stored(spark, beside.select("s", "th", "s0", "th0").unionByName(same.select("s", "th", "s0", "th0")), "near")
    # sets that share a band with another
    members = own.select("s", "th", "n", F.explode("keys").alias("key"))
    at = Window.partitionBy("key").orderBy("s")
    sharing = members.withColumn("before", F.lag("s").over(at)).withColumn("after", F.lead("s").over(at)).where("before IS NOT NULL OR after IS NOT NULL")
    sharing = stored(spark, sharing.select("s", "th", "n", "key"), "near")
    wanted = sharing.select("s", "th").unionByName(signed.select("s", "th")).unionByName(signed.select(F.col("s0").alias("s"), F.col("th0").alias("th")))
    wanted = wanted.groupBy("th").agg(F.first("s").alias("s")).join(own.select("s", "rows"), "s")
    # a text has no more rows than its set; copies meet the one that is wanted where they are, and collapse before the shuffle
    wanted = wanted.select(F.col("th").alias("__key"), F.col("rows").alias("__n"), "s")
    texts = met(slim, "th", ["id"], wanted, rows.count()).select("s", "text").dropDuplicates(["s"])
    sets = stored(spark, texts.mapInArrow(lean(_sets), "s long, all array<long>"), "near")
    # shingles that no other candidate has can't be shared: m is what is left, and bounds every overlap
    alone = sets.select("s", F.explode("all").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("s").alias("s")).where("c = 1")
    alone = alone.groupBy("s").agg(F.count("*").alias("u"))
    low, high = SIMILAR
    sharing = sharing.join(alone, "s", "left").withColumn("m", F.expr("n - coalesce(u, 0)")).where(f"m * {high} >= n * {low}").select("s", "n", "m", "key")

    # each set beside the one before it and the first one of its bucket, those of fewest shingles of their own first
    at = Window.partitionBy("key").orderBy(F.expr("n - m"), "n", "s")
    sharing = sharing.withColumn("ahead", F.array_distinct(F.array(F.lag("s").over(at), F.first("s").over(at))))
    sharing = stored(spark, sharing, "near")
    pair = lambda x, y: [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]
    chain = sharing.select("s", F.explode("ahead").alias("t")).where("t <> s").select(*pair("t", "s")).unionByName(signed.select(*pair("s", "s0"))).distinct()
    chain = stored(spark, chain, "near")
    linked = connected_components(spark, similar(chain, sets))
    named = sharing.join(linked, sharing["s"] == linked["node"], "left").select("s", "n", "key", F.coalesce("root", "s").alias("c"))
    mixed = named.groupBy(F.col("key").alias("__key")).agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("__n")).where("c0 < c1").drop("c0", "c1")
    named = stored(spark, met(named, "key", ["s"], mixed, sharing.count()).groupBy("s").agg(F.first("n").alias("n"), F.first("c").alias("c")), "near")
    across = stored(spark, prefixes(sets.join(named, "s")).join(chain, ["u", "v"], "left_anti"), "near")
    more = stored(spark, similar(across, sets), "near")
    if not more.isEmpty():
        linked = connected_components(spark, linked.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    of = own.select("s", "rows").join(linked, own["s"] == linked["node"], "left")
    of = of.select(F.col("s").alias("__key"), F.col("rows").alias("__n"), F.coalesce("root", "s").alias("class"))
    return met(rows, "s", ["id", "th"], of, rows.count()).select("id", "th", "class")
