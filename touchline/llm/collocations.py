"""Phrase collocation mining: candidates from a sketch, exact counts by Aho-Corasick automata.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and
tabs into words. Phrases are runs of words of one piece, counted for each language.

1. Sketch. Every phrase of up to ``longest`` words is hashed to one of 2^36 cells, and the cells
   that occur are counted over all texts: a cell's count is an upper bound of that of each
   phrase in it. Tasks send sorted cells with their counts, packed, to the block that a cell is
   in; a block's cells that reach the least count become bits of a map of 2^20 to 2^30 bits
   (growing with the input up to 128 MB, the bound of what is broadcast, packed).
2. Candidates and counts. The corpus is read again in shards (slabs of some megabytes). The
   phrases of a shard whose bit is set are its candidates. They are compiled into an
   automaton, each between two spaces, and the shard, its words between single spaces, its
   pieces parted by a line feed, is scanned for all matches, overlapping ones included. A phrase
   that is frequent has its bit set in every shard that holds it, so the sum over the shards is
   its exact count; a bit set by other phrases costs time and no correctness.
3. Sums, thresholds and scores are DataFrame operations on the frequent phrases.

Memory: a shard's arrays and automaton, the map, and a block's cells. Texts longer than a shard
are cut between pieces, which no phrase crosses.

Words in a shard are told apart by themselves and not by hashes, so results are exact.

Edge cases: null texts are empty; a null language is ``und``; repeated rows count each; a text
of delimiters only has no words; one piece longer than a shard is a shard of its own; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, bounded_batches, lean, met, parts_for, stored

LONGEST, LEAST, TOP, SUBSUMED = 4, 30, 2000, 80
CELL_BITS, MAP_BITS = 36, 30
SLAB = 4 << 20
MERGE = 1 << 23
DELIMITERS, BREAK = b".,;:!?\n\x0b\x0c\r", b"\xff"  # the break is no byte of UTF-8


def _table() -> bytes:
    out = bytearray(range(256))
    for c in range(65, 91):
        out[c] = c + 32
    for c in DELIMITERS:
        out[c] = BREAK[0]
    out[9] = 32
    return bytes(out)


TABLE = _table()


def slabs(batches: Iterator[pa.RecordBatch], size: int = SLAB) -> Iterator[dict[str, list[bytes]]]:
    """Texts of (lang, text) by language, translated, about ``size`` bytes at a time; a longer text in parts that end with a piece."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            if not text.is_valid:
                continue
            data, at = text.as_buffer().to_pybytes().translate(TABLE), 0
            while at < len(data):
                end = len(data)
                if end - at > size:
                    end = data.rfind(BREAK, at + 1, at + size)
                    end = data.find(BREAK, at + size) if end < 0 else end
                    end = len(data) if end < 0 else end
                held.setdefault(lang, []).append(data[at:end])
                total += end - at
                at = end + 1
                if total >= size:
                    yield held
                    held, total = {}, 0
    if held:
        yield held


class Vocabulary(dict):
    """Numbers of words in order of appearance; 0 is the break."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Words of the texts of one language: tokens, their numbers, and 64-bit hashes of phrases."""

    def __init__(self, lang: str, texts: list[bytes]):
        import numpy as np
        import xxhash

        data = (BREAK.join(texts)).replace(BREAK, b" " + BREAK + b" ")
        self.tokens = data.split()  # on spaces only: all other white space was a delimiter
        vocabulary = Vocabulary({BREAK: 0})
        self.ids = np.fromiter(map(vocabulary.__getitem__, self.tokens), dtype=np.int64, count=len(self.tokens))
        self.words = list(vocabulary)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), dtype=np.uint64, count=len(self.words))
        self.hashes = hashes[self.ids]
        self.lang = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8"), 1))

    def cells(self, longest: int) -> Iterator[tuple[int, object, object]]:
        """(words, starts, cells) of the phrases of one word, two words and so on."""
        import numpy as np

        whole = self.ids != 0
        h, good = self.hashes, whole
        for k in range(1, longest + 1):
            if k > 1:
                h = _mixed(h[:-1]) + self.hashes[k - 1 :]
                good = good[:-1] & whole[k - 1 :]
            at = np.flatnonzero(good)
            yield k, at, _mixed(h[at] ^ (self.lang + np.uint64(k))) >> np.uint64(64 - CELL_BITS)

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join(self.tokens[at : at + k])


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def packed(values) -> bytes:
    """Small unsigned integers, byte by byte of each next to each other, compressed."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _sketched(longest: int, block_bits: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        width = np.uint64(CELL_BITS - block_bits)
        for slab in slabs(batches, size):
            all_cells = [c for lang, texts in slab.items() for _, _, c in Shard(lang, texts).cells(longest)]
            cells, counts = np.unique(np.concatenate(all_cells), return_counts=True)
            del all_cells
            blocks = (cells >> width).astype(np.int64)
            begin = np.flatnonzero(np.diff(blocks, prepend=-1)).tolist()
            inside = (cells & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
            rows = [(int(blocks[s]), packed(np.diff(inside[s:e], prepend=0)), packed(counts[s:e])) for s, e in zip(begin, [*begin[1:], len(cells)])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _SKETCH)] if rows else [pa.array([], k) for k in _SKETCH], ["block", "cells", "counts"])

    return run


_SKETCH = [pa.int32(), pa.binary(), pa.binary()]


def _summed(cells, counts):
    """Distinct cells in order and their counts."""
    import numpy as np

    by = np.argsort(cells, kind="stable")
    cells, counts = cells[by], counts[by]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[first], np.add.reduceat(counts, first) if len(first) else counts


def _mapped(least: int, block_bits: int, map_bits: int):
    """Segments of the map, compressed; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        def segment():
            cells, counts = _summed(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
            bits = np.zeros(1 << (map_bits - block_bits), dtype=np.uint8)
            bits[cells[counts >= least] >> (CELL_BITS - map_bits)] = 1
            data = zstandard.ZstdCompressor(level=3).compress(np.packbits(bits).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([data], pa.binary())], ["block", "segment"])

        held, last, size = [], None, 0
        for b in batches:
            for block, cells, counts in zip(*(c.to_pylist() for c in b.columns)):
                if held and block != last:
                    yield segment()
                    held, size = [], 0
                held.append((np.cumsum(unpacked(cells).astype(np.int64)), unpacked(counts).astype(np.int64)))
                size, last = size + len(held[-1][0]), block
                if size > MERGE and len(held) > 1:
                    held = [_summed(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))]
                    size = 0  # counted anew: distinct cells alone are what a block holds
        if held:
            yield segment()

    return run


class Map:
    """Bits of cells, unpacked once a worker process."""

    kept: dict = {}

    def __init__(self, segments: dict[int, bytes], block_bits: int, map_bits: int):
        import numpy as np
        import zstandard

        self.shift, each = CELL_BITS - map_bits, 1 << (map_bits - block_bits - 3)
        self.bits = np.zeros(1 << (map_bits - 3), dtype=np.uint8)
        for block, data in segments.items():
            self.bits[block * each : (block + 1) * each] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)

    def __call__(self, cells):
        import numpy as np

        at = cells >> np.uint64(self.shift)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) != 0

    @classmethod
    def of(cls, shared, block_bits: int, map_bits: int) -> Map:
        if shared.value["name"] not in cls.kept:
            cls.kept = {shared.value["name"]: cls(shared.value["segments"], block_bits, map_bits)}
        return cls.kept[shared.value["name"]]


def candidates(shard: Shard, hot: Map, longest: int) -> tuple[set[bytes], object]:
    """The phrases of two words or more whose bits are set, and the numbers of words whose bits are."""
    import numpy as np

    out: set[bytes] = set()
    words = np.zeros(0, dtype=np.int64)
    for k, at, cells in shard.cells(longest):
        mine = hot(cells)
        at, cells = at[mine], cells[mine]
        if k == 1:
            words = np.unique(shard.ids[at])
            continue
        _, first, of = np.unique(cells, return_index=True, return_inverse=True)
        out.update(shard.phrase(p, k) for p in at[first].tolist())
        # phrases that share a cell with the first one in it
        other = np.zeros(len(at), dtype=bool)
        for j in range(k):
            other |= shard.ids[at + j] != shard.ids[at[first[of]] + j]
        out.update(shard.phrase(p, k) for p in at[other].tolist())
    return out, words


def matches(shard: Shard, phrases: list[bytes]) -> list[int]:
    """How often each phrase occurs in the shard, by one automaton of all of them."""
    import ahocorasick
    import numpy as np

    if not phrases:
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        automaton.add_word(f" {p.decode('utf-8')} ", i)
    automaton.make_automaton()
    text = (b" " + b" ".join(shard.tokens).replace(BREAK, b"\n") + b" ").decode("utf-8")
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), dtype=np.int64), minlength=len(phrases)).tolist()


_COUNTS = [pa.string(), pa.string(), pa.int32(), pa.int64()]


def _counted(shared, block_bits: int, map_bits: int, longest: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hot = None
        for slab in slabs(batches, size):
            hot = hot or Map.of(shared, block_bits, map_bits)
            for lang, texts in slab.items():
                shard = Shard(lang, texts)
                found, words = candidates(shard, hot, longest)
                phrases = sorted(found)
                counts = np.bincount(shard.ids, minlength=len(shard.words))
                names = [p.decode("utf-8") for p in phrases] + [shard.words[w].decode("utf-8") for w in words.tolist()] + [""]
                sizes = [p.count(b" ") + 1 for p in phrases] + [1] * len(words) + [0]
                n = [*matches(shard, phrases), *counts[words].tolist(), int((shard.ids != 0).sum())]
                cols = [[lang] * len(n), names, sizes, n]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _COUNTS)], ["lang", "phrase", "k", "n"])

    return run


def frequent(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, slab: int = SLAB,
    map_bits: int | None = None,
) -> DataFrame:
    """(lang, phrase, k words, f) of every phrase of up to ``longest`` words that occurs ``least`` times or more; and per lang k 0 with the words in all."""
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bits = min(16, max(6, math.ceil(math.log2(size / (4 << 20) + 1))))
    map_bits = max(block_bits + 3, map_bits or min(MAP_BITS, max(20, math.ceil(math.log2(size / 8 + 1)))))
    sketch = rows.mapInArrow(lean(_sketched(longest, block_bits, slab)), "block int, cells binary, counts binary")
    dealt = sketch.repartition(parts_for(spark), "block").sortWithinPartitions("block")
    segments = dealt.mapInArrow(lean(_mapped(least, block_bits, map_bits)), "block int, segment binary")
    # 2^map_bits bits at most, packed
    found = {r.block: bytes(r.segment) for r in segments.collect()}
    shared = spark.sparkContext.broadcast({"name": f"{id(docs)}-{size}-{len(found)}-{hash(tuple(sorted(found.items())))}", "segments": found})
    counts = rows.mapInArrow(lean(_counted(shared, block_bits, map_bits, longest, slab)), "lang string, phrase string, k int, n long")
    counts = counts.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).where(f"k = 0 OR f >= {least}")
    return stored(spark, counts, "collocations")


def collocations(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP,
    subsumed: int = SUBSUMED, **kw,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the ``top`` phrases of each language by their lowest-scoring cut."""
    counts = frequent(spark, docs, text_col, lang_col, longest, least, **kw)
    mine = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # both parts of every cut; a part of a frequent phrase is frequent, so its count is there
    cuts = mine.select("lang", "phrase", "a", "w", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    halves = "array(struct(0 AS side, array_join(slice(w, 1, cut), ' ') AS part), struct(1 AS side, array_join(slice(w, cut + 1, k - cut), ' ') AS part))"
    halves = cuts.select("lang", "phrase", "a", "cut", F.explode(F.expr(halves)).alias("h"))
    halves = stored(spark, halves.select("lang", "phrase", "a", "cut", "h.side", F.struct("lang", "h.part").alias("at")), "collocations")
    # "of" may be a part of a third of all phrases: such keys are dealt out
    often = halves.groupBy("at").agg(F.count("*").alias("__n"))
    keyed = counts.where("k >= 1").select(F.struct("lang", F.col("phrase").alias("part")).alias("at"), "f").join(often, "at").withColumnRenamed("at", "__key")
    parts = met(halves, "at", ["phrase", "cut"], keyed, halves.count())
    parts = parts.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.expr("CASE WHEN side = 0 THEN f END")).alias("l"), F.max(F.expr("CASE WHEN side = 1 THEN f END")).alias("r"))
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(38,0)) * a div (CAST(l AS DECIMAL(38,0)) + r) AS BIGINT)")
    scored = parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    # words of a longer candidate that is nearly as frequent
    inner = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(w, s, m), ' '))))"
    longer = mine.where("k >= 3").select("lang", F.explode(F.expr(inner)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR CAST(100 AS DECIMAL(38,0)) * longer < CAST({subsumed} AS DECIMAL(38,0)) * a"
    )
    order = [F.col("c.score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each of SALTS parts of a language, then of those
    left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = F.broadcast(counts.where("k = 0").select("lang", F.col("f").alias("n"))) if counts.where("k = 0").count() <= 100_000 else counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return left.join(words, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score", F.col("c.cut").alias("cut"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cut")


ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS txt FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(txt, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
e AS (SELECT lang, row_number() OVER () AS pid, ws FROM w),
i AS (SELECT lang, pid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM e),
o AS (SELECT lang, w, lead(w) OVER v AS w2, lead(w, 2) OVER v AS w3, lead(w, 3) OVER v AS w4 FROM i WINDOW v AS (PARTITION BY pid ORDER BY i)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, 1 AS k, w AS phrase FROM o UNION ALL SELECT lang, 2, w || ' ' || w2 FROM o UNION ALL
        SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM o UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM o)
      WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
h AS MATERIALIZED (SELECT c.*, j, array_to_string(ws[1 : j], ' ') AS p1, array_to_string(ws[j + 1 : c.k], ' ') AS p2 FROM c, range(1, 4) t(j) WHERE j < c.k),
u AS (SELECT h.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score FROM h
      JOIN f x ON x.lang = h.lang AND x.phrase = h.p1 JOIN f y ON y.lang = h.lang AND y.phrase = h.p2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS q FROM u) WHERE q = 1),
s AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
        SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) t(m) WHERE m < k) GROUP BY ALL),
z AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN s ON b.lang = s.lang AND b.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 80 * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM z JOIN n USING (lang) WHERE rank <= 2000"""
