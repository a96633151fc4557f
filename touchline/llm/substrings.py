"""Suffix-array dedup of repeated byte strings.

A byte goes if a string of ``span`` (200) bytes that covers it also starts elsewhere
(``keep="none"``) or starts earlier (``keep="first"``: later copies go, the first stays).

Every window of ``span`` bytes names an anchor, its leftmost smallest 32-byte gram by
hash. Equal windows name equal anchors, so only windows of one anchor need comparing.
Consecutive windows with one anchor form a block. Blocks that occur twice as a whole are
repeated whole, which settles most copies on slim rows (anchor, block digest, place).
Where an anchor has several different blocks, one of each is fetched, and the blocks of
an anchor are compared together: a suffix array of their concatenation by prefix doubling,
common prefixes of neighbours, and from the nearest smaller positions before and behind
each place the longest previous factor of every position and where it is. A position whose
factor has ``span`` bytes is a later copy, and the position of that factor a first one.
Anchors with over ``HOT_BLOCKS`` different blocks are compared by window digests instead,
counted with pre-aggregation, so no anchor fills a task.

Bytes are UTF-8; windows never cross documents. Digests are cryptographic, of 128 bits, for
blocks, beside the 64-bit anchor, and of 128 bits for windows of hot anchors. Blocks are
written once; texts are shuffled compressed.

Edge cases: null texts are empty; shorter texts than ``span`` stay whole; rows equal in
id and text are copies of each other; a null id is an id like any other, and texts of one id
are told apart by 128 bits of id and text; very long texts
are cut into overlapping segments for hashing only; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, met, parts_for, stored

SPAN, GRAM = 200, 32
HOT_BLOCKS = 4000
#: Bytes of blocks that one task puts in suffix order together.
ORDER_BYTES = 1 << 20
SEGMENT = 1 << 22
POSITION = (1 << 24) - 1


def anchors(data: bytes, span: int = SPAN):
    """(window start of each block, window end inclusive, anchor hash) arrays of a text of at least ``span`` bytes."""
    import numpy as np

    out = []
    for base in range(0, len(data) - span + 1, SEGMENT):
        part = data[base : base + SEGMENT + span - 1]
        n = len(part) - GRAM + 1
        word = np.ndarray((len(part) - 7,), dtype="<u8", buffer=part, strides=(1,))
        h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
        for i, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
            h ^= h >> np.uint64(32)
            h += word[i : i + n] * np.uint64(odd)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        width, count = span - GRAM + 1, len(part) - span + 1
        packed = (h & ~np.uint64(POSITION)) | np.arange(n, dtype=np.uint64)
        rows = -(-n // width)
        grid = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        grid[:n] = packed
        grid = grid.reshape(rows, width)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(after[:count], before[width - 1 : width - 1 + count]) & np.uint64(POSITION)).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(place)) + 1)
        last = np.append(first[1:] - 1, count - 1)
        out.append((first + base, last + base, h[place[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _blocks(span: int, ordered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
        names = ["id", "row", "a", "size", "cover", "n", "anchor", "block"]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            cols: list[list] = [[] for _ in names]

            def pack():
                out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
                for c in cols:
                    c.clear()
                return out

            for i, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) < span:
                    continue
                starts, ends, hashes = (x.tolist() for x in anchors(data, span))
                row, prior = None, None
                for s, e, h in zip(starts, ends, hashes):
                    d = digest(data[s : e + span])
                    if (d, h) == prior:  # a period: the same block again, right behind
                        row[4], row[5] = e + span - row[2], row[5] + 1
                        continue
                    if row:
                        for c, x in zip(cols, row):
                            c.append(x)
                    row, prior = [i if ordered else None, own, s, e + span - s, e + span - s, 1, h, d], (d, h)
                for c, x in zip(cols, row):
                    c.append(x)
                if len(cols[0]) > 20_000:
                    yield pack()
            if cols[0]:
                yield pack()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    coder = zstandard.ZstdCompressor(level=1)
    for b in batches:
        z = [coder.compress(t.as_buffer() if t.is_valid else b"") for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], ["id", "row", "z"])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted block of each document."""
    import zstandard

    coder = zstandard.ZstdDecompressor()
    names = ["anchor", "block", "n", "id", "row", "a", "hot", "data"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary()]
    for b in batches:
        rows = []
        for i, own, z, want in zip(*(b.column(k).to_pylist() for k in range(4))):
            data = coder.decompress(z)
            rows += [(w["anchor"], w["block"], w["n"], i, own, w["a"], w["hot"], data[w["a"] : w["a"] + w["size"]]) for w in want]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def suffixes(data, cut, depth: int):
    """Suffix array of ``data`` by its first ``depth`` bytes or more, ties by position, and the ranks of each doubling.

    ``cut``: for each position the bytes left in its block; a suffix ends there, and what
    follows it sorts as nothing.
    """
    import numpy as np

    n = len(data)
    padded = np.append(data, np.zeros(8, dtype=np.uint8)).astype(np.uint64)
    word = np.zeros(n, dtype=np.uint64)
    for i in range(7):  # seven bytes, and how many of them are there
        word = word << np.uint64(8) | np.where(cut > i, padded[i : i + n], np.uint64(0))
    word = word << np.uint64(8) | np.minimum(cut, 7).astype(np.uint64)
    rank, tied = np.zeros(n, dtype=np.int64), np.arange(n)
    ranks, k, key = [], 7, word
    while True:
        # suffixes whose rank isn't theirs alone, put in order by it and by what follows; a rank is the number of smaller suffixes
        by = np.argsort(key, kind="stable")
        here, key, old = tied[by], key[by], rank[tied[by]]
        fresh = np.append(True, (key[1:] != key[:-1]) | (old[1:] != old[:-1]))[: len(here)]
        group = np.append(True, old[1:] != old[:-1])[: len(here)]
        place = np.arange(len(here))
        rank = rank.copy()
        rank[here] = old + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        tied = here[~(fresh & np.append(fresh[1:], True)[: len(here)])]
        ranks.append((k, rank))
        if k >= depth or not len(tied):
            return np.argsort(rank, kind="stable"), ranks
        behind = np.minimum(tied + k, n - 1)
        key = rank[tied] * (n + 2) + np.where(cut[tied] > k, rank[behind] + 1, 0)
        k *= 2


def common(i, j, data, cut, ranks, span: int):
    """Length of the longest common prefix of the suffixes at ``i`` and ``j``, in whole steps of the first rank but exact just below ``span``."""
    import numpy as np

    i, j, left = i.copy(), j.copy(), np.minimum(cut[i], cut[j])
    length, n = np.zeros(len(i), dtype=np.int64), len(cut)
    for k, rank in reversed(ranks):
        same = (left >= k) & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        step = np.where(same, k, 0)
        length, i, j, left = length + step, i + step, j + step, left - step
    near = np.flatnonzero((length < span) & (length + ranks[0][0] > span))
    for _ in range(ranks[0][0] - 1):
        near = near[left[near] > 0]
        near = near[data[i[near]] == data[j[near]]]
        length[near] += 1
        i[near] += 1
        j[near] += 1
        left[near] -= 1
    return length


def nearest_smaller(order, lcp, span: int):
    """For each place of the suffix array: the place before it of the nearest smaller position and the least lcp on the way (-1 and 0 if under ``span``).

    Pointers jump over places with larger positions, all at once; each round doubles what a pointer has behind it.
    """
    import numpy as np

    to = np.where(lcp >= span, np.arange(len(order)) - 1, -1)
    least = lcp.copy()
    active = np.flatnonzero(to >= 0)
    active = active[order[to[active]] > order[active]]
    while len(active):
        over = to[active]
        reach = np.minimum(least[active], least[over])
        to[active], least[active] = to[over], reach
        active = active[to[active] >= 0]
        active = active[order[to[active]] > order[active]]
    least[(to < 0)] = 0
    return to, least


def previous_factors(blocks: list[bytes], span: int = SPAN):
    """Longest previous factors of the blocks' concatenation: (block of each position, place in it, lpf, an earlier position that has it or -1).

    Factors end with their block; those under ``span`` bytes aren't looked for (0). In suffix order the longest earlier match of a
    position is at the nearest place before or behind it with a smaller position.
    """
    import numpy as np

    data = np.frombuffer(b"".join(blocks), dtype=np.uint8)
    sizes = np.array([len(b) for b in blocks], dtype=np.int64)
    owner = np.repeat(np.arange(len(blocks)), sizes)
    at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cut = sizes[owner] - at
    order, ranks = suffixes(data, cut, span)
    lcp = np.zeros(len(order) + 1, dtype=np.int64)
    lcp[1:-1] = common(order[1:], order[:-1], data, cut, ranks, span)
    up, up_lcp = nearest_smaller(order, lcp[:-1], span)
    down, down_lcp = nearest_smaller(order[::-1], lcp[::-1][:-1], span)
    down, down_lcp = np.where(down[::-1] >= 0, len(order) - 1 - down[::-1], -1), down_lcp[::-1]
    best = np.where(up_lcp >= down_lcp, up, down)
    lpf, source = np.zeros(len(order), dtype=np.int64), np.full(len(order), -1, dtype=np.int64)
    lpf[order] = np.maximum(up_lcp, down_lcp)
    source[order] = np.where(best >= 0, order[np.maximum(best, 0)], -1)
    return owner, at, lpf, source


def repeats(blocks: list[bytes], span: int = SPAN):
    """For each position of the blocks (in text order): (block number, place in it, has an earlier equal window, is the earlier one of another)."""
    import numpy as np

    owner, at, lpf, source = previous_factors(blocks, span)
    later = lpf >= span
    first = np.zeros(len(at), dtype=bool)
    first[source[later]] = True
    return owner, at, later, first


def _runs(owner, at, flag) -> dict[int, list[dict]]:
    """Maximal runs of flagged window starts per block."""
    import numpy as np

    pick = np.flatnonzero(flag)
    if not len(pick):
        return {}
    o, p = owner[pick], at[pick]
    cut = np.append(0, np.flatnonzero((np.diff(o) != 0) | (np.diff(p) != 1)) + 1)
    end = np.append(cut[1:] - 1, len(pick) - 1)
    out: dict[int, list[dict]] = {}
    for b, s, e in zip(o[cut].tolist(), p[cut].tolist(), p[end].tolist()):
        out.setdefault(b, []).append({"s": s, "e": e})
    return out


RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _ordered(span: int, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def resolved():
            held.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[4]))
            owner, at, later, first = repeats([r[5] for r in held], span)
            found = _runs(owner, at, later if keep == "first" else later | first)
            rows = [(held[b][0], held[b][1], runs) for b, runs in found.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], RUNS)],
                ["anchor", "block", "runs"],
            )

        # rows come sorted by anchor, and the blocks of one anchor are never parted
        last = None
        for b in batches:
            for anchor, block, i, own, a, data in zip(*(b.column(k).to_pylist() for k in range(6))):
                if size > ORDER_BYTES and anchor != last:
                    yield resolved()
                    held, size = [], 0
                held.append((anchor, block, i, own, a, data))
                size, last = size + len(data), anchor
        if held:
            yield resolved()

    return run


def _windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = ["anchor", "block", "id", "row", "a", "s", "w1", "w2"]
        for b in batches:
            rows = []
            for anchor, block, i, own, a, data in zip(*(b.column(k).to_pylist() for k in range(6))):
                for s in range(len(data) - span + 1):
                    d = xxhash.xxh3_128_digest(data[s : s + span])
                    rows.append((anchor, block, i, own, a, s, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each document's spans and hash what is left."""
    import zstandard

    coder = zstandard.ZstdDecompressor()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    for b in batches:
        rows = []
        for i, z, spans in zip(*(b.column(k).to_pylist() for k in range(3))):
            data = coder.decompress(z)
            merged: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            kept, at = [], 0
            for s, e in merged:
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            rest = b"".join(kept)
            rows.append((i, len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest, [{"start": s, "end": e} for s, e in merged]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def removed(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, keep: str = "none",
    hot_blocks: int = HOT_BLOCKS,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, spans) of every row of ``docs``."""
    if keep not in ("none", "first") or span < 64:
        raise ValueError("keep is 'none' or 'first', span at least 64")
    bounded_batches(spark)
    text = F.col(text_col).cast("string")
    whole = F.coalesce(text, F.lit(""))
    # 128 bits of id and text tell rows apart; rows equal in both are told apart by nothing and have the same result
    name = F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), F.lit("\n"), whole))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(name).alias("row"), text.alias("text"))
    block_schema = "id long, row binary, a int, size int, cover int, n long, anchor long, block binary"
    blocks = stored(spark, rows.mapInArrow(lean(_blocks(span, keep == "first")), block_schema), "substrings")
    packed = rows.mapInArrow(lean(_packed), "id long, row binary, z binary")
    # one row per different block: occurrences and the first place
    different = blocks.groupBy("anchor", "block").agg(F.sum("n").alias("n"), F.min(F.struct("id", "row", "a")).alias("at"), F.max("size").alias("size"))
    shared = different.groupBy(F.col("anchor").alias("__anchor")).agg(F.count("*").alias("blocks"), F.sum("n").alias("places")).where("places > 1")
    known = different.join(shared, F.col("anchor") == F.col("__anchor")).drop("__anchor", "places")
    known = stored(spark, known, "substrings")
    contested = known.where("blocks > 1")
    parts = max(parts_for(spark), int((contested.agg(F.sum("size")).first()[0] or 0) // ORDER_BYTES) + 1)
    wanted = contested.select(
        F.col("at.row").alias("__row"),
        F.struct("anchor", "block", "n", F.col("at.a").alias("a"), "size", (F.col("blocks") > hot_blocks).alias("hot")).alias("want"),
    ).groupBy("__row").agg(F.collect_list("want").alias("want"))
    own = F.col("row") == F.col("__row")
    # rows equal in id and text would fetch the same blocks twice; equal blocks would then match themselves
    fetched = packed.join(wanted, own).select("id", "row", "z", "want").mapInArrow(
        lean(_fetched), "anchor long, block binary, n long, id long, row binary, a int, hot boolean, data binary"
    )
    fetched = stored(spark, fetched, "substrings")
    single = ["anchor", "block", "id", "row", "a", "data"]
    cold = fetched.where("NOT hot").select(*single).repartition(parts, "anchor").sortWithinPartitions("anchor", "block").dropDuplicates(["anchor", "block"])
    cold = cold.sortWithinPartitions("anchor").mapInArrow(lean(_ordered(span, keep)), "anchor long, block binary, runs array<struct<s: int, e: int>>")
    windows = fetched.where("hot").select(*single).dropDuplicates(["anchor", "block"]).mapInArrow(
        lean(_windows(span)), "anchor long, block binary, id long, row binary, a int, s int, w1 long, w2 long"
    )
    place = F.struct("id", "row", "a", "s")
    equal = windows.groupBy(F.col("w1").alias("__w1"), F.col("w2").alias("__w2")).agg(F.count("*").alias("c"), F.min(place).alias("__first")).where("c > 1")
    hot = windows.join(equal, (F.col("w1") == F.col("__w1")) & (F.col("w2") == F.col("__w2")))
    if keep == "first":
        hot = hot.where(place > F.col("__first"))
    hot = hot.groupBy("anchor", "block").agg(F.collect_list(F.struct(F.col("s"), F.col("s").alias("e"))).alias("runs"))
    runs = cold.unionByName(hot).select(F.col("anchor").alias("__anchor"), F.col("block").alias("__block"), "runs")
    marked = known.join(runs, (F.col("anchor") == F.col("__anchor")) & (F.col("block") == F.col("__block")), "left").where("n > 1 OR runs IS NOT NULL")
    # equal blocks have equal anchors, so a block's digest is the key; a passage of a third of all documents is dealt out
    marked = stored(spark, marked.select(F.col("block").alias("__key"), F.col("n").alias("__n"), (F.col("n") > 1).alias("whole"), "at", "runs"), "substrings")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    found = met(blocks, "block", ["row", "a"], marked, total, counts=marked)
    whole = F.col("whole")
    begin, behind = F.col("a"), F.col("a") + F.col("cover")
    if keep == "first":
        first = (F.col("row") == F.col("at.row")) & (F.col("a") == F.col("at.a"))
        # inside a period only the first block of the row is the first copy
        begin = F.when(first, F.col("a") + F.expr(f"CAST((cover - size) / greatest(n - 1, 1) AS INT) + size - {span}")).otherwise(begin)
        begin = F.when(first & (F.col("n") > 1), F.greatest(begin - (F.col("size") - span) , F.col("a") + 1)).otherwise(begin)
        whole = whole & (~first | (F.col("n") > 1))
    spans = F.when(whole, F.array(F.struct(begin.cast("long").alias("start"), behind.cast("long").alias("end"))))
    part = F.expr(f"transform(runs, r -> struct(CAST(a + r.s AS BIGINT) AS start, CAST(a + r.e + {span} AS BIGINT) AS end))")
    none = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)")
    # a whole block needs no runs, unless its first copy stays
    both = F.coalesce(spans, part, none) if keep == "none" else F.concat(F.coalesce(spans, none), F.when(first | ~F.col("whole"), F.coalesce(part, none)).otherwise(none))
    found = found.select(F.col("row").alias("__row"), both.alias("spans")).groupBy("__row").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return packed.join(found, own, "left").select("id", "z", "spans").mapInArrow(
        lean(_cut), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: bigint, end: bigint>>"
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
