"""Exact nearest neighbours by pivots, and sums of distances by blocks: no pair of rows is ever a row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS, MAX_PIVOTS = 2000, 256
#: Numbers that the pivots of short vectors hold together: there are more of them.
PIVOT_NUMBERS = 16384
#: Groups of rows that a table is dealt into, each met by every row that may have a neighbour there, and the most rows of one.
COPIES, GROUP_ROWS = 24, 100_000
QUERIES_AT_ONCE = 512
#: Queries that are compared with a block at once.
AT_ONCE = 64
#: Bounds are widened by this share, far more than rounding can move them.
SLACK = 1e-9


def _matrix(column: pa.Array, dims: int):
    import numpy as np

    flat = column.flatten()
    if len(flat) != len(column) * dims or flat.null_count:
        raise ValueError(f"vectors must have {dims} components, none null")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _packed(x) -> pa.Array:
    """Rows of numbers as binaries: they pass between the engines without a look at each number."""
    import numpy as np

    at = np.arange(len(x) + 1, dtype=np.int64) * 8 * x.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x, dtype="<f8"))]).cast(pa.binary())


def _unpacked(column: pa.Array, dims: int):
    import numpy as np

    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<f8", len(column) * dims, at[0]).reshape(-1, dims) if len(column) else np.empty((0, dims))


def _distances(x, y):
    """Square roots of the exact sums of squared differences, a few rows of x at a time."""
    import numpy as np

    out = np.empty((len(x), len(y)))
    for i in range(0, len(x), AT_ONCE):
        out[i : i + AT_ONCE] = np.sqrt(((x[i : i + AT_ONCE, None, :] - y[None]) ** 2).sum(axis=2))
    return out


def _squares(x, y):
    """(squared distances by one matrix product, how far rounding may have moved them)."""
    import numpy as np

    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    size = xx[:, None] + yy[None]
    return size - 2.0 * (x @ y.T), size * (4.0 * (x.shape[1] + 8) * np.finfo(float).eps)


def nearest(rows: DataFrame, key: str, vector: str, k: int, block_rows: int = BLOCK_ROWS, max_pivots: int | None = None, written=lambda df: df) -> DataFrame:
    """(key, neighbours array<struct<distance, key>>): the ``k`` nearest other rows of each, ties by key; fewer if there are no more rows."""
    return _searched(rows, key, vector, k, None, block_rows, max_pivots, written)


def within(rows: DataFrame, key: str, vector: str, reach: float, block_rows: int = BLOCK_ROWS, max_pivots: int | None = None, written=lambda df: df) -> DataFrame:
    """(key, neighbours array<struct<distance, key>>): all other rows of each at a distance of ``reach`` or less, nearest first."""
    return _searched(rows, key, vector, None, reach, block_rows, max_pivots, written)


def _group_rows(n: int, block_rows: int) -> int:
    """Rows of a group: so many that about ``COPIES`` groups hold ``n`` rows, ``GROUP_ROWS`` at most."""
    return max(block_rows, min(GROUP_ROWS, -(-n // COPIES)))


def _packed_cells(size, pivots, target: int):
    """(first group, parts) of every cell, and the number of groups: cells that lie side by side share a group of about ``target`` rows, larger ones are cut."""
    import numpy as np

    centred = pivots - pivots.mean(axis=0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if len(pivots) > 1 else np.zeros(1)
    first, parts = np.zeros(len(pivots), int), np.ones(len(pivots), int)
    group, held = 0, 0
    for c in np.argsort(along, kind="stable"):
        if held and held + size[c] > target:
            group, held = group + 1, 0
        first[c], parts[c] = group, max(1, -(-int(size[c]) // target))
        held += size[c]
        if parts[c] > 1:
            group, held = group + parts[c], 0
    return first, parts, group + 1


def _searched(rows: DataFrame, key: str, vector: str, k: int | None, within: float | None, block_rows: int, max_pivots: int | None, written) -> DataFrame:
    """Neighbours of every row, the ``k`` nearest or those ``within`` a distance.

    Rows belong to the cell of their nearest pivot (some rows drawn by hash, at most ``max_pivots``). The k-th distance inside a row's own block of
    about ``block_rows`` rows, and the distances to the pivots with the cells' radii, bound that of its k-th neighbour from above; pivots and radii bound
    the distance to any row of a cell from below. Cells are packed into groups, and a row is sent once to every group with a cell that may hold
    one of its neighbours: there are about ``COPIES`` groups, so what is shuffled is at most that many times the table until groups reach ``GROUP_ROWS``
    rows, which bounds a task's memory. A matrix product finds the pairs that may be within the bound, and these are measured exactly.
    ``key`` tells rows apart; ``written`` may store a table between the steps.
    """
    import numpy as np
    import pyarrow.compute as pc

    spark = rows.sparkSession
    base = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    kind = base.schema["key"].dataType.simpleString()
    n = base.count()
    if n < 2:
        return base.select(F.col("key").alias(key), F.array().cast(f"array<struct<distance: double, key: {kind}>>").alias("neighbours"))
    dims = len(base.first().v)
    most = max_pivots or max(MAX_PIVOTS, PIVOT_NUMBERS // dims)
    drawn = base.orderBy(F.xxhash64("key"), "key").limit(min(most, max(1, math.isqrt(n)))).select("v").collect()
    pivots = np.array([r.v for r in drawn], dtype=float)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dims)
            d = _distances(x, pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("key"), _packed(x), pa.array(cell, pa.int32()), pa.array(d[range(len(cell)), cell])], ["key", "v", "cell", "far"])

    cells = written(base.mapInArrow(placed, f"key {kind}, v binary, cell int, far double"))
    stats = {r.cell: (r.n, r.radius) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    size, radius = np.array([stats.get(c, (0, 0.0))[0] for c in range(len(pivots))]), np.array([stats.get(c, (0, 0.0))[1] for c in range(len(pivots))])
    first, parts, groups = _packed_cells(size, pivots, _group_rows(n, block_rows))
    member = np.zeros((len(pivots), groups), np.float32)
    for c in range(len(pivots)):
        member[c, first[c] : first[c] + parts[c]] = 1
    layout = spark.createDataFrame([(c, int(first[c]), int(parts[c]), max(1, -(-int(size[c]) // block_rows))) for c in range(len(pivots))], "cell int, at int, parts int, cut int")
    cells = cells.select("key", "v", "cell").join(F.broadcast(layout), "cell")

    def bounded(block: pa.Table) -> pa.Table:
        v = block.column("v").combine_chunks()
        x = _unpacked(v, dims)
        limit = np.full(len(x), np.inf)
        if len(x) > k:
            for i in range(0, len(x), 512):
                square, off = _squares(x[i : i + 512], x)
                limit[i : i + 512] = np.sqrt(np.maximum(np.partition(square + off, k, axis=1)[:, k], 0.0))  # itself is one of the k + 1
        return pa.table([block.column("key"), v, block.column("cell"), pa.array(limit)], ["key", "v", "cell", "bound"])

    if k is None:
        asked = cells.select("key", "v", "cell", F.lit(float(within)).alias("bound"))
    else:
        cut = cells.select("key", "v", "cell", F.pmod(F.xxhash64("key"), "cut").alias("b"))
        asked = written(cut.groupBy("cell", "b").applyInArrow(bounded, f"key {kind}, v binary, cell int, bound double"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_unpacked(b.column("v"), dims), pivots)
            bound = b.column("bound").to_numpy()
            if k is not None and np.isinf(bound).any():
                reach = d + radius  # all rows of a cell are within
                order = np.argsort(reach, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1)
                enough = np.minimum((held < min(k + 1, n)).sum(axis=1), len(pivots) - 1)  # itself is one of them
                bound = np.minimum(bound, np.take_along_axis(reach, order, axis=1)[range(len(d)), enough])
            bound = bound * (1 + SLACK)
            wanted = (d - radius - SLACK * (d + radius) <= bound[:, None]) & (size > 0)
            who, to = np.nonzero(wanted.astype(np.float32) @ member > 0)
            counts = np.bincount(who, minlength=len(d))
            to = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(to, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), b.column("cell"), pa.array(bound), to], ["key", "v", "cell", "bound", "groups"])

    blocks = cells.select((F.col("at") + F.pmod(F.xxhash64(F.lit("part"), "key"), "parts")).cast("int").alias("grp"), F.lit(0).alias("sent"), "cell", "key", "v", F.lit(0.0).alias("bound"))
    sent = asked.mapInArrow(routed, f"key {kind}, v binary, cell int, bound double, groups array<int>")
    sent = sent.select(F.explode("groups").alias("grp"), F.lit(1).alias("sent"), "cell", "key", "v", "bound")

    def pairs_of(x, bound, asked_keys, y, lifted, names, spans):
        """(query, distance, key) of the rows of a group within the bounds of some queries, as a table."""
        far = _distances(x, pivots[[c for c, _, _ in spans]])
        # x.y - y.y / 2 of a pair within the bound is at least this, whatever rounding does
        xx, yy = np.einsum("ij,ij->i", x, x), -2.0 * lifted[:, -1].min(initial=0.0)
        least = (xx - bound**2 - (xx + yy) * (4.0 * (dims + 8) * np.finfo(float).eps)) / 2
        above = np.column_stack([x, np.ones(len(x))])
        found: list = []
        for s, (c, a, z) in enumerate(spans):
            who = np.flatnonzero(far[:, s] - radius[c] - SLACK * (far[:, s] + radius[c]) <= bound)
            for m in range(a, z if len(who) else a, 4096):
                i, j = np.nonzero(above[who] @ lifted[m : min(z, m + 4096)].T >= least[who, None])
                for p in range(0, len(i), 65536):
                    q, r = who[i[p : p + 65536]], j[p : p + 65536] + m
                    d = np.sqrt(((x[q] - y[r]) ** 2).sum(axis=1))
                    near = d <= (within if k is None else bound[q])
                    found.append((q[near], d[near], r[near]))
        q, d, r = (np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
        other = pc.not_equal(names.take(pa.array(r)), asked_keys.take(pa.array(q)))
        t = pa.table([pa.array(q, pa.int64()), pa.array(d, pa.float64()), names.take(pa.array(r))], ["q", "d", "key"]).filter(other)
        return t.sort_by([("q", "ascending"), ("d", "ascending"), ("key", "ascending")])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, y, lifted, names, spans = None, None, None, None, []
        keys, held, of = [], [], []
        for b in batches:
            g, is_sent = b.column("grp").to_numpy(), b.column("sent").to_numpy()
            cuts = (np.flatnonzero((np.diff(g) != 0) | (np.diff(is_sent) != 0)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(g)]):
                part = b.slice(i, j - i)
                if g[i] != at:
                    at, y, keys, held, of = g[i], None, [], [], []
                if not is_sent[i]:
                    keys.append(part.column("key"))
                    held.append(_unpacked(part.column("v"), dims))
                    of.append(part.column("cell").to_numpy())
                    continue
                if y is None:  # the rows of a group come in order of their cells
                    y, names = np.concatenate([np.empty((0, dims)), *held]), pa.concat_arrays(keys or [part.column("key").slice(0, 0)])
                    cell = np.concatenate([np.empty(0, np.int32), *of])
                    starts = np.flatnonzero(np.diff(cell, prepend=-1)).tolist()
                    spans = [(int(cell[a]), a, z) for a, z in zip(starts, [*starts[1:], len(cell)])]
                    held, lifted = [], np.column_stack([y, -0.5 * np.einsum("ij,ij->i", y, y)])
                for s in range(0, len(part), QUERIES_AT_ONCE):
                    some = part.slice(s, QUERIES_AT_ONCE)
                    t = pairs_of(_unpacked(some.column("v"), dims), some.column("bound").to_numpy(), some.column("key"), y, lifted, names, spans)
                    counts = np.bincount(t.column("q").to_numpy(), minlength=len(some)) if len(t) else np.zeros(len(some), int)
                    if k is not None and (counts > k).any():
                        rank = np.arange(len(t)) - np.repeat(np.cumsum(counts) - counts, counts)
                        t, counts = t.filter(pa.array(rank < k)), np.minimum(counts, k)
                    key_type = b.schema.field("key").type
                    each = pa.StructArray.from_arrays([t.column("d").combine_chunks(), t.column("key").combine_chunks().cast(key_type)], ["distance", "key"])
                    near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), each)
                    yield pa.RecordBatch.from_arrays([some.column("key"), near], ["key", "near"])

    dealt = blocks.unionByName(sent).repartition("grp").sortWithinPartitions("grp", "sent", "cell")
    found = dealt.mapInArrow(met, f"key {kind}, near array<struct<distance: double, key: {kind}>>")
    best = F.array_sort(F.flatten(F.collect_list("near")))
    best = best if k is None else F.slice(best, 1, k)
    return found.groupBy("key").agg(best.alias("neighbours")).select(F.col("key").alias(key), "neighbours")


def silhouettes(rows: DataFrame, key: str, vector: str, cluster: str, block_rows: int = 1000) -> DataFrame:
    """(key, cluster, silhouette) of every row, by exact Euclidean distances to all rows; 0 for a cluster of one.

    Blocks of about ``block_rows`` rows are packed; a task keeps the summed distances of one group of blocks to each cluster and streams
    all blocks past it, so no distance is a row. There are about ``COPIES`` groups, each of ``GROUP_ROWS`` rows at most, so the table is shuffled that
    often and memory doesn't grow with it. The work is that of all pairs, by matrix products; pairs that are too near for these are measured exactly.
    """
    import numpy as np

    base = rows.select(F.col(key).alias("key"), F.col(cluster).cast("string").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    kind = base.schema["key"].dataType.simpleString()
    sizes = {r.c: r.n for r in base.groupBy("c").agg(F.count("*").alias("n")).orderBy("c").collect()}  # a row per cluster
    names = list(sizes)
    n = sum(sizes.values())
    blocks = max(1, -(-n // block_rows))
    groups = -(-n // _group_rows(n, block_rows)) if n else 1
    dealt = base.withColumn("b", F.pmod(F.xxhash64("key", "v"), F.lit(blocks)).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        data = np.array(table.column("v").to_pylist(), dtype="<f8")
        at = pa.array([[names.index(c) for c in table.column("c").to_pylist()]], pa.list_(pa.int32()))
        return pa.table([table.column("b").slice(0, 1), pa.array([table.column("key").to_pylist()], pa.list_(table.schema.field("key").type)), at, pa.array([data.tobytes()], pa.binary())], ["b", "keys", "at", "data"])

    whole = dealt.groupBy("b").applyInArrow(packed, f"b int, keys array<{kind}>, at array<int>, data binary")
    right = whole.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("to"), F.lit(1).alias("other"), "keys", "at", "data")
    left = whole.select(F.pmod("b", F.lit(groups)).alias("to"), F.lit(0).alias("other"), "keys", "at", "data")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.array([sizes[c] for c in names], dtype=float)
        to, own = None, None

        def scored():
            keys, at, _, total = own
            rows = np.arange(len(at))
            mine = counts[at]
            a = total[rows, at] / np.maximum(mine - 1, 1)
            others = total / counts
            others[rows, at] = np.inf
            b = others.min(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where((mine > 1) & np.isfinite(b), (b - a) / np.maximum(a, b), 0.0)
            return pa.RecordBatch.from_arrays([pa.array(keys, kinds), pa.array([names[i] for i in at], pa.string()), pa.array(np.nan_to_num(s))], ["key", "c", "s"])

        def grown(parts):
            keys, at, x = zip(*parts)
            return [z for ks in keys for z in ks], np.concatenate(at), np.concatenate(x), np.zeros((sum(map(len, at)), len(names)))

        mine: list = []
        for batch in batches:
            kinds = batch.schema.field("keys").type.value_type
            for where, other, keys, at, data in zip(*(batch.column(c).to_pylist() for c in ("to", "other", "keys", "at", "data"))):
                at, x = np.array(at), np.frombuffer(data, dtype="<f8").reshape(len(at), -1)
                if where != to and own is not None:
                    yield scored()
                    own = None
                to = where
                if not other:
                    mine.append((keys, at, x))
                    continue
                if own is None:
                    if not mine:
                        continue
                    own, mine = grown(mine), []
                order = np.argsort(at, kind="stable")
                x, at = x[order], at[order]
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                for i in range(0, len(own[1]), QUERIES_AT_ONCE):
                    part = own[2][i : i + QUERIES_AT_ONCE]
                    square, off = _squares(part, x)
                    p, q = np.nonzero(square <= off * 1e6)
                    for m in range(0, len(p), 65536):
                        a, z = p[m : m + 65536], q[m : m + 65536]
                        square[a, z] = ((part[a] - x[z]) ** 2).sum(axis=1)
                    own[3][i : i + QUERIES_AT_ONCE, at[starts]] += np.add.reduceat(np.sqrt(square), starts, axis=1)
        if own is not None:
            yield scored()

    pairs = left.unionByName(right).repartition("to").sortWithinPartitions("to", "other")
    found = pairs.mapInArrow(summed, f"key {kind}, c string, s double")
    return found.select(F.col("key").alias(key), F.col("c").cast(rows.schema[cluster].dataType).alias(cluster), F.col("s").alias("silhouette"))
