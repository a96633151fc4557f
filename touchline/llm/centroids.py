"""Centroid clustering with Elkan's bounds, in exact integers.

A vector is kept if it has exactly ``dims`` components, none null, NaN or infinite; each
component x becomes the integer floor(scale * x). The first centroids are the ``k`` kept vectors
with the smallest hash of their id. A round assigns every vector to its nearest centroid
(squared distance; of equal ones the smaller number) and moves each centroid that has vectors
to their componentwise floor(sum / count).

Every vector carries its cluster, an upper bound of the distance to that centroid and a lower
bound of the distance to each of the k. A centroid is skipped if its lower bound, or half of
the distance between it and the vector's own centroid, lies strictly above the upper bound:
a tie is never skipped. Roots are taken in floating point and then widened away from the true
value, as are the shifts of the bounds when centroids move, so a skipped centroid is farther
in exact arithmetic, too. What isn't skipped is compared by exact squared distances.

Plan: vectors and bounds are one table in the shared folder, rewritten each round by tasks
that need nothing but the k centroids; no vector is shuffled. A task sums up its vectors by
cluster, and only those sums (k rows a task) are shuffled. The driver holds k centroids.

Edge cases: vectors that aren't kept don't appear; equal vectors and equal ids are rows of
their own (of equal hashes the smaller vector comes first as a centroid); a null id hashes as
an empty one; with fewer vectors than k there are as many centroids; an empty table gives an
empty result; components beyond the range of a long count as its ends; a squared distance or
a sum of them that passes 63 bits is null, while the assignment stays exact; columns other
than id and vector, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, lean, stored

K, DIMS, SCALE, ROUNDS, SEED = 16, 64, 64, 3, "1:"
#: Components up to this size have exact squared distances in 64 bits.
NARROW = 1 << 26
WIDER, NARROWER = 1 + 2.0**-50, 1 - 2.0**-50
LONG = (1 << 63) - 1
STATE = "id {id}, v array<long>, cluster int, upper double, lower array<double>, n_distances long, distance decimal(38,0)"


def vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the kept vectors."""
    whole = F.col(vec_col).cast("array<double>")
    slim = rows.select(F.col(id_col).alias("id"), whole.alias("x")).where(F.size("x") == dims)
    odd = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return slim.where(~odd).select("id", F.transform("x", lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def first_centroids(kept: DataFrame, k: int = K, seed: str = SEED) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed`` and their id."""
    name = F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return [r.v for r in kept.orderBy(F.sha2(name, 256), "v").limit(k).select("v").collect()]


def exact(x, centre):
    """Squared distances of the rows of ``x`` to one centroid, or to one each: int64, or Python integers where those could overflow."""
    import numpy as np

    if x.dtype == object or centre.dtype == object:
        return ((x.astype(object) - centre.astype(object)) ** 2).sum(axis=1)
    d = x - centre
    return np.einsum("ij,ij->i", d, d)


def above(squares):
    """No less than the roots."""
    import numpy as np

    return np.sqrt(squares.astype(np.float64)) * WIDER


def below(squares):
    """No more than the roots."""
    import numpy as np

    return np.sqrt(squares.astype(np.float64)) * NARROWER


def integers(values):
    """An integer array that exact() may use."""
    import numpy as np

    out = np.array(values, dtype=np.int64)
    return out if not out.size or (out.min() >= -NARROW and out.max() <= NARROW) else out.astype(object)


class Step:
    """One assignment of vectors to centroids, with bounds that are shifted by how far each centroid has moved."""

    def __init__(self, centres: list[list[int]], before: list[list[int]] | None):
        import numpy as np

        self.c = integers(centres)
        k = len(centres)
        self.half = np.zeros((k, k))
        for j in range(k):
            self.half[:, j] = below(exact(self.c, self.c[j])) / 2
        self.moved = above(exact(self.c, integers(before))) if before is not None else None

    def __call__(self, x, cluster, upper, lower, last: bool = False):
        """(cluster, upper, lower, distances computed, exact squared distances) of the rows of ``x``; without ``last`` the distances of skipped rows are 0."""
        import numpy as np

        k, n = len(self.c), len(x)
        counted = np.zeros(n, dtype=np.int64)
        if self.moved is None:
            cluster, lower = np.zeros(n, dtype=np.int64), np.zeros((n, k))
            upper = np.full(n, np.inf)
        else:
            cluster = cluster.astype(np.int64)
            upper = (upper + self.moved[cluster]) * WIDER
            lower = np.maximum(lower - self.moved, 0) * NARROWER
        # a loose bound is made tight where some other centroid might be as near
        might = (upper[:, None] >= lower) & (upper[:, None] >= self.half[cluster])
        might[np.arange(n), cluster] = False
        tight = np.arange(n) if last or self.moved is None else np.flatnonzero(might.any(axis=1))
        best = np.zeros(n, dtype=np.int64).astype(object if self.c.dtype == object or x.dtype == object else np.int64)
        best[tight] = exact(x[tight], self.c[cluster[tight]])
        upper[tight] = np.minimum(upper[tight], above(best[tight]))
        lower[tight, cluster[tight]] = below(best[tight])
        counted[tight] += 1
        for j in range(k):
            near = tight[(cluster[tight] != j) & (upper[tight] >= lower[tight, j]) & (upper[tight] >= self.half[cluster[tight], j])]
            if not len(near):
                continue
            d = exact(x[near], self.c[j])
            counted[near] += 1
            lower[near, j] = below(d)
            better = (d < best[near]) | ((d == best[near]) & (j < cluster[near]))
            to = near[better.astype(bool)]
            cluster[to], best[to] = j, d[better.astype(bool)]
            upper[to] = above(best[to])
        return cluster, upper, lower, counted, best


def _assigned(centres: list[list[int]], before: list[list[int]] | None, dims: int, last: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        step, k = Step(centres, before), len(centres)
        for b in batches:
            n = b.num_rows
            x = integers(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dims))
            if before is None:
                state = [np.full(n, -1), None, None]
            else:
                state = [b.column("cluster").to_numpy(), b.column("upper").to_numpy(), b.column("lower").flatten().to_numpy().reshape(n, k).copy()]
            cluster, upper, lower, counted, best = step(x, *state, last)
            if before is not None:
                counted = counted + b.column("n_distances").to_numpy()
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(lower.reshape(-1)))
            distance = pa.array([int(d) if d < 10**38 else None for d in best.tolist()], pa.decimal128(38, 0))
            cols = [b.column("id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), bounds, pa.array(counted), distance]
            yield pa.RecordBatch.from_arrays(cols, ["id", "v", "cluster", "upper", "lower", "n_distances", "distance"])

    return run


def _summed(dims: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n, sums = [0] * k, np.zeros((k, dims), dtype=object)
        for b in batches:
            x = integers(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims))
            cluster = b.column("cluster").to_numpy()
            for j in np.unique(cluster).tolist():
                mine = x[cluster == j]
                n[j] += len(mine)
                sums[j] += mine.sum(axis=0).astype(object)  # a batch of narrow components stays below 63 bits
        rows = [(j, d, n[j], int(sums[j][d])) for j in range(k) if n[j] for d in range(dims)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["cluster", "d", "n", "s"])

    return run


def moved(state: DataFrame, centres: list[list[int]], dims: int) -> list[list[int]]:
    """Each centroid at floor(sum / count) of its vectors; one without vectors stays."""
    parts = state.select("v", "cluster").mapInArrow(lean(_summed(dims, len(centres))), "cluster int, d int, n long, s decimal(38,0)")
    out = [list(c) for c in centres]
    for r in parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # k * dims rows
        out[r.cluster][r.d] = int(r.s) // r.n
    return out


def clustered(
    spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, dims: int = DIMS, scale: int = SCALE,
    rounds: int = ROUNDS, seed: str = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """((id, v, cluster, upper, lower, n_distances, distance) of every kept vector, the final centroids)."""
    bounded_batches(spark)
    kept = vectors(rows, id_col, vec_col, dims, scale)
    kind = kept.schema["id"].dataType.simpleString()
    state, before = stored(spark, kept, "centroids"), None
    centres = first_centroids(state, k, seed)
    if not centres:
        return spark.createDataFrame([], T.StructType.fromDDL(STATE.format(id=kind))), []
    for _ in range(rounds):
        state = stored(spark, state.mapInArrow(lean(_assigned(centres, before, dims)), STATE.format(id=kind)), "centroids")
        before, centres = centres, moved(state, centres, dims)
    return state.mapInArrow(lean(_assigned(centres, before, dims, True)), STATE.format(id=kind)), centres


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = clustered(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = stored(spark, found.select("id", "cluster", "distance"), "centroids")
    long = lambda c: F.when(c <= F.lit(LONG), c.cast("long"))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    inertia = found.groupBy(F.col("cluster").alias("c")).agg(whole("distance").alias("s")).collect()  # a row per cluster
    total = None if any(r.s is None for r in inertia) else sum(int(r.s) for r in inertia)
    fits = lambda x: None if x is None or x > LONG else int(x)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    table = spark.createDataFrame(
        [(r.c, fits(r.s), fits(total), names[r.c]) for r in inertia], "c int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    joined = found.join(F.broadcast(table), F.col("cluster") == F.col("c"))  # K rows
    return joined.select(F.col("id").alias("vec_id"), "cluster", long(F.col("distance")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same in DuckDB, a stage per assignment, every distance computed."""
    out = [
        f"""WITH r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, i, floor(embedding[i]::DOUBLE * {scale})::BIGINT AS x FROM r, range(1, {dims + 1}) t(i)),
f AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS c FROM r),
c0 AS MATERIALIZED (SELECT f.c, v.i, v.x FROM f JOIN v USING (rid) WHERE f.c < {k})"""
    ]
    for n in range(rounds + 1):
        out.append(f"""d{n} AS (SELECT v.rid, c{n}.c, sum((v.x - c{n}.x) * (v.x - c{n}.x)) AS d FROM v JOIN c{n} USING (i) GROUP BY v.rid, c{n}.c),
a{n} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS k FROM d{n}) WHERE k = 1)""")
        if n < rounds:
            out.append(f"""s{n} AS (SELECT a.c, v.i, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n} a JOIN v USING (rid) GROUP BY a.c, v.i),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, c{n}.i, CASE WHEN n IS NULL THEN c{n}.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x
    FROM c{n} LEFT JOIN s{n} USING (c, i))""")
    return ",\n".join(out) + f"""
SELECT r.vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN r USING (rid) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) h ON a.c = h.c"""
