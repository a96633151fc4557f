"""Centroid clustering against plain Python over every distance."""

import hashlib

import numpy as np
import pytest

from touchline.llm import centroids


def plain(rows, k, dims, rounds, scale=64):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centres)), key=lambda j: (far(v, centres[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(i), v, nearest(v), far(v, centres[nearest(v)])) for i, v in kept), centres


def run(spark, rows, k, dims, rounds=3, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, centres = centroids.clustered(spark, df, k=k, dims=dims, rounds=rounds, **kw)
    got = found.collect()
    return sorted((str(r.id), list(r.v), r.cluster, int(r.distance)) for r in got), centres, got


def test_equals_every_distance(spark):
    draw = np.random.default_rng(5)
    middle = draw.normal(size=(6, 8)) * 3
    rows = [(i, [float(np.float32(x)) for x in (middle[i % 6] + draw.normal(size=8) * (0.2 if i % 3 else 2))]) for i in range(900)]
    got, centres, state = run(spark, rows, 7, 8, rounds=5)
    assert (got, centres) == plain(rows, 7, 8, 5)
    # bounds skip most of the 7 distances in 6 assignments
    assert sum(r.n_distances for r in state) < 0.6 * 900 * 7 * 6


def test_ties_repeats_nulls_and_wide_components(spark):
    ring = [(i, [float((i // 2) % 3), float(i % 4), 0.0]) for i in range(60)]  # many equal distances
    odd = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0]), (106, [0.0] * 4)]
    same = [(7, [1.0, 1.0, 1.0])] * 3 + [(None, [2.0, 1.0, 1.0]), (None, [1.0, 1.0, -1.0])]
    got, centres, _ = run(spark, ring + odd + same, 5, 3)
    assert (got, centres) == plain(ring + odd + same, 5, 3, 3) and len(got) == 65
    wide = [(i, [float(2**30 * (i % 5)), float(i), -float(2**33)]) for i in range(20)]
    got, centres, _ = run(spark, wide, 4, 3)
    assert (got, centres) == plain(wide, 4, 3, 3)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [4.0, 4.0])]
    got, centres, _ = run(spark, rows, 16, 2)
    assert (got, centres) == plain(rows, 16, 2, 3) and len(centres) == 2
    empty, centres, _ = run(spark, [], 16, 2)
    assert empty == [] and centres == []


@pytest.mark.parametrize("clash", ["cluster", "distance", "v", "id"])
def test_query_ignores_other_columns(spark, tmp_path, clash):
    rows = [(i, [float((i * 7 + j) % 5) for j in range(64)], "x") for i in range(40)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, {clash} string")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = centroids.op12_centroids(spark, str(tmp_path)).collect()
    want, centres = plain([r[:2] for r in rows], 16, 64, 3)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == [(i, c, d) for i, _, c, d in want]
    assert {r.inertia for r in got} == {sum(d for *_, d in want)}
    assert {r.cluster: r.centroid_sha256 for r in got} == {c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest() for _, _, c, _ in want}
