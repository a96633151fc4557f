"""Model selection, resampling and clusters against brute force or by hand."""

import numpy as np
from pyspark.sql import functions as F

from touchline.operators import clusters, joins, learning, resampling, selection
from touchline.plans import modelling


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(3, 0.1, (40, 2)), [[10.0, 10.0], [1.5, 1.4]]])
    rows = spark.createDataFrame([(1, i, p.tolist()) for i, p in enumerate(points)], "g int, i int, v array<double>")
    got = dict(clusters.dbscan(rows, "g", "i", "v", eps=0.3, least=4).select("i", "cluster").collect())
    near = [{j for j in range(82) if np.linalg.norm(points[i] - points[j]) <= 0.3} for i in range(82)]
    core = {i for i in range(82) if len(near[i]) >= 4}
    assert {i for i in got if got[i] < 0} == {i for i in range(82) if i not in core and not near[i] & core}
    assert all(got[i] == got[j] for i in core for j in near[i] & core)
    assert got[0] != got[40]
    assert clusters.dbscan(rows.where("i = 0"), "g", "i", "v").first()["cluster"] == -1
    assert clusters.dbscan(rows.where("i < 0"), "g", "i", "v").count() == 0


def test_density_holds_few_distances_at_once(monkeypatch):
    """The clusters don't depend on how many distances a task holds."""
    points = np.random.default_rng(6).normal(size=(300, 3))
    want = clusters._dbscan(points, 0.5, 4, 4, 0.9)
    monkeypatch.setattr(clusters, "AT_ONCE", 900)
    assert (clusters._dbscan(points, 0.5, 4, 4, 0.9) == want).all() and len(set(want)) > 1


def test_greedy_pairs():
    scores = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.1), ("c", "x", 0.85)]
    assert clusters.greedy_pairs(scores) == {"a": "x", "b": "y"}
    assert clusters.greedy_pairs(scores, highest=False) == {"b": "y", "c": "x"}


def test_synthetic_rows_lie_between_neighbours(spark):
    few = [(i, 1, float(i), 2.0 * i) for i in range(30)]
    rows = spark.createDataFrame(few + [(100 + i, 0, 0.0, 0.0) for i in range(90)], "k int, y int, a double, b double")
    out = resampling.synthetic(rows, "y", 1, "k", ["a", "b"], copies=2, neighbours=2)
    made = out.where("synthetic").collect()
    assert out.count() == 120 + 60 and {r["y"] for r in made} == {1}
    assert all(abs(r["b"] - 2 * r["a"]) < 1e-9 and abs(r["a"] - r["k"]) <= 2 for r in made)  # the 2 nearest are at most 2 away
    again = resampling.synthetic(rows, "y", 1, "k", ["a", "b"], copies=2, neighbours=2)
    assert sorted(map(tuple, made)) == sorted(map(tuple, again.where("synthetic").collect()))
    assert resampling.synthetic(rows.where("k = 3"), "y", 1, "k", ["a", "b"]).where("synthetic").first()["a"] == 3.0
    small = resampling.synthetic(rows, "y", 1, "k", ["a", "b"], block_rows=10)
    assert small.where("synthetic").count() == 30


def test_under_sampling(spark):
    rows = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "k int, y int")
    got = resampling.undersampled(rows, "y", "k").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 100, 1: 100}
    assert resampling.undersampled(rows.where("k < 0"), "y", "k").count() == 0


def test_drawn_settings():
    space = {"a": [1, 2, 3], "b": [4, 5]}
    got = selection.drawn(space, 4)
    assert len({tuple(s.items()) for s in got}) == 4 and got == selection.drawn(space, 4)
    assert len(selection.drawn(space, 99)) == 6


class Doubled:
    """Stands for a model: scores depend on x alone."""

    def transform(self, rows):
        return rows.withColumn("p", F.col("x") * 2)


def test_permutation_importance(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(300)], "k int, x double, z double")
    numbers = [r["__i"] for r in selection._numbered(rows, F.xxhash64("k")).collect()]
    assert sorted(numbers) == list(range(1, 301))

    def score(df):
        return -df.withColumn("y", F.pmod("k", F.lit(7)) * 2).agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]

    loss = dict(selection.permutation_importance(Doubled(), rows, ["x", "z"], "k", score))
    assert loss["x"] > 1 and loss["z"] == 0


def test_choices():
    assert selection.preferred({"forest": 0.60, "boosted": 0.595}, "boosted") == "boosted"
    assert selection.preferred({"forest": 0.62, "boosted": 0.595}, "boosted") == "forest"
    assert selection.locked(0.96, 1.0) and not selection.locked(0.94, 1.0) and not selection.locked(1.0, 1.0, gain=0.02)


def test_token_subset(spark):
    left = spark.createDataFrame([(1, "john smith"), (2, "smith"), (3, "none here"), (4, None), (5, "ann lee ann")], "a int, ln string")
    right = spark.createDataFrame([(7, "john peter smith"), (8, "jane smith"), (9, "lee ann"), (9, "lee ann"), (10, None)], "b int, rn string")
    assert sorted(map(tuple, joins.token_subset(left, "a", "ln", right, "b", "rn").collect())) == [(1, 7), (5, 9)]


def test_weighted_cells_give_the_trees_of_the_rows(spark):
    """Every row is counted, far fewer rows are fitted, and each row's score is that of a fit on all rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(8)
    rows = [(i, int(i % 3), float(rng.integers(0, 4)), float(rng.integers(0, 5)), "xyz"[rng.integers(0, 3)]) for i in range(3000)]
    rows = [(i, f, a, b, c, float(rng.random() < (0.2 + 0.1 * a if c == "x" else 0.1 * b))) for i, f, a, b, c in rows] + [(3000, 1, None, float("nan"), None, 1.0)]
    rows = spark.createDataFrame(rows, "k int, fold int, a double, b double, c string, label double")
    p = vector_to_array(F.col("probability"))[1].alias("p")
    for i, (train, test) in enumerate(learning.cells(rows, 3, ["a", "b"], ["c"], "label")):
        ours, theirs = rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)
        assert train.agg(F.sum("weight")).first()[0] == ours.count() and test.agg(F.sum("weight")).first()[0] == theirs.count()
        assert train.count() <= 4 * 5 * 3 * 2 + 1
        boosted = GBTClassifier(maxIter=4, maxDepth=3, seed=1)
        plain = learning.fitted(ours, learning.features(["a", "b"], ["c"]), boosted).transform(theirs)
        got = boosted.copy({boosted.weightCol: "weight", boosted.maxBins: learning.BINS + 1}).fit(train).transform(test)
        want = sorted((r["c"] or "", r["label"], round(r["p"], 9)) for r in plain.select("c", "label", p).collect())
        assert sorted(x for r in got.select("c", "label", p, "weight").collect() for x in [(r["c"] or "", r["label"], round(r["p"], 9))] * int(r["weight"])) == want


def test_thresholds():
    assert learning.thresholds([]) == learning.thresholds([3.0, 3.0]) == []
    assert learning.thresholds([1.0, 2.0, 2.0, 4.0]) == [1.5, 3.0]
    assert learning.thresholds([float(i) for i in range(100)], 4) == [24.5, 49.5, 74.5]
    assert len(learning.thresholds(sorted(np.random.default_rng(2).normal(size=5000).tolist()))) == learning.BINS - 1


def test_search_fits_cells(spark, sf, monkeypatch):
    """parameter_search fits cells, and their weights are all rows of the other folds."""
    seen, total = [], spark.read.parquet(f"{sf}/lineitem.parquet").count()

    def searched(parts, space, n, *_):
        seen.append([sum(df.agg(F.sum("weight")).first()[0] for df in part) for part in parts])
        return {}, []

    monkeypatch.setattr(selection, "searched", searched, raising=False)
    modelling.QUERIES["parameter_search"](spark, sf).count()
    assert seen == [[total] * 3]


def test_shot_model_fits_cells(spark, sf, monkeypatch):
    """Fits see weighted cells, and the metrics count every row."""
    fits, boosted = [], modelling._boosted

    def shorter(part, setting):
        fits.append((setting, part.agg(F.sum("weight")).first()[0]))
        return boosted(part, setting | {"maxIter": 2})

    monkeypatch.setattr(modelling, "_boosted", shorter)
    got, total = modelling.QUERIES["shot_model"](spark, sf).first(), spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert got["tp"] + got["fp"] + got["fn"] + got["tn"] == total and 0 < got["brier"] < 0.3
    assert [s["maxIter"] for s, _ in fits] == [40] * 3 and sum(n for _, n in fits) == 2 * total


def test_values_are_dealt_once_for_all_columns(spark, monkeypatch):
    """Every row gets the values of another, each goes to one row, copies of keys and nulls too; the order is made and stored once."""
    rows = spark.createDataFrame([(i // 2, float(i), None if i % 5 == 0 else -float(i)) for i in range(500)], "k int, x double, z double")
    for buckets in (1, 7, 4096):
        got = selection._beside_next(rows, ["x", "z"], F.xxhash64("k"), buckets).select("x", "z", F.col("__next.x").alias("a"), F.col("__next.z").alias("b")).collect()
        assert sorted(r["a"] for r in got) == sorted(r["x"] for r in got) == [float(i) for i in range(500)]
        assert all(r["a"] != r["x"] and r["b"] == (None if r["a"] % 5 == 0 else -r["a"]) for r in got)
    assert selection._beside_next(rows.where("x < 1"), ["x"], F.xxhash64("k")).first()["__next"]["x"] == 0

    puts, put = [], selection.written
    monkeypatch.setattr(selection, "written", lambda s: lambda df: puts.append(df) or put(s)(df))
    selection.permutation_importance(Doubled(), rows, ["x", "z"], "k", lambda df: float(df.count()))
    assert len(puts) == 1


def test_shot_model_boosts_all_rounds(spark, sf, monkeypatch):
    """Every fold asks for the 400 rounds of the full model."""
    asked, boosted = [], modelling._boosted
    monkeypatch.setattr(modelling, "_boosted", lambda part, setting: asked.append(setting["maxIter"]) or boosted(part, setting | {"maxIter": 2}))
    modelling.QUERIES["shot_model"](spark, sf).first()
    assert asked == [400] * 3
