"""Profiles, component reports, graphs built edge by edge, pre-match points."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import evaluation, graph, learning, profiles, quality, serving
from touchline.plans import endpoints

COUNTERS = sorted({*profiles.MEANS.values(), "goals"})


def stats(spark, rows):
    """rows: (match, player, team, position, minutes, {counter: value})."""
    return spark.createDataFrame(
        [(m, p, t, pos, mins, *[float(c.get(k, 0)) for k in COUNTERS]) for m, p, t, pos, mins, c in rows],
        "match_id int, player_id int, team_id int, position string, minutes_played int, " + ", ".join(f"{k} double" for k in COUNTERS),
    )


def test_efficiency(spark):
    rows = [(m, 1, 9, "Back" if m else "Wing", 90, {"xg": 0.2 * m, "xa": 0.1, "tackles": 10}) for m in range(3)]
    rows += [(m, 2, 9, "Wing" if m % 2 else "Back", 45, {"xg": 1.0, "pass_accuracy": 80}) for m in range(4)] + [(m, 3, 9, "Wing", 90, {"xg": 9}) for m in range(2)]
    rows += [(m, p, 8, "Back", 10, {"xg": 0.5}) for m in range(3) for p in range(20, 40)]
    got = {(r.team_id, r.player_id): r for r in profiles.efficiency(stats(spark, rows), spark.createDataFrame([(1, "runner")], "player_id int, player_type string")).collect()}
    assert sorted(p for t, p in got if t == 9) == [1, 2] and sorted(p for t, p in got if t == 8) == list(range(20, 32))  # ties by id, twelve a team
    one, two = got[9, 1], got[9, 2]
    assert (one.position, one.matches, one.minutes, one.rank, one.player_type, one.radar_defending) == ("Back", 3, 270.0, 2, "runner", 100.0)
    assert (two.position, two.rank, two.player_type, two.pass_completion, two.radar_attack) == ("Back", 1, "Unclassified", 80.0, 100.0)
    assert one.xg_per_90 == pytest.approx(0.2)


def test_style_vector(spark):
    rows = [(1, 1, 9, "x", 60, {"xg": 1, "passes_attempted": 10, "dribbles_completed": 5, "pass_accuracy": 50}), (2, 1, 9, "x", 30, {"progressive_passes": 2, "progressive_carries": 1, "pass_accuracy": 100}), (1, 2, 9, "x", 0, {"xg": 1})]
    got = profiles.style_vector(stats(spark, rows)).collect()
    assert len(got) == 1 and len(got[0]) == 14
    r = got[0]
    assert (r.total_minutes, r.xg_90, r.touches_90, r.progressive_actions_90, r.carries_90, r.pass_accuracy) == (90, 1.0, 15.0, 3.0, 1.0, 75.0)


def test_graph_takes_the_last_of_equal_edges(spark):
    e = spark.createDataFrame([("g", 1, 2, 5.0, 1), ("g", 1, 2, 7.0, 2), ("g", 2, 1, 1.0, 1), ("g", 3, 3, 9.0, 1), ("g", 1, 4, 2.0, 1)], "g string, src int, dst int, weight double, at int")
    built = graph.built(e, ["g"], "at")
    assert sorted((r.src, r.dst, r.weight) for r in built.collect()) == [(1, 2, 7.0), (1, 4, 2.0), (2, 1, 1.0)]
    assert {r.node: (r.degree, r.centrality) for r in graph.degrees(built, ["g"]).collect()} == {1: (3, 1.5), 2: (2, 1.0), 4: (1, 0.5)}


def test_component_report(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(200, 3)) @ np.array([[3, 1, 0], [0, 1, 0], [0, 0, 0.2]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = learning.component_report(df, ["a", "b", "c"], 2).collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, axes = np.linalg.eigh(np.cov(z.T))
    for i in (1, 2):
        axis = axes[:, -i] * (1 if axes[abs(axes[:, -i]).argmax(), -i] > 0 else -1)
        mine = [r for r in got if r.component == i]
        assert [r.loading for r in mine] == pytest.approx(axis.tolist(), abs=1e-9) and mine[0].share == pytest.approx(values[-i] / values.sum())
        assert mine[0].cumulated == pytest.approx(values[-i:].sum() / values.sum())


def test_full_profile(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (None, "a", 4.0), (1, "c", None)], "i int, s string, x double")
    got = {r.column_name: r for r in quality.profile_full(df, 2).collect()}
    assert (got["i"].n_null, got["i"].null_percent, got["i"].n_distinct, got["i"].least, got["i"].mean, got["i"].samples) == (1, 33.33, 1, "1", 1.0, ["1"])
    assert (got["s"].n_distinct, got["s"].greatest, got["s"].mean, got["s"].samples) == (3, "c", None, ["a", "b"]) and got["x"].mean == 3.0
    assert {(r.n_rows, r.n_null, r.n_distinct) for r in quality.profile_full(df.where("false")).collect()} == {(0, 0, 0)}


def test_prematch_points_are_of_an_unseen_season(spark, sf):
    points = endpoints.prematch_points(spark, sf).cache()
    rows = endpoints.prematch_rows(spark, sf)
    last = rows.agg(F.max("season")).first()[0]
    assert points.count() == rows.where(F.col("season") == last).count() and {r.season for r in points.select("season").distinct().collect()} == {last}
    one = points.orderBy("match_id").first()
    p = json.loads(one.probabilities)
    assert set(p) == {"win", "draw", "loss"} and sum(p.values()) == pytest.approx(1, abs=2e-4) and one.win == pytest.approx(100 * p["win"], abs=0.06)
    found = serving.prematch_point(points, one.match_id, one.team_id).collect()
    assert len(found) == 1 and found[0].win == one.win
    assert serving.prematch_point(points, one.match_id, -1).count() == 0
    train, test = evaluation.held_out(rows, "season", last)
    assert train.count() + test.count() == rows.count()


def test_panels_and_liveness(spark, sf):
    assert serving.alive(spark).first().ok and serving.rows_or_empty(spark, "a int", lambda: spark.range(1).select("nothing")).schema.simpleString() == "struct<a:int>"
    got = {r.table_name: (r.present, r.n_rows) for r in serving.table_report(spark, sf, ["nation", "weather"]).collect()}
    assert got == {"nation": (True, 25), "weather": (False, None)}
    shots = spark.createDataFrame([(1,), (2,)], "player_id int")
    assert serving.of_player(shots, 2).count() == 1 and serving.of_player(shots, None).count() == 2
