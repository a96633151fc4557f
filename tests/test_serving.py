"""Parameters, linking, positions, windows and the registry on hand-computed cases."""

import datetime as dt

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import clusters, graph, learning, ordered, quality, rating, serving


def test_season_parameters(spark):
    rows = spark.createDataFrame([(1, "2015/2016"), (2, "2016/2017"), (3, None)], "match_id int, season string")
    shots = spark.createDataFrame([(1,), (1,), (2,), (None,)], "m int")
    for blank in (None, "", "all", "ALL"):
        assert serving.in_season(rows, blank).count() == 3 and serving.of_matches(shots, rows, blank, "m", "match_id").count() == 4
    assert serving.in_season(rows, "2015/2016").count() == 1 and serving.of_matches(shots, rows, "2015/2016", "m", "match_id").count() == 2
    assert serving.exists(rows, F.col("match_id") == 3) and not serving.exists(rows, F.col("match_id") == 9)
    assert serving.rows_or_none(lambda: rows.select("nothing")) == [] and len(serving.rows_or_none(lambda: rows)) == 3


def test_season_table_takes_differences_of_rounded_values(spark):
    m = spark.createDataFrame(
        [("a", 1, 2, 2, 1, 1.24, None), ("a", 2, 1, 0, 0, 0.5, 0.31), ("a", 1, 2, None, 1, 9.0, 9.0)],
        "season string, home int, away int, home_score int, away_score int, home_xg double, away_xg double",
    )
    one = serving.season_table(m).where("team = 1").first()
    assert (one.played, one.goals_for, one.goals_against, one.points, one.xg_for, one.xg_against) == (2, 2, 1, 4, 1.6, 0.5)
    assert one.xg_diff == 1.1 and one.points_diff == pytest.approx(round(4 - one.xpoints, 1))
    assert serving.season_table(m, "b").count() == 0


def test_count_windows(spark):
    rows = spark.createDataFrame([(1, i + 1, m, s) for i, (m, s) in enumerate([(90.0, 1), (30.0, 0), (95.0, 1), (90.0, 1)])], "p int, i long, mins double, started int")
    got = [tuple(r)[2:] for r in ordered.count_windows(rows, ["p"], "i", "mins", "started", 2).orderBy("i").collect()]
    assert got == [(0, 0, 0.0, 0.0, 0.0, 0), (1, 1, 90.0, 90.0, 0.0, 1), (1, 1, 60.0, 90.0, 0.5, 0), (1, 1, 62.5, 95.0, 0.5, 1)]


def test_positions_and_places(spark):
    rows = spark.createDataFrame([("Left Wing Back",), ("Secondary Striker",), ("Center Defensive Midfield",), ("Sweeper",), (None,)], "p string")
    got = rows.select(S.broad_position(F.col("p")), S.coarse_position(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("FB", "Defender"), ("ST", "Attacker"), ("DM", "Other"), (None, "Other"), (None, None)]
    names = spark.createDataFrame([(" Old�Trafford (Manchester)\t ground",), (None,)], "n string")
    assert [r[0] for r in names.select(S.place_name(F.col("n"))).collect()] == ["Old Trafford ground", ""]
    places = spark.createDataFrame([(1, "Santiago Bernabéu"), (2, "Estadio Santiago Bernabeu (Madrid)"), (3, "Elsewhere"), (4, None)], "place_id int, place_name string")
    curated = spark.createDataFrame([(1, "bernabeu", 1.0, 2.0), (2, "santiago bernabeu", 3.0, 4.0)], "position int, name string, lat double, lng double")
    at = {r.place_id: (r.lat, r.tier) for r in serving.located(places, curated).collect()}
    assert at == {1: (3.0, "exact"), 2: (1.0, "contained"), 3: (None, "unresolved"), 4: (None, "unresolved")}


def test_players_and_injuries(spark):
    known = spark.createDataFrame([(5, 100, "José Díaz"), (7, None, "Ann Bee")], "player_id int, source_id int, name string")
    new = spark.createDataFrame([(100, "renamed"), (200, "ann bee jr"), (300, "New One"), (301, "New One"), (300, "New One")], "source_id int, name string")
    assert {(r.source_id, r.player_id) for r in serving.players_merged(known, new).collect()} == {(100, 5), (200, 7), (300, 8), (301, 9)}
    day = dt.date(2020, 1, 1)
    hurt = spark.createDataFrame([(100, day, None), (100, None, day), (999, day, day)], "source_id int, start_day date, end_day date")
    assert [tuple(r) for r in serving.injuries_linked(hurt, known).select("player_id", "start_day", "end_day").collect()] == [(5, day, None)]


def test_graph_features_of_no_edges_are_zeros(spark):
    e = spark.createDataFrame([(1, "A", "B", 3), (1, "B", "C", 1)], "g int, src string, dst string, weight long")
    sides = spark.createDataFrame([(1, 2), (2, 0)], "g int, goals int")
    one, none = graph.feature_matrix(e, sides, ["g"], "goals").orderBy("g").collect()
    assert one.weighted_density == pytest.approx(4 / 6) and one.passes_per_player == pytest.approx(4 / 3) and one.edges_per_player == pytest.approx(2 / 3)
    assert one.hub_dominance > 1 and one.centralization == pytest.approx(one.betweenness_max - one.betweenness_mean) and one.goals == 2
    assert not any(tuple(none)[1:])


def test_elo_join_back(spark):
    m = spark.createDataFrame([(1, dt.date(2024, 1, 1), 10, 20, 2, 0), (2, dt.date(2024, 1, 2), 20, 10, 1, 1)], "match_id long, day date, home_id long, away_id long, home_score int, away_score int")
    rows = spark.createDataFrame([(2, 10), (2, 20), (3, 10)], "m int, t int")
    a, b, c = rating.with_elo(rows, rating.elo(m), "m", "t").orderBy("m", "t").collect()
    assert a.elo_diff > 0 and a.elo_diff == -b.elo_diff and a.elo_pre == b.opp_elo_pre and (c.elo_pre, c.opp_elo_pre, c.elo_diff) == (0, 0, 0)


def test_style_labels_are_unique_with_hybrids():
    means = {0: [5.0, 0.0], 1: [0.0, 5.0], 2: [1.0, 1.0]}
    assert clusters.style_labels(means, {"x": [1.0, -1.0], "y": [-1.0, 1.0]}) == {0: "x", 1: "y", 2: "Hybrid"}
    assert clusters.style_labels({0: [1.0, 1.0]}, {}) == {0: "Hybrid"}


def test_collinear_in_order(spark):
    rows = spark.createDataFrame([(float(i), float(i * i), float((i * 7) % 5)) for i in range(20)], "a double, b double, c double")
    assert learning.collinear_in_order(rows, ["a", "b", "c"]) == ["a", "c"] and learning.collinear_in_order(rows, ["c", "b", "a"]) == ["c", "b"]


def test_registry_and_saved_models(spark, tmp_path):
    card = lambda v, n: quality.card(spark, "xg", v, "classification", "boosted", {"auc": 0.7}, n)
    first = serving.registered(card("1", 10), card("2", 20))
    again = serving.registered(first, card("1", 30))
    assert [(r.version, r.n_train_rows) for r in serving.models_list(again).collect()] == [("1", 30), ("2", 20)]
    rows = spark.createDataFrame([(1, 1, m, float(m), float(m % 3)) for m in range(30)], "match_id int, team_id int, minute int, x double, label double")
    model = learning.fitted(rows, learning.features(["x"]), LogisticRegression(maxIter=5, family="multinomial"))
    serving.save_model(model, str(tmp_path / "m"))
    curve = serving.outcome_curve(rows, serving.load_model(str(tmp_path / "m")), {"win": 2, "draw": 1, "loss": 0}).collect()
    assert [r.minute for r in curve] == list(range(30)) and all(abs(r.win + r.draw + r.loss - 100) < 0.31 for r in curve)
    (tmp_path / "r.json").write_text('{"auc": 0.5, "n": 3}')
    assert serving.artifact(spark, str(tmp_path / "r.json")).first().n == 3


def test_masks_and_identifiers(spark):
    c = spark.createDataFrame([("postgres://me:secret@host/db",), ("postgres://host/db",), (None,)], "d string")
    assert [r[0] for r in c.select(serving.masked_dsn(F.col("d"))).collect()] == ["postgres://me:***@host/db", "postgres://host/db", None]
    assert serving.identifier("model_key") == "model_key"
    for bad in ("a b", "1a", "a;b", ""):
        with pytest.raises(ValueError):
            serving.identifier(bad)


@pytest.mark.parametrize("few", [2, 250_000])
def test_rank_correlations_equal_the_library_without_sorting_rows(spark, monkeypatch, few):
    import random

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    monkeypatch.setattr(learning, "FEW_VALUES", few)
    monkeypatch.setattr(Correlation, "corr", lambda *a: pytest.fail("sorts every value of every column"))
    draw = random.Random(3)
    rows = [(draw.choice([None, 1.0, 2.0]), draw.gauss(0, 1), i % 7, 4.0) for i in range(300)]
    df = spark.createDataFrame([(a, b, c, d, b**3 + (a or 0)) for a, b, c, d in rows], "a double, b double, c int, d double, e double")
    names = ["a", "b", "c", "d", "e"]
    got = learning._rank_correlations(df, names)
    monkeypatch.undo()
    data = VectorAssembler(inputCols=names, outputCol="v").transform(df.na.fill(0, names))
    want = Correlation.corr(data, "v", "spearman").first()[0].toArray()
    assert all(got[i][j] == pytest.approx(0.0 if want[i][j] != want[i][j] else want[i][j], abs=1e-9) for i in range(5) for j in range(5) if i != j)


def test_ratings_are_joined_once_a_match(spark):
    """Each side, a team against itself, a stranger, a match without rating, two ratings of a match; no rating is shuffled twice."""
    ratings = spark.createDataFrame([(1, 10, 20, 1500.0, 1600.0, 0.0), (2, 10, 10, 1510.0, 1520.0, 0.0), (3, 10, 20, 1.0, 2.0, 0.0), (3, 30, 40, 3.0, 4.0, 0.0), (None, 10, 20, 5.0, 6.0, 0.0)], rating.SCHEMA)
    rows = spark.createDataFrame([(1, 10), (1, 20), (1, 99), (2, 10), (3, 40), (7, 10), (None, 10), (1, None)], "m long, t long")
    got = sorted((r["m"] or 0, r["t"] or 0, r["elo_pre"], r["opp_elo_pre"]) for r in rating.with_elo(rows, ratings, "m", "t").collect())
    assert got == [(0, 10, 0, 0), (1, 0, 0, 0), (1, 10, 1500, 1600), (1, 20, 1600, 1500), (1, 99, 0, 0), (2, 10, 1510, 1520), (2, 10, 1520, 1510), (3, 40, 4, 3), (7, 10, 0, 0)]
    plan = rating.with_elo(rows.hint("merge"), ratings, "m", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # sides are made after the join
