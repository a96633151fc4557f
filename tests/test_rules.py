"""Hand-computed cases of the domain rules."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import events as E
from touchline.operators import graph, ordered, quality, rating, upsert
from touchline.sources import readers


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_scalars(spark):
    d = lambda s: F.lit(s).cast("date")
    r = one(
        spark, a=S.age_years(d("2021-02-28"), d("2000-02-29")), b=S.age_years(d("2021-03-01"), d("2000-02-29")), n=S.norm_name(F.lit("Ángel Di María Jr.")),
        g=S.shot_angle(F.lit(108.0), F.lit(40.0)), p=S.shot_angle(F.lit(120.0), F.lit(36.0)), c=S.in_cone(F.lit(114.0), F.lit(40.0), F.lit(108.0), F.lit(40.0)),
        e=S.elo_expected(F.lit(1500.0), F.lit(1500.0), 100.0), x=S.expected_points(F.lit(1.0), F.lit(1.0)), u=S.or_unknown(F.lit("  ")), i=S.safe_int(F.lit("7.0")), j=S.safe_int(F.lit("x")),
    )
    assert (r.a, r.b, r.n, r.p, r.c, r.u, r.i, r.j) == (20, 21, "angel di maria", 0.0, True, "Unknown", 7, None)
    assert r.g == pytest.approx(2 * math.atan(4 / 12)) and r.e == pytest.approx(0.640065, abs=1e-6) and 1.3 < r.x < 1.4
    assert spark.createDataFrame([("Ángel Di María Jr.",), (None,)], "n string").select(S.norm_name_full("n")).collect() == [("angel di maria",), ("",)]


def test_weather_and_buckets(spark):
    rows = [(5.0, None, None, "heavy_rain"), (1.0, None, None, "rain"), (None, 50.0, None, "windy"), (None, None, 4.9, "cold"), (None, None, 30.0, "hot"), (None, None, None, "clear")]
    df = spark.createDataFrame(rows, "p double, w double, t double, want string")
    assert df.where(S.weather_label(F.col("p"), F.col("w"), F.col("t")) != F.col("want")).count() == 0
    days = spark.createDataFrame([(-1,), (30,), (31,), (91,), (180,)], "d int").select(S.recency_bucket(F.col("d"))).collect()
    assert [r[0] for r in days] == ["no_history", "0-30d", "31-90d", "91-180d", "91-180d"]


def test_calendar_streak(spark):
    days = ["2024-01-01", "2024-01-08", "2024-04-01", "2024-04-08", "2024-04-15"]
    df = spark.createDataFrame([(1, dt.date.fromisoformat(d), True) for d in days], "k int, day date, played boolean")
    assert [r.streak_before for r in ordered.with_calendar_streak(df, ["k"], "day", "played").orderBy("day").collect()] == [0, 1, 2, 0, 2]


def test_start_streak(spark):
    df = spark.createDataFrame([(1, i, bool(s)) for i, s in enumerate([1, 1, 0, 1])], "k int, i int, f boolean")
    assert [r.streak_before for r in ordered.with_streak(df, ["k"], ["i"], "f").orderBy("i").collect()] == [0, 1, 2, 0]


def test_asof_and_last_n_exclude_the_same_day(spark):
    df = spark.createDataFrame([(1, 0, 5, 1.0), (1, 1, 3, 7.0), (1, 1, 7, 9.0), (1, 0, 2, 2.0)], "m int, side int, minute int, v double")
    got = {(r.side, r.minute): r.opp_v for r in ordered.asof_other(df, "m", "side", "minute", ["v"]).collect()}
    assert got == {(0, 5): 7.0, (0, 2): 0.0, (1, 3): 2.0, (1, 7): 1.0}
    df = spark.createDataFrame([(1, d, i, float(i)) for i, d in enumerate([1, 2, 3, 4, 5, 6, 7, 7])], "k int, dn int, id int, v double")
    out = {r.id: list(r.last) for r in ordered.with_last_before(df, ["k"], "dn", "id", "v", 5, "last").collect()}
    assert out[7] == out[6] == [5.0, 4.0, 3.0, 2.0, 1.0] and out[0] == []


def test_elo(spark):
    m = spark.createDataFrame([(1, dt.date(2024, 1, 1), 10, 20, 2, 0), (2, dt.date(2024, 1, 2), 20, 10, 1, 1)], "match_id long, day date, home_id long, away_id long, home_score int, away_score int")
    a, b = rating.elo(m).orderBy("match_id").collect()
    assert (a.home_elo, a.away_elo) == (1500.0, 1500.0) and a.delta == pytest.approx(10.798050, abs=1e-5)
    assert b.home_elo + b.away_elo == pytest.approx(3000.0)


def test_elo_streams_a_league(spark):
    """A league is never held whole: its matches pass in small batches, and leagues of one task don't mix."""
    rows = [(i, None if i == 5 else dt.date(2024, 1, 1) + dt.timedelta(i % 9), i % 4, (i + 1) % 4, None if i == 3 else i % 5, i % 3, i % 2) for i in range(60)]
    m = spark.createDataFrame(rows, "match_id long, day date, home_id long, away_id long, home_score int, away_score int, l int")
    want = {}
    for league in (0, 1):
        of: dict = {}
        for i, _, home, away, x, y, _ in sorted((r for r in rows if r[6] == league), key=lambda r: (r[1] is None, r[1] or dt.date.min, r[0])):
            h, a = of.get(home, 1500.0), of.get(away, 1500.0)
            d = 0.0 if x is None else 20 * rating.multiplier(abs(x - y)) * ((x > y) + 0.5 * (x == y) - 1 / (1 + 10 ** (-(h + 100 - a) / 400)))
            want[i] = (h, a, d)
            of[home], of[away] = h + d, a - d
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = rating.elo(m, "l")
        assert "InPandas" not in found._jdf.queryExecution().toString()
        assert {r.match_id: (r.home_elo, r.away_elo, r.delta) for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_graph(spark):
    e = spark.createDataFrame([(1, "A", "B", 1), (1, "B", "A", 1), (1, "B", "C", 1)], "g int, src string, dst string, weight long")
    r = graph.basics(e, ["g"]).first()
    assert (r.n_nodes, r.n_edges) == (3, 3) and r.density == pytest.approx(2 / 3) and r.reciprocity == pytest.approx(2 / 3) and r.degree_mean == 0.5
    assert graph.clustering(e, ["g"]).first().clustering == 0
    p = graph.path_metrics(e, ["g"]).first()
    assert p.betweenness_max == pytest.approx(0.5) and p.largest_component == 1.0
    two = [(1, a, b, 1) for a, b in ("AB", "BC", "CA", "XY", "YZ", "ZX", "CX")]
    assert graph.path_metrics(spark.createDataFrame(two, "g int, src string, dst string, weight long"), ["g"]).first().n_communities == 2


def test_upserts(spark):
    t = lambda *r: spark.createDataFrame(list(r), "k int, name string, v int")
    old, new = t((1, "Team 7", 1), (2, "Rovers", 2)), t((1, "Rovers", 5), (2, "Team 7", 6), (3, "Team 9", 7))
    rename = upsert.merged(old, new, ["k"], {"name": upsert.conditional_rename("name")})
    assert sorted(map(tuple, rename.collect())) == [(1, "Rovers"), (2, "Rovers"), (3, "Team 9")]
    once = upsert.last_wins(old, new, ["k"], "v")
    assert sorted(map(tuple, upsert.last_wins(once, new, ["k"], "v").collect())) == sorted(map(tuple, once.collect()))
    assert sorted(r.v for r in upsert.first_wins(old, new, ["k"], "v").collect()) == [1, 2, 7]
    assert upsert.scaffold(old.select("k"), new, ["k"]).count() == 3


EVENTS = [
    {"id": "x0", "minute": 0, "type": {"name": "Starting XI"}, "team": {"id": 1, "name": "H"}},
    {"id": "x1", "minute": 0, "type": {"name": "Starting XI"}, "team": {"id": 2, "name": "A"}},
    {"id": "b1", "minute": 60, "type": {"name": "Bad Behaviour"}, "player": {"id": 5, "name": "O"}, "team": {"id": 2, "name": "A"}, "bad_behaviour": {"card": {"name": "Second Yellow"}}},
    {"id": "s1", "minute": 3, "type": {"name": "Shot"}, "player": {"id": 9, "name": "N"}, "team": {"id": 1, "name": "H"}, "location": [108.0, 40.0],
     "shot": {"statsbomb_xg": 0.2, "outcome": {"name": "Goal"}, "body_part": {"name": "Knee"}, "freeze_frame": [
         {"teammate": False, "location": [114.0, 40.0], "position": {"name": "Center Back"}}, {"teammate": False, "location": [119.0, 40.0], "position": {"name": "Goalkeeper"}}]}},
    {"id": "s2", "minute": 5, "type": {"name": "Shot"}, "player": {"id": 9, "name": "N"}, "team": {"id": 1, "name": "H"}, "location": [100.0, 40.0], "shot": {"statsbomb_xg": 0.4, "outcome": {"name": "Saved"}}},
    {"id": "p1", "minute": 3, "type": {"name": "Pass"}, "player": {"id": 8, "name": "M"}, "team": {"id": 1, "name": "H"}, "location": [60.0, 40.0], "pass": {"recipient": {"id": 9}, "end_location": [90.0, 40.0], "assisted_shot_id": "s1"}},
    {"id": "p2", "minute": 7, "type": {"name": "Pass"}, "player": {"id": 8, "name": "M"}, "team": {"id": 1, "name": "H"}, "location": [60.0, 40.0], "pass": {"recipient": {"id": 9}, "end_location": [80.0, 40.0], "goal_assist": True}},
    {"id": "p3", "minute": 8, "type": {"name": "Pass"}, "player": {"id": 8, "name": "M"}, "team": {"id": 1, "name": "H"}, "location": [60.0, 40.0], "pass": {"outcome": {"name": "Incomplete"}, "recipient": {"id": 9}, "end_location": [99.0, 40.0]}},
    {"id": "c1", "minute": 9, "type": {"name": "Carry"}, "player": {"id": 8, "name": "M"}, "team": {"id": 1, "name": "H"}, "location": [40.0, 40.0], "carry": {"end_location": [52.0, 40.0]}},
    {"id": "c2", "minute": 9, "type": {"name": "Carry"}, "player": {"id": 8, "name": "M"}, "team": {"id": 1, "name": "H"}, "location": [30.0, 40.0], "carry": {"end_location": [45.0, 40.0]}},
    {"id": "u1", "minute": 70, "type": {"name": "Substitution"}, "player": {"id": 8, "name": "M"}, "team": {"id": 1, "name": "H"}},
    {"id": "z1", "minute": 94, "type": {"name": "Pressure"}, "player": {"id": 5, "name": "O"}, "team": {"id": 2, "name": "A"}},
]


@pytest.fixture
def root(tmp_path):
    for name, rows in (("events/77.json", EVENTS), ("lineups/77.json", [{"lineup": [{"player_id": 8, "positions": [
        {"position": "Wing", "start_reason": "Starting XI", "from_period": None}, {"position": "Center", "start_reason": "Starting XI", "from_period": 1}]}]}])):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(rows))
    (tmp_path / "p.csv").write_text(" TM ID , Full Name\n1,A B\n")
    return str(tmp_path)


def test_events(spark, root):
    ev = readers.events(spark, root)
    s = {r.player_id: r for r in E.player_stats(ev).collect()}
    assert (s[8].passes_attempted, s[8].passes_completed, s[8].pass_accuracy, s[8].progressive_passes, s[8].progressive_carries) == (3, 2, 66.67, 2, 1)  # an incomplete pass can be progressive
    assert s[8].xa == pytest.approx(0.2 + 0.3) and (s[8].minutes_played, s[9].minutes_played, s[9].goals) == (70, 94, 1)
    edge = E.pass_edges(ev).first()
    assert (edge.match_id, edge.passer_id, edge.receiver_id, edge.pass_count, edge.avg_x_end) == (77, 8, 9, 2, 85.0)
    snap = {(r.team_id, r.minute): r for r in E.snapshots(ev).collect()}
    assert snap[1, 3].pass_acc_so_far == 100 and snap[1, 8].pass_acc_so_far == 66.67 and (1, 6) not in snap and snap[1, 70].goals_so_far == 1
    shot = E.shots(ev).orderBy("minute").first()
    assert (shot.distance, shot.angle, shot.defenders_in_cone, shot.gk_dist_to_goal, shot.body_part) == (12.0, 0.6435, 1, 1.0, "Other")
    assert (s[5].yellow_cards, s[5].red_cards) == (1, 0)  # a second yellow is a yellow
    both = E.match_summary(ev).first()
    assert (both.home_team_id, both.away_team_id, both.home_goals, both.away_goals, both.home_xg) == (1, 2, 1, 0, 0.6)
    assert E.match_summary(ev.where("id <> 'x1'")).first().home_goals == 0  # one line-up names no sides
    assert E.starting_positions(readers.lineups(spark, root)).collect() == [(77, 8, "Center")]
    assert {r.reason: r.n for r in E.validity(ev).collect()} == {"valid": 10, "missing player": 2}
    assert readers.csv_file(spark, f"{root}/p.csv").columns == ["player_id", "full_name"]


def test_quality(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    found = {(r.column_name, r.finding) for r in quality.conformance(df, {"k": "int", "v": "int", "w": "string"}).collect()}
    assert found == {("v", "type mismatch"), ("w", "missing")}
    p = {r.column_name: r for r in quality.profile(df).collect()}
    assert p["v"].n_null == 0 and p["k"].n_distinct == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    from touchline.streaming import windows

    assert windows.run_once(spark, sf, str(tmp_path)).exceptAll(windows.batch(spark, sf)).count() == 0


def test_containment_at_any_place(spark):
    from touchline.operators import joins

    left = [(1, "estadio santiago bernabeu"), (2, "wembley"), (3, "a"), (4, ""), (5, None), (6, "wembley"), (7, "camp nou"), (8, "nab")]
    right = [(1, "santiago bernabeu"), (2, "old wembley stadium"), (3, "nou"), (4, ""), (5, "bernabeu"), (6, None), (7, "camp noux"), (8, "mp n")]
    got = joins.contains_either_way(spark.createDataFrame(left, "a long, an string"), "an", spark.createDataFrame(right, "b long, bn string"), "bn")
    want = sorted((a, b) for a, x in left for b, y in right if x and y and (x in y or y in x))
    assert sorted((r.a, r.b) for r in got.collect()) == want and (1, 1) in want
    plan = joins.contains_either_way(spark.createDataFrame(left, "a long, an string"), "an", spark.createDataFrame(right, "b long, bn string"), "bn")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 6 and plan.count("BroadcastHashJoin") == 0  # names never go through the driver
