"""Event operators over nested match events, which are made of the order lines: sixteen orders are a match, a line is an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events as E
from ..operators import profiles
from ..sources.readers import run_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: One row per event in flat columns; text that both engines read.
_FLAT = """SELECT CAST(floor(o / 16) AS BIGINT) AS match_id, (o % 16) * 8 + ln AS seq, concat(CAST(o AS VARCHAR(20)), '-', CAST(ln AS VARCHAR(20))) AS id,
  CASE WHEN ln = 1 AND o % 16 < 2 THEN 'Starting XI' WHEN p % 41 = 0 THEN NULL WHEN p % 16 < 2 THEN 'Shot' WHEN p % 16 < 7 THEN 'Pass' WHEN p % 16 < 9 THEN 'Carry' WHEN p % 16 = 9 THEN 'Dribble'
    WHEN p % 16 = 10 THEN 'Duel' WHEN p % 16 = 11 THEN 'Interception' WHEN p % 16 = 12 THEN 'Clearance' WHEN p % 16 = 13 THEN 'Pressure' WHEN p % 16 = 14 THEN 'Bad Behaviour' ELSE 'Substitution' END AS kind,
  CASE WHEN ln = 1 AND o % 16 < 2 OR p % 23 = 0 THEN NULL ELSE s % 10 + 1 END AS player_id,
  CASE WHEN ln = 1 AND o % 16 < 2 THEN o % 2 + 1 ELSE s % 2 + 1 END AS team_id, p % 29 = 0 AS nowhere,
  CAST((p * 7 + s * 3 + ln * 11) % 120 AS DOUBLE) AS x, CAST((p * 5 + ln * 13) % 80 AS DOUBLE) AS y,
  CAST((p * 11 + o) % 121 AS DOUBLE) AS ex, CAST((o * 3 + ln) % 81 AS DOUBLE) AS ey, CASE WHEN ln <> 6 THEN d / 7.0 + 0.0137 END AS xg,
  CASE WHEN rf = 'A' THEN 'Goal' ELSE 'Saved' END AS shot_outcome, CASE WHEN rf = 'R' THEN 'Incomplete' END AS pass_outcome,
  CASE WHEN rf = 'A' THEN 'Complete' ELSE 'Incomplete' END AS dribble_outcome, CASE WHEN rf = 'N' THEN 'Tackle' ELSE 'Aerial Lost' END AS duel_type,
  rf = 'A' AND s % 5 = 0 AS goal_assist, ls = 'O' AND s % 4 = 0 AS shot_assist, CASE WHEN s % 3 = 0 THEN concat(CAST(o AS VARCHAR(20)), '-', CAST(ln + 1 AS VARCHAR(20))) END AS assisted,
  CASE WHEN p % 31 <> 0 THEN (p + o) % 10 + 1 END AS recipient_id,
  CASE s % 4 WHEN 0 THEN 'Yellow Card' WHEN 1 THEN 'Second Yellow' WHEN 2 THEN 'Red Card' END AS card,
  CASE p % 3 WHEN 0 THEN 'Right Foot' WHEN 1 THEN 'Head' ELSE 'Knee' END AS body_part, p % 13 AS frame, s % 2 = 0 AS b_mate, s % 7 = 0 AS c_hidden, CAST(38 + s % 5 AS DOUBLE) AS c_y
FROM (SELECT l_orderkey AS o, l_linenumber AS ln, max(l_partkey) AS p, max(l_suppkey) AS s, max(l_discount) AS d, max(l_returnflag) AS rf, max(l_linestatus) AS ls
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS b"""
_SQL = f"WITH f AS ({_FLAT.format(lineitem='lineitem')}), e AS (SELECT *, CASE WHEN NOT nowhere THEN x END AS lx, CASE WHEN NOT nowhere THEN y END AS ly FROM f) "


def match_events(spark: SparkSession, d: str) -> DataFrame:
    """The events as the sources read them from match files."""
    named = lambda field, value: f"IF({value} IS NULL, NULL, named_struct('{field}', {value}))"
    player = lambda mate, where, position: f"named_struct('teammate', {mate}, 'location', {where}, 'position', named_struct('name', {position}))"
    frame = f"""array({player('CAST(NULL AS BOOLEAN)', 'array(x + 4, y)', 'CAST(NULL AS STRING)')}, {player('b_mate', 'array(ex, ey)', "'Center Back'")},
      {player('false', 'IF(c_hidden, NULL, array(CAST(118 AS DOUBLE), c_y))', "'Goalkeeper'")})"""
    shot = f"""named_struct('statsbomb_xg', xg, 'outcome', named_struct('name', shot_outcome), 'body_part', named_struct('name', body_part), 'type', named_struct('name', 'Open Play'),
      'technique', named_struct('name', 'Normal'), 'first_time', CAST(NULL AS BOOLEAN), 'freeze_frame', CASE frame WHEN 0 THEN NULL WHEN 1 THEN slice({frame}, 1, 0) ELSE {frame} END)"""
    passed = f"""named_struct('outcome', {named('name', 'pass_outcome')}, 'recipient', {named('id', 'recipient_id')}, 'end_location', array(ex, ey),
      'goal_assist', IF(goal_assist, true, NULL), 'shot_assist', IF(shot_assist, true, NULL), 'assisted_shot_id', assisted)"""
    only = lambda kind, struct: f"IF(kind = '{kind}', {struct}, NULL)"
    return run_sql(spark, d, _FLAT).selectExpr(
        "match_id", "seq", "id", "CAST(seq AS INT) AS minute", f"{named('name', 'kind')} AS type", "IF(player_id IS NULL, NULL, named_struct('id', player_id, 'name', CAST(player_id AS STRING))) AS player",
        "named_struct('id', team_id, 'name', CAST(team_id AS STRING)) AS team", "named_struct('name', 'Regular Play') AS play_pattern", "CAST(NULL AS BOOLEAN) AS under_pressure",
        "IF(nowhere, NULL, array(x, y)) AS location", f"{only('Shot', shot)} AS shot", f"{only('Pass', passed)} AS pass", f"{only('Carry', "named_struct('end_location', array(ex, ey))")} AS carry",
        f"{only('Dribble', "named_struct('outcome', named_struct('name', dribble_outcome))")} AS dribble", f"{only('Duel', "named_struct('type', named_struct('name', duel_type))")} AS duel",
        f"{only('Bad Behaviour', f"named_struct('card', {named('name', 'card')})")} AS bad_behaviour",
    )


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = lambda spark, d: f(match_events(spark, d))
        ORACLE[name] = _SQL + sql
        return f

    return put


_GOAL = "sqrt(pow(120 - {0}, 2) + pow(40 - {1}, 2))"
_GAIN = f"{_GOAL.format('lx', 'ly')} - {_GOAL.format('ex', 'ey')}"


@query("match_player_stats", f""", s AS (SELECT match_id, id, coalesce(xg, 0) AS xg FROM e WHERE kind = 'Shot'), m AS (SELECT match_id, avg(xg) AS mean FROM s GROUP BY match_id),
a AS (SELECT e.match_id, player_id, sum(CASE WHEN s.id IS NOT NULL THEN s.xg WHEN goal_assist THEN coalesce(mean, 0) ELSE 0 END) AS xa
  FROM e LEFT JOIN s ON s.match_id = e.match_id AND s.id = assisted LEFT JOIN m ON m.match_id = e.match_id WHERE kind = 'Pass' GROUP BY e.match_id, player_id),
z AS (SELECT match_id, max(seq) AS last FROM e GROUP BY match_id),
g AS (SELECT match_id, player_id, count(*) FILTER (WHERE kind = 'Shot' AND shot_outcome = 'Goal') AS goals, count(*) FILTER (WHERE kind = 'Pass' AND goal_assist) AS assists,
  count(*) FILTER (WHERE kind = 'Shot') AS shots, round(coalesce(sum(xg) FILTER (WHERE kind = 'Shot'), 0), 4) AS xg, count(*) FILTER (WHERE kind = 'Pass' AND (goal_assist OR shot_assist)) AS key_passes,
  count(*) FILTER (WHERE kind = 'Pass') AS passes_attempted, count(*) FILTER (WHERE kind = 'Pass' AND pass_outcome IS NULL) AS passes_completed,
  count(*) FILTER (WHERE kind = 'Pass' AND {_GAIN} >= 25) AS progressive_passes,
  round(coalesce(sum(sqrt(pow(ex - lx, 2) + pow(ey - ly, 2))) FILTER (WHERE kind = 'Carry'), 0), 2) AS carry_distance,
  count(*) FILTER (WHERE kind = 'Carry' AND {_GAIN} >= 10 AND ex >= 48) AS progressive_carries,
  count(*) FILTER (WHERE kind = 'Dribble' AND dribble_outcome = 'Complete') AS dribbles_completed, count(*) FILTER (WHERE kind = 'Duel' AND duel_type = 'Tackle') AS tackles,
  count(*) FILTER (WHERE kind = 'Interception') AS interceptions, count(*) FILTER (WHERE kind = 'Clearance') AS clearances, count(*) FILTER (WHERE kind = 'Pressure') AS pressures,
  count(*) FILTER (WHERE kind = 'Bad Behaviour' AND card IN ('Yellow Card', 'Second Yellow')) AS yellow_cards, count(*) FILTER (WHERE kind = 'Bad Behaviour' AND card = 'Red Card') AS red_cards,
  min(seq) FILTER (WHERE kind = 'Substitution') AS sub_minute FROM e WHERE player_id IS NOT NULL GROUP BY match_id, player_id)
SELECT g.*, round(coalesce(xa, 0), 4) AS xa, coalesce(sub_minute, last) AS minutes_played, round(CASE WHEN passes_attempted > 0 THEN passes_completed * 100.0 / passes_attempted ELSE 0 END, 2) AS pass_accuracy
FROM g JOIN z ON z.match_id = g.match_id LEFT JOIN a ON a.match_id = g.match_id AND a.player_id = g.player_id""")
def match_player_stats(events):
    return E.player_stats(events).drop("team_id", "player_name")


@query("match_summaries", """, x AS (SELECT match_id, team_id, row_number() OVER (PARTITION BY match_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY match_id) AS n FROM e WHERE kind = 'Starting XI'),
h AS (SELECT match_id, max(team_id) FILTER (WHERE k = 1) AS home, max(team_id) FILTER (WHERE k = 2) AS away FROM x WHERE n >= 2 GROUP BY match_id)
SELECT e.match_id, max(home) AS home_team_id, max(away) AS away_team_id, count(*) FILTER (WHERE kind = 'Shot' AND shot_outcome = 'Goal' AND team_id = home) AS home_goals,
  count(*) FILTER (WHERE kind = 'Shot' AND shot_outcome = 'Goal' AND team_id = away AND team_id <> home) AS away_goals, round(coalesce(sum(xg) FILTER (WHERE kind = 'Shot' AND team_id = home), 0), 4) AS home_xg,
  round(coalesce(sum(xg) FILTER (WHERE kind = 'Shot' AND team_id = away AND team_id <> home), 0), 4) AS away_xg, count(*) AS total_events
FROM e LEFT JOIN h ON h.match_id = e.match_id GROUP BY e.match_id""")
def match_summaries(events):
    return E.match_summary(events)


@query("match_pass_edges", """SELECT match_id, team_id, player_id AS passer_id, recipient_id AS receiver_id, count(*) AS pass_count, round(sum(coalesce(lx, 0)) / count(*), 2) AS avg_x_start,
  round(sum(coalesce(ly, 0)) / count(*), 2) AS avg_y_start, round(avg(ex), 2) AS avg_x_end, round(avg(ey), 2) AS avg_y_end
FROM e WHERE kind = 'Pass' AND pass_outcome IS NULL AND recipient_id IS NOT NULL AND player_id IS NOT NULL GROUP BY match_id, team_id, player_id, recipient_id""")
def match_pass_edges(events):
    return E.pass_edges(events)


@query("match_snapshots", """, t AS (SELECT DISTINCT match_id, team_id, seq AS minute FROM e), r AS (SELECT t.match_id, t.team_id, minute,
  count(*) FILTER (WHERE kind = 'Shot' AND shot_outcome = 'Goal') AS goals_so_far, round(coalesce(sum(xg) FILTER (WHERE kind = 'Shot'), 0), 4) AS xg_so_far, count(*) FILTER (WHERE kind = 'Shot') AS shots_so_far,
  count(*) FILTER (WHERE kind = 'Pass') AS passes_so_far, count(*) FILTER (WHERE kind = 'Pass' AND pass_outcome IS NULL) AS done, count(*) FILTER (WHERE kind = 'Pressure') AS pressures_so_far,
  count(*) FILTER (WHERE kind = 'Bad Behaviour' AND card = 'Red Card') AS red_cards_so_far FROM t JOIN e ON e.match_id = t.match_id AND e.team_id = t.team_id AND e.seq <= t.minute GROUP BY t.match_id, t.team_id, minute)
SELECT match_id, team_id, minute, goals_so_far, xg_so_far, shots_so_far, passes_so_far, round(CASE WHEN passes_so_far > 0 THEN done * 100.0 / passes_so_far ELSE 0 END, 2) AS pass_acc_so_far,
  pressures_so_far, red_cards_so_far FROM r""")
def match_snapshots(events):
    return E.snapshots(events)


_SIDE = "(({px}) - ({bx})) * (({ay}) - ({by})) - (({ax}) - ({bx})) * (({py}) - ({by}))"


def _cone(px: str, py: str) -> str:
    d = [_SIDE.format(px=px, py=py, ax=a, ay=b, bx=c, by=e) for a, b, c, e in (("x", "y", "120", "36"), ("120", "36", "120", "44"), ("120", "44", "x", "y"))]
    return f"NOT (least({', '.join(d)}) < 0 AND greatest({', '.join(d)}) > 0)"


@query("match_shots", f"""SELECT id AS sb_event_id, match_id, player_id, team_id, seq AS minute, x, y, round({_GOAL.format('x', 'y')}, 3) AS distance,
  CASE WHEN body_part = 'Knee' THEN 'Other' ELSE body_part END AS body_part, shot_outcome = 'Goal' AS is_goal, xg AS statsbomb_xg,
  CASE WHEN frame > 1 THEN CASE WHEN {_cone('x + 4', 'y')} THEN 1 ELSE 0 END + CASE WHEN NOT b_mate AND {_cone('ex', 'ey')} THEN 1 ELSE 0 END END AS defenders_in_cone,
  CASE WHEN frame > 1 THEN round(CASE WHEN b_mate THEN 4.0 ELSE least(4.0, sqrt(pow(ex - x, 2) + pow(ey - y, 2))) END, 3) END AS dist_to_nearest_def,
  CASE WHEN frame > 1 AND NOT c_hidden THEN round({_GOAL.format('118', 'c_y')}, 3) END AS gk_dist_to_goal,
  CASE WHEN frame > 1 AND NOT c_hidden THEN round(sqrt(pow(118 - x, 2) + pow(c_y - y, 2)), 3) END AS gk_dist_to_shot
FROM e WHERE kind = 'Shot' AND NOT nowhere""")
def match_shots(events):
    return E.shots(events).drop("angle", "shot_type", "technique", "play_pattern", "under_pressure", "first_time")


@query("event_validity", """SELECT CASE WHEN player_id IS NULL THEN 'missing player' WHEN kind IS NULL THEN 'missing type' ELSE 'valid' END AS reason, count(*) AS n FROM e GROUP BY 1""")
def event_validity(events):
    return E.validity(events)


@query("event_presets", """SELECT 'attack' AS preset, count(*) AS n FROM e WHERE kind IN ('Shot', 'Dribble', 'Carry') UNION ALL
SELECT 'defence', count(*) FROM e WHERE kind IN ('Duel', 'Interception', 'Clearance', 'Pressure', 'Block') UNION ALL
SELECT 'setpiece', count(*) FROM e WHERE kind IN ('Pass', 'Free Kick', 'Corner Received') UNION ALL SELECT 'all', count(*) FROM e""")
def event_presets(events):
    parts = [E.preset(events, p).agg(F.count("*").alias("n")).select(F.lit(p).alias("preset"), "n") for p in ("attack", "defence", "setpiece", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_POSITIONS = "'Goalkeeper', 'Left Wing Back', 'Center Midfield', 'Left Wing', 'Secondary Striker', 'Substitute', ''"


@query("position_groups", """SELECT CASE coalesce(player_id, 0) % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'GK' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 7 THEN 'unknown' ELSE 'FWD' END AS position_group, count(*) AS n
FROM e GROUP BY 1""")
def position_groups(events):
    name = F.expr(f"try_element_at(array({_POSITIONS}), CAST(nullif(coalesce(player.id, 0) % 8, 0) AS INT))")
    return events.groupBy(S.position_group(name).alias("position_group")).agg(F.count("*").alias("n"))


_STATS = ORACLE["match_player_stats"]
_NAMES = "'Goalkeeper', 'Left Back', 'Center Midfield', 'Left Wing', 'Secondary Striker'"


def _positioned(events: DataFrame) -> DataFrame:
    """Statistics with the position of each appearance."""
    return E.player_stats(events).withColumn("position", F.expr(f"element_at(array({_NAMES}), CAST((player_id + match_id % 3) % 5 + 1 AS INT))"))


_EFFICIENCY = ", ".join(f"avg({c}) AS {n}" for n, c in profiles.MEANS.items())
_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in profiles.MEANS)
_RADAR = ", ".join(f"round(greatest(0, least(100, {c} * {k})), 1) AS radar_{a}" for a, (c, k) in profiles.RADAR.items())


@query("efficiency_profiles", f"""SELECT team_id, player_id, position, matches, round(minutes, 6) AS minutes, rank, {_ROUNDED}, {_RADAR},
  CASE WHEN player_id % 4 = 0 THEN 'Unclassified' ELSE 'type ' || (player_id % 4)::VARCHAR END AS player_type FROM (
  SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY best DESC, player_id) AS rank FROM (
    SELECT t.team_id, ps.player_id, mode(position ORDER BY position) AS position, count(*) AS matches, avg(minutes_played) * count(*) AS minutes, avg(xa + xg) AS best, {_EFFICIENCY}
    FROM ({_STATS}) ps JOIN (SELECT match_id, player_id, arg_max(team_id, seq) AS team_id, [{_NAMES}][(player_id + match_id % 3) % 5 + 1] AS position FROM e WHERE player_id IS NOT NULL GROUP BY match_id, player_id) t
      ON t.match_id = ps.match_id AND t.player_id = ps.player_id GROUP BY t.team_id, ps.player_id HAVING count(*) >= 3)) WHERE rank <= 12""")
def efficiency_profiles(events):
    stats = _positioned(events)
    types = stats.select("player_id").distinct().where("player_id % 4 <> 0").select("player_id", F.concat(F.lit("type "), (F.col("player_id") % 4).cast("string")).alias("player_type"))
    out = profiles.efficiency(stats, types)
    return out.withColumns({c: F.round(c, 6) for c in ("minutes", *profiles.MEANS)}).withColumn("rank", F.col("rank").cast("long"))


@query("style_vectors", f"""SELECT player_id, sum(minutes_played) AS total_minutes, round(avg(pass_accuracy), 6) AS pass_accuracy, round(sum(xg) / (sum(minutes_played) / 90.0), 6) AS xg_90, round(sum(xa) / (sum(minutes_played) / 90.0), 6) AS xa_90,
  round(sum(shots) / (sum(minutes_played) / 90.0), 6) AS shots_90, round(sum(goals) / (sum(minutes_played) / 90.0), 6) AS goals_90, round(sum(passes_attempted) / (sum(minutes_played) / 90.0), 6) AS passes_90,
  round(sum(progressive_carries) / (sum(minutes_played) / 90.0), 6) AS carries_90, round(sum(passes_attempted + dribbles_completed) / (sum(minutes_played) / 90.0), 6) AS touches_90,
  round(sum(progressive_passes + progressive_carries) / (sum(minutes_played) / 90.0), 6) AS progressive_actions_90, round(sum(tackles) / (sum(minutes_played) / 90.0), 6) AS tackles_90,
  round(sum(interceptions) / (sum(minutes_played) / 90.0), 6) AS interceptions_90, round(sum(pressures) / (sum(minutes_played) / 90.0), 6) AS pressures_90 FROM ({_STATS}) ps GROUP BY player_id HAVING sum(minutes_played) > 0""")
def style_vectors(events):
    v = profiles.style_vector(E.player_stats(events))
    return v.select("player_id", "total_minutes", *[F.round(c, 6).alias(c) for c in v.columns[2:]])


@query("subbed_off", "SELECT DISTINCT match_id, player_id FROM e WHERE kind = 'Substitution' AND player_id IS NOT NULL")
def subbed_off(events):
    return profiles.subbed_off(events)


@query("match_players_named", """SELECT match_id, player_id, arg_max(team_id, seq) AS team_id, max(player_id::VARCHAR) AS player_name FROM e WHERE player_id IS NOT NULL GROUP BY match_id, player_id""")
def match_players_named(events):
    return E.player_stats(events).select("match_id", "player_id", "team_id", "player_name")
