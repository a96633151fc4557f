"""Match events: player statistics, pass edges, minute snapshots, line-ups, shot rows. Pure DataFrame plans over nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def _flat(events: DataFrame) -> DataFrame:
    at = lambda c, i: F.when(F.size(c) >= 2, F.get(F.col(c), F.lit(i)))
    return events.select(
        "match_id", "seq", "id", "minute", F.col("type.name").alias("kind"), F.col("player.id").alias("player_id"),
        F.col("player.name").alias("player_name"), F.col("team.id").alias("team_id"), F.col("team.name").alias("team_name"),
        at("location", 0).alias("x"), at("location", 1).alias("y"),
        F.when(F.size("pass.end_location") >= 2, F.col("pass.end_location")[0]).alias("px"), F.when(F.size("pass.end_location") >= 2, F.col("pass.end_location")[1]).alias("py"),
        F.when(F.size("carry.end_location") >= 2, F.col("carry.end_location")[0]).alias("cx"), F.when(F.size("carry.end_location") >= 2, F.col("carry.end_location")[1]).alias("cy"),
        F.col("shot.statsbomb_xg").alias("xg"), F.col("shot.outcome.name").alias("shot_outcome"), F.col("pass.outcome.name").alias("pass_outcome"),
        F.col("pass.recipient.id").alias("recipient_id"), F.col("pass.goal_assist").alias("goal_assist"), F.col("pass.shot_assist").alias("shot_assist"),
        F.col("pass.assisted_shot_id").alias("assisted_shot_id"), F.col("dribble.outcome.name").alias("dribble_outcome"), F.col("duel.type.name").alias("duel_type"),
        F.col("bad_behaviour.card.name").alias("card"),
    )


def expected_assists(e: DataFrame) -> DataFrame:
    """(match_id, player_id, xa): xG of the linked shots; a goal assist without a link counts the match's mean xG."""
    shots = e.where("kind = 'Shot'").select(F.col("match_id").alias("__m"), F.col("id").alias("__shot"), F.coalesce("xg", F.lit(0.0)).alias("shot_xg"))
    mean = shots.groupBy("__m").agg(F.avg("shot_xg").alias("mean_xg"))
    passes = e.where("kind = 'Pass' AND (assisted_shot_id IS NOT NULL OR goal_assist)")
    linked = passes.join(shots, (F.col("match_id") == F.col("__m")) & (F.col("assisted_shot_id") == F.col("__shot")), "left").drop("__m")
    linked = linked.join(mean, F.col("match_id") == F.col("__m"), "left")
    xa = F.coalesce("shot_xg", F.when(F.coalesce("goal_assist", F.lit(False)), F.coalesce("mean_xg", F.lit(0.0))), F.lit(0.0))
    return linked.groupBy("match_id", "player_id").agg(F.sum(xa).alias("xa"))


def player_stats(events: DataFrame) -> DataFrame:
    """One row per match and player: 21 counters and sums in one aggregate."""
    e = _flat(events)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("int")
    k = F.col("kind")
    goal = lambda x, y: S.distance(F.col(x), F.col(y))
    gain_pass, gain_carry = goal("x", "y") - goal("px", "py"), goal("x", "y") - goal("cx", "cy")
    done = (k == "Pass") & F.col("pass_outcome").isNull()
    stats = e.where("player_id IS NOT NULL").groupBy("match_id", "player_id").agg(
        F.max_by("team_id", "seq").alias("team_id"), F.max_by("player_name", "seq").alias("player_name"),
        n((k == "Shot") & (F.col("shot_outcome") == "Goal")).alias("goals"), n((k == "Pass") & F.coalesce("goal_assist", F.lit(False))).alias("assists"),
        n(k == "Shot").alias("shots"), F.round(F.sum(F.when(k == "Shot", F.coalesce("xg", F.lit(0.0))).otherwise(0.0)), 4).alias("xg"),
        n((k == "Pass") & (F.coalesce("shot_assist", F.lit(False)) | F.coalesce("goal_assist", F.lit(False)))).alias("key_passes"),
        n(k == "Pass").alias("passes_attempted"), n(done).alias("passes_completed"),
        n((k == "Pass") & (gain_pass >= S.PROGRESSIVE_PASS)).alias("progressive_passes"),
        F.round(F.sum(F.when(k == "Carry", F.coalesce(S.distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")), F.lit(0.0))).otherwise(0.0)), 2).alias("carry_distance"),
        n((k == "Carry") & (gain_carry >= S.PROGRESSIVE_CARRY) & (F.col("cx") >= S.CARRY_END_X)).alias("progressive_carries"),
        n((k == "Dribble") & (F.col("dribble_outcome") == "Complete")).alias("dribbles_completed"),
        n((k == "Duel") & (F.col("duel_type") == "Tackle")).alias("tackles"), n(k == "Interception").alias("interceptions"),
        n(k == "Clearance").alias("clearances"), n(k == "Pressure").alias("pressures"),
        n((k == "Bad Behaviour") & F.col("card").isin("Yellow Card", "Second Yellow")).alias("yellow_cards"),
        n((k == "Bad Behaviour") & (F.col("card") == "Red Card")).alias("red_cards"),
        F.min_by(F.when(k == "Substitution", F.col("minute")), F.when(k == "Substitution", F.col("seq"))).alias("sub_minute"),
    )
    last = e.groupBy(F.col("match_id").alias("__m")).agg(F.max("minute").alias("__last"))
    xa = expected_assists(e).select(F.col("match_id").alias("__xm"), F.col("player_id").alias("__xp"), "xa")
    rows = stats.join(last, F.col("match_id") == F.col("__m"))
    rows = rows.join(xa, (F.col("match_id") == F.col("__xm")) & (F.col("player_id") == F.col("__xp")), "left").drop("__m", "__xm", "__xp")
    return rows.withColumns({
        "xa": F.round(F.coalesce("xa", F.lit(0.0)), 4), "minutes_played": F.coalesce("sub_minute", "__last"),
        "pass_accuracy": F.round(S.rate(F.col("passes_completed"), F.col("passes_attempted")), 2),
    }).drop("__last")


def match_summary(events: DataFrame) -> DataFrame:
    """(match_id, both team ids, goals and xG of both sides, total events); the first two Starting XI events name home and away, one alone names nobody."""
    e = _flat(events)
    listed = e.where("kind = 'Starting XI' AND team_id IS NOT NULL").select(F.col("match_id").alias("__m"), "seq", "team_id")
    sides = listed.groupBy("__m").agg(F.sort_array(F.collect_list(F.struct("seq", "team_id")))["team_id"].alias("__t")).where(F.size("__t") >= 2)
    rows = e.join(sides.select("__m", F.col("__t")[0].alias("home_team_id"), F.col("__t")[1].alias("away_team_id")), F.col("match_id") == F.col("__m"), "left").drop("__m")
    shot, home = F.col("kind") == "Shot", F.col("team_id") == F.col("home_team_id")
    away = ~home & (F.col("team_id") == F.col("away_team_id"))
    goals = lambda side: F.sum(F.when(shot & side & (F.col("shot_outcome") == "Goal"), 1).otherwise(0))
    xg = lambda side: F.round(F.sum(F.when(shot & side, F.coalesce("xg", F.lit(0.0))).otherwise(0.0)), 4)
    return rows.groupBy("match_id").agg(
        F.max("home_team_id").alias("home_team_id"), F.max("away_team_id").alias("away_team_id"), goals(home).alias("home_goals"), goals(away).alias("away_goals"),
        xg(home).alias("home_xg"), xg(away).alias("away_xg"), F.count("*").alias("total_events"),
    )


def pass_edges(events: DataFrame) -> DataFrame:
    """(match_id, team_id, passer_id, receiver_id, pass_count, mean places); a missing place adds 0 to the sum and 1 to the count."""
    e = _flat(events).where("kind = 'Pass' AND pass_outcome IS NULL AND recipient_id IS NOT NULL AND player_id IS NOT NULL")
    mean = lambda c: F.round(F.sum(F.coalesce(c, F.lit(0.0))) / F.count("*"), 2)
    return e.groupBy("match_id", "team_id", F.col("player_id").alias("passer_id"), F.col("recipient_id").alias("receiver_id")).agg(
        F.count("*").alias("pass_count"), mean("x").alias("avg_x_start"), mean("y").alias("avg_y_start"), mean("px").alias("avg_x_end"), mean("py").alias("avg_y_end")
    )


def snapshots(events: DataFrame) -> DataFrame:
    """Running totals per match, team and minute that has an event of the team."""
    e = _flat(events).where("team_id IS NOT NULL AND minute IS NOT NULL")
    k = F.col("kind")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    per = e.groupBy("match_id", "team_id", "minute").agg(
        n((k == "Shot") & (F.col("shot_outcome") == "Goal")).alias("goals"), F.sum(F.when(k == "Shot", F.coalesce("xg", F.lit(0.0))).otherwise(0.0)).alias("xg"),
        n(k == "Shot").alias("shots"), n(k == "Pass").alias("passes"), n((k == "Pass") & F.col("pass_outcome").isNull()).alias("done"),
        n(k == "Pressure").alias("pressures"), n((k == "Bad Behaviour") & (F.col("card") == "Red Card")).alias("reds"),
    )
    w = Window.partitionBy("match_id", "team_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    run = {c: F.sum(c).over(w) for c in ("goals", "xg", "shots", "passes", "done", "pressures", "reds")}
    return per.select(
        "match_id", "team_id", "minute", run["goals"].alias("goals_so_far"), F.round(run["xg"], 4).alias("xg_so_far"), run["shots"].alias("shots_so_far"),
        run["passes"].alias("passes_so_far"), F.round(S.rate(run["done"], run["passes"]), 2).alias("pass_acc_so_far"), run["pressures"].alias("pressures_so_far"), run["reds"].alias("red_cards_so_far"),
    )


def starting_positions(lineups: DataFrame) -> DataFrame:
    """(match_id, player_id, position): the earliest Starting XI entry, a missing period last."""
    rows = lineups.select("match_id", F.explode("lineup").alias("p"))
    start = F.filter("p.positions", lambda x: x["start_reason"] == "Starting XI")
    first = F.array_min(F.transform(start, lambda x: F.struct(F.coalesce(x["from_period"], F.lit(99)).alias("period"), x["position"].alias("position"))))
    return rows.select("match_id", F.col("p.player_id").alias("player_id"), first["position"].alias("position")).where("position IS NOT NULL")


def shots(events: DataFrame) -> DataFrame:
    """One row per shot with geometry and freeze-frame features."""
    e = events.where(F.col("type.name") == "Shot").where(F.size("location") >= 2)
    x, y = F.col("location")[0], F.col("location")[1]
    # a player without a team flag is an opponent, one without a position an outfield player
    opponents = F.filter("shot.freeze_frame", lambda p: ~F.coalesce(p["teammate"], F.lit(False)))
    frame = F.filter(opponents, lambda p: F.coalesce(F.size(p["location"]) >= 2, F.lit(False)))
    in_goal = lambda p: F.coalesce(p["position"]["name"] == "Goalkeeper", F.lit(False))
    keeper, field = F.filter(frame, in_goal), F.filter(frame, lambda p: ~in_goal(p))
    gk = F.try_element_at(keeper, F.lit(-1))["location"]
    to = lambda p: S.distance(p["location"][0], p["location"][1], x, y)
    cone = lambda p: S.in_cone(p["location"][0], p["location"][1], x, y)
    return e.select(
        F.col("id").alias("sb_event_id"), "match_id", F.col("player.id").alias("player_id"), F.col("team.id").alias("team_id"), "minute", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"),
        F.round(S.distance(x, y), 3).alias("distance"), F.round(S.shot_angle(x, y), 4).alias("angle"), S.body_part(F.col("shot.body_part.name")).alias("body_part"),
        F.col("shot.type.name").alias("shot_type"), F.col("shot.technique.name").alias("technique"), F.col("play_pattern.name").alias("play_pattern"),
        F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"), F.coalesce("shot.first_time", F.lit(False)).alias("first_time"),
        F.when(F.size(opponents) > 0, F.size(F.filter(field, cone))).alias("defenders_in_cone"), F.round(F.array_min(F.transform(field, to)), 3).alias("dist_to_nearest_def"),
        F.round(S.distance(gk[0], gk[1]), 3).alias("gk_dist_to_goal"), F.round(S.distance(gk[0], gk[1], x, y), 3).alias("gk_dist_to_shot"),
        F.col("shot.statsbomb_xg").alias("statsbomb_xg"), F.coalesce(F.col("shot.outcome.name") == "Goal", F.lit(False)).alias("is_goal"),
    )


def validity(events: DataFrame) -> DataFrame:
    """(reason, n): events by the first rule that they break, 'valid' if none."""
    reason = (
        F.when(F.col("player").isNull(), "missing player").when(F.col("player.id").isNull(), "player without id")
        .when(F.col("type").isNull(), "missing type").when(F.col("type.name").isNull(), "type without name").otherwise("valid")
    )
    return events.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def preset(events: DataFrame, name: str) -> DataFrame:
    """Events of a preset: all, attack, defence or setpiece."""
    kinds = {
        "attack": ["Shot", "Dribble", "Carry"],
        "defence": ["Duel", "Interception", "Clearance", "Pressure", "Block"],
        "setpiece": ["Pass", "Free Kick", "Corner Received"],
    }
    return events if name == "all" else events.where(F.col("type.name").isin(kinds[name]))
