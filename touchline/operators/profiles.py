"""Player profiles from per-match statistics: efficiency with radar and archetype, and the style vector per 90 minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Output name and source of the per-match means of the efficiency table, in its order.
MEANS = {
    "xg_per_90": "xg", "xa_per_90": "xa", "pass_completion": "pass_accuracy", "key_passes": "key_passes", "dribbles": "dribbles_completed", "shots": "shots",
    "passes_attempted": "passes_attempted", "tackles": "tackles", "interceptions": "interceptions", "clearances": "clearances", "carry_distance": "carry_distance",
    "progressive_carries": "progressive_carries", "progressive_passes": "progressive_passes", "pressures": "pressures",
}
#: Radar axis, the mean it shows and what a mean of 1 scores, capped at 100.
RADAR = {"attack": ("xg_per_90", 200.0), "creation": ("xa_per_90", 250.0), "passing": ("pass_completion", 1.0), "dribbling": ("dribbles", 25.0), "defending": ("tackles", 25.0)}


def efficiency(stats: DataFrame, archetypes: DataFrame, least_matches: int = 3, top: int = 12) -> DataFrame:
    """Per team its ``top`` players of at least ``least_matches`` matches by the mean of xA + xG (ties by id): position, minutes, 14 means, radar, archetype.

    ``stats``: a row per match and player with team_id, position, minutes_played and the counters; ``archetypes``: player_id, player_type
    (a player that it lacks is Unclassified). The means are per match, whatever their names say; the position is the most frequent one,
    the first by name at ties.
    """
    means = [F.avg(c).alias(n) for n, c in MEANS.items()]
    per = stats.groupBy("team_id", "player_id").agg(
        F.mode("position", True).alias("position"), F.count("*").alias("matches"), (F.avg("minutes_played") * F.count("*")).alias("minutes"), F.avg(F.col("xa") + F.col("xg")).alias("__by"), *means
    ).where(F.col("matches") >= least_matches)
    rank = F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("__by"), "player_id"))
    best = per.withColumn("rank", rank).where(F.col("rank") <= top).drop("__by")
    radar = [F.round(S.clip(F.col(c) * k, 0.0, 100.0), 1).alias(f"radar_{a}") for a, (c, k) in RADAR.items()]
    known = archetypes.groupBy(F.col("player_id").alias("__p")).agg(F.min("player_type").alias("__t"))
    return best.join(known, F.col("player_id") == F.col("__p"), "left").select(*best.columns, *radar, F.coalesce("__t", F.lit("Unclassified")).alias("player_type"))


def style_vector(stats: DataFrame, least_minutes: float = 0.0) -> DataFrame:
    """(player_id, total_minutes, 12 features): sums per 90 minutes and the mean pass accuracy, of players of more than ``least_minutes``."""
    total = lambda *cs: F.sum(sum((F.col(c) for c in cs[1:]), F.col(cs[0])))
    sums = {
        "xg_90": total("xg"), "xa_90": total("xa"), "shots_90": total("shots"), "goals_90": total("goals"), "passes_90": total("passes_attempted"),
        "carries_90": total("progressive_carries"), "touches_90": total("passes_attempted", "dribbles_completed"),
        "progressive_actions_90": total("progressive_passes", "progressive_carries"), "tackles_90": total("tackles"), "interceptions_90": total("interceptions"), "pressures_90": total("pressures"),
    }
    per = stats.groupBy("player_id").agg(F.sum("minutes_played").alias("total_minutes"), F.avg("pass_accuracy").alias("pass_accuracy"), *[c.alias(n) for n, c in sums.items()])
    per = per.where(F.col("total_minutes") > least_minutes)
    rate: list[Column] = [S.per90(F.col(n), F.col("total_minutes")).alias(n) for n in sums]
    return per.select("player_id", "total_minutes", "pass_accuracy", *rate)


def subbed_off(events: DataFrame) -> DataFrame:
    """(match_id, player_id) of players who were taken off: those whom a substitution event names."""
    return events.where("type.name = 'Substitution' AND player.id IS NOT NULL").select("match_id", F.col("player.id").alias("player_id")).distinct()
