"""Batches of matches in which a broken file, event or player costs itself and not the batch."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import events as E


class Batch(NamedTuple):
    players: DataFrame  # match_id, player_id and the counters; all 0 for a player with an unreadable event
    matches: DataFrame  # match_id and the summary; all 0 for a wanted match without a readable event
    errors: DataFrame  # match_id, player_id, reason, n


def isolated(rows: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the fields of ``schema`` parsed from the JSON of ``text``, rows whose text doesn't parse as it). A null text is in neither."""
    parsed = rows.where(F.col(text).isNotNull()).withColumn(
        "__j", F.from_json(text, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    )
    bad = F.col("__j").isNull() | F.col("__j.__bad").isNotNull()
    return parsed.where(~bad).select(*rows.columns, "__j.*").drop("__bad"), parsed.where(bad).drop("__j")


def _zeros(rows: DataFrame, like: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` of keys with every numeric column of ``like`` at 0 and the others null."""
    numeric = ("int", "bigint", "double", "float", "decimal")
    return rows.select(*[
        F.col(c).cast(t).alias(c) if c in keys else (F.lit(0) if t.startswith(numeric) else F.lit(None)).cast(t).alias(c) for c, t in like.dtypes
    ])


def process(files: DataFrame, wanted: DataFrame | None = None) -> Batch:
    """Statistics of a batch. ``files``: match_id, seq, element, broken, and the fields of an event (``readers.events_checked``); ``wanted``: match_id.

    Reasons: ``broken file`` (no JSON array), ``absent file`` (wanted, and not there or without a byte), ``no events``, ``unreadable event`` (with the
    player, where the element still names one). A player with an unreadable event has a row of zeros in that match, as statistics
    from the rest would be wrong; other players and matches have theirs.
    """
    good = files.where("NOT broken AND element IS NOT NULL AND unreadable IS NULL")
    bad = files.where("unreadable IS NOT NULL").select("match_id", F.get_json_object("unreadable", "$.player.id").try_cast("int").alias("player_id"))
    bad = bad.groupBy("match_id", "player_id").agg(F.count("*").alias("n"))
    players, matches = E.player_stats(good), E.match_summary(good)
    lost = bad.where("player_id IS NOT NULL").select("match_id", "player_id")
    players = players.join(lost, ["match_id", "player_id"], "left_anti").unionByName(_zeros(lost, players, ["match_id", "player_id"]))
    seen = files.select("match_id", "broken", F.col("element").isNotNull().alias("some")).groupBy("match_id").agg(F.max("broken").alias("broken"), F.max("some").alias("some"))
    ids = wanted.select(F.col("match_id").alias("__w")).distinct() if wanted is not None else seen.select(F.col("match_id").alias("__w"))
    asked = ids.join(seen, F.col("__w") == F.col("match_id"), "left")
    reason = F.when(F.col("broken").isNull(), "absent file").when(F.col("broken"), "broken file").when(~F.col("some"), "no events")
    whole = asked.select(F.col("__w").alias("match_id"), F.lit(None).cast("int").alias("player_id"), reason.alias("reason"), F.lit(1).cast("long").alias("n")).where("reason IS NOT NULL")
    errors = whole.unionByName(bad.select("match_id", "player_id", F.lit("unreadable event").alias("reason"), "n"))
    empty = ids.select(F.col("__w").alias("match_id")).join(matches.select("match_id"), "match_id", "left_anti")
    return Batch(players, matches.unionByName(_zeros(empty, matches, ["match_id"])), errors)
