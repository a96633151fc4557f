"""Elo ratings: a fold over matches in (date, id) order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE, K, HOME_EDGE = 1500.0, 20.0, 100.0
SCHEMA = "match_id long, home_id long, away_id long, home_elo double, away_elo double, delta double"


def multiplier(goals: float) -> float:
    return 1.0 if goals <= 1 else 1.5 if goals == 2 else 1.75 + (goals - 3) / 8


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches in order of (league, day, id), a batch at a time: only the ratings of the league at hand are kept."""
    league, rating = None, {}
    for b in batches:
        out: list[list] = [[], [], []]
        sides = [b.column(c).to_pylist() for c in ("home_id", "away_id")]
        for of, home, away, x, y in zip(b.column("__league").to_pylist(), *sides, b.column("home_score").to_pylist(), b.column("away_score").to_pylist()):
            if of != league:
                league, rating = of, {}
            h, a = rating.get(home, BASE), rating.get(away, BASE)
            d = 0.0
            if x is not None and y is not None and x == x and y == y:
                won = 1.0 if x > y else 0.5 if x == y else 0.0
                d = K * multiplier(abs(x - y)) * (won - 1 / (1 + 10 ** (-(h + HOME_EDGE - a) / 400)))
            for values, value in zip(out, (h, a, d)):
                values.append(value)
            rating[home] = h + d
            rating[away] = a - d
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("match_id", "home_id", "away_id")], *[pa.array(v, pa.float64()) for v in out]], [c.split()[0] for c in SCHEMA.split(", ")])


def elo(matches: DataFrame, league: str | None = None) -> DataFrame:
    """(match_id, home_id, away_id, ratings before the match, delta) from (match_id, day, home_id, away_id, home_score, away_score).

    Ratings move along matches, so a league is one fold: leagues run side by side, and a task streams the sorted matches of its leagues.
    """
    key = F.col(league) if league else F.lit(0)
    ids = [F.col(c).cast("long").alias(c) for c in ("match_id", "home_id", "away_id")]
    rows = matches.select(*ids, "day", "home_score", "away_score", key.alias("__league"))
    return rows.repartition("__league").sortWithinPartitions("__league", F.asc_nulls_last("day"), F.asc_nulls_last("match_id")).mapInArrow(_fold, SCHEMA)


def with_elo(rows: DataFrame, ratings: DataFrame, match: str, team: str) -> DataFrame:
    """Rows with elo_pre, opp_elo_pre and elo_diff of their (match, team); 0 where the match has no rating.

    A match's rating is shuffled once, not once a side; a team that meets itself has both sides.
    """
    names = {"match_id": "__m", "home_id": "__h", "away_id": "__a", "home_elo": "__x", "away_elo": "__y"}
    home, away = F.col(team) == F.col("__h"), F.col(team) == F.col("__a")
    out = rows.join(ratings.select(*[F.col(c).alias(n) for c, n in names.items()]), (F.col(match) == F.col("__m")) & (home | away), "left")
    side = lambda of, x, y: F.when(of, F.struct(F.col(x).alias("elo_pre"), F.col(y).alias("opp_elo_pre")))
    out = out.withColumn("__s", F.explode_outer(F.array_compact(F.array(side(home, "__x", "__y"), side(away, "__y", "__x"))))).select(*rows.columns, "__s.*")
    return out.withColumn("elo_diff", F.col("elo_pre") - F.col("opp_elo_pre")).na.fill(0, ["elo_pre", "opp_elo_pre", "elo_diff"])
