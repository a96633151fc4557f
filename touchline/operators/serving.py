"""Parameters of the query surface, linking of players, and the model registry."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import joins, upsert


def has_season(season: str | None) -> bool:
    """A season is asked for: not none, not empty, not 'all' in any case."""
    return bool(season) and season.lower() != "all"


def in_season(rows: DataFrame, season: str | None, column: str = "season") -> DataFrame:
    """Rows of one season, or all of them where none is asked for."""
    return rows.where(F.col(column) == season) if has_season(season) else rows


def of_matches(rows: DataFrame, matches: DataFrame, season: str | None, key: str, match_key: str, column: str = "season") -> DataFrame:
    """Rows whose match is in the season: a semi join, no set of ids on the driver."""
    if not has_season(season):
        return rows
    wanted = in_season(matches, season, column).select(F.col(match_key).alias("__m"))
    return rows.join(wanted, F.col(key) == F.col("__m"), "left_semi")


def exists(rows: DataFrame, condition: Column) -> bool:
    """Existence probe: stops at the first row."""
    return not rows.where(condition).limit(1).isEmpty()


def rows_or_empty(spark: SparkSession, schema: str, build, *args) -> DataFrame:
    """A panel's rows, or none of its schema where its query can't be analysed (a missing table or column). Nothing is collected; other errors are raised."""
    try:
        return build(*args)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def rows_or_none(build, *args) -> list:
    """Rows of a panel, or an empty list where its query can't be analysed: for panels of a few rows (``rows_or_empty`` collects nothing)."""
    try:
        return build(*args).collect()
    except AnalysisException:
        return []


def alive(spark: SparkSession) -> DataFrame:
    """One row (ok, version): a query runs."""
    return spark.range(1).select((F.col("id") == 0).alias("ok"), F.version().alias("version"))


def table_report(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(table_name, present, n_rows) of the Parquet tables that are expected below a folder."""
    from ..sources.readers import parquet_or_none

    parts = []
    for n in names:
        rows = parquet_or_none(spark, f"{root}/{n}.parquet")
        count = rows.agg(F.count("*").alias("n_rows")) if rows is not None else spark.range(1).select(F.lit(None).cast("long").alias("n_rows"))
        parts.append(count.select(F.lit(n).alias("table_name"), F.lit(rows is not None).alias("present"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def season_table(matches: DataFrame, season: str | None = None) -> DataFrame:
    """(team, played, goals_for, goals_against, xg_for, xg_against, points, xpoints, xg_diff, points_diff) of matches with both scores.

    ``matches``: season, home, away, home_score, away_score, home_xg, away_xg. A missing xG counts as 0. The two differences are taken
    between values already rounded to one decimal.
    """
    m = in_season(matches, season).where("home_score IS NOT NULL AND away_score IS NOT NULL").na.fill(0.0, ["home_xg", "away_xg"])
    side = lambda a, b: F.struct(
        F.col(a).alias("team"), F.col(f"{a}_score").alias("gf"), F.col(f"{b}_score").alias("ga"), F.col(f"{a}_xg").alias("xgf"), F.col(f"{b}_xg").alias("xga")
    )
    t = m.select(F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("s.*")
    won = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    out = t.withColumns({"xp": S.expected_points(F.col("xgf"), F.col("xga")), "p": won}).groupBy("team").agg(
        F.count("*").alias("played"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"), F.round(F.sum("xgf"), 1).alias("xg_for"),
        F.round(F.sum("xga"), 1).alias("xg_against"), F.sum("p").alias("points"), F.round(F.sum("xp"), 1).alias("xpoints"),
    )
    return out.withColumns({"xg_diff": F.round(F.col("xg_for") - F.col("xg_against"), 1), "points_diff": F.round(F.col("points") - F.col("xpoints"), 1)})


def season_options(team_matches: DataFrame) -> DataFrame:
    """(team, season, n), per team the seasons of most matches first, the later one at ties."""
    return team_matches.groupBy("team", "season").agg(F.count("*").alias("n")).orderBy("team", F.desc("n"), F.desc("season"))


def players_merged(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """(source_id, name, player_id): a known source id keeps its player, a new one with the normalised name of a known player reuses it
    (the smallest id of the name), any other is a player of its own, numbered after the known ones by source id.

    ``known``: player_id, source_id, name. New rows aren't merged with each other. The number of new players is a dimension's:
    their numbering is one task's.
    """
    norm = S.norm_name(F.col("name"))
    rows = incoming.groupBy("source_id").agg(F.min("name").alias("name"))
    by_id = known.where("source_id IS NOT NULL").groupBy(F.col("source_id").alias("__s")).agg(F.min("player_id").alias("by_id"))
    by_name = known.select("player_id", norm.alias("__n")).where("__n <> ''").groupBy("__n").agg(F.min("player_id").alias("by_name"))
    found = rows.withColumn("__k", norm).join(by_id, F.col("source_id") == F.col("__s"), "left").join(by_name, F.col("__k") == F.col("__n"), "left")
    found = found.select("source_id", "name", F.coalesce("by_id", "by_name").alias("player_id"))
    last = known.agg(F.coalesce(F.max("player_id"), F.lit(0)).alias("__last"))  # one row
    fresh = found.where("player_id IS NULL").withColumn("__i", F.row_number().over(Window.orderBy("source_id")))
    fresh = fresh.join(F.broadcast(last)).select("source_id", "name", (F.col("__last") + F.col("__i")).alias("player_id"))
    return found.where("player_id IS NOT NULL").unionByName(fresh)


def injuries_linked(injuries: DataFrame, players: DataFrame) -> DataFrame:
    """Injury rows by player_id: rows of unknown source ids and rows without a start day go, a missing end stays missing."""
    ids = players.where("source_id IS NOT NULL").select("source_id", "player_id")
    return injuries.where("start_day IS NOT NULL").join(ids, "source_id").drop("source_id")


def missing_matches(matches: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Matches without any edge: what a backfill has to do."""
    return matches.join(edges.select(key).distinct(), key, "left_anti")


def located(places: DataFrame, curated: DataFrame) -> DataFrame:
    """(place_id, lat, lng, tier) of places (place_id, place_name) by the curated (position, name, lat, lng).

    A normalised name equal to a curated one is ``exact``; else the first curated name in list order that contains it or is contained
    is ``contained``; else the tier is ``unresolved`` and the coordinates are null.
    """
    p = places.select("place_id", S.norm_name(S.place_name(F.col("place_name"))).alias("__n"))
    c = curated.select("position", S.norm_name(F.col("name")).alias("__c"), "lat", "lng")
    exact = c.groupBy(F.col("__c").alias("__n")).agg(F.min_by(F.struct("lat", "lng"), "position").alias("e"))
    pairs = joins.contains_either_way(p.select("__n").distinct(), "__n", c.select("__c"), "__c")
    first = pairs.join(c, "__c").groupBy("__n").agg(F.min_by(F.struct("lat", "lng"), "position").alias("s"))
    at = p.join(exact, "__n", "left").join(first, "__n", "left").withColumn("at", F.coalesce("e", "s"))
    tier = F.when(F.col("e").isNotNull(), "exact").when(F.col("s").isNotNull(), "contained").otherwise("unresolved")
    return at.select("place_id", F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng"), tier.alias("tier"))


def masked_dsn(c: Column) -> Column:
    """A connection string without its password."""
    return F.regexp_replace(c, r"(://[^:/@]+:)[^@]*@", "$1***@")


def identifier(name: str) -> str:
    """``name`` if it is a plain SQL identifier; an error otherwise."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def registered(registry: DataFrame, cards: DataFrame) -> DataFrame:
    """The registry after an upsert of cards by (model_key, version); the latest ``trained_at`` of a key wins."""
    return upsert.last_wins(registry, cards, ["model_key", "version"], "trained_at")


def models_list(registry: DataFrame) -> DataFrame:
    return registry.orderBy("model_key", "version")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def artifact(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report as one relation."""
    return spark.read.option("multiLine", True).json(path)


def outcome_curve(snapshots: DataFrame, model: PipelineModel, classes: dict[str, int]) -> DataFrame:
    """(match_id, team_id, minute, a percentage of one decimal for each of ``classes``) in order of minutes."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(snapshots.na.fill(0)).withColumn("__p", vector_to_array("probability"))
    shares = [F.round(F.col("__p")[i] * 100, 1).alias(n) for n, i in classes.items()]
    return scored.select("match_id", "team_id", "minute", *shares).orderBy("match_id", "team_id", "minute")


def outcome_shares(scored: DataFrame, classes: dict[str, int], keys: list[str]) -> DataFrame:
    """(keys, a percentage of one decimal for each of ``classes``, probabilities): the last a JSON object of label and probability, four decimals."""
    from pyspark.ml.functions import vector_to_array

    p = scored.withColumn("__p", vector_to_array("probability"))
    shares = [F.round(F.get("__p", F.lit(i)) * 100, 1).alias(n) for n, i in classes.items()]
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in classes]), F.array(*[F.round(F.get("__p", F.lit(i)), 4) for i in classes.values()]))
    return p.select(*keys, *shares, F.to_json(pairs).alias("probabilities"))


def prematch_point(points: DataFrame, match_id, team_id) -> DataFrame:
    """The pre-match outcome of one team in one match: one row, or none."""
    return points.where((F.col("match_id") == match_id) & (F.col("team_id") == team_id)).limit(1)


def of_player(shots: DataFrame, player_id) -> DataFrame:
    """The shots of one player, or all of them without one."""
    return shots if player_id is None else shots.where(F.col("player_id") == player_id)
