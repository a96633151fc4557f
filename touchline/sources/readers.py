"""Sources and sinks: typed JSON, CSV and Parquet scans, literal relations, table writes."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: The fields of a raw match event that are read; every one may be missing.
EVENT_SCHEMA = """id string, minute int, type struct<name: string>, player struct<id: int, name: string>, team struct<id: int, name: string>,
  play_pattern struct<name: string>, under_pressure boolean, location array<double>,
  shot struct<statsbomb_xg: double, outcome: struct<name: string>, body_part: struct<name: string>, type: struct<name: string>,
    technique: struct<name: string>, first_time: boolean,
    freeze_frame: array<struct<teammate: boolean, location: array<double>, position: struct<name: string>>>>,
  pass struct<outcome: struct<name: string>, recipient: struct<id: int>, end_location: array<double>, goal_assist: boolean,
    shot_assist: boolean, assisted_shot_id: string>,
  carry struct<end_location: array<double>>, dribble struct<outcome: struct<name: string>>, duel struct<type: struct<name: string>>,
  bad_behaviour struct<card: struct<name: string>>"""
MATCH_SCHEMA = """match_id int, match_date date, home_score int, away_score int,
  home_team struct<home_team_id: int, home_team_name: string>, away_team struct<away_team_id: int, away_team_name: string>,
  stadium struct<name: string>"""
LINEUP_SCHEMA = """lineup array<struct<player_id: int, positions: array<struct<position: string, start_reason: string, from_period: int>>>>"""
COMPETITION_SCHEMA = "competition_id int, season_id int, competition_name string, season_name string"
#: Accepted names of the player id column of the CSV inputs.
ID_COLUMNS = ("player_id", "id", "tm_id", "transfermarkt_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names or TABLES}


def run_sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over the tables it names as ``{table}``; nothing is registered in the catalogue."""
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **tables(spark, sf_dir, *sorted(used & set(TABLES) - set(frames))) if used & set(TABLES) - set(frames) else {}, **frames)


def json_files(spark: SparkSession, path: str, schema: str, key: str = "match_id") -> DataFrame:
    """One JSON array per file; ``key`` is the number in the file's name and ``seq`` the order inside the file.

    Missing files, and a missing folder, read as no rows. All files are one scan.
    """
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("ignoreMissingFiles", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, {key} int, seq long")
    rows = rows.withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).cast("int"))
    return rows.withColumn("seq", F.monotonically_increasing_id())


def events_checked(spark: SparkSession, root: str, folder: str = "events", schema: str = EVENT_SCHEMA) -> DataFrame:
    """(match_id, seq, element, broken, unreadable, the fields of an event) of every element of every file of a folder; no rows where there is no folder.

    A file that is no JSON array is one row with ``broken``, an empty array one row without an ``element``. An element that doesn't
    fit the schema keeps its text in ``unreadable``: what is wrong costs a file or an element, and never the scan.
    """
    fields = f"{schema}, __bad string"
    try:
        files = spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(f"{root}/{folder}")
        files = files.select("value", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).try_cast("int").alias("match_id"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "value string, match_id int")
    files = files.where("match_id IS NOT NULL").withColumn("__all", F.from_json("value", "array<string>"))
    each = files.select("match_id", F.col("__all").isNull().alias("broken"), F.posexplode_outer("__all").alias("seq", "element"))
    each = each.withColumn("__j", F.from_json("element", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    unreadable = F.when(F.col("element").isNotNull() & (F.col("__j").isNull() | F.col("__j.__bad").isNotNull()), F.col("element"))
    return each.select("match_id", F.col("seq").cast("long").alias("seq"), "element", "broken", unreadable.alias("unreadable"), "__j.*").drop("__bad")


def events(spark: SparkSession, root: str) -> DataFrame:
    return json_files(spark, f"{root}/events", EVENT_SCHEMA)


def lineups(spark: SparkSession, root: str) -> DataFrame:
    return json_files(spark, f"{root}/lineups", LINEUP_SCHEMA)


def competitions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(COMPETITION_SCHEMA).option("multiLine", True).json(f"{root}/competitions.json")


def matches(spark: SparkSession, root: str) -> DataFrame:
    """All matches/{competition}/{season}.json files, the two ids taken from the path."""
    rows = spark.read.schema(MATCH_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(f"{root}/matches")
    at = F.col("_metadata.file_path")
    return rows.withColumns({
        "competition_id": F.regexp_extract(at, r"/(\d+)/\d+\.json$", 1).cast("int"),
        "season_id": F.regexp_extract(at, r"/(\d+)\.json$", 1).cast("int"),
    })


def csv_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with its header made canonical: trimmed, lower case, spaces as underscores."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*[c.strip().lower().replace(" ", "_") for c in rows.columns])
    found = next((c for c in ID_COLUMNS if c in rows.columns), None)
    if found is None:
        raise ValueError(f"no id column among {rows.columns}")
    return rows.withColumnRenamed(found, "player_id")


def in_scope(rows: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Rows whose (competition_id, season_id) is in a literal relation."""
    scope = rows.sparkSession.createDataFrame(pairs, "competition_id int, season_id int")
    return rows.join(F.broadcast(scope), ["competition_id", "season_id"], "left_semi")


def parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, name: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").saveAsTable(name)


def missing_tables(spark: SparkSession, required: list[str]) -> list[str]:
    have = {t.name for t in spark.catalog.listTables()}
    return sorted(set(required) - have)
