"""Queries of the parameterised surface, of linking and of the features that models take; each with SQL where it can express it."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clusters, evaluation, graph, learning, ordered, rating, serving
from ..sources.readers import table
from .dataframes import _O, _XP, _edges, _orders
from .texts import _EDGES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _matches(spark, d):
    """Orders as matches: two teams, their goals (a few unknown) and xG."""
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("match_id"), F.year("o_orderdate").cast("string").alias("season"), (k % 25).alias("home"), ((k * 7 + 1) % 25).alias("away"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 4).alias("home_score"), (k % 3).alias("away_score"),
        (F.col("o_totalprice") / 200003.0).alias("home_xg"), F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_orderkey") % 7) / F.lit(3.0)).alias("away_xg"),
    )


_M = """m AS (SELECT o_orderkey AS match_id, year(o_orderdate)::VARCHAR AS season, o_custkey % 25 AS home, (o_custkey * 7 + 1) % 25 AS away, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 4 END AS hs, o_custkey % 3 AS "as",
  o_totalprice / 200003.0::DOUBLE AS hx, coalesce(CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 7) / 3.0::DOUBLE END, 0) AS ax FROM orders)"""


def _league(where: str) -> str:
    return f"""WITH {_M}, p AS (SELECT * FROM m WHERE hs IS NOT NULL AND {where}),
t AS (SELECT home AS team, hs AS gf, "as" AS ga, hx AS a, ax AS b FROM p UNION ALL SELECT away, "as", hs, ax, hx FROM p), x AS (SELECT *, {_XP} AS xp FROM t),
s AS (SELECT team, count(*) AS played, sum(gf)::BIGINT AS goals_for, sum(ga)::BIGINT AS goals_against, round(sum(a), 1) AS xg_for, round(sum(b), 1) AS xg_against,
  sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END)::BIGINT AS points, round(sum(xp), 1) AS xpoints FROM x GROUP BY team)
SELECT *, round(xg_for - xg_against, 1) AS xg_diff, round(points - xpoints, 1) AS points_diff FROM s"""


@query(_league("season = '1997'"))
def league_xg_season(spark, d):
    return serving.season_table(_matches(spark, d), "1997")


@query(_league("true"))
def league_xg_all(spark, d):
    return serving.season_table(_matches(spark, d), "All")


@query(f"""WITH {_M} SELECT l_orderkey AS match_id, l_linenumber AS shot_no, l_partkey AS player_id, l_discount AS xg FROM lineitem
WHERE l_suppkey % 25 = 7 AND l_orderkey IN (SELECT match_id FROM m WHERE season = '1998')""")
def team_season_shots(spark, d):
    """Shots of one team in one season: a feature, the parameters of the endpoint."""
    rows = table(spark, d, "lineitem").where(F.col("l_suppkey") % 25 == 7)
    rows = serving.of_matches(rows, _matches(spark, d), "1998", "l_orderkey", "match_id")
    return rows.select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("shot_no"), F.col("l_partkey").alias("player_id"), F.col("l_discount").alias("xg"))


@query(f"WITH {_M} SELECT team, season, count(*) AS n FROM (SELECT home AS team, season FROM m UNION ALL SELECT away, season FROM m WHERE away <> home) GROUP BY ALL ORDER BY team, n DESC, season DESC")
def season_options_sorted(spark, d):
    teams = F.explode(F.array_distinct(F.array("home", "away"))).alias("team")
    return serving.season_options(_matches(spark, d).select(teams, "season"))


_APPEARANCES = """a AS (SELECT l_partkey AS p, l_orderkey AS o, l_linenumber AS l, l_suppkey AS s, l_quantity * 2 AS mins, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS started, CAST(o_orderdate AS DATE) AS day, l_extendedprice AS x,
  row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {_APPEARANCES}, b AS (SELECT a.*, max(CASE WHEN started = 0 THEN i END) OVER (PARTITION BY p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM a)
SELECT b.p AS player_id, b.i AS appearance, coalesce(sum(c.started), 0)::BIGINT AS starts_last5, count(CASE WHEN c.mins >= 90 THEN 1 END) AS full90_last5, coalesce(round(avg(c.mins), 6), 0) AS minutes_last5,
  coalesce(max(c.mins), 0) AS minutes_max5, coalesce(round(avg(1.0 - c.started), 6), 0)::DOUBLE AS sub_share5, b.i - 1 - coalesce(max(b.stop), 0) AS starts_in_a_row
FROM b LEFT JOIN a c ON c.p = b.p AND c.i BETWEEN b.i - 5 AND b.i - 1 GROUP BY b.p, b.i""")
def count_window_last5(spark, d):
    """Starts, full matches, minutes and substitutions of the five appearances before each, and the run of starts before it."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    a = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("player_id"), (F.col("l_quantity") * 2).alias("mins"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("started"),
        "o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
    )
    by = Window.partitionBy("player_id").orderBy("o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    a = a.withColumn("appearance", F.row_number().over(by).cast("long"))
    return ordered.count_windows(a, ["player_id"], "appearance", "mins", "started", 5)


@query(f"""WITH {_O}, n AS (SELECT o.*, o_custkey % 25 AS t FROM o), f AS (SELECT t, day, avg(points) AS p, count(*) AS c FROM n GROUP BY ALL),
w AS (SELECT a.t, a.day, count(b.day) AS n7 FROM (SELECT DISTINCT o_custkey AS t, day FROM o) a LEFT JOIN o b ON b.o_custkey = a.t AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY ALL),
v AS (SELECT a.t, a.day, count(b.day) AS n14 FROM (SELECT DISTINCT o_custkey AS t, day FROM o) a LEFT JOIN o b ON b.o_custkey = a.t AND b.day BETWEEN a.day - 14 AND a.day - 1 GROUP BY ALL)
SELECT o_orderkey, n7, n14, round(n7 / 7.0 + n14 / 14.0, 6)::DOUBLE AS congestion, ((o_orderkey % 23 + 17) * (o_orderkey % 23 + 17))::DOUBLE AS age_squared FROM o JOIN w ON w.t = o_custkey AND w.day = o.day JOIN v ON v.t = o_custkey AND v.day = o.day""")
def derived_features(spark, d):
    """Matches of the last 7 and 14 days, their congestion score, and a squared age."""
    o, dn = _orders(spark, d), F.col("dn")
    n = lambda days: F.count(F.lit(1)).over(ordered.prior_days(["o_custkey"], dn, days))
    out = o.select("o_orderkey", n(7).alias("n7"), n(14).alias("n14"), (F.col("o_orderkey") % 23 + 17).cast("double").alias("age"))
    return out.select("o_orderkey", "n7", "n14", F.round(F.col("n7") / 7.0 + F.col("n14") / 14.0, 6).alias("congestion"), (F.col("age") * F.col("age")).alias("age_squared"))


@query(f"""WITH {_M}, t AS (SELECT match_id, home AS team, away AS opp, hx AS x FROM m UNION ALL SELECT match_id, away, home, ax FROM m WHERE home <> away),
w AS (SELECT match_id, team, opp, round(avg(x) OVER (PARTITION BY team ORDER BY match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS form FROM t)
SELECT a.match_id, a.team, a.form, b.form AS opp_form FROM w a LEFT JOIN w b ON b.match_id = a.match_id AND b.team = a.opp AND a.team <> a.opp""")
def opponent_form(spark, d):
    """Each team's mean xG of its last five matches, and its opponent's: one window, then an equal join by match and opponent."""
    m = _matches(spark, d).na.fill(0.0, ["away_xg"])
    side = lambda a, b: F.struct(F.col(a).alias("team"), F.col(b).alias("opp"), F.col(f"{a}_xg").alias("x"))
    both = F.when(F.col("home") == F.col("away"), F.array(side("home", "away"))).otherwise(F.array(side("home", "away"), side("away", "home")))
    t = m.select("match_id", F.explode(both).alias("s")).select("match_id", "s.*")
    w = t.withColumn("form", F.round(F.avg("x").over(Window.partitionBy("team").orderBy("match_id").rowsBetween(-5, -1)), 6))
    other = w.select(F.col("match_id").alias("m2"), F.col("team").alias("t2"), F.col("form").alias("opp_form"))
    return w.join(other, (F.col("match_id") == F.col("m2")) & (F.col("opp") == F.col("t2")) & (F.col("team") != F.col("opp")), "left").select("match_id", "team", "form", "opp_form")


@query("""WITH t AS (SELECT l_suppkey AS team_id, l_orderkey AS match_id, round(sum(l_discount), 6) AS x FROM lineitem GROUP BY ALL)
SELECT team_id, match_id, round(avg(x) OVER (PARTITION BY team_id ORDER BY match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 5) AS xg_last5 FROM t""")
def match_sum_last5(spark, d):
    """Sum per match, then the mean of the five matches before."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("team_id"), F.col("l_orderkey").alias("match_id")).agg(F.round(F.sum("l_discount"), 6).alias("x"))
    return t.select("team_id", "match_id", F.round(F.avg("x").over(Window.partitionBy("team_id").orderBy("match_id").rowsBetween(-5, -1)), 5).alias("xg_last5"))


@query("""SELECT o_orderkey AS match_id, (SELECT max(l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS result FROM orders""")
def match_result_lookup(spark, d):
    """One result of each match: the scalar look-up as an aggregate and a join."""
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("result"))
    return table(spark, d, "orders").join(r, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("match_id"), "result")


@query("""WITH s AS (SELECT o_orderkey AS m, year(o_orderdate) AS season FROM orders) SELECT season, count(*) AS n, round(avg(l_quantity), 6) AS minutes_mean FROM lineitem JOIN s ON l_orderkey = m GROUP BY season""")
def attach_season(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("m"), F.year("o_orderdate").alias("season"))
    return table(spark, d, "lineitem").join(s, F.col("l_orderkey") == F.col("m")).groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("minutes_mean"))


_POSITION_NAMES = sorted({n for part in (S.BROAD_POSITIONS, S.COARSE_POSITIONS) for names in part.values() for n in names}) + ["Sweeper"]


def _case(groups: dict[str, list[str]]) -> str:
    return " ".join("WHEN pos IN (" + ", ".join(f"'{n}'" for n in names) + f") THEN '{g}'" for g, names in groups.items())


@query(f"""WITH p AS (SELECT c_custkey, ([{', '.join(f"'{n}'" for n in _POSITION_NAMES)}])[1 + c_custkey % {len(_POSITION_NAMES) + 1}] AS pos FROM customer)
SELECT c_custkey, CASE {_case(S.BROAD_POSITIONS)} END AS broad, CASE {_case(S.COARSE_POSITIONS)} WHEN pos IS NOT NULL THEN 'Other' END AS coarse FROM p""")
def position_maps(spark, d):
    names = F.array(*[F.lit(n) for n in _POSITION_NAMES])
    p = table(spark, d, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % (len(_POSITION_NAMES) + 1)).cast("int")).alias("pos"))
    return p.select("c_custkey", S.broad_position(F.col("pos")).alias("broad"), S.coarse_position(F.col("pos")).alias("coarse"))


@query("""SELECT c_custkey, trim(regexp_replace(regexp_replace(replace(c_name || chr(65533) || ' (' || c_mktsegment || ')  Park', chr(65533), ' '), '\\(.*?\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS place,
  regexp_replace('postgres://user:' || c_custkey || '@host/' || c_name, '(://[^:/@]+:)[^@]*@', '\\1***@', 'g') AS dsn, (c_acctbal + CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END) / 2 AS mean_of_two FROM customer""")
def clean_texts(spark, d):
    raw = F.concat(F.col("c_name"), F.lit("� ("), F.col("c_mktsegment"), F.lit(")  Park"))
    dsn = F.concat(F.lit("postgres://user:"), F.col("c_custkey").cast("string"), F.lit("@host/"), F.col("c_name"))
    second = F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", S.place_name(raw).alias("place"), serving.masked_dsn(dsn).alias("dsn"), ((F.col("c_acctbal") + second) / 2).alias("mean_of_two"))


_LETTERS = "translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')"


@query(f"""WITH p AS (SELECT c_custkey AS id, lower(c_mktsegment) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' park' ELSE ' ' || {_LETTERS} END AS n FROM customer UNION ALL SELECT -1 - n_nationkey, 'zz ' || {_LETTERS.replace('c_custkey', 'n_nationkey')} FROM nation),
c AS (SELECT row_number() OVER (ORDER BY s) AS pos, s || ' park' AS name FROM (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer) UNION ALL SELECT 100 + row_number() OVER (ORDER BY s), s FROM (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer)),
h AS (SELECT id, pos, c.name = n AS same FROM p JOIN c ON contains(n, name) OR contains(name, n)),
r AS (SELECT id, coalesce(min(CASE WHEN same THEN pos END), min(pos)) AS pos, bool_or(same) AS exact FROM h GROUP BY id)
SELECT id AS place_id, pos::DOUBLE AS lat, -pos::DOUBLE AS lng, CASE WHEN exact THEN 'exact' WHEN exact IS NOT NULL THEN 'contained' ELSE 'unresolved' END AS tier FROM p LEFT JOIN r USING (id)""")
def geocode_tiers(spark, d):
    c, letters = table(spark, d, "customer"), lambda k: F.translate(F.col(k).cast("string"), "0123456789", "abcdefghij")
    k, park = F.col("c_custkey") % 3, F.initcap("c_mktsegment")
    places = c.select(F.col("c_custkey").alias("place_id"), F.when(k == 0, park).when(k == 1, F.concat(park, F.lit(" (old)  Park"))).otherwise(F.concat(park, F.lit(" "), letters("c_custkey"))).alias("place_name"))
    places = places.unionByName(table(spark, d, "nation").select((-1 - F.col("n_nationkey")).alias("place_id"), F.concat(F.lit("ZZ "), letters("n_nationkey")).alias("place_name")))
    names = c.select("c_mktsegment").distinct().withColumn("i", F.row_number().over(Window.orderBy("c_mktsegment")))  # a handful of names
    curated = names.select(F.col("i").alias("position"), F.concat("c_mktsegment", F.lit(" Park")).alias("name")).unionByName(names.select((F.col("i") + 100).alias("position"), F.col("c_mktsegment").alias("name")))
    at = F.col("position").cast("double")
    return serving.located(places, curated.withColumns({"lat": at, "lng": -at}))


@query(f"""WITH k AS (SELECT c_custkey + 1 AS pid, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS sid, 'P ' || {_LETTERS} AS name FROM customer WHERE c_custkey % 4 < 3),
i AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -1 - c_custkey END AS sid, 'P ' || {_LETTERS} AS name FROM customer),
f AS (SELECT i.sid, i.name, coalesce((SELECT min(pid) FROM k WHERE k.sid = i.sid), (SELECT min(pid) FROM k WHERE k.name = i.name)) AS pid FROM i)
SELECT sid AS source_id, name, coalesce(pid, (SELECT max(pid) FROM k) + row_number() OVER (PARTITION BY pid IS NULL ORDER BY sid)) AS player_id FROM f""")
def player_merge(spark, d):
    """Known players by source id, then by normalised name; new ones numbered after them."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("P "), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    known = c.where(k % 4 < 3).select((k + 1).alias("player_id"), F.when(k % 2 == 0, k).alias("source_id"), F.upper(name).alias("name"))
    return serving.players_merged(known, c.select(F.when(k % 2 == 0, k).otherwise(-1 - k).alias("source_id"), name.alias("name")))


@query("""SELECT p_partkey AS player_id, CAST(o_orderdate AS DATE) AS start_day, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + 20 END AS end_day FROM orders JOIN part ON p_partkey * 2 = o_custkey WHERE o_orderkey % 7 > 0""")
def injuries_two_pass(spark, d):
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    rows = o.select(F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderkey") % 7 > 0, day).alias("start_day"), F.when(F.col("o_orderkey") % 3 > 0, F.date_add(day, 20)).alias("end_day"))
    players = table(spark, d, "part").select((F.col("p_partkey") * 2).alias("source_id"), F.col("p_partkey").alias("player_id"))
    return serving.injuries_linked(rows, players).select("player_id", "start_day", "end_day")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 2 = 0)")
def edge_backfill(spark, d):
    edges = table(spark, d, "lineitem").where("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("o_orderkey"))
    return serving.missing_matches(table(spark, d, "orders").select("o_orderkey"), edges, "o_orderkey")


@query("""WITH c AS (SELECT l_linenumber AS g, CAST(sum(CASE WHEN l_discount >= 0.05 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN l_discount >= 0.05 AND l_returnflag <> 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN l_discount < 0.05 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN l_discount < 0.05 AND l_returnflag <> 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM lineitem GROUP BY 1)
SELECT g, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS prec, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2, 6) AS balanced FROM c""")
def confusion_metrics(spark, d):
    """Precision, recall, F1 and balanced accuracy per group; a ratio of nothing is 0."""
    yes, is_r = F.col("l_discount") >= 0.05, F.col("l_returnflag") == "R"
    n = lambda c: F.sum(c.cast("double"))
    c = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("g")).agg(n(yes & is_r).alias("tp"), n(yes & ~is_r).alias("fp"), n(~yes & is_r).alias("fn"), n(~yes & ~is_r).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("g", F.round(ratio(tp, tp + fp), 6).alias("prec"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2, 6).alias("balanced"))


@query("""WITH p AS (SELECT o_custkey % 25 AS team, (o_orderkey % 17) / 4.0::DOUBLE AS x, (o_custkey % 5)::DOUBLE AS y FROM orders), s AS (SELECT team, x, y, 1 / (1 + exp(-(0.4 * x - 0.3 * y))) AS p FROM p)
SELECT team, round(avg(p), 6) AS mean_of_scores, round(1 / (1 + exp(-(0.4 * avg(x) - 0.3 * avg(y)))), 6) AS score_of_mean FROM s GROUP BY team""")
def score_orders(spark, d):
    """The mean of scores and the score of the mean features are two results: each endpoint has its own."""
    p = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("team"), ((F.col("o_orderkey") % 17) / F.lit(4.0)).alias("x"), (F.col("o_custkey") % 5).cast("double").alias("y"))
    score = lambda x, y: 1 / (1 + F.exp(-(0.4 * x - 0.3 * y)))
    return p.groupBy("team").agg(F.round(F.avg(score(F.col("x"), F.col("y"))), 6).alias("mean_of_scores"), F.round(score(F.avg("x"), F.avg("y")), 6).alias("score_of_mean"))


@query("""WITH t AS (SELECT l_partkey AS p, CASE WHEN l_discount < 0.03 THEN 'Low' WHEN l_discount < 0.06 THEN 'Medium' ELSE 'High' END AS tier, l_discount AS s, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem)
SELECT tier, count(*) AS n, round(avg(s), 6)::DOUBLE AS predicted, round(avg(y), 6)::DOUBLE AS observed FROM t GROUP BY tier""")
def tier_observed_rate(spark, d):
    s = F.col("l_discount")
    t = table(spark, d, "lineitem").groupBy(F.when(s < 0.03, "Low").when(s < 0.06, "Medium").otherwise("High").alias("tier"))
    return t.agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("predicted"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("observed"))


@query("""SELECT p_partkey AS player_id, p_name AS player_name, coalesce(p_brand, 'Unclassified') AS style FROM part WHERE contains(lower(p_name), 'ring') AND p_type = 'ECONOMY'""")
def player_lookup(spark, d):
    """Players of a name and a style: the parameters are the feature."""
    p = table(spark, d, "part").where(F.lower("p_name").contains("ring") & (F.col("p_type") == "ECONOMY"))
    return p.select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("player_name"), F.coalesce("p_brand", F.lit("Unclassified")).alias("style"))


@query(f"""WITH e AS ({_EDGES}), v AS (SELECT src AS x FROM e UNION SELECT dst FROM e), s AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m, (SELECT sum(weight) FROM e)::DOUBLE AS w)
SELECT 'all' AS g, n AS n_nodes, m AS n_edges, round(w / (n * (n - 1)), 6) AS weighted_density, round(w / n, 6) AS passes_per_player, round(m / n, 6) AS edges_per_player, 1 AS goals FROM s
UNION ALL SELECT 'none', 0, 0, 0, 0, 0, 0""")
def graph_feature_matrix(spark, d):
    """Features of a graph and of one without edges, zeros there."""
    m = graph.feature_matrix(_edges(spark, d), spark.createDataFrame([("all", 1), ("none", 0)], "g string, goals int"), ["g"], "goals")
    return m.select("g", "n_nodes", "n_edges", *[F.round(c, 6).alias(c) for c in ("weighted_density", "passes_per_player", "edges_per_player")], "goals")


@query()
def elo_features(spark, d):
    """Snapshots with the ratings of their match, 0 where there is none."""
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    m = o.select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").cast("date").alias("day"), (k % 20).alias("home_id"), ((k + 7) % 20).alias("away_id"),
                 (F.col("o_orderkey") % 4).alias("home_score"), (k % 3).alias("away_score"), F.year("o_orderdate").alias("league"))
    rows = o.select(F.col("o_orderkey").alias("m"), (k % 20).alias("t")).unionByName(o.select(F.col("o_orderkey").alias("m"), ((k + 3) % 20).alias("t")))
    return rating.with_elo(rows, rating.elo(m, "league"), "m", "t")


_CLASSES = {"win": 2, "draw": 1, "loss": 0}


@query()
def win_probability_timeline(spark, d):
    """Win, draw and loss in percent after every hour of a user's day: running totals against how the day ends, each user by a model of other users."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("team_id"), F.to_date("ts").alias("match_id"), F.hour("ts").alias("minute")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    day = Window.partitionBy("match_id", "team_id")
    sofar = day.orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("v").over(day) / F.sum("n").over(day)
    rows = e.select("match_id", "team_id", F.col("minute").cast("double").alias("minute"), F.sum("v").over(sofar).alias("total"), F.sum("n").over(sofar).cast("double").alias("seen"), end.alias("end"))
    rows = rows.withColumn("label", F.when(F.col("end") > 55, 2.0).when(F.col("end") > 45, 1.0).otherwise(0.0)).drop("end")
    fit = lambda part: learning.fitted(part, learning.features(["total", "seen", "minute"]), LogisticRegression(maxIter=20, family="multinomial"))
    scored = evaluation.cross_validated(evaluation.with_balanced_fold(rows, "team_id", 3), 3, fit)
    return serving.outcome_shares(scored, _CLASSES, ["match_id", "team_id", "minute"]).drop("probabilities").orderBy("match_id", "team_id", "minute")


def prematch_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a team's matches: form, points of the season so far and rest before each, and its outcome."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("s"))
    o = o.withColumns({"points": F.when(F.col("s") == "F", 3).when(F.col("s") == "P", 1).otherwise(0), "dn": ordered.day_number("day"), "season": F.year("day")})
    o = ordered.with_last_before(o, ["o_custkey"], "dn", "o_orderkey", "points", 5, "last")
    prior = F.avg("points").over(ordered.all_prior_days(["o_custkey", "season"], F.col("dn")))
    rest = F.least(F.lit(60), ordered.days_since(["o_custkey"], F.col("dn"), F.col("dn")))
    rows = o.select(F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("team_id"), "season", ordered.mean_of(F.col("last")).alias("form"), prior.alias("ppg"), rest.cast("double").alias("rest"), "points")
    return rows.withColumn("label", F.when(F.col("points") == 3, 2.0).when(F.col("points") == 1, 1.0).otherwise(0.0)).drop("points")


@query()
def prematch_points(spark, d):
    """Win, draw and loss before the matches of the last season, by a model of the seasons before it; what isn't known yet counts as the median."""
    rows = prematch_rows(spark, d)
    last = rows.agg(F.max("season")).first()[0]
    parts = evaluation.held_out(rows, "season", last)
    train, test = parts if parts else (rows, rows)
    model = learning.fitted(train, learning.features(["form", "ppg", "rest"]), LogisticRegression(maxIter=20, family="multinomial"))
    return serving.outcome_shares(model.transform(test), _CLASSES, ["match_id", "team_id", "season"])


@query()
def style_labels(spark, d):
    """Vector clusters named by the signature of the highest cosine, each name once, Hybrid beyond."""
    means = clusters.centroids(table(spark, d, "embeddings").select("label", F.col("embedding").alias("v")), "v", "label").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("m"))
    at = {r["label"]: list(r["m"]) for r in means.orderBy("label").collect()}  # a row per cluster
    size = len(next(iter(at.values()), []))
    signatures = {f"style {s}": [1.0 if i % 8 == s else 0.0 for i in range(size)] for s in range(8)}
    return spark.createDataFrame(sorted(clusters.style_labels(at, signatures).items()), "label int, style string")


@query()
def collinear_kept(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", (F.col("l_quantity") * 2 + 1).alias("quantity_twice"))
    return spark.createDataFrame([(c,) for c in learning.collinear_in_order(rows, ["l_quantity", "l_extendedprice", "l_discount", "quantity_twice"])], "kept string")
