"""Queries built from the operators; each with an independent DuckDB text where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, joins, ordered, rating, upsert
from ..sources.readers import table
from ..sources.shared import written
from .texts import _EDGES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    points = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    return o.withColumns({"points": points, "dn": ordered.day_number("day"), "season": F.year("day")})


_O = """o AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS season,
  CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS points FROM orders)"""


@query("interval_label", f"""WITH {_O}, e AS (SELECT DISTINCT o_custkey AS k, day AS d FROM o WHERE points = 1)
SELECT o_orderkey, EXISTS (SELECT 1 FROM e WHERE k = o_custkey AND d >= day AND d <= day + 30) AS hit FROM o""")
def interval_label(spark, d):
    o = _orders(spark, d)
    events = o.where("points = 1").select("o_custkey", F.col("day").alias("e_day"))
    return joins.with_event_within(o, events, "o_custkey", "day", "e_day", 30, "hit").select("o_orderkey", "hit")


@query("workload_days", f"""WITH {_O} SELECT a.o_orderkey, count(b.o_orderkey) FILTER (WHERE b.day >= a.day - 30) AS n_30,
  count(b.o_orderkey) FILTER (WHERE b.day >= a.day - 14) AS n_14, count(b.o_orderkey) FILTER (WHERE b.day >= a.day - 7) AS n_7,
  round(coalesce(sum(b.o_totalprice) FILTER (WHERE b.day >= a.day - 30), 0), 2) AS load_30
FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.day < a.day AND b.day >= a.day - 30 GROUP BY a.o_orderkey""")
def workload_days(spark, d):
    o, dn = _orders(spark, d), F.col("dn")
    n = lambda days: F.count("*").over(ordered.prior_days(["o_custkey"], dn, days)).alias(f"n_{days}")
    load = F.round(F.coalesce(F.sum("o_totalprice").over(ordered.prior_days(["o_custkey"], dn, 30)), F.lit(0.0)), 2)
    return o.select("o_orderkey", n(30), n(14), n(7), load.alias("load_30"))


@query("days_since_last", f"""WITH {_O} SELECT o_orderkey, date_diff('day', (SELECT max(b.day) FROM o b WHERE b.o_custkey = o.o_custkey AND b.day < o.day AND b.points = 1), day) AS days,
  coalesce(least(60, date_diff('day', (SELECT max(b.day) FROM o b WHERE b.o_custkey = o.o_custkey AND b.day < o.day), day)), -1) AS rest,
  (SELECT count(*) FROM o b WHERE b.o_custkey = o.o_custkey AND b.day < o.day AND b.points = 1) AS earlier FROM o""")
def days_since_last(spark, d):
    o, dn = _orders(spark, d), F.col("dn")
    hit = F.when(F.col("points") == 1, dn)
    return o.select(
        "o_orderkey", ordered.days_since(["o_custkey"], dn, hit).cast("long").alias("days"),
        F.coalesce(F.least(F.lit(60), ordered.days_since(["o_custkey"], dn, dn)), F.lit(-1)).cast("long").alias("rest"),
        F.count(hit).over(ordered.all_prior_days(["o_custkey"], dn)).alias("earlier"),
    )


def _form(n: int) -> str:
    return f"(SELECT round(avg(points), 6) FROM (SELECT points FROM o b WHERE b.o_custkey = o.o_custkey AND b.day < o.day ORDER BY b.day DESC, b.o_orderkey DESC LIMIT {n}))"


@query("form_last_n", f"WITH {_O} SELECT o_orderkey, {_form(5)} AS form5, {_form(3)} AS form3 FROM o")
def form_last_n(spark, d):
    o = ordered.with_last_before(_orders(spark, d).select("o_orderkey", "o_custkey", "dn", "points"), ["o_custkey"], "dn", "o_orderkey", "points", 5, "last")
    form = lambda n: F.round(ordered.mean_of(F.slice("last", 1, n)), 6).alias(f"form{n}")
    return o.select("o_orderkey", form(5), form(3))


@query("season_ppg_prior", f"""WITH {_O}, g AS (SELECT avg(points) AS m FROM o)
SELECT o_orderkey, round(coalesce((SELECT avg(points) FROM o b WHERE b.o_custkey = o.o_custkey AND b.season = o.season AND b.day < o.day), m), 6) AS ppg FROM o, g""")
def season_ppg_prior(spark, d):
    o = _orders(spark, d)
    prior = F.avg("points").over(ordered.all_prior_days(["o_custkey", "season"], F.col("dn")))
    mean = o.agg(F.avg("points").alias("m"))  # one row
    return o.withColumn("p", prior).join(F.broadcast(mean)).select("o_orderkey", F.round(F.coalesce("p", "m"), 6).alias("ppg"))


@query("opponent_mirror", """WITH t AS (SELECT l_orderkey, l_suppkey, round(sum(l_discount), 6) AS xg FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey FROM t GROUP BY 1 HAVING count(*) = 2)
SELECT t.l_orderkey, t.l_suppkey, t.xg, b.xg AS opp_xg FROM t JOIN s USING (l_orderkey) JOIN t b ON t.l_orderkey = b.l_orderkey AND t.l_suppkey <> b.l_suppkey""")
def opponent_mirror(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.round(F.sum("l_discount"), 6).alias("xg"))
    two = t.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n = 2").select("l_orderkey")
    return joins.mirror(t.join(two, "l_orderkey", "left_semi"), "l_orderkey", "l_suppkey", ["xg"]).select("l_orderkey", "l_suppkey", "xg", "opp_xg")


_SNAP = """s AS (SELECT CAST(user_id % 40 AS INT) AS grp, CAST(user_id % 2 AS INT) AS side, event_id AS minute, value FROM events),
  f AS (SELECT CAST(floor(grp / 2) AS INT) AS m, side, minute, value FROM s)"""


@query("opponent_asof", f"""WITH {_SNAP} SELECT f.m, f.side, f.minute, round(f.value, 4) AS value, round(coalesce(b.value, 0), 4) AS opp_value
FROM f ASOF LEFT JOIN (SELECT m, 1 - side AS for_side, minute, value FROM f) b ON f.m = b.m AND f.side = b.for_side AND f.minute >= b.minute""")
def opponent_asof(spark, d):
    e = table(spark, d, "events")
    f = e.select(F.floor(F.col("user_id") % 40 / 2).cast("int").alias("m"), (F.col("user_id") % 2).cast("int").alias("side"), F.col("event_id").alias("minute"), "value")
    out = ordered.asof_other(f, "m", "side", "minute", ["value"])
    return out.select("m", "side", "minute", F.round("value", 4).alias("value"), F.round("opp_value", 4).alias("opp_value"))


@query("streak_before", """WITH e AS (SELECT event_id, user_id, event_type <> 'error' AS ok, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island,
  ts FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM e)
SELECT event_id, coalesce(lag(run) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)::BIGINT AS streak_before FROM r""")
def streak_before(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return ordered.with_streak(e, ["user_id"], ["ts", "event_id"], "ok").select("event_id", F.col("streak_before").cast("long").alias("streak_before"))


@query("calendar_streak", """WITH c AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, bool_or(o_orderstatus <> 'O') AS played FROM orders GROUP BY 1, 2),
g AS (SELECT *, coalesce(date_diff('day', lag(day) OVER (PARTITION BY k ORDER BY day), day) > 45, false) AS gap FROM c),
i AS (SELECT *, sum((gap OR NOT played)::INT) OVER (PARTITION BY k ORDER BY day) AS island FROM g),
r AS (SELECT *, CASE WHEN gap THEN 0 ELSE sum(played::INT) OVER (PARTITION BY k, island ORDER BY day) END AS run FROM i)
SELECT k, day, coalesce(lag(run) OVER (PARTITION BY k ORDER BY day), 0)::BIGINT AS streak_before FROM r""")
def calendar_streak(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("day")).agg(F.bool_or(F.col("o_orderstatus") != "O").alias("played"))
    return ordered.with_calendar_streak(o, ["k"], "day", "played").select("k", "day", F.col("streak_before").cast("long").alias("streak_before"))


@query("orphan_checks", """SELECT 'lineitem.order' AS check_name, count(*) AS n_orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer.nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'lineitem.supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'supplier.nation', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'nation.region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT 'labels.document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'events.customer', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'embeddings.document', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'conversations.page', count(*) FROM conversations WHERE conv_id NOT IN (SELECT page_id FROM pages)""")
def orphan_checks(spark, d):
    t = lambda n: table(spark, d, n)
    out = joins.orphans(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "lineitem.order")
    for c, k, p, pk, n in (
        ("orders", "o_custkey", "customer", "c_custkey", "orders.customer"), ("customer", "c_nationkey", "nation", "n_nationkey", "customer.nation"),
        ("lineitem", "l_partkey", "part", "p_partkey", "lineitem.part"), ("lineitem", "l_suppkey", "supplier", "s_suppkey", "lineitem.supplier"),
        ("supplier", "s_nationkey", "nation", "n_nationkey", "supplier.nation"), ("nation", "n_regionkey", "region", "r_regionkey", "nation.region"),
        ("labels", "doc_id", "documents", "doc_id", "labels.document"), ("events", "user_id", "customer", "c_custkey", "events.customer"),
        ("embeddings", "vec_id", "documents", "doc_id", "embeddings.document"), ("conversations", "conv_id", "pages", "page_id", "conversations.page"),
    ):
        out = out.unionByName(joins.orphans(t(c), k, t(p), pk, n))
    return out


_XP = """(SELECT sum(exp(-a) * power(a, i) / factorial(i) * exp(-b) * power(b, j) / factorial(j) * CASE WHEN i > j THEN 3 WHEN i = j THEN 1 ELSE 0 END) FROM (SELECT unnest(range(9))::INT AS i), (SELECT unnest(range(9))::INT AS j))"""


@query("league_table_xpoints", f"""WITH m AS (SELECT o_orderkey, o_custkey % 25 AS home, (o_custkey * 7 + 1) % 25 AS away, (o_totalprice / 100000.0)::DOUBLE AS a, ((o_orderkey % 7) / 3.0)::DOUBLE AS b FROM orders),
t AS (SELECT home AS team, a, b FROM m UNION ALL SELECT away, b, a FROM m), x AS (SELECT team, a, b, {_XP} AS xp FROM t)
SELECT team, count(*) AS played, round(sum(a), 4) AS xgf, round(sum(b), 4) AS xga, round(sum(xp), 4) AS xpoints FROM x GROUP BY team""")
def league_table_xpoints(spark, d):
    o = table(spark, d, "orders")
    k, other = F.col("o_custkey"), ((F.col("o_orderkey") % 7) / F.lit(3.0))
    m = o.select((k % 25).alias("home"), ((k * 7 + 1) % 25).alias("away"), (F.col("o_totalprice") / 100000.0).alias("a"), other.alias("b"))
    sides = F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("away").alias("team"), F.col("b").alias("a"), F.col("a").alias("b"))))
    t = m.select(sides.alias("s")).select("s.*").withColumn("xp", S.expected_points(F.col("a"), F.col("b")))
    return t.groupBy("team").agg(F.count("*").alias("played"), F.round(F.sum("a"), 4).alias("xgf"), F.round(F.sum("b"), 4).alias("xga"), F.round(F.sum("xp"), 4).alias("xpoints"))


def _edges(spark, d):
    li, s, o, c = (table(spark, d, n) for n in ("lineitem", "supplier", "orders", "customer"))
    e = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return e.select(F.lit("all").alias("g"), F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).where("src <> dst").groupBy("g", "src", "dst").agg(F.count("*").alias("weight"))


@query("graph_basics", f"""WITH e AS ({_EDGES}), p AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, count(*) AS ways FROM e GROUP BY 1, 2), v AS (SELECT src AS x FROM e UNION SELECT dst FROM e),
c AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m, (SELECT sum(weight) FROM e)::BIGINT AS w, (SELECT count(*) FROM p) AS pairs, (SELECT sum(CASE WHEN ways = 2 THEN 2.0 ELSE 0 END) FROM p) AS two)
SELECT n AS n_nodes, m AS n_edges, w AS total_weight, round(2.0 * pairs / (n * (n - 1)), 6) AS density, round(two / m, 6)::DOUBLE AS reciprocity FROM c""")
def graph_basics(spark, d):
    b = graph.basics(_edges(spark, d), ["g"])
    return b.select("n_nodes", F.col("n_edges").cast("long").alias("n_edges"), "total_weight", F.round("density", 6).alias("density"), F.round("reciprocity", 6).alias("reciprocity"))


@query("graph_clustering", """WITH e AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS g, least(l_suppkey % 25, l_partkey % 25) AS a, greatest(l_suppkey % 25, l_partkey % 25) AS b FROM lineitem), u AS (SELECT * FROM e WHERE a <> b),
x AS (SELECT g, a, b FROM u UNION ALL SELECT g, b, a FROM u), k AS (SELECT g, a, count(*) AS k FROM x GROUP BY g, a),
t AS (SELECT p.g, p.a, count(*) AS t FROM x p JOIN x q ON p.g = q.g AND p.a = q.a AND p.b < q.b JOIN u ON u.g = p.g AND u.a = p.b AND u.b = q.b GROUP BY p.g, p.a)
SELECT g, round(avg(CASE WHEN k < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (k * (k - 1)) END), 6) AS clustering FROM k LEFT JOIN t USING (g, a) GROUP BY g""")
def graph_clustering(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select(F.col("l_shipdate").cast("date").alias("g"), (F.col("l_suppkey") % 25).alias("src"), (F.col("l_partkey") % 25).alias("dst"))
    return graph.clustering(e, ["g"]).select("g", F.round("clustering", 6).alias("clustering"))


@query("graph_path_metrics")
def graph_path_metrics(spark, d):
    return graph.path_metrics(_edges(spark, d), ["g"])


@query("elo_ratings")
def elo_ratings(spark, d):
    o = table(spark, d, "orders")
    m = o.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 20).alias("home_id"), ((F.col("o_custkey") + 7) % 20).alias("away_id"),
        (F.col("o_orderkey") % 4).alias("home_score"), (F.col("o_custkey") % 3).alias("away_score"), F.year("o_orderdate").alias("league"),
    )
    return rating.elo(m, "league")


_OLD, _NEW = "SELECT c_custkey AS k, c_name AS name, c_acctbal AS v FROM customer", "SELECT p_partkey + 50 AS k, 'new ' || p_name AS name, p_retailprice AS v FROM part"


def _old_new(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    return old, table(spark, d, "part").select((F.col("p_partkey") + 50).alias("k"), F.concat(F.lit("new "), "p_name").alias("name"), F.col("p_retailprice").alias("v"))


@query("upsert_last_wins", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT k, name, round(v, 2) AS v FROM n UNION ALL SELECT k, name, round(v, 2) FROM o WHERE k NOT IN (SELECT k FROM n)")
def upsert_last_wins(spark, d):
    return upsert.last_wins(*_old_new(spark, d), ["k"], "v").select("k", "name", F.round("v", 2).alias("v"))


@query("upsert_first_wins", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT k, name, round(v, 2) AS v FROM o UNION ALL SELECT k, name, round(v, 2) FROM n WHERE k NOT IN (SELECT k FROM o)")
def upsert_first_wins(spark, d):
    return upsert.first_wins(*_old_new(spark, d), ["k"], "v").select("k", "name", F.round("v", 2).alias("v"))


@query("upsert_merged", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.k, n.k) AS k, coalesce(o.name, n.name) AS name, round(coalesce(n.v, o.v), 2) AS v FROM o FULL JOIN n ON o.k = n.k")
def upsert_merged(spark, d):
    return upsert.merged(*_old_new(spark, d), ["k"], {"name": upsert.fill_only("name"), "v": F.round(upsert.overwrite("v", "k"), 2)})


@query("conditional_rename", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN s_name WHEN s_suppkey % 4 = 1 THEN 'Team ' || s_suppkey ELSE 'real' END AS name FROM supplier")
def conditional_rename(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    placeholder = F.concat(F.lit("Team "), k.cast("string"))
    old = s.select(k.alias("k"), F.when(k % 4 < 2, placeholder).otherwise("real").alias("name"))
    new = s.select(k.alias("k"), F.when(k % 4 == 0, F.col("s_name")).otherwise(placeholder).alias("name"))
    return upsert.merged(old, new, ["k"], {"name": upsert.conditional_rename("name")})


@query("surrogate_keys", "SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS id FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def surrogate_keys(spark, d):
    return upsert.surrogate_keys(table(spark, d, "customer"), ["c_mktsegment"], "id").select("c_mktsegment", F.col("id").cast("long").alias("id"))


@query("name_normalise", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(coalesce(text, ''))), '\b(jr|sr|ii|iii|iv)\b', '', 'g'), '[^a-z\s]', '', 'g'), '\s+', ' ', 'g')) AS name FROM documents""")
def name_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", S.norm_name(F.col("text")).alias("name"))


@query("token_subset_join", """WITH l AS (SELECT c_custkey AS a, list_distinct(string_split(c_name || ' ' || c_mktsegment, ' ')) AS t FROM customer),
r AS (SELECT c_custkey AS b, c_mktsegment || ' n' || c_nationkey || ' ' || c_name AS n FROM customer UNION ALL SELECT -1 - c_custkey, c_name || ' second ' || c_mktsegment FROM customer WHERE c_acctbal < 0),
p AS (SELECT a, b FROM l, r WHERE list_has_all(string_split(n, ' '), t)) SELECT a, min(b) AS b FROM p GROUP BY a HAVING count(*) = 1""")
def token_subset_join(spark, d):
    c = table(spark, d, "customer")
    left = c.select(F.col("c_custkey").alias("a"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("ln"))
    right = c.select(F.col("c_custkey").alias("b"), F.expr("c_mktsegment || ' n' || c_nationkey || ' ' || c_name").alias("rn"))
    more = c.where("c_acctbal < 0").select((-1 - F.col("c_custkey")).alias("b"), F.expr("c_name || ' second ' || c_mktsegment").alias("rn"))
    return joins.token_subset(left, "a", "ln", right.unionByName(more), "b", "rn")


def _word(seed: str) -> str:
    """A word of seven letters for each customer, the same text in both engines."""
    return f"translate(substr(md5('{seed}' || CAST(c_custkey AS STRING)), 1, 7), '0123456789abcdef', 'bcdfghjklmnpraei')"


_LONG = f"'old ' || {_word('p')} || ' ' || {_word('q')} || ' ' || {_word('r')}"


@query("name_containment_join", f"""WITH n AS (SELECT c_custkey AS a, {_word('p')} || ' ' || {_word('q')} AS an FROM customer),
r AS (SELECT c_custkey AS b, {_LONG} AS bn FROM customer WHERE c_acctbal > 0 UNION ALL SELECT -1 - c_custkey, substr({_word('q')}, 2, 5) FROM customer WHERE c_acctbal <= 0)
SELECT a, b FROM n JOIN r ON contains(an, bn) OR contains(bn, an)""")
def name_containment_join(spark, d):
    c = table(spark, d, "customer")
    n = c.select(F.col("c_custkey").alias("a"), F.expr(f"{_word('p')} || ' ' || {_word('q')}").alias("an"))
    long = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("b"), F.expr(_LONG).alias("bn"))
    short = c.where("c_acctbal <= 0").select((-1 - F.col("c_custkey")).alias("b"), F.expr(f"substr({_word('q')}, 2, 5)").alias("bn"))
    return joins.contains_either_way(n, "an", long.unionByName(short), "bn").select("a", "b")


_LEFT, _RIGHT = f"{_word('p')} || ' ' || {_word('q')}", f"{_word('p')} || ' ' || substr({_word('q')}, 1, 5) || 'z'"


@query("fuzzy_block_join", f"""WITH l AS (SELECT c_custkey AS a, {_LEFT} AS an FROM customer), r AS (SELECT c_custkey AS b, {_RIGHT} AS bn FROM customer),
p AS (SELECT a, b, (1 - levenshtein(an, bn)::DOUBLE / greatest(length(an), length(bn))) * 100 AS score FROM l JOIN r ON substr(string_split(an, ' ')[-1], 1, 1) = substr(string_split(bn, ' ')[-1], 1, 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM p WHERE score >= 60) SELECT a, b, round(score, 4) AS score FROM o WHERE n = 1""")
def fuzzy_block_join(spark, d):
    c = table(spark, d, "customer")
    left, right = c.select(F.col("c_custkey").alias("a"), F.expr(_LEFT).alias("an")), c.select(F.col("c_custkey").alias("b"), F.expr(_RIGHT).alias("bn"))
    return joins.fuzzy_block(left, "a", "an", right, "b", "bn", 60.0, written(spark)).select("a", "b", F.round("score", 4).alias("score"))


@query("date_multi_parse", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def date_multi_parse(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.select("o_orderkey", S.parse_date(text).alias("parsed"))


@query("age_years", "SELECT o_orderkey, coalesce(date_part('year', age(CAST(o_orderdate AS DATE), DATE '1970-01-01' + (o_custkey % 9000)::INT)), 25)::INT AS years FROM orders")
def age_years(spark, d):
    born = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("o_custkey") % 9000).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(S.age_years(F.col("o_orderdate").cast("date"), born), F.lit(25)).alias("years"))



@query("geometry_shots", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(119.0, l_quantity * 2.4)::DOUBLE AS x, (l_partkey % 80)::DOUBLE AS y, (l_suppkey % 120)::DOUBLE AS dx, (l_partkey % 79)::DOUBLE AS dy FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt((120 - x) ** 2 + (40 - y) ** 2), 6) AS distance,
  round(acos(greatest(-1, least(1, ((120 - x) ** 2 + (36 - y) * (44 - y)) / (sqrt((120 - x) ** 2 + (36 - y) ** 2) * sqrt((120 - x) ** 2 + (44 - y) ** 2))))), 6) AS angle FROM p""")
def geometry_shots(spark, d):
    p = table(spark, d, "lineitem").withColumns({"x": F.least(F.lit(119.0), F.col("l_quantity") * 2.4), "y": (F.col("l_partkey") % 80).cast("double")})
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(S.distance(F.col("x"), F.col("y")), 6).alias("distance"), F.round(S.shot_angle(F.col("x"), F.col("y")), 6).alias("angle"))


@query("point_in_triangle", """WITH p AS (SELECT user_id, event_id, 100.0 + user_id % 20 AS x, value * 0.8 AS y FROM events), s AS (SELECT *, (x - 120.0) * (40 - 36.0) - (108.0 - 120.0) * (y - 36.0) AS d1, (x - 120.0) * (36.0 - 44.0) - 0 * (y - 44.0) AS d2,
  (x - 108.0) * (44.0 - 40) - (120.0 - 108.0) * (y - 40) AS d3 FROM p) SELECT event_id, NOT ((d1 < 0 OR d2 < 0 OR d3 < 0) AND (d1 > 0 OR d2 > 0 OR d3 > 0)) AS inside FROM s""")
def point_in_triangle(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.in_cone(100.0 + F.col("user_id") % 20, F.col("value") * 0.8, F.lit(108.0), F.lit(40.0)).alias("inside"))


@query("vector_cosine", """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2), q AS (SELECT label, list(m ORDER BY i) AS u FROM c GROUP BY label)
SELECT vec_id, label AS signature, round(list_cosine_similarity(v, u), 6) AS cosine FROM a, q""")
def vector_cosine(spark, d):
    e = table(spark, d, "embeddings")
    m = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    q = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("u"))  # a signature per label: ten rows, whatever the number of vectors
    return e.select("vec_id", "embedding").join(F.broadcast(q)).select("vec_id", F.col("label").alias("signature"), F.round(S.cosine(F.col("embedding"), F.col("u")), 6).alias("cosine"))


@query("cluster_centroid_distance", """WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.m - b.m) ** 2)), 5) AS distance FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def cluster_centroid_distance(spark, d):
    c = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.label") < F.col("b.label")))
    return pairs.groupBy(F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(F.round(F.sqrt(F.sum(F.pow(F.col("a.m") - F.col("b.m"), F.lit(2)))), 5).alias("distance"))


@query("group_folds", """WITH f AS (SELECT l_orderkey, CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 15))::BIGINT % 5 AS INT) AS fold FROM lineitem)
SELECT fold, count(DISTINCT l_orderkey) AS n_groups, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM f GROUP BY fold""")
def group_folds(spark, d):
    from ..operators.evaluation import with_fold

    f = with_fold(table(spark, d, "lineitem"), "l_orderkey", 5)
    return f.groupBy("fold").agg(F.count_distinct("l_orderkey").alias("n_groups"), F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"))


@query("cluster_kmeans")
def cluster_kmeans(spark, d):
    from ..operators.learning import kmeans

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return kmeans(e, "v", 9, 42, restarts=30).select("vec_id", "cluster")


@query("workload_7_14", f"""WITH {_O} SELECT a.o_orderkey, count(b.o_orderkey) FILTER (WHERE b.day >= a.day - 7) AS matches_7, count(b.o_orderkey) AS matches_14,
  round(coalesce(sum(b.o_totalprice) FILTER (WHERE b.day >= a.day - 7), 0), 2) AS minutes_7, round(coalesce(sum(b.o_totalprice), 0), 2) AS minutes_14
FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.day < a.day AND b.day >= a.day - 14 GROUP BY a.o_orderkey""")
def workload_7_14(spark, d):
    o, dn = _orders(spark, d), F.col("dn")
    w = {n: ordered.prior_days(["o_custkey"], dn, n) for n in (7, 14)}
    n = [F.count("*").over(w[k]).alias(f"matches_{k}") for k in w]
    return o.select("o_orderkey", *n, *[F.round(F.coalesce(F.sum("o_totalprice").over(w[k]), F.lit(0.0)), 2).alias(f"minutes_{k}") for k in w])


@query("graph_last_wins", """WITH r AS (SELECT CAST(l_shipdate AS DATE) AS g, l_suppkey % 25 AS src, l_partkey % 25 AS dst, l_quantity AS w,
    row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_suppkey % 25, l_partkey % 25 ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS k FROM lineitem),
e AS (SELECT g, src, dst, w FROM r WHERE k = 1 AND src <> dst), v AS (SELECT g, src AS x FROM e UNION SELECT g, dst FROM e), n AS (SELECT g, count(*) AS n FROM v GROUP BY g),
t AS (SELECT g, x, count(*) AS d FROM (SELECT g, src AS x FROM e UNION ALL SELECT g, dst FROM e) GROUP BY 1, 2), c AS (SELECT g, max(d) AS d, avg(d) AS m FROM t GROUP BY g)
SELECT e.g, any_value(n) AS n_nodes, count(*) AS n_edges, sum(w) AS total_weight, round(any_value(d)::DOUBLE / (any_value(n) - 1), 6) AS degree_max, round(any_value(m) / (any_value(n) - 1), 6) AS degree_mean
FROM e JOIN n USING (g) JOIN c USING (g) GROUP BY e.g""")
def graph_last_wins(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select(
        F.col("l_shipdate").cast("date").alias("g"), (F.col("l_suppkey") % 25).alias("src"), (F.col("l_partkey") % 25).alias("dst"), F.col("l_quantity").alias("weight"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("order"),
    )
    built = graph.built(e, ["g"], "order")
    size = built.groupBy("g").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("total_weight"))
    degree = graph.degrees(built, ["g"]).groupBy("g").agg(F.count("*").alias("n_nodes"), F.round(F.max("centrality"), 6).alias("degree_max"), F.round(F.avg("centrality"), 6).alias("degree_mean"))
    return size.join(degree, "g").select("g", "n_nodes", "n_edges", "total_weight", "degree_max", "degree_mean")
