"""Graph queries over many graphs at once: a day of order lines is a graph of suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import centrality
from ..sources.readers import table
from ..sources.shared import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put


def edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("g"), (F.col("l_suppkey") % 25).alias("src"), (F.col("l_partkey") % 25).alias("dst"), F.col("l_quantity").alias("weight"))


_E = """e AS MATERIALIZED (SELECT date_trunc('month', CAST(l_shipdate AS DATE))::DATE AS g, l_suppkey % 25 AS src, l_partkey % 25 AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem WHERE l_suppkey % 25 <> l_partkey % 25 GROUP BY 1, 2, 3),
v AS MATERIALIZED (SELECT g, x, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, src AS x FROM e UNION SELECT g, dst FROM e)),
t AS (SELECT g, src, sum(w) AS t FROM e GROUP BY 1, 2),
h AS MATERIALIZED (SELECT e.g, e.src, dst, w / t AS share FROM e JOIN t ON e.g = t.g AND e.src = t.src UNION ALL SELECT v.g, v.x, o.x, 1.0 / v.n FROM v ANTI JOIN t ON v.g = t.g AND v.x = t.src JOIN v o ON o.g = v.g UNION ALL SELECT g, x, x, 0 FROM v)"""


@query("graph_page_ranks", f"""WITH RECURSIVE {_E}, r AS (SELECT 0 AS i, g, x, n, 1.0::DOUBLE / n AS p FROM v UNION ALL
  SELECT i + 1, r.g, h.dst, max(n), 0.15 / max(n) + 0.85 * sum(p * share) FROM r JOIN h ON r.g = h.g AND r.x = h.src WHERE i < 100 GROUP BY i, r.g, h.dst)
SELECT g, x AS node, round(p, 6) AS rank FROM r WHERE i = 100""")
def graph_page_ranks(spark, d):
    return centrality.page_ranks(edges(spark, d), ["g"], written(spark)).select("g", "node", F.round("rank", 6).alias("rank"))


@query("graph_components", """WITH RECURSIVE e AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS g, l_suppkey % 25 AS a, l_partkey % 25 AS b FROM lineitem WHERE l_suppkey % 25 <> l_partkey % 25),
b AS MATERIALIZED (SELECT g, a, b FROM e UNION SELECT g, b, a FROM e), r AS (SELECT g, a AS x, a AS y FROM b UNION SELECT r.g, r.x, b.b FROM r JOIN b ON r.g = b.g AND r.y = b.a)
SELECT g, x AS node, min(y) AS root FROM r GROUP BY g, x""")
def graph_components(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select(F.col("l_shipdate").cast("date").alias("g"), (F.col("l_suppkey") % 25).alias("src"), (F.col("l_partkey") % 25).alias("dst"), F.lit(1.0).alias("weight"))
    return centrality.components(e, ["g"], written(spark))


def _paths() -> str:
    """Distances by doubling, five times for up to 32 edges, and shortest paths counted edge by edge."""
    out = ["d0 AS (SELECT g, src AS s, dst AS t, w AS d FROM e)"]
    for i in range(5):
        out.append(f"d{i + 1} AS MATERIALIZED (SELECT g, s, t, min(d) AS d FROM (SELECT * FROM d{i} UNION ALL SELECT a.g, a.s, b.t, a.d + b.d FROM d{i} a JOIN d{i} b ON a.g = b.g AND a.t = b.s WHERE a.s <> b.t) GROUP BY 1, 2, 3)")
    out.append("p0 AS (SELECT d.g, s, t, 1.0 AS k FROM d5 d JOIN e ON e.g = d.g AND e.src = s AND e.dst = t WHERE abs(w - d) <= 1e-9)")
    for i in range(12):
        out.append(f"""p{i + 1} AS MATERIALIZED (SELECT p.g, p.s, e.dst AS t, sum(k) AS k FROM p{i} p JOIN d5 u ON u.g = p.g AND u.s = p.s AND u.t = p.t JOIN e ON e.g = p.g AND e.src = p.t
  JOIN d5 d ON d.g = p.g AND d.s = p.s AND d.t = e.dst WHERE abs(u.d + w - d.d) <= 1e-9 GROUP BY 1, 2, 3)""")
    every = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(13))
    out.append(f"k AS MATERIALIZED (SELECT c.g, c.s, c.t, c.k, d.d FROM (SELECT g, s, t, sum(k) AS k FROM ({every}) GROUP BY 1, 2, 3) c JOIN d5 d ON d.g = c.g AND d.s = c.s AND d.t = c.t)")
    return ",\n".join(out)


@query("graph_betweenness", f"""WITH {_E},\n{_paths()},
x AS (SELECT a.g, a.t AS node, sum(a.k * b.k / c.k) AS x FROM k a JOIN k b ON a.g = b.g AND a.t = b.s JOIN k c ON c.g = a.g AND c.s = a.s AND c.t = b.t WHERE a.s <> b.t AND abs(a.d + b.d - c.d) <= 1e-9 GROUP BY 1, 2)
SELECT v.g, v.x AS node, round(coalesce(x.x, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END, 6) AS score FROM v LEFT JOIN x ON x.g = v.g AND x.node = v.x""")
def graph_betweenness(spark, d):
    return centrality.betweenness(edges(spark, d), ["g"], written(spark)).select("g", "node", F.round("score", 6).alias("score"))


_RANKED = ORACLE["graph_page_ranks"].replace("round(p, 6) AS rank", "p AS rank")
_SCORED = ORACLE["graph_betweenness"].replace("round(coalesce(x.x, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END, 6)", "coalesce(x.x, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END")


@query("graph_hubs", f"""SELECT g, count(*) AS n_nodes, round(max(rank) / avg(rank), 5) AS hub_dominance, round(stddev_pop(rank), 6) AS pagerank_std, round(max(score), 6) AS betweenness_max,
  round(max(score) - avg(score), 6) AS centralization FROM ({_RANKED}) a JOIN ({_SCORED}) b USING (g, node) GROUP BY g""")
def graph_hubs(spark, d):
    s = centrality.summary(edges(spark, d), ["g"], written(spark))
    return s.select("g", "n_nodes", F.round("hub_dominance", 5).alias("hub_dominance"), *[F.round(c, 6).alias(c) for c in ("pagerank_std", "betweenness_max", "centralization")])
