"""Queries on evaluation: balanced folds, calibration out of fold, rank correlations and their p-values, silhouettes, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, evaluation, learning, neighbours, ranks
from ..sources.readers import table
from ..sources.shared import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


@query("balanced_folds", """WITH RECURSIVE g AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n DESC, k) AS i FROM g),
r AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS w, [0, 0, 0, 0, 0]::BIGINT[] AS c UNION ALL
  SELECT pos, list_transform(range(1, 6), lambda j: w[j] + CASE WHEN j = f THEN n ELSE 0 END), list_transform(range(1, 6), lambda j: c[j] + CASE WHEN j = f THEN 1 ELSE 0 END)
  FROM (SELECT o.i AS pos, w, c, n, list_position(w, list_min(w)) AS f FROM r JOIN o ON o.i = r.i + 1))
SELECT unnest(range(5))::INT AS fold, unnest(c)::BIGINT AS n_groups, unnest(w)::BIGINT AS n FROM (SELECT w, c FROM r ORDER BY i DESC LIMIT 1)""")
def balanced_folds(spark, d):
    f = evaluation.with_balanced_fold(table(spark, d, "orders"), "o_custkey", 5)
    return f.groupBy("fold").agg(F.count_distinct("o_custkey").alias("n_groups"), F.count("*").alias("n"))


@query("stratified_folds")
def stratified_folds(spark, d):
    rows = table(spark, d, "orders").withColumn("y", (F.col("o_orderstatus") == "P").cast("int"))
    f = evaluation.with_balanced_fold(rows, "o_custkey", 5, "y")
    return f.groupBy("fold").agg(F.count_distinct("o_custkey").alias("n_groups"), F.count("*").alias("n"), F.sum("y").alias("n_positive"))


@query("calibration_folds", """WITH r AS (SELECT round(least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE), 2) AS s, toxic::DOUBLE AS y, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % 3 AS fold FROM labels JOIN documents USING (doc_id)),
k AS (SELECT unnest(range(3)) AS f), t AS (SELECT f, s, count(*) AS n, sum(y) AS p FROM r JOIN k ON fold <> f GROUP BY f, s),
c AS (SELECT f, s, n, p, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM t WINDOW w AS (PARTITION BY f ORDER BY s)),
m AS (SELECT x.f, x.i, a.i AS a, min((b.cp - a.cp + a.p) / (b.cn - a.cn + a.n)) AS least FROM c x JOIN c a ON a.f = x.f AND a.i <= x.i JOIN c b ON b.f = x.f AND b.i >= x.i GROUP BY 1, 2, 3),
fit AS (SELECT c.f, c.s, max(least) AS v FROM m JOIN c ON m.f = c.f AND m.i = c.i GROUP BY 1, 2),
h AS (SELECT DISTINCT fold AS f, s FROM r),
e AS (SELECT h.f, h.s, lo.s AS s0, lo.v AS v0, hi.s AS s1, hi.v AS v1 FROM h ASOF LEFT JOIN fit lo ON h.f = lo.f AND h.s >= lo.s ASOF LEFT JOIN fit hi ON h.f = hi.f AND h.s <= hi.s),
z AS (SELECT f, s, CASE WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL THEN v0 WHEN s0 = s1 THEN v0 ELSE v0 + (v1 - v0) * (s - s0) / (s1 - s0) END AS v FROM e),
q AS (SELECT avg((r.s - y) ** 2) AS before, avg((v - y) ** 2) AS after FROM r JOIN z ON r.fold = z.f AND r.s = z.s)
SELECT round(before, 6) AS before, round(after, 6) AS after, after < before AS kept FROM q""")
def calibration_folds(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 2).alias("s"))
    rows = table(spark, d, "labels").select("doc_id", "toxic").join(docs, "doc_id")
    model, before, after = learning.calibrated(rows, "toxic", "s", "doc_id")
    return spark.createDataFrame([(round(before, 6), round(after, 6), model is not None)], "before double, after double, kept boolean")


def _density(f: str, low: str, high: str, steps: int = 20_000) -> str:
    """Simpson's rule over f(u) from low to high."""
    return f"(SELECT sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f}) * (({high}) - ({low})) / {steps} / 3 FROM (SELECT i, ({low}) + (({high}) - ({low})) * i / {steps} AS u FROM range({steps} + 1) s(i)))"


_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _COLUMNS)
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]
_T = "exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * power(1 + u * u / (n - 2), -(n - 1) / 2.0)"


@query("spearman_matrix", f"""WITH r AS (SELECT {_RANKED} FROM lineitem), c AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS rho FROM r" for a, b in _PAIRS)}),
t AS (SELECT *, abs(rho) * sqrt((n - 2) / ((1 - rho) * (1 + rho))) AS t FROM c)
SELECT a, b, n, round(rho, 6) AS rho, round(CASE WHEN t > 30 THEN 0 ELSE 1 - 2 * {_density(_T, '0', 't')} END, 6) AS p FROM t""")
def spearman_matrix(spark, d):
    m = ranks.spearman_matrix(table(spark, d, "lineitem"), list(_COLUMNS))
    return m.select("a", "b", "n", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"))


_CHI = "CASE WHEN u = 0 THEN 0 ELSE exp((df / 2.0 - 1) * ln(u) - u / 2 - df / 2.0 * ln(2) - lgamma(df / 2.0)) END"


@query("kruskal_test", f"""WITH r AS (SELECT l_returnflag || l_linestatus || (l_linenumber::VARCHAR) AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r, l_quantity AS v FROM lineitem),
s AS (SELECT g, sum(r)::DOUBLE AS s, count(*)::DOUBLE AS m FROM r GROUP BY g), n AS (SELECT sum(m) AS n, count(*) - 1 AS df, sum(s * s / m) AS q FROM s),
t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v)), h AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, df FROM n, t)
SELECT round(h, 4) AS h, df, round(1 - {_density(_CHI, '0', 'h')}, 5) AS p FROM h""")
def kruskal_test(spark, d):
    rows = table(spark, d, "lineitem").withColumn("g", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))
    return ranks.kruskal(rows, "l_quantity", "g").select(F.round("h", 4).alias("h"), "df", F.round("p", 5).alias("p"))


@query("chi_square_test", f"""WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), x AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1),
k AS (SELECT sum((coalesce(n, 0) - na * nb / t) ** 2 / (na * nb / t)) AS chi2, (count(DISTINCT x.a) - 1) * (count(DISTINCT y.b) - 1) AS df FROM x, y, (SELECT sum(n)::DOUBLE AS t FROM c) z LEFT JOIN c ON c.a = x.a AND c.b = y.b)
SELECT round(chi2, 6) AS chi2, df, round(1 - {_density(_CHI, '0', 'chi2')}, 5) AS p FROM k""")
def chi_square_test(spark, d):
    return ranks.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber").select(F.round("chi2", 6).alias("chi2"), "df", F.round("p", 5).alias("p"))


@query("silhouette_euclidean", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
k AS (SELECT label, count(*) AS n FROM e GROUP BY 1), m AS (SELECT vec_id, own, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d JOIN k ON other = label GROUP BY 1, 2)
SELECT own AS label, count(*) AS n, round(avg(CASE WHEN n > 1 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS silhouette FROM m JOIN k ON own = label GROUP BY own""")
def silhouette_euclidean(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    s = neighbours.silhouettes(e, "vec_id", "embedding", "label")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 5).alias("silhouette"))


@query("nearest_vectors", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, other, rank FROM (SELECT a.vec_id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= 5""")
def nearest_vectors(spark, d):
    found = neighbours.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 5)
    return found.select("vec_id", F.posexplode("neighbours").alias("i", "n")).select("vec_id", F.col("n.key").alias("other"), (F.col("i") + 1).cast("long").alias("rank"))


@query("density_clusters", """WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id AS i, embedding::DOUBLE[] AS v FROM embeddings), d AS MATERIALIZED (SELECT a.i, b.i AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.i <> b.i),
f AS (SELECT quantile_cont(d, 0.5) AS eps FROM (SELECT d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM d) WHERE k = 5),
n AS MATERIALIZED (SELECT i, j FROM d, f WHERE d <= eps), c AS MATERIALIZED (SELECT i FROM n GROUP BY i HAVING count(*) + 1 >= 5), l AS MATERIALIZED (SELECT n.i, n.j FROM n JOIN c ON c.i = n.i JOIN c o ON o.i = n.j),
r AS (SELECT i AS x, i AS y FROM c UNION SELECT r.x, l.j FROM r JOIN l ON r.y = l.i), t AS (SELECT x, min(y) AS root FROM r GROUP BY x), k AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM t)),
m AS (SELECT x AS i, cluster FROM t JOIN k USING (root)), b AS (SELECT n.i, min(cluster) AS cluster FROM n JOIN m ON m.i = n.j WHERE n.i NOT IN (SELECT i FROM c) GROUP BY n.i)
SELECT e.i AS vec_id, coalesce(m.cluster, b.cluster, -1)::INT AS cluster FROM e LEFT JOIN m USING (i) LEFT JOIN b USING (i)""")
def density_clusters(spark, d):
    return clusters.density(table(spark, d, "embeddings"), "vec_id", "embedding", written(spark), quantile=0.5)
