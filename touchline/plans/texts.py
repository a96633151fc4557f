"""Queries that are plain SQL in both engines. Where the dialects differ the Spark text is given beside the DuckDB one.

On the driver's tables orders stand for matches, customers and suppliers for teams, parts for
players, lineitems for player rows of a match, and events for minute snapshots and injuries.
"""

from __future__ import annotations

import re

from ..sources.readers import TABLES, run_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_NAMES = re.compile(r"(?i)\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")


def add(name: str, duck: str, spark: str | None = None) -> None:
    text = _NAMES.sub(r"\1 {\2} AS \2", spark or duck)
    text = re.sub(r"(\{\w+\}) AS \w+ (?=[a-z]\w*\b)(?!(?:WHERE|GROUP|ORDER|LEFT|JOIN|ON|USING|CROSS|LIMIT|UNION|LATERAL|HAVING)\b)", r"\1 AS ", text)
    text = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1D", text)  # a plain 1.0 would be a decimal
    QUERIES[name] = lambda spark, sf_dir, text=text: run_sql(spark, sf_dir, text)
    ORACLE[name] = duck


# flagship: players with enough matches, mode of a label, means, top 12 by a composite, radar scaling
add("player_efficiency", """
SELECT l_partkey AS player_id, p_brand AS archetype, mode(l_returnflag ORDER BY l_returnflag) AS main_position, count(*) AS n_matches,
  round(avg(l_discount), 6) AS xg_mean, round(avg(l_tax), 6) AS xa_mean, round(avg(l_quantity), 6) AS minutes_mean,
  round(avg(l_quantity) * count(*), 4) AS minutes, round(least(100.0, avg(l_discount) * 1000), 1) AS radar_xg
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
GROUP BY l_partkey, p_brand HAVING count(*) >= 3
ORDER BY round(avg(l_discount) + avg(l_tax), 9) DESC, l_partkey LIMIT 12""", """
SELECT l_partkey AS player_id, p_brand AS archetype, mode() WITHIN GROUP (ORDER BY l_returnflag) AS main_position, count(*) AS n_matches,
  round(avg(l_discount), 6) AS xg_mean, round(avg(l_tax), 6) AS xa_mean, round(avg(l_quantity), 6) AS minutes_mean,
  round(avg(l_quantity) * count(*), 4) AS minutes, round(least(100.0, avg(l_discount) * 1000), 1) AS radar_xg
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
GROUP BY l_partkey, p_brand HAVING count(*) >= 3
ORDER BY round(avg(l_discount) + avg(l_tax), 9) DESC, l_partkey LIMIT 12""")

add("season_options", """SELECT team_id, season, count(*) AS n FROM (SELECT o_custkey % 25 AS team_id, year(o_orderdate) AS season FROM orders
  UNION ALL SELECT (o_custkey * 7 + 1) % 25, year(o_orderdate) FROM orders WHERE (o_custkey * 7 + 1) % 25 <> o_custkey % 25) AS t GROUP BY team_id, season""")
add("either_side", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
add("latest_matches", """SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, concat(c_name, ' v ', n_name) AS label
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 40""")
add("team_options", "SELECT DISTINCT n_nationkey AS team_id, n_name AS team_name FROM nation")
add("coverage", """SELECT r_name AS competition, year(o_orderdate) AS season, count(*) AS matches, count(DISTINCT o_custkey) AS teams
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, year(o_orderdate)""")
add("coverage_rollup", """SELECT r_name AS competition, year(o_orderdate) AS season, count(*) AS matches
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, year(o_orderdate))""")
add("position_counts", "SELECT coalesce(nullif(trim(c_mktsegment), ''), 'Unknown') AS position, count(*) AS n FROM customer GROUP BY 1")
add("value_histogram", """SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE CAST(floor(value / 5.0) AS INT) + 1 END AS bucket, count(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY 1""", "SELECT CAST(width_bucket(value, 0, 100, 20) AS INT) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
add("goals_distribution", "SELECT n_lines, count(*) AS n FROM (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) AS t GROUP BY n_lines")
add("conversion_by_class", """SELECT l_shipmode_class, count(*) AS shots, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS goals,
  round(avg(CASE WHEN l_returnflag = 'R' THEN 100.0 ELSE 0.0 END), 6) AS conversion
FROM (SELECT *, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS l_shipmode_class FROM lineitem) AS t GROUP BY l_shipmode_class""")
add("label_balance", "SELECT toxic, count(*) AS n, round(avg(quality), 6) AS quality_mean FROM labels GROUP BY toxic")
add("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
add("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
), " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS STRING) AS least, CAST(max({c}) AS STRING) AS greatest FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
))
add("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
add("stat_validity", """SELECT CAST(sum(CASE WHEN l_quantity < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_minutes, CAST(sum(CASE WHEN l_discount < 0 OR l_discount > 1 THEN 1 ELSE 0 END) AS BIGINT) AS rate_out_of_range,
  CAST(sum(CASE WHEN l_orderkey IS NULL OR l_partkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_keys, count(*) AS n FROM lineitem""")
add("finishing_leaders", """SELECT player_id, shots, goals, xg, round(goals - xg, 2) AS xg_diff FROM (
  SELECT l_partkey AS player_id, count(*) AS shots, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS goals, round(sum(CAST(l_discount AS DECIMAL(12, 4))), 2) AS xg FROM lineitem GROUP BY l_partkey) AS t
ORDER BY goals - xg DESC, player_id LIMIT 15""", """SELECT player_id, shots, goals, CAST(xg AS DOUBLE) AS xg, CAST(round(goals - xg, 2) AS DOUBLE) AS xg_diff FROM (
  SELECT l_partkey AS player_id, count(*) AS shots, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS goals, round(sum(CAST(l_discount AS DECIMAL(12, 4))), 2) AS xg FROM lineitem GROUP BY l_partkey) AS t
ORDER BY goals - xg DESC, player_id LIMIT 15""")
ORACLE["finishing_leaders"] = ORACLE["finishing_leaders"].replace("goals, xg, round(goals - xg, 2) AS xg_diff", "goals, xg::DOUBLE AS xg, round(goals - xg, 2)::DOUBLE AS xg_diff")
add("shot_map", """SELECT l_suppkey AS team_id, l_orderkey AS match_id, l_linenumber AS shot_no, l_partkey AS player_id, coalesce(p_brand, concat('Player ', CAST(l_partkey AS VARCHAR))) AS player_name,
  round(coalesce(l_discount, l_tax, 0.0), 4) AS xg, round(3 + sqrt(greatest(0.0, l_discount)) * 15, 6) AS radius
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""", """SELECT l_suppkey AS team_id, l_orderkey AS match_id, l_linenumber AS shot_no, l_partkey AS player_id, coalesce(p_brand, concat('Player ', CAST(l_partkey AS STRING))) AS player_name,
  round(coalesce(l_discount, l_tax, 0.0), 4) AS xg, round(3 + sqrt(greatest(0.0, l_discount)) * 15, 6) AS radius
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
add("team_record", """SELECT l_suppkey AS team_id, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS wins,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS draws, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS losses,
  round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM lineitem GROUP BY l_suppkey""")
add("win_rate_by_match", """SELECT team_id, count(*) AS n_matches, round(avg(won), 6) AS win_rate FROM (
  SELECT l_suppkey AS team_id, l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS won FROM lineitem GROUP BY l_suppkey, l_orderkey) AS t GROUP BY team_id""")
add("win_probability_fallback", """SELECT s_suppkey AS team_id, coalesce(r.win_pct, CAST(60 + 2 * (s_suppkey % 4) AS DOUBLE)) AS win_pct, CASE WHEN r.win_pct IS NULL THEN 'demo' ELSE 'database' END AS source
FROM supplier LEFT JOIN (SELECT l_suppkey, round(avg(CASE WHEN l_returnflag = 'A' THEN 100.0 ELSE 0.0 END), 4) AS win_pct FROM lineitem GROUP BY l_suppkey
  HAVING sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) >= sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)) AS r ON s_suppkey = r.l_suppkey""")
add("injury_risk_rows", """SELECT l_partkey AS player_id, count(*) AS n, round(avg(l_quantity), 6) AS minutes_mean, year(max(o_orderdate)) - year(min(o_orderdate)) AS seasons,
  CASE WHEN avg(l_discount) >= 0.067 THEN 'high' WHEN avg(l_discount) >= 0.04 THEN 'medium' ELSE 'low' END AS risk
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey HAVING count(*) >= 3 ORDER BY sum(CAST(l_quantity AS BIGINT)) DESC, l_partkey LIMIT 15""")
add("weighted_position", """SELECT l_partkey AS player_id, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 4) AS x, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) AS y
FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 0""")
_EDGES = """SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey"""
add("pass_edges", _EDGES)
add("edge_top40", f"""WITH e AS ({_EDGES}) SELECT a.n_name AS passer, b.n_name AS receiver, weight FROM e JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey
ORDER BY weight DESC, src, dst LIMIT 40""")
add("partner_degree", f"WITH e AS ({_EDGES}) SELECT node, count(DISTINCT partner) AS degree FROM (SELECT src AS node, dst AS partner FROM e UNION SELECT dst AS node, src AS partner FROM e) AS t GROUP BY node")
add("network_kpi", f"""WITH e AS ({_EDGES}), v AS (SELECT src AS node FROM e UNION SELECT dst AS node FROM e),
s AS (SELECT (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM v) AS n)
SELECT n AS nodes, m AS edges, round(2.0 * m / n, 6) AS avg_degree, round(least(1.0, CAST(m AS DOUBLE) / (n * (n - 1))), 6) AS density FROM s""")
add("edge_gini", f"""WITH e AS ({_EDGES}), r AS (SELECT weight, row_number() OVER (ORDER BY weight, src, dst) AS i, count(*) OVER () AS n FROM e)
SELECT round(CAST(2 * sum(i * weight) AS DOUBLE) / (max(n) * CAST(sum(weight) AS DOUBLE)) - (max(n) + 1.0) / max(n), 6) AS gini FROM r""")
add("edge_entropy", f"""WITH e AS ({_EDGES}), p AS (SELECT CAST(weight AS DOUBLE) / sum(weight) OVER () AS p FROM e)
SELECT round(-sum(p * ln(p + 1e-12)) / ln(count(*)), 6) AS entropy FROM p""")
add("edge_topk_share", f"""WITH e AS ({_EDGES}), r AS (SELECT weight, row_number() OVER (ORDER BY weight DESC, src, dst) AS i FROM e)
SELECT round(CAST(sum(CASE WHEN i <= 3 THEN weight ELSE 0 END) AS DOUBLE) / sum(weight), 6) AS top3_share, round(CAST(max(weight) AS DOUBLE) / sum(weight), 6) AS max_share FROM r""")
add("running_totals", """SELECT user_id, minute, CAST(sum(n) OVER w AS BIGINT) AS events_so_far, round(sum(v) OVER w, 4) AS value_so_far FROM (
  SELECT user_id, hour(ts) AS minute, count(*) AS n, sum(value) AS v FROM events GROUP BY user_id, hour(ts)) AS t
WINDOW w AS (PARTITION BY user_id ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
add("cumulative_race", """SELECT event_id, user_id, event_type = 'purchase' AS marker, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total
FROM events""")
add("sampled_snapshots", """SELECT user_id, event_id, h FROM (SELECT user_id, event_id, hour(ts) AS h, max(event_id) OVER (PARTITION BY user_id) AS last_id FROM events) AS t
WHERE (h % 5 = 0 AND h > 0) OR event_id = last_id""")
add("team_rollup", """SELECT l_orderkey AS match_id, l_suppkey AS team_id, round(sum(l_discount), 6) AS xg, round(avg(l_tax), 6) AS tax_mean, max(l_quantity) AS minutes_max, count(l_shipdate) FILTER (WHERE l_shipdate IS NOT NULL) AS dated
FROM lineitem GROUP BY l_orderkey, l_suppkey""")
add("home_away_rows", """SELECT o_orderkey AS match_id, o_custkey AS team_id, 1 AS is_home, CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS points FROM orders
UNION ALL SELECT o_orderkey, o_custkey % 50, 0, CASE WHEN o_orderstatus = 'O' THEN 3 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END FROM orders""")
add("zscore_groups", """SELECT segment, round((m - avg(m) OVER ()) / CASE WHEN stddev_pop(m) OVER () = 0 THEN 1 ELSE stddev_pop(m) OVER () END, 6) AS z
FROM (SELECT c_mktsegment AS segment, avg(c_acctbal) AS m FROM customer GROUP BY c_mktsegment) AS t""")
add("avg_rank_composite", """SELECT team_id, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 + rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS composite
FROM (SELECT l_suppkey AS team_id, count(*) AS a, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) % 50 AS b FROM lineitem GROUP BY l_suppkey) AS t""")
QUERIES["avg_rank_composite"] = lambda spark, sf_dir, q=QUERIES["avg_rank_composite"]: q(spark, sf_dir).selectExpr("team_id", "CAST(composite AS DOUBLE) AS composite")
ORACLE["avg_rank_composite"] = f"SELECT team_id, composite::DOUBLE AS composite FROM ({ORACLE['avg_rank_composite']})"
add("decile_calibration", """WITH q AS (SELECT list_distinct(quantile_cont(l_extendedprice, [i / 10.0 FOR i IN range(11)])) AS e FROM lineitem), r AS (SELECT list_sort(e) AS e FROM q)
SELECT bucket, count(*) AS n, round(avg(s), 6) AS predicted, round(avg(y), 6) AS observed FROM (
  SELECT l_discount AS s, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, (len(list_filter(e[2:len(e) - 1], lambda x: x < l_extendedprice)) + 1)::INT AS bucket FROM lineitem, r) AS t GROUP BY bucket""", "SELECT 1")
add("quantile_tiers", """WITH q AS (SELECT quantile_cont(c_acctbal, 0.5) AS a, quantile_cont(c_acctbal, 0.8) AS b, quantile_cont(c_acctbal, 0.95) AS c FROM customer),
t AS (SELECT CASE WHEN c_acctbal < a THEN 'Low' WHEN c_acctbal < b THEN 'Medium' WHEN c_acctbal < c THEN 'High' ELSE 'Very High' END AS tier, c_acctbal FROM customer, q)
SELECT tier, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM t GROUP BY tier""", """WITH q AS (SELECT percentile(c_acctbal, array(0.5, 0.8, 0.95)) AS p FROM customer),
t AS (SELECT CASE WHEN c_acctbal < p[0] THEN 'Low' WHEN c_acctbal < p[1] THEN 'Medium' WHEN c_acctbal < p[2] THEN 'High' ELSE 'Very High' END AS tier, c_acctbal FROM customer CROSS JOIN q)
SELECT tier, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM t GROUP BY tier""")
add("pearson_spearman", """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT round(corr(x, y), 6) AS pearson, round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS spearman FROM r""")
add("crosstab", """SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o_count, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f_count,
  round(100.0 * sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) / count(*), 6) AS o_percent FROM lineitem GROUP BY l_returnflag""",
"""SELECT l_returnflag, CAST(coalesce(O, 0) AS BIGINT) AS o_count, CAST(coalesce(F, 0) AS BIGINT) AS f_count, CAST(round(100.0D * coalesce(O, 0) / (coalesce(O, 0) + coalesce(F, 0)), 6) AS DOUBLE) AS o_percent
FROM (SELECT l_returnflag, l_linestatus FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('O' AS O, 'F' AS F))""")
add("chi_square", """WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus),
g AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM t), ra AS (SELECT a, CAST(sum(n) AS DOUBLE) AS na FROM t GROUP BY a), rb AS (SELECT b, CAST(sum(n) AS DOUBLE) AS nb FROM t GROUP BY b)
SELECT round(sum(power(coalesce(n, 0) - na * nb / total, 2) / (na * nb / total)), 4) AS chi2, CAST((count(DISTINCT ra.a) - 1) * (count(DISTINCT rb.b) - 1) AS BIGINT) AS dof
FROM ra CROSS JOIN rb CROSS JOIN g LEFT JOIN t ON t.a = ra.a AND t.b = rb.b""")
add("kruskal_h", """WITH r AS (SELECT l_returnflag AS g, CAST(rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS DOUBLE) AS r, count(*) OVER () AS n FROM lineitem),
s AS (SELECT g, sum(r) AS total, count(*) AS m, max(n) AS n FROM r GROUP BY g)
SELECT round(12.0 / (CAST(max(n) AS DOUBLE) * (max(n) + 1)) * sum(total * total / m) - 3.0 * (max(n) + 1), 4) AS h FROM s""")
# evaluation on labels and a length score
_SCORED = "SELECT d.doc_id, toxic AS y, least(1.0, d.n_chars / 5000.0D) AS s FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
_SCORED_DUCK = _SCORED.replace("5000.0D", "5000.0::DOUBLE").replace("least(1.0,", "least(1.0::DOUBLE,")


def scored(name: str, text: str) -> None:
    add(name, text.replace("@scored", _SCORED_DUCK), text.replace("@scored", _SCORED.replace("least(1.0,", "least(1.0D,")))


scored("threshold_table", """WITH s AS (@scored), t AS (SELECT CAST(k AS DOUBLE) / 10 AS threshold FROM (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 5 UNION ALL SELECT 7 UNION ALL SELECT 9) AS x),
c AS (SELECT threshold, CAST(sum(CASE WHEN s >= threshold AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN s >= threshold AND y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN s < threshold AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM s CROSS JOIN t GROUP BY threshold)
SELECT threshold, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS prec, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
scored("auc_rank", """WITH s AS (@scored), r AS (SELECT y, CAST(rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS DOUBLE) AS r FROM s)
SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))), 6) AS auc FROM r""")
scored("average_precision", """WITH s AS (@scored), c AS (SELECT s, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY s),
w AS (SELECT p, sum(p) OVER v AS tp, sum(n) OVER v AS seen, sum(p) OVER () AS total FROM c WINDOW v AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(sum(p / total * tp / seen), 6) AS average_precision FROM w""")
scored("recall_at_precision", """WITH s AS (@scored), c AS (SELECT s, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY s),
w AS (SELECT sum(p) OVER v AS tp, sum(n) OVER v AS seen, sum(p) OVER () AS total FROM c WINDOW v AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(max(CASE WHEN tp / seen >= 0.1 THEN tp / total END), 6) AS recall_at_p10, round(max(CASE WHEN tp / total >= 0.8 THEN tp / seen END), 6) AS precision_at_r80 FROM w""")
scored("brier_logloss", """WITH s AS (@scored), p AS (SELECT y, greatest(1e-6, least(1 - 1e-6, s)) AS p FROM s)
SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS logloss, CAST(sum(y) AS BIGINT) AS actual FROM p""")
add("confusion_macro_f1", """WITH c AS (SELECT l_returnflag AS truth, CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END AS guess, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT DISTINCT truth AS k FROM c), f AS (SELECT k, (SELECT coalesce(sum(n), 0) FROM c WHERE truth = k AND guess = k) AS tp, (SELECT coalesce(sum(n), 0) FROM c WHERE truth = k) AS t, (SELECT coalesce(sum(n), 0) FROM c WHERE guess = k) AS g FROM k)
SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(avg(CASE WHEN t + g > 0 THEN 2 * tp / (t + g) ELSE 0 END), 6) AS macro_f1 FROM f""",
"""WITH c AS (SELECT l_returnflag AS truth, CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END AS guess, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
f AS (SELECT k, sum(CASE WHEN truth = k AND guess = k THEN n ELSE 0 END) AS tp, sum(CASE WHEN truth = k THEN n ELSE 0 END) AS t, sum(CASE WHEN guess = k THEN n ELSE 0 END) AS g
  FROM c LATERAL VIEW explode(array_distinct(array(truth, guess))) x AS k GROUP BY k)
SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(avg(CASE WHEN t + g > 0 THEN 2 * tp / (t + g) ELSE 0 END), 6) AS macro_f1 FROM f""")
add("regression_metrics", """WITH r AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p, avg(l_extendedprice) OVER () AS m FROM lineitem)
SELECT round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) AS r2, round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse FROM r""")
add("bucket_accuracy", """SELECT CASE WHEN hour(ts) < 4 THEN '1-15' WHEN hour(ts) < 8 THEN '16-30' WHEN hour(ts) < 12 THEN '31-45' WHEN hour(ts) < 18 THEN '46-60' ELSE '61+' END AS bucket,
  count(*) AS n, round(avg(CASE WHEN (value > 50) = (event_type = 'purchase') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events GROUP BY 1""")
add("loso_eligibility", """SELECT year(o_orderdate) AS season, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS positives,
  count(*) >= 30 AND sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) >= 5 AS eligible FROM orders GROUP BY year(o_orderdate)""")
add("class_weights", """SELECT l_returnflag AS class, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight FROM lineitem GROUP BY l_returnflag""")
add("ari_nmi_table", """WITH t AS (SELECT label AS a, CAST(vec_id % 10 AS INT) AS b, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS n FROM t GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM t GROUP BY b),
g AS (SELECT sum(n) AS n FROM t), x AS (SELECT sum(n * (n - 1) / 2) AS i FROM t), xa AS (SELECT sum(n * (n - 1) / 2) AS i FROM ra), xb AS (SELECT sum(n * (n - 1) / 2) AS i FROM rb),
h AS (SELECT (SELECT -sum(ra.n / g.n * ln(ra.n / g.n)) FROM ra CROSS JOIN g) AS ha, (SELECT -sum(rb.n / g.n * ln(rb.n / g.n)) FROM rb CROSS JOIN g) AS hb,
  (SELECT sum(t.n / g.n * ln(t.n * g.n / (ra.n * rb.n))) FROM t JOIN ra ON t.a = ra.a JOIN rb ON t.b = rb.b CROSS JOIN g) AS mi)
SELECT round((x.i - xa.i * xb.i / (g.n * (g.n - 1) / 2)) / ((xa.i + xb.i) / 2 - xa.i * xb.i / (g.n * (g.n - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi FROM x CROSS JOIN xa CROSS JOIN xb CROSS JOIN g CROSS JOIN h""")
add("zone_purity", """SELECT label, max(n) AS top, CAST(sum(n) AS BIGINT) AS total, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS purity FROM (SELECT label, vec_id % 5 AS zone, count(*) AS n FROM embeddings GROUP BY label, vec_id % 5) AS t GROUP BY label""")
add("top1_per_group", """SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) AS t WHERE r = 1""")
add("closest_to_median", """WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY c_mktsegment),
r AS (SELECT c.c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY round(abs(c_acctbal - m), 6), c_custkey) AS r FROM customer c JOIN m ON c.c_mktsegment = m.c_mktsegment)
SELECT c_mktsegment, c_custkey FROM r WHERE r = 1""")
add("distinct_survivor", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
add("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
add("set_intersection", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
add("safe_casts", """SELECT event_id, TRY_CAST(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS INT) AS k, TRY_CAST(event_type AS INT) AS bad FROM events""", """SELECT event_id, TRY_CAST(TRY_CAST(get_json_object(props, '$.k') AS DOUBLE) AS INT) AS k, TRY_CAST(event_type AS INT) AS bad FROM events""")
add("json_extract", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n, sum(CAST(variant_get(parse_json(props), '$.k', 'bigint') AS BIGINT)) AS total FROM events GROUP BY event_type")
add("ladder_labels", """SELECT event_id, CASE WHEN value >= 95 THEN 'heavy_rain' WHEN value >= 80 THEN 'rain' WHEN coalesce(value, 0) >= 50 THEN 'windy' WHEN value < 5 THEN 'cold' ELSE 'clear' END AS label FROM events""")
add("bucketed_recency", """SELECT c_custkey, CASE WHEN d < 0 THEN 'no_history' WHEN d <= 30 THEN '0-30d' WHEN d <= 90 THEN '31-90d' ELSE '91-180d' END AS bucket FROM (
  SELECT c_custkey, least(180, coalesce(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-02'), -1)) AS d FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate < DATE '2001-08-02' GROUP BY c_custkey) AS t""",
"""SELECT c_custkey, CASE WHEN d < 0 THEN 'no_history' WHEN d <= 30 THEN '0-30d' WHEN d <= 90 THEN '31-90d' ELSE '91-180d' END AS bucket FROM (
  SELECT c_custkey, least(180, coalesce(datediff(DATE '2001-08-02', CAST(max(o_orderdate) AS DATE)), -1)) AS d FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate < DATE '2001-08-02' GROUP BY c_custkey) AS t""")
add("per90_rates", "SELECT l_partkey AS player_id, round(sum(l_discount) / (sum(l_quantity) / 90.0), 6) AS xg_per90, round(ln(1 + greatest(0.0, sum(l_tax))), 6) AS log_tax FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 0")
add("missing_work_list", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
add("zero_share", "SELECT round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 6) AS discount_zero, round(avg(CASE WHEN l_tax = 0 THEN 1.0 ELSE 0.0 END), 6) AS tax_zero, round(stddev_samp(l_quantity), 6) AS quantity_std, median(l_quantity) AS quantity_median FROM lineitem")
add("mode_by_group", "SELECT o_custkey, mode(o_orderpriority ORDER BY o_orderpriority) AS main_priority FROM orders GROUP BY o_custkey", "SELECT o_custkey, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS main_priority FROM orders GROUP BY o_custkey")
add("source_badge", "SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'database' WHEN bool_or(event_type = 'purchase') THEN 'mixed' ELSE 'demo' END AS source FROM events GROUP BY user_id")
add("last_name_initials", "SELECT c_custkey, substr(c_name, 1, 1) AS initial, split_part(c_name, '#', 2) AS last_part, substr(CAST(c_acctbal AS VARCHAR), 1, 3) AS lead FROM customer", "SELECT c_custkey, substr(c_name, 1, 1) AS initial, split_part(c_name, '#', 2) AS last_part, substr(CAST(c_acctbal AS STRING), 1, 3) AS lead FROM customer")
add("team_mean_delta", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS delta FROM customer")
