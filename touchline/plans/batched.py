"""Queries on batches: isolated rows, counters of running queries, committed updates, dates by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches, quality
from ..operators.counters import Counters, counting
from ..sources import commits
from ..sources.readers import table
from ..sources.shared import fresh_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put


@query("isolated_batches", """SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS n_read, sum(CASE WHEN event_type <> 'error' THEN json_extract(props, '$.k')::BIGINT END)::BIGINT AS k,
  count(*) FILTER (WHERE event_type = 'error') AS n_unreadable FROM events GROUP BY user_id""")
def isolated_batches(spark, d):
    """Properties of events, those of one type cut short: a user's readable rows are summed, the others are counted."""
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props")).alias("text"))
    good, bad = batches.isolated(e, "text", "k bigint")
    read = good.groupBy("user_id").agg(F.count("*").alias("n_read"), F.sum("k").alias("k"))
    lost = bad.groupBy("user_id").agg(F.count("*").alias("n_unreadable"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return read.join(lost, "user_id", "full").select("user_id", zero("n_read"), "k", zero("n_unreadable"))


_WATCHED = {
    "events": ("event_type = 'error'", "event_id"), "lineitem": ("l_discount > 0.09", "l_orderkey"), "orders": ("o_totalprice < 1000", "o_custkey"), "labels": ("quality = 0", "doc_id"),
}


@query("counted_batches", " UNION ALL ".join(
    f"SELECT '{n}' AS batch, count(*) AS events, (count(*) FILTER (WHERE {bad})) AS failed, round((1 - (count(*) FILTER (WHERE {bad})) / greatest(count(*), 1)) * 100, 2)::DOUBLE AS success_rate FROM {n}"
    for n, (bad, _) in _WATCHED.items()
))
def counted_batches(spark, d):
    """Counters that four running queries leave behind."""
    c, own = Counters(), counting(spark)
    for n, (bad, match) in _WATCHED.items():
        c.run(n, lambda df: df.write.format("noop").mode("overwrite").save(), table(own, d, n), F.expr(bad), match)
    found = [(n, x["events"], x["failed"], x["success_rate"]) for n in _WATCHED for x in [c.of(n)]]
    return spark.createDataFrame(found, "batch string, events bigint, failed bigint, success_rate double")


@query("committed_updates", """WITH n AS (SELECT c_custkey, c_nationkey, round(c_acctbal + 1000, 2) AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5)
SELECT c_custkey, c_nationkey, c_acctbal FROM n UNION ALL SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""")
def committed_updates(spark, d):
    """Customers by nation in one batch, new balances of some in the next; only the partitions that they touch are written again."""
    c, root = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), fresh_folder(spark, "commits")
    schema = "c_custkey bigint, c_nationkey bigint, c_acctbal double"
    commits.commit(spark, root, 1, {"customer": c.selectExpr(*[f"CAST({x.split()[0]} AS {x.split()[1]}) AS {x.split()[0]}" for x in schema.split(", ")])}, {"customer": "c_nationkey"})
    new = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_nationkey < 5")
    commits.update(spark, root, 2, "customer", schema, new.select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") + 1000, 2).alias("c_acctbal")), ["c_custkey"], "c_nationkey")
    return commits.committed(spark, root, "customer", schema)


_TEXTS = """SELECT o_orderkey, CASE WHEN o_totalprice < 60000 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS a,
  CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'unknown' END AS b FROM orders"""
_DUCK = ("%b %d, %Y", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y")


def _chosen(c: str) -> str:
    each = ", ".join(f"avg((try_strptime({c}, '{f}') IS NOT NULL)::INT) AS r{i}" for i, f in enumerate(_DUCK))
    pick = " ".join(f"WHEN r{i} > 0.8 THEN try_strptime({c}, '{f}')" for i, f in enumerate(_DUCK))
    anyway = ", ".join(f"try_strptime({c}, '{f}')" for f in _DUCK)
    return f"(SELECT o_orderkey, (CASE {pick} ELSE coalesce({anyway}) END)::DATE AS {c} FROM t, (SELECT {each} FROM t))"


@query("dates_by_column", f"WITH t AS ({_TEXTS}) SELECT o_orderkey, a, b FROM {_chosen('a')} JOIN {_chosen('b')} USING (o_orderkey)")
def dates_by_column(spark, d):
    """One column mostly of one format, where months and days of the others are taken by it; one column of two formats."""
    o, day = table(spark, d, "orders"), F.col("o_orderdate").cast("date")
    a = F.when(F.col("o_totalprice") < 60000, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    b = F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderstatus") == "O", F.date_format(day, "dd/MM/yyyy")).otherwise("unknown")
    return quality.with_dates(o.select("o_orderkey", a.alias("a"), b.alias("b")), ["a", "b"])
