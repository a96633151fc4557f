"""Quality rules at host level (DataFrame functions only).

Each text is measured by the base rules. Rule failures are then counted by host, each
host's failure rate is shrunk towards all hosts by a beta prior fitted to the hosts'
rates (method of moments), and a host whose shrunk rate is over the limit rejects its
documents. Few documents of a host say little, so its rate stays near the mean.

Repeated three-word windows are found by sorting (window hash, position) inside a text:
nothing is exploded and no text is shuffled. Measures go to the shared folder once, host
counts are pre-aggregated, and host verdicts rejoin the slim measures, where a host with
a third of all rows can be split by the skew-join rule.

Edge cases: a null or empty text has no words and fails the base rules; a null host is a
host of its own; a single host, or hosts with equal rates, shrink fully to the mean;
repeated rows are judged alike and each counts for its host; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import met, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its shrunk failure rate is over this.
MAX_HOST_RATE = 0.5

_WORDS = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
_WITH_WORD = r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
# sorted (hash, position) of the windows; those with an equal neighbour repeat; their words are counted once
_REPEATS = """
transform(array(words), w -> transform(
  array(transform(sequence(1, greatest(size(w) - 2, 1)), i -> xxhash64(get(w, i - 1), get(w, i), get(w, i + 1)))),
  g -> CASE WHEN size(w) < 3 OR size(array_distinct(g)) = size(g) THEN 0L ELSE transform(
    array(array_sort(transform(g, (h, i) -> struct(h AS h, i AS i)))),
    s -> CAST(size(array_distinct(flatten(transform(
      filter(s, (x, j) -> CASE WHEN j > 0 AND s[greatest(j - 1, 0)].h = x.h THEN true
                               WHEN j < size(s) - 1 THEN s[least(j + 1, size(s) - 1)].h = x.h ELSE false END),
      x -> array(x.i, x.i + 1, x.i + 2))))) AS BIGINT))[0] END)[0])[0]
"""


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.expr(_WORDS)).withColumn("lines", F.expr(_WITH_WORD))
    out = rows.select(
        "id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.expr("regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATS).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate) of every host, by the empirical beta prior."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.sum("n_docs").alias("total"))
    # one row; equal rates have no spread, then the prior weighs as much as all documents
    prior = prior.withColumn("weight", F.expr("CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) ELSE CAST(total AS DOUBLE) END"))
    joined = hosts.join(F.broadcast(prior))
    return joined.select("host", "n_docs", "n_failed", F.expr("(n_failed + m * weight) / (n_docs + weight)").alias("shrunk_rate"))


def judged(spark: SparkSession, docs: DataFrame, max_rate: float = MAX_HOST_RATE, **cols) -> DataFrame:
    """Measures of every row with host_rate and kept."""
    measured = stored(spark, measures(docs, **cols), "quality")
    rates = host_rates(measured).select(F.col("host").alias("__key"), F.col("n_docs").alias("__n"), F.col("shrunk_rate").alias("host_rate"))
    joined = met(measured, "host", ["id", "n_words", "word_chars"], rates, measured.count(), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS txt FROM documents),
w AS (SELECT *, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(txt, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM w, range(1, len(ws) - 1) r(i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(3) o(k) WHERE n > 1 GROUP BY rid),
m AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        len(regexp_extract_all(txt, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM f GROUP BY source),
p AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v, sum(n) AS total FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) ELSE total END AS weight FROM p),
s AS (SELECT source, (bad + m * weight) / (n + weight) AS rate FROM h, q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source"""
