"""Line dedup by winnowing over line hashes (DataFrame functions only).

A text is its lines that hold a word; blank lines never match and always stay. A window
starts at each line and is the shortest run from there of ``run`` lines or ``words`` words:
a passage of one or two long lines is a window as well as three short lines. Of every
window the leftmost smallest line hash is selected as its fingerprint, so any repeated run
that holds a window shares one.

Plan: one row per selected position, with the windows that selected it, written once.
Fingerprints met twice or more join back to their positions; each match is extended both
ways to the windows that hold it, and a window equal to an earlier one (by document id,
digest of the text, line) is a later repeat. A line goes if a later repeat covers it, so
whole repeated runs go but for their first copy.

Windows are compared by two independent 64-bit hashes of their lines. First copies are
minima, pre-aggregated before their shuffle; positions are never paired with each other. A
fingerprint or window of over one in ``HOT_SHARE`` rows is dealt to ``SALTS`` keys. Texts
are shuffled once, for the rewrite.

Edge cases: null texts count as empty and come back null; a text without a window stays
whole; rows equal in id and text are one document (both keep or lose the same lines); rows
of one id with different texts come in order of the texts' digests; a null id sorts first;
empty tables give empty results; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

RUN_LINES, RUN_WORDS = 3, 50
#: A key of more than one in HOT_SHARE rows is hot: its rows are dealt to SALTS keys.
HOT_SHARE, SALTS = 1000, 32


def text_key(text: Column) -> Column:
    """60 bits of a text's digest: tells texts of one id apart, and orders them."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def positions(docs: DataFrame, id_col: str, text_col: str, run: int, words: int) -> DataFrame:
    """(id, th, p, h, windows): each selected line p with its hash and the windows (first line a, lines l, content k1, k2) that selected it."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("lines", F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    rows = rows.where(F.expr(f"size(lines) >= {run} OR length(text) >= {2 * words - 1}"))
    rows = rows.select(
        "id", "th", F.expr("transform(lines, l -> xxhash64(l))").alias("x"), F.expr("transform(lines, l -> xxhash64(7, l))").alias("y"),
        F.expr(r"transform(lines, l -> regexp_count(l, '[^\\x20\\x09-\\x0D]+'))").alias("w"),
    )
    enough = " ".join(f"WHEN a + {k - 1} < size(w) AND {' + '.join(f'w[a + {i}]' for i in range(k))} >= {words} THEN {k}" for k in range(1, run))
    length = f"CASE {enough} WHEN a + {run - 1} < size(w) THEN {run} END"
    each = f"""transform(transform(sequence(0, size(x) - 1), a -> struct(a AS a, {length} AS l)), v -> IF(v.l IS NULL, NULL, struct(v.a AS a, v.l AS l,
        v.a + array_position(slice(x, v.a + 1, v.l), array_min(slice(x, v.a + 1, v.l))) - 1 AS p,
        xxhash64(slice(x, v.a + 1, v.l)) AS k1, xxhash64(11, slice(y, v.a + 1, v.l)) AS k2)))"""
    # windows that select line p start at one of the run lines up to it
    chosen = f"""transform(array({each}), s -> filter(transform(sequence(0, size(x) - 1), p -> struct(p AS p, x[p] AS h,
        filter(slice(s, greatest(p - {run - 1}, 0) + 1, least(p + 1, {run})), v -> v IS NOT NULL AND v.p = p) AS windows)), q -> size(q.windows) > 0))[0]"""
    out = rows.where(F.size("x") > 0).select("id", "th", F.explode(F.expr(chosen)).alias("q"))
    return out.select("id", "th", "q.p", "q.h", F.expr("transform(q.windows, v -> struct(v.a, v.l, v.k1, v.k2))").alias("windows"))


def salted_join(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, by: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row per key ``on``, with its number of rows n); rows of a hot key are dealt by ``by``."""
    hot = F.col("n") * HOT_SHARE > F.lit(total)
    # fewer than HOT_SHARE keys can be hot
    few = F.broadcast(keyed.where(hot).select(*on, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(few, on, "left").withColumn("__salt", salt).drop("__hot")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(keyed.withColumn("__salt", F.explode(copies)).drop("n"), [*on, "__salt"]).drop("__salt")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN_LINES, words: int = RUN_WORDS) -> DataFrame:
    """(id, th, a, l): windows that repeat an earlier window, l lines from line a; th is the key of the text they are in."""
    spark = docs.sparkSession
    found = stored(spark, positions(docs, id_col, text_col, run, words), "lines")
    total = found.count()
    shared = stored(spark, found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "lines")
    matches = salted_join(found, shared, ["h"], total, ["id", "th", "p"])
    extended = stored(spark, matches.select("id", "th", F.explode("windows").alias("v")).select("id", "th", "v.*"), "lines")
    at = F.struct("id", "th", "a")
    firsts = extended.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    firsts = stored(spark, firsts.where("first < last").select("k1", "k2", "first", "n"), "lines")
    return salted_join(extended, firsts, ["k1", "k2"], total, ["id", "th", "a"]).where(at > F.col("first")).select("id", "th", "a", "l")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN_LINES, words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with the text rewritten, and columns (in place of any of these names) n_lines, n_removed and n_runs (lines with a word, those removed, removed runs)."""
    gone = repeated(docs, id_col, text_col, run, words).groupBy(F.col("id").alias("__id"), F.col("th").alias("__th"))
    gone = gone.agg(F.collect_set(F.struct("a", "l")).alias("__a"))
    covered = "array_sort(array_distinct(flatten(transform(coalesce(__a, array()), v -> sequence(v.a, v.a + v.l - 1)))))"
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col("__id")) & (text_key(docs[text_col]) == F.col("__th")), "left")
    joined = joined.withColumn("__gone", F.expr(covered)).withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # positions of the lines with a word, of which those numbered in __gone go: linear in the lines
    numbered = r"""transform(array(split(__text, '\n')), s -> transform(
        array(filter(sequence(0, size(s) - 1), i -> s[i] rlike '[^\\x20\\x09-\\x0D]')), w -> array_join(transform(
          array_except(sequence(0, size(s) - 1), transform(__gone, g -> w[g])), i -> s[i]), '\n'))[0])[0]"""
    return joined.select(
        *[docs[c] for c in docs.columns if c != text_col and c.lower() not in ("n_lines", "n_removed", "n_runs")],
        F.when(docs[text_col].isNull(), None).when(F.size("__gone") == 0, docs[text_col]).otherwise(F.expr(numbered)).alias(text_col),
        F.expr(r"CAST(size(filter(split(__text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')) AS BIGINT)").alias("n_lines"),
        F.size("__gone").cast("long").alias("n_removed"),
        F.expr("CAST(size(filter(__gone, (g, i) -> i = 0 OR __gone[greatest(i - 1, 0)] <> g - 1)) AS BIGINT)").alias("n_runs"),
    )


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduplicated(docs)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS txt, md5(coalesce(text, '')) AS th FROM documents),
l AS (SELECT doc_id, th, unnest(string_split(txt, chr(10))) AS line, unnest(range(len(string_split(txt, chr(10))))) AS pos FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, th ORDER BY pos) - 1 AS i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS c
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, th, i, CASE WHEN c >= 50 THEN 1 WHEN c + lead(c) OVER v >= 50 THEN 2 ELSE 3 END AS size,
        CASE WHEN c >= 50 THEN line WHEN c + lead(c) OVER v >= 50 THEN line || chr(10) || lead(line) OVER v
             ELSE line || chr(10) || lead(line) OVER v || chr(10) || lead(line, 2) OVER v END AS win
      FROM n WINDOW v AS (PARTITION BY doc_id, th ORDER BY i)),
r AS (SELECT doc_id, th, i, size, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, th, i) AS k FROM w WHERE win IS NOT NULL),
x AS (SELECT DISTINCT doc_id, th, i + o AS i FROM r, range(3) t(o) WHERE k > 1 AND o < size),
y AS (SELECT doc_id, th, count(*) AS n_removed, sum(CASE WHEN p IS NULL OR p <> i - 1 THEN 1 ELSE 0 END) AS n_runs
      FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, th ORDER BY i) AS p FROM x) GROUP BY doc_id, th),
k AS (SELECT l.doc_id, l.th, string_agg(l.line, chr(10) ORDER BY l.pos) AS rest FROM l
      LEFT JOIN n ON l.doc_id = n.doc_id AND l.th = n.th AND l.pos = n.pos
      LEFT JOIN x ON x.doc_id = l.doc_id AND x.th = l.th AND x.i = n.i WHERE x.i IS NULL GROUP BY l.doc_id, l.th),
c AS (SELECT doc_id, th, count(*) AS n_lines FROM n GROUP BY doc_id, th)
SELECT e.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  sha256(coalesce(rest, '')) AS kept_sha256
FROM (SELECT doc_id, md5(coalesce(text, '')) AS th FROM documents) e LEFT JOIN y USING (doc_id, th) LEFT JOIN k USING (doc_id, th) LEFT JOIN c USING (doc_id, th)"""
