"""Exact dedup as a stateful stream with a disk-backed keyed state.

Documents arrive as a file stream. The state is keyed by the digest of the normalised
text (A-Z lower-cased), lives in RocksDB under the shared folder, never expires, and
retains per digest the stable identifier (largest document id so far), the number of rows
and the content locator (file and row of that document) - never the text. Rows are
pre-aggregated before they meet the state, so a digest with a third of all rows costs
one row per task.

A digest seen more than once is a hit. After the stream has caught up, the full bytes of
every hit are compared with those at the retained locator; a digest whose texts differ is
split by its whole texts. The check joins hits to one retained text per digest. A digest
of over a thousandth of all rows (fewer than a thousand digests can be) is salted in both
joins, so no task gets its rows together.

Edge cases: null and empty texts are equal; among rows with the largest id the one at the
last locator stays; a null id is smaller than any; repeated rows are rows of one group and
one of them stays; an empty table gives an empty result; extra columns stay in ``kept``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, shared_path, stored

#: Session settings while the stream runs. Without preallocation a small state store takes kilobytes instead of megabytes;
#: changelogs are uploaded instead of whole snapshots at each commit.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
}
#: Bytes of files that one micro-batch takes.
TRIGGER_BYTES = 4 << 30
#: A digest of more than one in HOT_SHARE rows is hot: its rows are dealt to SALTS keys.
HOT_SHARE, SALTS = 1000, 32


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty; plain ASCII texts take the fast path."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(lower_ascii(t))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(id, norm, digest, file, row) of each row of a file scan."""
    return rows.select(
        F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    ).withColumn("digest", digest(F.col("norm")))


def run_stream(
    spark: SparkSession, path: str, id_col: str, text_col: str, digest: Callable[[Column], Column],
    checkpoint: str | None = None, trigger_bytes: int = TRIGGER_BYTES, trigger_files: int | None = None,
) -> DataFrame:
    """The state after all files of ``path``: (digest, best struct<id, file, row>, n). Resumes from ``checkpoint`` if given."""
    home = checkpoint or shared_path(spark, "dedup")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", trigger_files) if trigger_files else reader.option("maxBytesPerTrigger", trigger_bytes)
    # as a pattern, the path may be a single file as well as a folder
    rows = located(reader.parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"), id_col, text_col, digest)
    state = rows.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("best"), F.count("*").alias("n"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/changes/batch={number}")  # a repeated batch replaces itself

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{home}/state").foreachBatch(changed).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, best struct<id: {}, file: string, row: long>, n long, batch int".format(dict(spark.read.parquet(path).dtypes)[id_col])
    changes = spark.read.schema(schema).option("basePath", f"{home}/changes").parquet(f"{home}/changes") if query.lastProgress else spark.createDataFrame([], schema)
    return changes.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("s")).select("digest", "s.best", "s.n")


def salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` (digest, file, row, ..) with ``salt``: 0 to SALTS - 1 for rows of a hot digest, else 0."""
    flagged = rows.join(F.broadcast(hot), F.col("digest") == F.col("__hot"), "left")
    return flagged.withColumn("salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64("file", "row"), F.lit(SALTS))).otherwise(0).cast("int")).drop("__hot")


def copied(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """``keyed`` (a row per ``__d``) with ``__salt``: a copy for every salt of a hot digest, else one."""
    flagged = keyed.join(F.broadcast(hot), F.col("__d") == F.col("__hot"), "left")
    copies = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return flagged.withColumn("__salt", F.explode(copies)).drop("__hot")


def groups(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, **stream
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest, file, row) of every row of the Parquet table at ``path``."""
    state = stored(spark, run_stream(spark, path, id_col, text_col, digest, **stream), "dedup")
    total = state.agg(F.sum("n")).first()[0] or 0
    # digests of over one in HOT_SHARE rows each: fewer than HOT_SHARE of them, whatever the input
    hot = state.where((F.col("n") > 1) & (F.col("n") * HOT_SHARE > F.lit(total))).select(F.col("digest").alias("__hot"))
    rows = located(spark.read.parquet(path), id_col, text_col, digest)
    hits = state.where("n > 1").select(F.col("digest").alias("__d"), "best")
    # the retained texts, fetched by their locators
    at = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    retained = copied(rows.select("norm", "file", "row").join(hits, at).select("__d", F.col("norm").alias("__norm")), hot)
    same = (F.col("digest") == F.col("__d")) & (F.col("salt") == F.col("__salt"))
    wrong = salted(rows.select("norm", "digest", "file", "row"), hot).join(retained, same & (F.col("norm") != F.col("__norm")))
    wrong = stored(spark, wrong.select("digest").distinct(), "dedup")
    flat = [F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), F.col("best.file").alias("best_file"), F.col("best.row").alias("best_row")]
    plain = copied(state.select(F.col("digest").alias("__d"), *flat), hot)
    slim = rows.select("id", "digest", "file", "row")
    if not wrong.isEmpty():  # texts that share a digest: group those rows by their whole text
        both = rows.join(wrong, "digest", "left_semi")
        exact = both.groupBy("digest", "norm").agg(F.max(F.struct("id", "file", "row")).alias("best"), F.count("*").alias("n"))
        split = both.join(exact, ["digest", "norm"]).select("id", "digest", "file", "row", *flat)
        slim = slim.join(wrong, "digest", "left_anti")
    joined = salted(slim, hot).join(plain, same).select("id", "digest", "file", "row", "keep_id", "group_size", "best_file", "best_row")
    if not wrong.isEmpty():
        joined = joined.unionByName(split)
    own = (F.col("file") == F.col("best_file")) & (F.col("row") == F.col("best_row"))
    return joined.select("id", "keep_id", "group_size", own.alias("kept"), "digest", "file", "row")


def kept(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of the Parquet table at ``path`` that stay, all their columns."""
    stay = groups(spark, path, id_col, text_col, **kw).where("kept").select(F.col("file").alias("__f"), F.col("row").alias("__r"))
    docs = spark.read.parquet(path)
    rows = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return rows.join(stay, (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g"""
