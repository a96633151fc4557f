"""Batches that become visible as a whole: staged Parquet folders and one manifest a batch.

A batch is written to folders of its own and then named by a manifest in ``_commits``, which is put in place by one rename that
fails where the batch is there already. Readers follow manifests only, so a batch that fails midway, in any of its tables,
leaves the version before it readable, and one that is run again is committed once. The rename is atomic on HDFS and local
disks; a store without such a rename needs a single writer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert

PARTITION = "__part"


def _files(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a folder of any store that Spark can open."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def commit(spark: SparkSession, root: str, batch: int, tables: dict[str, DataFrame], partitions: dict[str, str] | None = None) -> bool:
    """Write and commit all tables of a batch at once; False if the batch is committed already (nothing is written then).

    A table with a column in ``partitions`` replaces those of its partitions that it has rows of; any other is added to.
    """
    partitions = partitions or {}
    at = f"{root}/_commits/{batch:012d}.json"
    fs, target = _files(spark, at)
    if fs.exists(target):
        return False
    placed: dict[str, dict[str, str]] = {}
    for name, df in tables.items():
        stage = f"{root}/{name}/{batch:012d}-{uuid.uuid4().hex}"
        if name in partitions:
            # the column stays in the files, too, with its type
            df.withColumn(PARTITION, F.coalesce(F.col(partitions[name]).cast("string"), F.lit(""))).write.partitionBy(PARTITION).parquet(stage)
            found = [s.getPath().getName() for s in fs.listStatus(_files(spark, stage)[1]) if s.isDirectory()]
            placed[name] = {part: f"{stage}/{part}" for part in sorted(found)}
        else:
            df.write.parquet(stage)
            placed[name] = {f"batch={batch}": stage}
    draft = f"{root}/_commits/.{batch:012d}-{uuid.uuid4().hex}"
    out = fs.create(_files(spark, draft)[1], False)
    out.write(bytearray(json.dumps({"batch": batch, "tables": {n: [{"part": p, "path": x} for p, x in ps.items()] for n, ps in placed.items()}}).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(_files(spark, draft)[1], target):
        fs.delete(_files(spark, draft)[1], False)
        return False
    return True


def batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed batches."""
    fs, folder = _files(spark, f"{root}/_commits")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def committed(spark: SparkSession, root: str, table: str, schema: str, upto: int | None = None) -> DataFrame:
    """The rows of a table as of the batch ``upto``, or the latest; no rows before its first batch.

    A manifest is a line a batch, and of a partition the latest batch counts: what the driver holds is a path a partition.
    """
    placed: dict[str, str] = {}
    wanted = [f"{root}/_commits/{b:012d}.json" for b in batches(spark, root) if upto is None or b <= upto]
    if wanted:
        manifests = spark.read.schema("batch long, tables map<string, array<struct<part: string, path: string>>>").json(wanted)
        for r in manifests.select("batch", F.inline(F.coalesce(F.col("tables")[table], F.array().cast("array<struct<part: string, path: string>>")))).orderBy("batch").collect():
            placed[r.part] = r.path
    if not placed:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*placed.values())


def update(spark: SparkSession, root: str, batch: int, table: str, schema: str, rows: DataFrame, keys: list[str], partition: str) -> bool:
    """Replace rows by ``keys`` in one batch: only partitions that have a new or a replaced row are written again. A key may move to another partition."""
    old = committed(spark, root, table, schema)
    part = lambda df: df.select(F.col(partition).alias("__p")).distinct()
    touched = part(rows).unionByName(part(old.join(rows.select(*keys), keys, "left_semi"))).distinct()
    mine = old.join(touched, F.col(partition).eqNullSafe(F.col("__p")), "left_semi")
    merged = upsert.last_wins(mine, rows.select(mine.columns), keys)
    emptied = part(mine).join(part(merged), "__p", "left_anti")
    if not emptied.where("__p IS NOT NULL").isEmpty():
        raise ValueError("a partition would lose its last row: give it a row that marks it empty")
    return commit(spark, root, batch, {table: merged}, {table: partition})
