"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A document descends region, rack and shard. At each node every child draws
``-ln(u) / weight`` with ``u`` from the digest of the key and the child's path; the
smallest draw wins, so a child is chosen with probability proportional to its weight and
a changed weight moves keys only out of, or into, the subtrees where it changed. A node's
weight is the sum of its shards' weights.

One more shard opens a region of its own: no other subtree's weight changes, so keys
move only into the new shard, however often a tree has grown. Law ``key``: the key and
the shard count decide, the first layout being fixed.

Slots are gapless without sorting a shard in one task: rows get a digest bucket, counts
per (shard, bucket) give offsets (at most ``shards * BUCKETS`` rows, the only broadcast),
and rows are numbered inside their bucket. Only slim columns are shuffled, never texts.

Edge cases: a null key is one key like any other (its rows are spread over buckets by
text); a null text has size 1 and the checksum of an empty text; repeated rows share
shard and bucket and get different slots; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Digest buckets of a shard; bounds the broadcast offsets.
BUCKETS = 1024
RACKS_PER_REGION, SHARDS_PER_RACK = 2, 4

Tree = list[list[list[float]]]


def uniform_tree(shards: int = 16) -> Tree:
    """A first layout of whole regions, each shard of weight 1; an error for any count that isn't a multiple of a region's.

    Layouts grow only by ``grown``: a tree of 24 made here is another layout than one of 16 grown eight times, and
    keys would move between old shards on the way from one to the other.
    """
    per = RACKS_PER_REGION * SHARDS_PER_RACK
    if shards < per or shards % per:
        raise ValueError(f"a first layout has whole regions of {per} shards; add single shards by grown()")
    return [[[1.0] * SHARDS_PER_RACK for _ in range(RACKS_PER_REGION)] for _ in range(shards // per)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return [*tree, [[weight]]]


def _cost(key: Column, path: str, weight: float) -> Column:
    digest = F.md5(F.concat(F.lit(f"{path}:"), key))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)
    return -F.log(u) / F.lit(float(weight))


def _lowest(costs: list[Column]) -> tuple[Column, Column]:
    """Index of the smallest draw (the first at ties), and the draw."""
    if len(costs) == 1:
        return F.lit(0), costs[0]
    least = F.least(*costs)
    index = F.lit(len(costs) - 1)
    for i in reversed(range(len(costs) - 1)):
        index = F.when(costs[i] == least, F.lit(i)).otherwise(index)
    return index, least


def placed(rows: DataFrame, tree: Tree, key: Column) -> DataFrame:
    """``rows`` with columns shard (int) and root_cost (double, the winning draw at the root)."""
    rows = rows.withColumn("__key", key)
    costs = [_cost(F.col("__key"), f"r{r}", sum(map(sum, racks))) for r, racks in enumerate(tree)]
    rows = rows.withColumns({f"__c{r}": c for r, c in enumerate(costs)})
    region, least = _lowest([F.col(f"__c{r}") for r in range(len(tree))])
    rows = rows.withColumns({"__region": region, "root_cost": least}).drop(*[f"__c{r}" for r in range(len(tree))])
    shard, base = F.lit(None).cast("int"), 0
    for r, racks in enumerate(tree):
        rack, _ = _lowest([_cost(F.col("__key"), f"r{r}/k{k}", sum(w)) for k, w in enumerate(racks)])
        inside = F.lit(None).cast("int")
        for k, weights in enumerate(racks):
            leaf, _ = _lowest([_cost(F.col("__key"), f"r{r}/k{k}/s{s}", w) for s, w in enumerate(weights)])
            inside = F.when(rack == k, leaf + F.lit(base)).otherwise(inside)
            base += len(weights)
        shard = F.when(F.col("__region") == r, inside).otherwise(shard)
    return rows.withColumn("shard", shard.cast("int")).drop("__region", "__key")


def assign(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) for every row of ``docs``."""
    n = sum(len(w) for racks in tree for w in racks)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    spread = F.when(F.col(id_col).isNull(), F.md5(text)).otherwise(F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("__k"),
        (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), spread)), 1, 8), 16, 10).cast("long") % buckets).cast("int").alias("bucket"),
    )
    rows = placed(rows, tree, F.col("__k"))
    more = _cost(F.col("__k"), f"r{len(tree)}", 1.0)
    rows = rows.withColumn("grown_shard", F.when(more < F.col("root_cost"), F.lit(n)).otherwise(F.col("shard")).cast("int"))
    rows = rows.select("id", "size", "text_crc32", "shard", "bucket", "grown_shard")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard").alias("__s"), F.col("bucket").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside))
    # at most shards * buckets rows of three numbers, whatever the input
    joined = numbered.join(F.broadcast(offsets), (F.col("shard") == F.col("__s")) & (F.col("bucket") == F.col("__b")))
    return joined.select("id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at") - 1).alias("slot"), "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), uniform_tree(16))
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def oracle(tree: Tree, buckets: int = BUCKETS) -> str:
    """DuckDB SQL of ``op3_sharding``; the checksum is folded over the bytes."""

    def cost(path: str, weight: float) -> str:
        return f"(-ln((('0x' || substr(md5('{path}:' || k), 1, 12))::BIGINT::DOUBLE + 1.0) / {float(1 << 48)!r}) / {float(weight)!r})"

    def lowest(costs: list[str]) -> str:
        if len(costs) == 1:
            return "0"
        least = f"least({', '.join(costs)})"
        return "CASE " + " ".join(f"WHEN {c} = {least} THEN {i}" for i, c in enumerate(costs[:-1])) + f" ELSE {len(costs) - 1} END"

    roots = [cost(f"r{r}", sum(map(sum, racks))) for r, racks in enumerate(tree)]
    base, cases, n = 0, [], sum(len(w) for racks in tree for w in racks)
    for r, racks in enumerate(tree):
        rack = lowest([cost(f"r{r}/k{k}", sum(w)) for k, w in enumerate(racks)])
        for k, weights in enumerate(racks):
            leaf = lowest([cost(f"r{r}/k{k}/s{s}", w) for s, w in enumerate(weights)])
            cases.append(f"WHEN region = {r} AND ({rack}) = {k} THEN {base} + ({leaf})")
            base += len(weights)
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE tab(i, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256) UNION ALL SELECT i, {step}, k + 1 FROM tab WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(text, '') AS txt, coalesce(doc_id::VARCHAR, '') AS k,
         CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) ELSE '' END AS spread FROM documents
), b AS (
  SELECT d.*, hex(encode(txt)) AS hx, ('0x' || substr(md5(k || '|' || spread), 1, 8))::BIGINT % {buckets} AS bucket,
         {lowest(roots)} AS region, least({', '.join(roots + ['1e300'])}) AS root_cost FROM d
), s AS (
  SELECT doc_id, strlen(txt) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(txt) + 1), lambda j: ('0x' || substr(hx, 2 * j - 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
    bucket, CASE {' '.join(cases)} END AS shard, {cost(f'r{len(tree)}', 1.0)} < root_cost AS moves FROM b, crc_table
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  (CASE WHEN moves THEN {n} ELSE shard END)::INT AS grown_shard
FROM s"""
