"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

A document's hash is the first 60 bits of the MD5 of its doc_id as text (null: of the empty text). A bucket is a prefix of it; the
shards are the shortest prefixes whose documents fit the byte limit. Everything runs on counts of (prefix, bytes),
never on texts: documents are summed into cells of some depth, cells into all their prefixes, and only cells that
are still oversized are summed again, deeper.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 60


def hash_of(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """depth, prefix, bytes, docs, oversized: the shards that partition the rows (h, n_bytes) of sizes.

    A bucket that holds one hash cannot be split by it: such a shard (one document above the limit, or rows of equal
    doc_id) stays and is marked oversized.
    """
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    top, out, rest = 0, None, sizes
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)
    while True:
        cells = rest.groupBy(F.call_function("shiftright", F.col("h"), F.lit(BITS - depth)).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = cells.select("*", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth"))
        prefixes = levels.groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")).alias("prefix")).agg(
            F.sum("b").alias("bytes"), F.sum("n").alias("docs"), (F.min("lo") == F.max("hi")).alias("single")
        )
        done = prefixes.select("depth", "prefix", "bytes", "docs", ((F.col("bytes") <= limit) | F.col("single")).alias("fits"), (F.col("bytes") > limit).alias("oversized"))
        done = C.materialize(done, "prefixes")
        parents = done.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("fits").alias("parent_fits"))
        child = done.withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        shards = child.join(parents, ["depth", "up"], "left").where("fits and not coalesce(parent_fits, false)").select("depth", "prefix", "bytes", "docs", "oversized")
        out = shards if out is None else out.unionByName(shards)
        deeper = done.where((F.col("depth") == depth) & ~F.col("fits")).select(F.col("prefix").alias("cell"))
        if depth == BITS or deeper.isEmpty():
            return C.materialize(out, "directory")
        rest = rest.join(deeper, F.call_function("shiftright", F.col("h"), F.lit(BITS - depth)) == F.col("cell"), "left_semi")
        top, depth = depth + 1, min(BITS, depth + step)


def assign_shards(docs: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """doc_id, n_bytes, shard_depth, shard_prefix, shard_bytes, oversized: one row per row of docs.

    n_bytes is that of the text in UTF-8 (null: 0). The empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    rows = C.materialize(rows.withColumn("h", hash_of(F.col("doc_id"))), "sizes")
    shards = directory(rows.select("h", "n_bytes"), limit)
    depths = [r.depth for r in shards.select("depth").distinct().collect()]  # BITS + 1 at most
    own = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.call_function("shiftright", F.col("h"), F.lit(BITS - d)).alias("prefix")) for d in sorted(depths)))) if depths else None
    if own is None:
        return rows.select("doc_id", "n_bytes", F.lit(0).alias("shard_depth"), F.lit(0).cast("long").alias("shard_prefix"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(False).alias("oversized"))
    spread = rows.select("doc_id", "n_bytes", own.alias("p")).select("doc_id", "n_bytes", "p.*")
    return spread.join(shards, ["depth", "prefix"]).select("doc_id", "n_bytes", F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), F.col("bytes").alias("shard_bytes"), "oversized")


def oracle(limit: int = 16 << 20, most: int = 24) -> str:
    """The same in DuckDB, for inputs whose shards need at most `most` bits and no document of which is oversized."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT d.*, g.depth::INTEGER AS depth, h >> ({BITS} - g.depth)::INTEGER AS prefix FROM d, generate_series(0, {most}) AS g(depth)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS bytes FROM p)
SELECT doc_id, n_bytes, min(depth) AS shard_depth, arg_min(prefix, depth) AS shard_prefix, arg_min(bytes, depth)::BIGINT AS shard_bytes, false AS oversized
FROM s WHERE bytes <= {limit} GROUP BY doc_id, n_bytes"""
