"""Shards by extendible hashing, in DataFrame operations only.

A row's hash is 64 bits: the first half from its id, the second from its id and
text, so rows of one id part only where their shard is oversized. The directory
is indexed by hash prefixes. Bytes are summed once per prefix of STEP bits; a
bucket that is over the limit splits on one more bit, others don't, until all
fit. Where a prefix of STEP bits is still over, only its rows are summed again by
STEP more bits. The directory has at most 2^STEP rows for each oversized prefix
and comes from the sums alone, however many rows there are.

Defined results: a null text has 0 bytes; a null id hashes as empty text. A row
larger than the limit is a shard of its own or shares it with rows of an equal
hash; equal rows (same id and text) can't be told apart by hash, so once all bits
are used a shard may stay over the limit: `fits` is false there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import joined, stored

LIMIT = 64 << 20
STEP = 16
BITS = 64
#: Directory rows up to which the directory is broadcast (2^STEP and a bit more); beyond, the join shuffles.
BROADCAST_ROWS = 70_000


def hash_bits(doc_id: str, text: str) -> Column:
    """64 characters 0 or 1."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    first = F.substring(F.md5(name.cast("binary")), 1, 8)
    second = F.substring(F.md5(F.concat(name, F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).cast("binary")), 1, 8)
    return F.concat(*(F.lpad(F.conv(h, 16, 2), 32, "0") for h in (first, second)))


def directory(sized: DataFrame, limit: int, step: int = STEP) -> DataFrame:
    """(prefix, shard, shard_bytes, fits): the shard of each full-step prefix that holds rows. sized: (bits, bytes)."""
    found, rest, at = None, sized, 0
    while True:
        depth = at + step
        sums = stored(rest.groupBy(F.substring("bits", 1, depth).alias("prefix")).agg(F.sum("bytes").alias("bytes")), "prefix-sums")
        tried = sums.select("prefix", "bytes", F.explode(F.sequence(F.lit(at), F.lit(depth))).alias("depth"))
        tried = tried.withColumn("shard", F.expr("substring(prefix, 1, depth)"))
        fits = tried.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
        best = joined(tried, fits, ["depth", "shard"]).groupBy("prefix").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("m"))
        level = stored(sums.join(best, "prefix", "left").select("prefix", "bytes", "m.shard", "m.shard_bytes"), "directory")
        over = level.where("shard IS NULL").select("prefix")
        last = depth >= BITS
        done = level.where("shard IS NOT NULL").select("prefix", "shard", "shard_bytes", F.lit(True).alias("fits"))
        if last:
            done = done.union(level.where("shard IS NULL").select("prefix", "prefix", "bytes", F.lit(False)))
        found = done if found is None else found.union(done)
        if last or over.isEmpty():
            return found
        rest = rest.join(over.withColumnRenamed("prefix", "p"), F.substring("bits", 1, depth) == F.col("p"), "left_semi")
        at = depth


def assign(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", step: int = STEP) -> DataFrame:
    """doc_id, n_bytes, shard (hash prefix, '' for the only one), depth, shard_bytes, fits of each row."""
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), hash_bits(doc_id, text).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")), "sized")
    shards = directory(sized, limit, step)
    depths = sorted(tuple(r) for r in shards.groupBy(F.length("prefix")).count().collect())
    out = None
    for depth, rows in depths:  # one for each STEP bits that the directory needed
        own = shards.where(F.length("prefix") == depth)
        found = sized.withColumn("prefix", F.substring("bits", 1, depth)).join(F.broadcast(own) if rows <= BROADCAST_ROWS else own, "prefix")
        found = found.select("doc_id", F.col("bytes").alias("n_bytes"), "shard", F.length("shard").alias("depth"), "shard_bytes", "fits")
        out = found if out is None else out.union(found)
    if out is None:
        out = sized.select("doc_id", F.col("bytes").alias("n_bytes"), F.lit("").alias("shard"), F.lit(0).alias("depth"), F.col("bytes").alias("shard_bytes"), F.lit(True).alias("fits"))
    return out


def write(docs: DataFrame, folder: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as one folder per shard; return the assignment. docs needs unique ids."""
    where = stored(assign(docs, limit, doc_id, text), "assignment")
    rows = docs.join(where.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard")), docs[doc_id].eqNullSafe(F.col("_id"))).drop("_id")
    rows.withColumn("_shard", F.concat(F.lit("s"), "_shard")).repartition("_shard").write.partitionBy("_shard").parquet(folder)
    return where
