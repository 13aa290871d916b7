"""Sharding by extendible hashing: DataFrame functions only.

A document's hash is 60 bits of md5 of its id.  The directory starts with one bucket; only a bucket of more bytes than a
shard may hold is split, on the next bit of the prefix, until every shard fits.  The directory is kept as a table
(prefix of DEPTH bits -> depth of its bucket), never on the driver: the documents are summed once into cells of DEPTH
bits, and the buckets of all depths are sums over cells.  Cells that are still too large go on with their next bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import materialize, table, unit_hash
from driftwood.llm.ordering import numbered

#: Bits of a document's hash; bits that one round of splitting looks at.
BITS, DEPTH = 60, 20
SHARD_BYTES = 32 << 20


def _round(rows: DataFrame, done: int, depth: int, limit: int) -> DataFrame:
    """rows(h, bytes), whose first done bits are settled as too large, to (cell, depth): null where none fits."""
    shift = BITS - done - depth
    cells = rows.groupBy(F.shiftright("h", shift).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    above = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0 if done == 0 else 1), F.lit(depth))).alias("d")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
    # written, so that AQE can split the rows of a shallow prefix, which many cells share
    fits = above.groupBy("d", "prefix").agg(F.sum("bytes").alias("bucket_bytes")).filter(F.col("bucket_bytes") <= limit)
    least = above.join(materialize(fits), ["d", "prefix"]).groupBy("cell").agg(F.min(F.struct("d", "bucket_bytes")).alias("leaf"))
    return cells.select("cell").join(least, "cell", "left").select("cell", (F.col("leaf.d") + done).alias("depth"), "leaf.bucket_bytes")


def shards(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bytes, depth, shard, shard_bytes) for every row of docs.

    bytes are those of the text in UTF-8 (null: 0); shard is the bit string of the bucket's prefix (empty: the only bucket).
    Rows of one id have equal hashes, which no bit separates.  If they exceed the limit together they are an overflow
    bucket at full depth, cut in order of size into shards of at most limit bytes, named prefix/number; so are single
    documents larger than the limit, which get a shard each.  A null id hashes as the empty string.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"), unit_hash(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"))
    out, done = [], 0
    while True:
        placed = rows.join(_round(rows, done, DEPTH, limit).withColumnRenamed("cell", "c"), F.shiftright("h", BITS - done - DEPTH) == F.col("c")).drop("c")
        name = F.expr("lpad(bin(shiftright(h, 60 - depth)), depth, '0')")
        out.append(placed.filter("depth is not null").select("doc_id", "bytes", "depth", F.when(F.col("depth") == 0, "").otherwise(name).alias("shard"), F.col("bucket_bytes").alias("shard_bytes")))
        rows, done = materialize(placed.filter("depth is null").select("doc_id", "bytes", "h")), done + DEPTH
        if rows.isEmpty():
            break
        if done == BITS:
            out.append(_overflow(rows, limit))
            break
    return reduce(DataFrame.unionByName, out)


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hashes: copies of one size are numbered over range partitions, and every each of them are a shard."""
    each = F.greatest(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(1))
    placed = numbered(rows.withColumn("copy", F.monotonically_increasing_id()), ["h", "doc_id", "bytes"], [F.col("copy")])
    part = F.floor(F.col("place") / each)
    name = F.concat(F.expr("lpad(bin(h), 60, '0')"), F.lit("/"), F.col("bytes").cast("string"), F.lit("."), part.cast("string"))
    return placed.select("doc_id", "bytes", F.lit(BITS).alias("depth"), name.alias("shard"), (F.least(each, F.col("rows") - part * each) * F.col("bytes")).alias("shard_bytes"))


#: The query's limit, so small that its buckets split in tables of a few megabytes too.
QUERY_BYTES = 64 << 10


def op4_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), QUERY_BYTES)


OP4_SQL = f"""
WITH docs AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents),
buckets AS (SELECT d, h >> ({BITS} - d) AS prefix, sum(bytes)::BIGINT AS shard_bytes FROM docs, range(0, {DEPTH} + 1) t(d) GROUP BY ALL HAVING sum(bytes) <= {QUERY_BYTES}),
leaf AS (SELECT h, min(d)::INT AS depth FROM (SELECT DISTINCT h FROM docs) x JOIN buckets ON prefix = h >> ({BITS} - d) GROUP BY h)
SELECT doc_id, bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - depth)), depth, '0') END AS shard, shard_bytes
FROM docs JOIN leaf USING (h) JOIN buckets b ON b.d = depth AND b.prefix = h >> ({BITS} - depth)
"""
