"""Sharding by extendible hashing (operator 5), DataFrame functions only.

Every row hashes to 60 bits (md5 of id and text).  The directory is indexed by
hash-prefix bits: a bucket that exceeds the byte limit splits on its next bit,
others stay whole, until every bucket fits.  All depths are decided from one
pre-aggregated histogram of prefixes: the bucket of a row is the shortest prefix
whose bytes fit.  Where even the finest prefixes of a round are too large, the
next round looks at more bits of those buckets only.

Rows with equal hashes (equal id and text) cannot be split by bits.  They are
interchangeable, so such a bucket overflows into pages by counting copies.  A
single row above the limit is a shard of its own, marked ``oversize``.

Null ids and texts hash as the empty string with a null mark and null texts have
0 bytes; an empty table gives an empty directory; other columns are ignored.
Repeated rows each get an output row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, spread_copies, stored

HASH_BITS = 60


def row_hash(id_: Column, text: Column) -> Column:
    mark = F.concat(F.coalesce(id_.cast("string"), F.lit("~")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(mark), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - depth).cast("int"))


def plan(docs: DataFrame, id_col: str, text_col: str, max_bytes: int, step_bits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(rows, directory): rows(id, h, bytes, copies) and directory(depth, prefix, bytes, rows).

    The first round looks at as many bits as shards are needed at least, plus ``step_bits``."""
    keyed = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).select(
        "id", row_hash(F.col("id"), F.col("text")).alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    rows = stored(keyed.groupBy("id", "h", "bytes").agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    total = rows.agg(F.sum(F.col("bytes") * F.col("copies"))).first()[0] or 0
    least = math.ceil(math.log2(max(1, total / max_bytes)))
    low, high = 0, min(HASH_BITS, least + step_bits)
    open_rows, found = rows, []
    while True:
        fine = open_rows.groupBy(_prefix(F.col("h"), F.lit(high)).alias("p")).agg(
            F.sum(F.col("bytes") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
        # each fine bucket counts towards its ancestor at every depth of this round
        depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        sizes = (fine.select("p", "bytes", "rows", depths)
                 .groupBy("depth", F.call_function("shiftright", F.col("p"), (F.lit(high) - F.col("depth")).cast("int")).alias("prefix"))
                 .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")))
        sizes = stored(sizes, "shard-sizes")
        large = sizes.filter(F.col("bytes") > max_bytes)
        child_of_large = large.select((F.col("depth") + 1).alias("depth"),
                                      F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        fits = sizes.filter(F.col("bytes") <= max_bytes)
        top = fits.filter(F.col("depth") == low) if low == 0 else fits.limit(0)
        found.append(top.unionByName(fits.join(child_of_large, ["depth", "prefix"], "left_semi")))
        still = large.filter(F.col("depth") == high).select("prefix")
        if still.isEmpty():
            break
        if high == HASH_BITS:
            found.append(large.filter(F.col("depth") == high))
            break
        open_rows = open_rows.join(still, _prefix(F.col("h"), F.lit(high)) == F.col("prefix"), "left_semi")
        low, high = high, min(HASH_BITS, high + step_bits)
    directory = found[0]
    for more in found[1:]:
        directory = directory.unionByName(more)
    return rows, stored(directory, "shard-directory")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 1 << 20) -> DataFrame:
    """One row per input row: id, n_bytes, shard (prefix bits, '-' for the undivided root, and
    '/page' in an overflowing bucket), depth, shard_bytes, shard_rows, oversize."""
    rows, directory = plan(docs, id_col, text_col, max_bytes)
    depths = [r[0] for r in directory.select("depth").distinct().collect()]  # at most 61 numbers
    candidates = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))) if depths else \
        rows.withColumn("depth", F.lit(0))
    placed = (candidates.withColumn("prefix", _prefix(F.col("h"), F.col("depth")))
              .join(directory.select(F.col("depth").cast("int").alias("depth"), "prefix",
                                     F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows")),
                    ["depth", "prefix"]))
    bits = F.when(F.col("depth") == 0, F.lit("-")).otherwise(
        F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest(F.col("bytes"), F.lit(1))))
    over = F.col("shard_bytes") > max_bytes
    out = (spread_copies(placed, "copies", "copy")
           .withColumn("page", F.floor(F.col("copy") / per_page))
           .withColumn("in_page", F.least(per_page, F.col("copies") - F.col("page") * per_page)))
    return out.select(
        F.col("id").alias(id_col), F.col("bytes").alias("n_bytes"),
        F.when(over, F.concat(bits, F.lit("/"), F.col("page").cast("string"))).otherwise(bits).alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        F.when(over, F.col("bytes") * F.col("in_page")).otherwise(F.col("shard_bytes")).alias("shard_bytes"),
        F.when(over, F.col("in_page")).otherwise(F.col("shard_rows")).alias("shard_rows"),
        (F.col("bytes") > max_bytes).alias("oversize"))


def oracle_sql(max_bytes: int) -> str:
    """The directory by its definition: a row's bucket is the shortest prefix that fits.  Copies
    (equal id and text) larger than the limit do not occur in the test tables."""
    return f"""
with t as (select doc_id, coalesce(strlen(text), 0) as n_bytes,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '~') || ':' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents),
d as (select unnest(range(0, 41)) as depth),
x as (select t.*, depth, h >> (60 - depth)::int as prefix from t, d),
s as (select depth, prefix, sum(n_bytes) as shard_bytes, count(*) as shard_rows from x group by depth, prefix),
f as (select x.doc_id, x.n_bytes, x.h, x.depth, x.prefix, s.shard_bytes, s.shard_rows,
    row_number() over (partition by x.doc_id, x.h order by x.depth) as k
  from x join s using (depth, prefix) where s.shard_bytes <= {max_bytes})
select doc_id, cast(n_bytes as bigint) as n_bytes,
  case when depth = 0 then '-' else lpad(bin(prefix), depth::int, '0') end as shard,
  cast(depth as int) as depth, cast(shard_bytes as bigint) as shard_bytes, shard_rows, false as oversize
from f where k = 1
"""
