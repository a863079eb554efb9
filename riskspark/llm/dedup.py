"""Exact dedup (operator 2), DataFrame functions only.

Texts are grouped by a 128-bit content hash together with their bytes: the hash
leads the grouping key, so rows meet by hash, and rows of one hash are compared
byte by byte.  The grouping is pre-aggregated before its shuffle, so a group
that holds a third of all rows arrives as one row per task.

Null texts count as empty, and empty texts equal each other.  Of a group the row
with the largest (``keep="max"``) or smallest id stays; null ids lose against any
other.  Rows that repeat an id within a group are the same row: the report marks
each of them as kept, ``drop_duplicates`` returns one of them (the one with the largest other
columns).  Empty tables give empty results; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, stored


def content_hash(text: Column) -> Column:
    """The first 128 bits of SHA-256 of the text's UTF-8 bytes."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
           normalise: Callable[[Column], Column] | None = None,
           hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    1. group by (hash, text): keeper and size, one shuffle of each distinct text per task;
    2. per hash the number of different texts, as a narrow stored table (no text);
    3. rows get their group by hash alone where the bytes showed one text, and by hash
       and text where a hash has several (a collision).
    The join of step 3 moves ids and hashes only; Spark's adaptive skew join splits a hot group.
    """
    best = F.max if keep == "max" else F.min
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(col(id_col).alias("id"), text.alias("text"))
    keyed = rows.withColumn("h", hash_of(F.col("text")))
    groups = keyed.groupBy("h", "text").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = stored(groups.select("h", "keep_id", "group_size").groupBy("h").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size")), "exact-groups")
    slim = keyed.select("id", "h", F.sha2("text", 256).alias("text_sha256"))
    done = slim.join(by_hash.filter("texts = 1").drop("texts"), "h")
    clashing = by_hash.filter("texts > 1").select("h")
    if not clashing.isEmpty():  # different texts under one hash: these rows meet by their bytes
        rest = keyed.join(clashing, "h").select("id", "h", "text", F.sha2("text", 256).alias("text_sha256"))
        sizes = rest.groupBy("h", "text").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        done = done.select("id", "text_sha256", "keep_id", "group_size").unionByName(
            rest.join(sizes, ["h", "text"]).select("id", "text_sha256", "keep_id", "group_size"))
    return done.select(F.col("id").alias(id_col), "keep_id", "group_size",
                       F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                    hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The kept rows with all columns of ``docs``, by one pre-aggregated shuffle.

    The row itself travels in the aggregate, so no join brings it back.  Columns other
    than id and text must be orderable (ties of the id are broken by them)."""
    best = F.max if keep == "max" else F.min
    h, key, row = (fresh(docs.columns, n) for n in ("hash", "text", "row"))
    rest = [c for c in docs.columns if c != text_col]
    ordered = [id_col, *[c for c in rest if c != id_col]]
    fields = [F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(ordered)]).alias("cols"),
              col(text_col).isNotNull().alias("has_text")]
    known = docs.select(F.coalesce(col(text_col).cast("string"), F.lit("")).alias(key), F.struct(*fields).alias(row))
    if keep == "min":  # null ids lose in either direction
        known = known.withColumn(row, F.struct(F.col(row)["cols"]["c0"].isNull().alias("no_id"),
                                               F.col(row)["cols"].alias("cols"), F.col(row)["has_text"].alias("has_text")))
    kept = (known.withColumn(h, hash_of(F.col(key))).groupBy(h, key).agg(best(row).alias(row)))
    text = F.when(F.col(row)["has_text"], F.col(key)).cast(docs.schema[text_col].dataType)
    return kept.select(*[text.alias(c) if c == text_col else F.col(row)["cols"][f"c{ordered.index(c)}"].alias(c)
                         for c in docs.columns])


ORACLE_SQL = """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t.text) as text_sha256
from t join g on t.text = g.text
"""
