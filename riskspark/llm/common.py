"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path

SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, also when it holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], base: str) -> str:
    """A column name that clashes with none of ``taken`` (case-insensitive)."""
    names, name = {c.lower() for c in taken}, f"__{base}"
    while name.lower() in names:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor does not repeat the work before it) and
    gives Catalyst the real size, so later joins broadcast only what is small.
    """
    spark = df.sparkSession
    path = checkpoint_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(id_col: str) -> Column:
    """True for ids whose crc32 (of the id as text) leaves 2 modulo 4; a null id counts as ''."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit(""))) % 4 == 2


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array as numpy views; nulls are empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if off is None or not len(arr):
        return np.zeros(len(arr) + 1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0]:offs[-1]]


def give_back() -> None:
    """Return memory that is free but held for reuse, by Arrow and by the C library where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def slices(batches: Iterator[pa.RecordBatch], text_index: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batches with about ``most`` bytes of text each (at
    least one row), so that memory per task does not follow the batch size.  A worker that goes on to
    other tasks gives back what Arrow holds for reuse."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            offs, _ = utf8(batch.column(text_index))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
                to = min(max(to, at + 1), batch.num_rows)
                yield batch.slice(at, to - at)
                at = to
    finally:
        give_back()


#: Keys up to this number are broadcast as they are (16 bytes each).
FEW_KEYS = 1 << 18


def row_keys(*parts: Column) -> list[Column]:
    """Two 64-bit hashes of the parts; equal parts (nulls too) have equal keys."""
    whole = [F.struct(*[F.coalesce(p.cast("string"), F.lit("")).alias(f"p{i}") for i, p in enumerate(parts)]),
             F.concat(*[p.isNull().cast("string") for p in parts])]
    return [F.xxhash64(F.lit(seed), *whole) for seed in (1, 2)]


def bloom_bits(longs: DataFrame, most_bits: int) -> np.ndarray:
    """Bloom filter of the values of a one-column table of longs: 16 bits for each, ``most_bits`` at most.

    Spark packs the bits into words; the driver fetches the words of the filter, not its bits."""
    name = longs.columns[0]
    n = longs.count()
    size = 1 << 10
    while size < min(16 * n, most_bits):
        size *= 2
    places = longs.select(F.explode(F.array(*[F.shiftrightunsigned(name, s).bitwiseAND(F.lit(size - 1).cast("long"))
                                              for s in (0, 17, 34)])).alias("b"))
    words = (places.groupBy(F.shiftright("b", 6).alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("v")))
    got = words.toArrow()  # size / 64 rows at most
    bits = np.zeros(size // 64, np.int64)
    bits[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return bits.view(np.uint8)


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit values may be in the filter."""
    size, out = np.uint64(len(bits) * 8 - 1), np.ones(len(values), bool)
    for s in (0, 17, 34):
        at = (values >> np.uint64(s)) & size
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def split_by_keys(docs: DataFrame, keys: list[str], listed: DataFrame, most_bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys are not listed, rows whose keys are), without moving the rows that are not.

    ``keys`` are two columns of longs in both tables.  A short list (counted) is broadcast.  A long one
    becomes a Bloom filter of bounded size; only rows it may hold meet the list by a shuffle join."""
    if listed.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        small = F.broadcast(listed)
        return docs.join(small, keys, "left_anti"), docs.join(small, keys, "left_semi")
    bits = bloom_bits(listed.select(keys[0]), most_bits)
    at = docs.columns.index(keys[0])

    def part(maybe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = may_hold(bits, batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64))
                yield batch.filter(pa.array(held if maybe else ~held))
        return docs.mapInArrow(run, docs.schema)

    suspects = part(True)
    return part(False).unionByName(suspects.join(listed, keys, "left_anti").select(*map(col, docs.columns))), \
        suspects.join(listed, keys, "left_semi").select(*map(col, docs.columns))


def spread_copies(rows: DataFrame, n: str, copy: str, page: int = 4096) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in column ``copy``.

    Rows come in pages: a row with very many copies gives one row per page first, and the pages are dealt over
    tasks before they open, so neither an array nor a task holds all copies of one row."""
    at = fresh([*rows.columns, copy], "page")
    few = rows.filter(F.col(n) <= page).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    many = rows.filter(F.col(n) > page)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / (page * page)))
    pages = many.withColumn(at, F.explode(blocks)).withColumn(at, F.explode(F.sequence(
        F.col(at) * page, F.least((F.col(at) + 1) * page, F.ceil(F.col(n) / page)) - 1))).repartition(F.col(at))
    opened = pages.withColumn(copy, F.explode(F.sequence(F.col(at) * page, F.least((F.col(at) + 1) * page, F.col(n)) - 1))).drop(at)
    return few.unionByName(opened)


def bounded_sample(rows: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The rows whose ``id`` is in ``ids`` (at most ``most`` of them), ``most`` rows at most.

    Where ids repeat and their rows are more than that, rows of equal id and text count once and ``most`` of the
    others are drawn by a hash of id and text.  Texts are read where they lie; only those drawn move."""
    some = rows.join(F.broadcast(ids), "id")
    if some.select("id").count() <= most:
        return some
    keys = ["id", "_text_key"]
    some = some.withColumn("_text_key", F.xxhash64("text"))
    drawn = some.select(*keys).distinct().orderBy(F.xxhash64(F.col("id").cast("string"), "_text_key"), *keys).limit(most)
    return some.join(F.broadcast(drawn), keys).dropDuplicates(keys).drop("_text_key")
