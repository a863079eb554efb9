"""Readers and file-level operators."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_transactions(spark: SparkSession, path: str, schema: T.StructType = schemas.TRANSACTIONS) -> DataFrame:
    """Every parquet file under ``path`` (glob allowed) with the fixed raw schema.

    An explicit schema avoids a footer-inference pass over every file."""
    return spark.read.schema(schema).parquet(path)


def read_features(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Column-pruned read of the wanted columns that exist (missing ones are skipped)."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in cols if c in df.columns])


def sample_limit(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """S3: first ``n`` rows in ``keys`` order (a deterministic head).

    The key of the n-th row is found by a band search over the leading numeric keys and the rows up to it are
    filtered where they lie, so n rows never meet in one task; only rows that equal the n-th in all those
    keys are ordered by the rest.  Without a leading numeric key the head is taken by order and limit."""
    from ..operators.selection import at_cut, below_cut, kth_cut
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = []
    for k in keys:
        if not isinstance(kinds[k], T.NumericType):
            break
        numeric.append(k)
    if not numeric:
        return df.orderBy(*keys).limit(n)
    total = df.count()
    if total <= n:
        return df
    cut = kth_cut(df, numeric, n, n=total)
    if cut is None:
        return df.limit(0)
    return df.where(below_cut(df, numeric, cut)).unionByName(df.where(at_cut(df, numeric, cut)).orderBy(*keys).limit(cut.take))


def latest_run(df: DataFrame, run: str = "run") -> DataFrame:
    """Only the newest run.  The newest run name is one scalar; filtering on
    a literal lets a partition column prune whole directories."""
    newest = df.agg(F.max(run)).first()[0]
    return df.where(F.col(run) == F.lit(newest)) if newest is not None else df.limit(0)


def exclude_processed(df: DataFrame, ledger: DataFrame, on: str | Sequence[str] = "run") -> DataFrame:
    """Rows of runs (or files) that are not in the ledger (left anti join)."""
    return df.join(ledger, on if isinstance(on, str) else list(on), "left_anti")


def recent_files(files: DataFrame, n: int = 100, min_rows: int | None = None,
                 order: Sequence[str] = ("mtime", "file", "run")) -> DataFrame:
    """Newest ``n`` files by modification time; with ``min_rows``, stop after
    the file that brings the running row count to ``min_rows``.

    The file table is metadata (one row per file); the newest n are taken with
    order + limit, and the running sum runs over those n rows only.
    """
    desc = [F.col(c).desc() for c in order]
    top = files.orderBy(*desc).limit(n)
    if min_rows is None:
        return top
    w = Window.orderBy(*desc).rowsBetween(Window.unboundedPreceding, 0)  # over <= n rows
    run = top.withColumn("cum_rows", F.sum("rows").over(w))
    return run.where(F.col("cum_rows") - F.col("rows") < min_rows)


def union_batches(dfs: Iterable[DataFrame]) -> DataFrame:
    """Concatenate feature batches by column name (missing columns become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def rows_in_run(df: DataFrame, run: str = "run", rows: str | None = None) -> DataFrame:
    """Rows per run (``count``; or the sum of a per-file row column)."""
    agg = F.count(F.lit(1)) if rows is None else F.sum(rows)
    return df.groupBy(run).agg(agg.cast("bigint").alias("rows"))


def retention(df: DataFrame, hours: float, time_col: str = "unix_time") -> DataFrame:
    """Keep rows whose event time is within ``hours`` of the newest one.
    The cut-off is one scalar, so the filter is a literal the scan can use."""
    newest = df.agg(F.max(time_col)).first()[0]
    if newest is None:
        return df
    return df.where(F.col(time_col) >= F.lit(newest - int(hours * 3600)))


def retention_by_topic(df: DataFrame, limits: DataFrame, now: Column, time_col: str, topic: str = "topic") -> DataFrame:
    """Rows younger than their topic's ``hours`` in ``limits(topic, hours)`` (one row per
    topic) at the time ``now``; topics without a limit keep all rows, rows without a time go."""
    lim = limits.select(F.col(topic).alias("_topic"), F.col("hours").alias("_hours"))
    j = df.join(lim, F.col(topic) == F.col("_topic"), "left")
    keep = F.col("_hours").isNull() | (F.col(time_col) >= now - F.make_dt_interval(hours=F.col("_hours").cast("int")))
    return j.where(keep & F.col(time_col).isNotNull()).drop("_topic", "_hours")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """File metadata at any depth below ``path`` (no file is opened; those of no bytes are left out)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", F.col("_metadata.file_path").alias("_uri"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")))


def _below(root: str, path: Column | str = "path") -> Column:
    """The part of a file's path below ``root`` (found by its last folder names, whatever the scheme)."""
    tail = "/" + root.rstrip("/").split("://")[-1].lstrip("/").split(":")[-1].lstrip("/") + "/"
    return F.substring_index(path, tail, -1)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File table of the parquet files in ``path/<topic>/<run>/``: (topic, run, file, rows, bytes,
    mtime), the input of S4, S5, S6, S12 and S18.  ``key=`` prefixes of folder names are cut off.
    Rows are counted by Spark from the files without reading a column; a file without rows has 0."""
    meta = _files(spark, path).where(F.col("path").endswith(".parquet"))
    rows = (spark.read.option("recursiveFileLookup", "true").parquet(path)
            .groupBy(F.col("_metadata.file_path").alias("_uri")).agg(F.count(F.lit(1)).alias("rows")))
    part = F.split(_below(path), "/")
    name = lambda i: F.regexp_replace(F.element_at(part, i), r"^[^=]*=", "")
    return (meta.join(rows, "_uri", "left")
            .select(name(-3).alias("topic"), name(-2).alias("run"), F.element_at(part, -1).alias("file"),
                    F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), "bytes", "mtime"))


def storage_bytes(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """Bytes and files per folder ``depth`` levels below ``path``, everything under it
    included, from the files' metadata (no data is read).  Files above that level count for
    the folder they lie in; those right in ``path`` for ``''``."""
    folders = F.slice(F.split(_below(path), "/"), F.lit(1), F.least(F.lit(depth), F.size(F.split(_below(path), "/")) - 1))
    return _files(spark, path).groupBy(F.array_join(folders, "/").alias("directory")).agg(
        F.sum("bytes").cast("bigint").alias("bytes"), F.count(F.lit(1)).cast("bigint").alias("files"))


def read_or_quarantine(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """S13 for files: (rows of the sound parquet files, (path, bytes, mtime) of the others).
    A file that cannot be opened as parquet does not end the job.  Spark skips the rest of a file at its
    first broken page, so a file is sound only if a scan of all the schema's columns gives as many rows as
    its footer counts; the others are reported and none of their rows is returned.  Each file that gave no
    row is reported, unreadable or not.  Files of no bytes hold nothing; Spark's scans pass over them."""
    good, sound = sound_files(spark, [path], schema)
    files = _files(spark, path).where(F.col("path").endswith(".parquet"))
    return good, files.join(sound, files["_uri"] == sound["path"], "left_anti").drop("_uri")


def sound_files(spark: SparkSession, paths: list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, path) of the parquet files in ``paths`` (folders or files) of which a scan of all the schema's
    columns gives as many rows, one at least, as the footer counts."""
    rows = (spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .option("ignoreCorruptFiles", "true").parquet(*paths))
    uri = F.col("_metadata.file_path").alias("_uri")
    footer = rows.select(uri).groupBy("_uri").agg(F.count(F.lit(1)).alias("_footer"))
    nested = (T.ArrayType, T.MapType, T.StructType)
    values = [F.to_json(F.struct(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in schema.fields]
    # the hash makes the scan decode every column; as it can be null, the optimiser cannot drop it
    scan = rows.select(uri, F.xxhash64(*values).alias("_hash")).groupBy("_uri").agg(
        F.count(F.lit(1)).alias("_rows"), F.bit_xor("_hash").alias("_hash"))
    sound = footer.join(scan, "_uri").where(F.col("_hash").isNotNull() & (F.col("_rows") == F.col("_footer"))).select("_uri")
    return rows.select("*", uri).join(sound, "_uri", "left_semi").drop("_uri"), sound.select(F.col("_uri").alias("path"))


# ------------------------------------------------------------------ conform / quarantine
def conform(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Cast every field to the fixed schema with ``try_cast`` (a value that
    does not fit becomes null) and keep a list of the fields that failed.
    ``keep`` names extra columns passed through unchanged."""
    casts, failed = [], []
    for f in schema.fields:
        if f.name not in df.columns:
            casts.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name).try_cast(f.dataType)
        casts.append(c.alias(f.name))
        failed.append(F.when(F.col(f.name).isNotNull() & c.isNull(), F.lit(f.name)))
    errs = F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else F.array().cast("array<string>")
    return df.select(*casts, *keep, errs.alias("_cast_errors"))


def quarantine(df: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, bad).  Bad rows are rows with a value that
    does not cast or a missing required field; they keep their original text
    and a ``reason``.  One pass computes both sides (the caller writes both)."""
    conformed = conform(df.select("*", F.struct(*df.columns).alias("_raw")), schema, keep=["_raw"])
    missing = [F.when(F.col(r).isNull() & (F.array_contains("_cast_errors", r) == F.lit(False)), F.lit(f"missing:{r}"))
               for r in required]
    reasons = F.concat(F.transform("_cast_errors", lambda x: F.concat(F.lit("cast:"), x)),
                       F.filter(F.array(*missing), lambda x: x.isNotNull()) if missing else F.array().cast("array<string>"))
    tagged = conformed.withColumn("_reasons", reasons)
    good = tagged.where(F.size("_reasons") == 0).drop("_cast_errors", "_reasons", "_raw")
    bad = tagged.where(F.size("_reasons") > 0).select("_raw.*", F.array_join("_reasons", ";").alias("reason"))
    return good, bad


#: Rows that one task of ``dedupe_batches`` compares, about.
DEDUPE_ROWS = 250_000


def dedupe_batches(df: DataFrame, cols: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """Drop repeated rows (a republished batch) -- whole-row identity, since
    the data has no unique key.  Hardly any row repeats within a task's input, and
    a combine before the shuffle would hold all of it; so equal rows first meet in
    partitions whose number follows ``rows`` (counted if not given).  Values of
    ``cols`` may be few, so these are combined before the shuffle."""
    if cols or len({c.lower() for c in df.columns}) < len(df.columns):  # columns of one name can't be named for a partition
        return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()
    n = -(-(df.count() if rows is None else rows) // DEDUPE_ROWS)
    names = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *names).dropDuplicates()
