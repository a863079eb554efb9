"""File streams with an audit (S13) and in file-name order.

``audited_stream`` takes files as a stream of names, so a broken file neither ends the stream nor shortens it
silently: every file of a micro-batch is read in full and held against its own footer; rows of sound files go
on, the others are written to a ledger.

``NameOrderSource`` is a stream source whose offset is the last file name taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import sound_files

LEDGER = "path string, bytes bigint, mtime timestamp, batch_id bigint"


def audited_stream(spark: SparkSession, path: str, schema: T.StructType, process: Callable[[DataFrame, int], None], ledger: str,
                   checkpoint: str, max_files: int = 50, available_now: bool = False) -> StreamingQuery:
    """S13 on a stream: ``process(rows, batch_id)`` gets the rows of the sound parquet files of each micro-batch
    (at most ``max_files``, oldest first, each once); the others are listed in ``ledger`` (path, bytes, mtime).

    The ledger is written per micro-batch and replaced when one is run again, so a file stands there once.
    ``process`` should be idempotent per batch id, as any ``foreachBatch`` function."""
    found = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", max_files)
             .load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")))  # contents stay unread

    def take(batch: DataFrame, batch_id: int) -> None:
        files = batch.collect()  # max_files names
        if not files:
            return
        s = batch.sparkSession
        rows, sound = sound_files(s, [f["path"] for f in files], schema)
        good = {r["path"] for r in sound.collect()}
        bad = [(f["path"], f["bytes"], f["mtime"], batch_id) for f in files if _plain(f["path"]) not in {_plain(p) for p in good}]
        if good:
            process(rows, batch_id)
        (s.createDataFrame(bad, LEDGER).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(ledger))

    w = found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()


def _plain(uri: str) -> str:
    """A path without the number of slashes its scheme is written with."""
    scheme, _, rest = uri.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if rest else uri


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class NameOrderReader(DataSourceStreamReader):
    """Files of a folder in the order of their names, each once, at most ``max_files`` per micro-batch."""

    def __init__(self, path: str, max_files: int, schema: T.StructType):
        self.path, self.max_files, self.schema = path, max_files, schema
        self.at: dict | None = None  # what was planned last

    def _files(self):
        """(file system, folder): any store pyarrow can open."""
        from pyarrow import fs
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def _names(self) -> list[str]:
        from pyarrow import fs
        store, folder = self._files()
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        last = (self.at or self.initialOffset())["last"]
        more = [n for n in self._names() if n > last][:self.max_files]
        self.at = {"last": more[-1] if more else last}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:  # started again: the last batch in the checkpoint is planned first
            self.at = end
        return [_File(n) for n in self._names() if start["last"] < n <= end["last"]]

    def read(self, partition: _File) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema
        store, folder = self._files()
        wanted = to_arrow_schema(self.schema)
        with store.open_input_file(f"{folder.rstrip('/')}/{partition.name}") as f:
            file = pq.ParquetFile(f)
            held = set(file.schema_arrow.names)
            for batch in file.iter_batches(columns=[n for n in wanted.names if n in held]):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x.name).cast(x.type) if x.name in held else pa.nulls(batch.num_rows, x.type) for x in wanted], schema=wanted)

    def commit(self, end: dict) -> None:
        pass


class NameOrderSource(DataSource):
    """``spark.readStream.format("name_order").schema(...).option("path", ...).option("maxFiles", 50).load()``."""

    @classmethod
    def name(cls) -> str:
        return "name_order"

    def schema(self):
        raise ValueError("name_order needs a schema")

    def streamReader(self, schema: T.StructType) -> NameOrderReader:
        return NameOrderReader(self.options["path"], int(self.options.get("maxFiles", 50)), schema)


def stream_in_name_order(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 50) -> DataFrame:
    """Pending parquet files of a folder in file-name order, each taken once, at most ``max_files`` per micro-batch.

    Names should grow, as time stamps and counters do: a file whose name sorts before one already taken is not seen.
    An ``availableNow`` run takes one micro-batch."""
    spark.dataSource.register(NameOrderSource)
    return spark.readStream.format("name_order").schema(schema).option("path", path).option("maxFiles", max_files).load()
