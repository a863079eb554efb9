"""WARC archives: writer, monolithic gzip normaliser, indexed reader (operator 4).

1. Records.  Of records with equal payloads (SHA-1 and length) the one with the largest id is the
   response, the others are revisits of it without a body; a revisit's headers keep digest and length of
   the full payload.
2. ``write_monolithic``: Spark writes whole-file gzip streams, one per task, as a crawler
   without record-level compression would leave them.
3. ``normalise``: one task per file inflates the stream once, chunk by chunk, and rewrites every
   record as a gzip member of its own; the offsets go to a sidecar index (parquet beside the archives).
   Memory is one chunk and one record.  A file is written under a name of the attempt and renamed when
   complete, so a lost executor leaves nothing half done.
4. ``read_indexed``: index rows are dealt over tasks, each member is read by offset and length alone.

Null payloads count as empty, empty payloads equal each other (``least`` bytes and up are
deduplicated).  A null id is written as such; it loses against any other.  Rows that repeat id and
payload are the same record and each come back with its type.  Null urls are left out; line breaks in
urls are percent-encoded.  An empty table gives an empty archive set; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_path
from .common import col

CHUNK = 1 << 20
#: Compressed bytes of records that one task reads.
READ_BYTES = 64 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648 base32


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string or binary column: 8 groups of 5 hex digits make
    4 letters each."""
    h = F.sha1(payload)
    out = []
    for group in range(8):
        bits = F.conv(F.substring(h, 5 * group + 1, 5), 16, 10).cast("int")
        for i in range(4):
            at = F.shiftright(bits, 15 - 5 * i).bitwiseAND(F.lit(31))
            out.append(F.substring(F.lit(ALPHABET), at + 1, F.lit(1)))
    return F.concat(*out)


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """id, url, payload, payload_bytes, payload_digest, refers_to, revisit of every row."""
    rows = pages.select(col(id_col).alias("id"), col(url_col).cast("string").alias("url"),
                        F.coalesce(col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    # payloads are equal if SHA-1, length and two more hashes are: known SHA-1 collisions differ in these
    rows = rows.withColumn("check_a", F.xxhash64(F.lit(1), "payload")).withColumn("check_b", F.xxhash64(F.lit(2), "payload"))
    same = ["payload_digest", "payload_bytes", "check_a", "check_b"]
    # counted per digest before the shuffle; only ids, digests and lengths move, the payload does not
    best = (rows.filter(F.col("payload_bytes") >= least).groupBy(*same)
            .agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    rows = rows.join(best, same, "left").drop("check_a", "check_b")
    revisit = F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best"))
    return rows.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("best"))).drop("best")


def urn(id_: Column) -> Column:
    """Record id of a page id, in URL encoding; the null id has a name of its own."""
    return F.when(id_.isNull(), F.lit("<urn:no-page-id>")).otherwise(F.concat(F.lit("<urn:page:"), F.url_encode(id_.cast("string")), F.lit(">")))


def record_text(r: DataFrame) -> Column:
    """One WARC/1.1 record without the final line break (the text writer adds it)."""
    line = "\r\n"
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
            F.concat(F.lit("WARC-Target-URI: "), url),
            F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
            F.when(F.col("revisit"), "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
            F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(line, *head), F.lit(line + line), block, F.lit(line))


def write_monolithic(rows: DataFrame, path: str, per_file: int = 5000) -> None:
    """Whole-file gzip streams of ``records`` rows under ``path``, at most ``per_file`` records each."""
    (rows.select(record_text(rows).alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n")
     .option("maxRecordsPerFile", per_file).text(path))


class Records:
    """Incremental reader of a WARC byte stream: feed bytes, get whole records."""

    def __init__(self):
        self.held = bytearray()
        self.need = 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        """(headers, block, the record's bytes) for each record completed by ``data``."""
        self.held += data
        while len(self.held) >= self.need:
            end = self.held.find(b"\r\n\r\n")
            if end < 0:
                self.need = len(self.held) + 1
                return
            lines = bytes(self.held[:end]).decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record here: {lines[0][:80]!r}")
            head = {}
            for line in lines[1:]:
                name, _, value = line.partition(":")
                head[name.strip().lower()] = value.strip()
            size = int(head["content-length"])
            self.need = end + 4 + size + 4
            if len(self.held) < self.need:
                return
            whole = bytes(self.held[:self.need])
            del self.held[:self.need]
            self.need = 0
            yield head, whole[end + 4:end + 4 + size], whole

    def finish(self) -> None:
        if self.held:
            raise ValueError(f"the archive ends inside a record ({len(self.held)} bytes left)")


def inflate(stream) -> Iterator[bytes]:
    """Bytes of a gzip stream, one member or many, read once in chunks."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield z.decompress(data, CHUNK)
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    while rest := z.decompress(z.unconsumed_tail, CHUNK):
        yield rest


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Spark writes it (file:/x, hdfs://..., or a plain path)."""
    if uri.startswith("/"):
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


INDEX = T.StructType([T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
                      T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
                      T.StructField("payload_digest", T.StringType())])


def _member(whole: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(whole) + z.flush()


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite each gzip file under ``source`` as ``target``/name.warc.gz with one member per record;
    the sidecar index is written to ``target``/index and returned."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    files = names.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                to_fs, folder = open_fs(target)
                to_fs.create_dir(folder, recursive=True)
                name = path.rsplit("/", 1)[-1].split(".", 1)[0] + ".warc.gz"
                own = f"{folder}/.{name}.{uuid.uuid4().hex}"
                rows, offset, reader = [], 0, Records()
                with fs.open_input_stream(at, compression=None) as stream, to_fs.open_output_stream(own, compression=None) as out:
                    for data in inflate(stream):
                        for head, _, whole in reader.feed(data):
                            member = _member(whole)
                            out.write(member)
                            rows.append((f"{target.rstrip('/')}/{name}", offset, len(member), head.get("warc-record-id"), head.get("warc-type"),
                                         head.get("warc-payload-digest")))
                            offset += len(member)
                    reader.finish()
                to_fs.move(own, f"{folder}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])], names=INDEX.names)

    where = f"{target.rstrip('/')}/index"
    names.repartition(max(1, files)).mapInArrow(run, INDEX).write.parquet(where)
    return spark.read.schema(INDEX).parquet(where)


READ = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
                     T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()),
                     T.StructField("payload_bytes", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType())])


def read_indexed(index: DataFrame) -> DataFrame:
    """The records of index rows; each is one ranged read and one inflate.  Response digests and lengths
    are computed from the payload read back and must equal the headers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import hashlib
        opened: tuple[str, object] | None = None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if opened is None or opened[0] != archive:
                    if opened:
                        opened[1].close()
                    fs, at = open_fs(archive)
                    opened = (archive, fs.open_input_file(at))
                opened[1].seek(offset)
                reader = Records()
                (head, block, _), = reader.feed(zlib.decompress(opened[1].read(length), 31))
                reader.finish()
                digest, n = head["warc-payload-digest"].removeprefix("sha1:"), int(head["warc-payload-length"])
                if head["warc-type"] == "response":
                    found = base64.b32encode(hashlib.sha1(block).digest()).decode()
                    if found != digest or len(block) != n:
                        raise ValueError(f"record {head['warc-record-id']} of {archive} does not match its digest")
                rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), digest, n, head.get("warc-target-uri"), block))
                size += len(block)
                if size > 4 * CHUNK:
                    yield _read_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _read_batch(rows)
        if opened:
            opened[1].close()

    # dealt by the bytes to be read, not by the size of the index: a stretch of an archive is a task's work
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    stretch = F.floor(F.col("offset") / max(1 << 20, min(READ_BYTES, total // tasks + 1)))
    dealt = index.select("archive", "offset", "length").repartition(int(tasks), "archive", stretch)
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(run, READ)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=READ.names)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0,
            folder: str | None = None, per_file: int = 5000) -> DataFrame:
    """Write, normalise and read back; one row per page: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = folder or checkpoint_path(spark, "llm", f"warc-{uuid.uuid4().hex}")
    write_monolithic(records(pages, id_col, url_col, payload_col, least), f"{folder}/whole", per_file)
    back = read_indexed(normalise(spark, f"{folder}/whole", f"{folder}/members"))
    kind = pages.schema[id_col].dataType

    def page(c: str) -> Column:
        return F.when(F.col(c).rlike("^<urn:page:"), F.url_decode(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1))).cast(kind)

    return back.select(page("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


_BITS = "('0x' || substr(h, {at}, 5))::int"
ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as h, max(page_id) over (partition by html) as best from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  {" || ".join(f"substr('{ALPHABET}', 1 + (({_BITS.format(at=5 * g + 1)} >> {15 - 5 * i}) & 31), 1)" for g in range(8) for i in range(4))} as payload_digest,
  case when page_id = best then 'response' else 'revisit' end as record_type,
  case when page_id <> best then best end as refers_to
from d
"""
