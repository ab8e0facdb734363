"""WARC archives as a chunked record table.

A record's payload is rows of (record, chunk number, bytes), so neither the writer nor the reader holds a whole payload in
Python: the writer appends chunk after chunk to a gzip member, and the reader inflates, parses and emits fixed-size chunks
with the bytes and the SHA-1 so far. A record's last chunk row carries its full length and digest.

Equal payloads are written once, as a ``response`` of the smallest id; the others are ``revisit`` records that refer to
it. Groups of equal payloads are found from digests by a partial aggregate; after the join back the copies of a payload are
in one task, unless the groups are few enough to be broadcast.

Files go below the shared folder, under a name with the task attempt in it; a file counts only once its task's row is in
the manifest table, so a lost executor leaves at most an unlisted file behind.

Defined cases: a null payload is empty; a null id sorts behind all others and is kept; rows that repeat the smallest id of
a payload are responses too; line ends in a url are percent-encoded; bytes that are no UTF-8 stay as they are in a payload
and are percent-encoded in a url; a null url gives no target header; other columns are ignored; an empty table gives no
archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copycensus.session import materialize, shared_dir

CHUNK = 256 << 10
#: A task starts another archive when one has so many compressed bytes.
ARCHIVE_BYTES = 1 << 30


def with_roles(pages: DataFrame, record_id: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """``record_id, url, payload, payload_bytes, sha1, refers_to``: null for responses."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(record_id).cast("long").alias("record_id"), url.alias("url"), body.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "payload_bytes").agg(
        F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1").drop("_copies")
    joined = rows.join(first, ["sha1", "payload_bytes"], "left")
    refers = F.when(~F.col("record_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("record_id", "url", "payload", "payload_bytes", "sha1", refers.alias("refers_to"))


def chunked(roles: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows in record order within each partition; a revisit has one chunk without bytes."""
    bytes_ = F.when(F.col("refers_to").isNull(), F.col("payload").cast("binary")).otherwise(F.lit(b""))
    last = F.floor(F.greatest(F.octet_length("_b") - 1, F.lit(0)) / F.lit(chunk)).cast("int")
    return roles.withColumn("_b", bytes_).select(
        "record_id", F.col("url").cast("binary").alias("url"), "payload_bytes", "sha1", "refers_to", last.alias("last_chunk"), "_b",
        F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"),
    ).withColumn("data", F.substring("_b", F.col("chunk_no") * chunk + 1, F.lit(chunk))).drop("_b")


def _base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _uri(record_id: int | None) -> str:
    return f"<urn:x-record:{'none' if record_id is None else record_id}>"


def _header(row: dict) -> bytes:
    revisit = row["refers_to"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(row['record_id'])}",
             "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["url"] is not None:
        safe = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogateescape"))
                       for c in row["url"].decode("utf-8", "surrogateescape"))
        lines.append(f"WARC-Target-URI: {safe}")
    lines.append(f"WARC-Payload-Digest: sha1:{_base32(row['sha1'])}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_uri(row['refers_to'])}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Length: 0"]
    else:
        lines += ["Content-Type: text/html", f"Content-Length: {row['payload_bytes']}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def made(spark: SparkSession, folder: str) -> str:
    """Make the folder, on the driver; returns it with its file system.

    A path without a scheme lies on the session's default file system, as it does for Spark's writers.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path)
    return fs.makeQualified(path).toString()


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path on it; Spark writes a local path plainly, so its blanks and percent signs stand for themselves."""
    if folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


def shared(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """As ``opened``, in a task: a local path is shared only if the folder that the driver has made is there."""
    fs, root = opened(folder)
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        fs.create_dir(root, recursive=True)
    elif fs.get_file_info(root).type != pyarrow.fs.FileType.Directory:
        raise FileNotFoundError(f"{root} is not there: the shared folder must be one that the driver and every executor can reach.")
    return fs, root


def write_archives(chunks: DataFrame, folder: str, level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``*.warc.gz`` files into a folder from ``made``, one gzip member per record; returns the manifest ``path, records, bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared(folder)
        context = TaskContext.get()
        out = member = path = None
        records = written = number = 0

        def put(data: bytes) -> None:
            nonlocal written
            out.write(data)
            written += len(data)

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is not None and written >= archive_bytes:
                        out.close()
                        yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": written}], MANIFEST)
                        out = None
                    if out is None:
                        path = f"{root}/part-{context.partitionId():05d}-{number:04d}-{context.taskAttemptId()}.warc.gz"
                        out, records, written, number = fs.open_output_stream(path, compression=None), 0, 0, number + 1
                    member = zlib.compressobj(level, wbits=31)
                    put(member.compress(_header(row)))
                    records += 1
                put(member.compress(row["data"]))
                if row["chunk_no"] == row["last_chunk"]:
                    put(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": written}], MANIFEST)

    return materialize(chunks.mapInArrow(run, "path string, records long, bytes long"))


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


class Inflated:
    """The bytes of a file of gzip members, in bounded pieces."""

    def __init__(self, source, piece: int):
        self.source, self.piece = source, piece
        self.z, self.rest, self.ready = zlib.decompressobj(wbits=31), b"", bytearray()

    def _more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.source.read(self.piece)
                if not self.rest:
                    return False
            got = self.z.decompress(self.rest, self.piece)
            self.rest = self.z.unconsumed_tail if not self.z.eof else b""
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(wbits=31)
            if got:
                self.ready += got
                return True

    def line(self) -> bytes | None:
        """Up to and with a line end; None at the end of the file."""
        while (end := self.ready.find(b"\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.ready[:end + 1])
        del self.ready[:end + 1]
        return out

    def take(self, most: int) -> bytes:
        while len(self.ready) < most and self._more():
            pass
        out = bytes(self.ready[:most])
        del self.ready[:most]
        return out


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table: ``record_id, record_type, refers_to, url, chunk_no, is_last, data, bytes_so_far, digest_so_far,
    payload_bytes, payload_digest``. The last two are those of the header, so a revisit has its response's."""
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("record_id", T.LongType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("url", T.StringType()),
        ("chunk_no", T.LongType()), ("is_last", T.BooleanType()), ("data", T.BinaryType()), ("bytes_so_far", T.LongType()),
        ("digest_so_far", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()))])
    arrow = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                       ("chunk_no", pa.int64()), ("is_last", pa.bool_()), ("data", pa.binary()), ("bytes_so_far", pa.int64()),
                       ("digest_so_far", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def number(uri: str | None) -> int | None:
        tail = uri.rstrip(">").rpartition(":")[2] if uri else "none"
        return None if tail == "none" else int(tail)

    def records(stream: Inflated) -> Iterator[dict]:
        while (line := stream.line()) is not None:
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"not a record: {line[:40]!r}")
            head = {}
            while (line := stream.line()).strip():
                name, _, value = line.decode().partition(":")
                head[name.lower()] = value.strip()
            left = int(head["content-length"])
            digest, so_far, at = hashlib.sha1(), 0, 0
            base = {"record_id": number(head["warc-record-id"]), "record_type": head["warc-type"],
                    "refers_to": number(head.get("warc-refers-to")), "url": head.get("warc-target-uri"),
                    "payload_bytes": int(head.get("x-payload-length", left)),
                    "payload_digest": head["warc-payload-digest"].removeprefix("sha1:")}
            while True:
                data = stream.take(min(chunk, left))
                if len(data) < min(chunk, left):
                    raise ValueError("the archive ends within a record")
                left -= len(data)
                so_far += len(data)
                digest.update(data)
                yield base | {"chunk_no": at, "is_last": left == 0, "data": data, "bytes_so_far": so_far,
                              "digest_so_far": base64.b32encode(digest.digest()).decode()}
                at += 1
                if not left:
                    break
            stream.take(4)  # the two line ends behind a record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for row in records(Inflated(source, chunk)):
                        rows.append(row)
                        held += len(row["data"]) + 300
                        if held > 8 * chunk:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    files = manifest.select("path")
    return files.repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, record_id: str = "page_id", payload: str = "html", least_bytes: int = 0,
               chunk: int = CHUNK) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back as the chunk table."""
    spark = pages.sparkSession
    folder = made(spark, f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    manifest = write_archives(chunked(with_roles(pages, record_id, payload, least_bytes), chunk), folder)
    return read_archives(spark, manifest, folder, chunk)


def checked_records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk; fails where a response's bytes do not have the digest of its header."""
    wrong = (F.col("record_type") == "response") & (
        (F.col("digest_so_far") != F.col("payload_digest")) | (F.col("bytes_so_far") != F.col("payload_bytes")))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("damaged record "), F.coalesce(F.col("record_id").cast("string"), F.lit("none")))))
    return chunks.where("is_last").select(
        "record_id", "payload_bytes", digest.otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
