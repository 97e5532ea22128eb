"""WARC archives: one gzip member per record, written and read back record by record.

Writing needs no exchange of payloads unless there are very many repeated ones: a task writes its rows one after the
other into archives of bounded size, through a temporary name, so that a failed attempt leaves no archive, and only
archives of tasks that ended well are listed. A record whose payload an equal one with a larger id has is a revisit: it has the
header block and the digest of the full payload, and names the record to look at.

Reading is sequential and bounded by one record: compressed bytes are inflated piece by piece, the header ends at an empty
line, the block is as long as Content-Length says, and the member must end with the record. Digests are computed on the way.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import keep, shared_folder, small, tidy, write_table

# fixed values of the format
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
URN = "urn:x-record:"

#: Compressed bytes of an archive after which the next one is begun, bytes read at once, payload bytes of a batch.
ARCHIVE_BYTES, PIECE, BATCH_BYTES = 1 << 30, 1 << 16, 1 << 23
GZIP = 16 + zlib.MAX_WBITS
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, verified boolean"


class BrokenArchive(ValueError):
    """The framing of an archive does not hold."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(id: str | None, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> list[bytes]:
    """The pieces of one record; ids and URIs are percent-encoded where a header line could not hold them."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = [http] if refers_to is not None else [http, payload]
    digest = hashlib.sha1(http)
    for piece in block[1:]:
        digest.update(piece)
    lines = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{URN}{quote(id, safe='')}>" if id is not None else f"<{uuid.uuid4().urn}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if uri is None else quote(uri, safe="!#$%&'()*+,/:;=?@[]~-._"),
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else f"<{URN}{quote(refers_to, safe='')}>",
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(digest.digest()).decode()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(sum(map(len, block))),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None)
    return [VERSION, b"\r\n", head.encode(), b"\r\n", *block, END]


def member(pieces: list[bytes], level: int) -> Iterator[bytes]:
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    yield from (packer.compress(p) for p in pieces)
    yield packer.flush()


class Reader:
    """Records of one stream of gzip members."""

    def __init__(self, stream, piece: int = PIECE):
        self.stream, self.piece = stream, piece
        self.packed, self.plain, self.inflater = b"", bytearray(), None

    def _more(self) -> bool:
        """Inflate one more piece of the current member; False at its end."""
        if self.inflater.eof:
            return False
        if not self.packed:
            self.packed = self.stream.read(self.piece)
            if not self.packed:
                raise BrokenArchive("the archive ends inside a member")
        self.plain += self.inflater.decompress(self.packed, self.piece)
        self.packed = self.inflater.unconsumed_tail or self.inflater.unused_data
        return True

    def _until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.plain.find(mark, start)) < 0:
            start = max(0, len(self.plain) - len(mark) + 1)
            if not self._more():
                raise BrokenArchive("a record without end of its header")
        found = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return found

    def _exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self._more():
                raise BrokenArchive("a record shorter than its length")
            part = bytes(self.plain[:n])
            del self.plain[:n]
            n -= len(part)
            yield part

    def records(self) -> Iterator[tuple[dict[str, str], bytes, bool]]:
        """Header fields (names in lower case), block, and whether the block's digest is right."""
        while True:
            self.packed = self.packed or self.stream.read(self.piece)
            if not self.packed:
                return
            self.inflater = zlib.decompressobj(GZIP)
            version, *lines = self._until(END).split(b"\r\n")
            if not version.startswith(b"WARC/"):
                raise BrokenArchive(f"not a record: {version[:20]!r}")
            fields = {}
            for name, _, value in (line.decode().partition(":") for line in lines):
                fields[name.strip().lower()] = value.strip()
            if not fields.get("content-length", "").isdigit():
                raise BrokenArchive("a record without length")
            digest, block = hashlib.sha1(), bytearray()
            for part in self._exactly(int(fields["content-length"])):
                digest.update(part)
                block += part
            end = b"".join(self._exactly(len(END)))
            while not self.plain and self._more():
                pass  # the rest of the member, which must hold no more text
            if end != END or self.plain:
                raise BrokenArchive("a member that does not end with its record")
            yield fields, bytes(block), fields.get("warc-block-digest") in (None, f"sha1:{base64.b32encode(digest.digest()).decode()}")


def _id(value: str | None) -> str | None:
    value = (value or "").strip("<>")
    return unquote(value[len(URN) :]) if value.startswith(URN) else None


def parsed(fields: dict[str, str], block: bytes, right: bool) -> tuple:
    """A row of SCHEMA and the payload, which a revisit doesn't have."""
    head, _, payload = block.partition(END)
    length = next((int(v) for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    verified = right and length is not None and (revisit or (len(payload) == length and base32_sha1(payload) == digest))
    uri = fields.get("warc-target-uri")
    row = (_id(fields.get("warc-record-id")), fields["warc-type"], uri, digest, length, _id(fields.get("warc-refers-to")), verified)
    return row, None if revisit else payload


def _filesystem(place: str) -> tuple[FileSystem, str]:
    """Local folders, and shared ones by their URI, as far as pyarrow knows the scheme."""
    return FileSystem.from_uri("file://" + place[5:] if place.startswith("file:/") and not place.startswith("file://") else place)


def with_targets(df: DataFrame, id: str, payload: str, least: int = 0) -> DataFrame:
    """Add ``refers_to``: the largest id among rows with an equal payload of at least ``least`` bytes, if it is another id.

    Null payloads are empty. Rows that repeat the largest id are no revisits; a null id never is a target. Only digests
    that occur more than once are joined to the rows, by broadcast if they are few.
    """
    content = F.coalesce(F.col(f"`{payload}`"), F.lit("").cast(df.schema[payload].dataType)).cast("binary")
    rows = df.withColumn("__sha", F.unhex(F.sha1(content))).withColumn("__size", F.octet_length(content))
    groups = rows.where(F.col("__size") >= least).groupBy("__sha", "__size").agg(F.max(f"`{id}`").alias("__last"), F.count(F.lit(1)).alias("__n"))
    repeated = keep(groups.where((F.col("__n") > 1) & F.col("__last").isNotNull()).drop("__n"))
    revisit = F.col("__last").isNotNull() & ~F.col("__last").eqNullSafe(F.col(f"`{id}`"))
    return rows.join(small(repeated), ["__sha", "__size"], "left").withColumn("refers_to", F.when(revisit, F.col("__last"))).drop("__sha", "__size", "__last")


def write_archives(
    df: DataFrame, folder: str, id: str, uri: str, payload: str, date: str, least: int = 0, level: int = 6, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write a record per row below ``folder``, a place that all executors share, and return (path, records, bytes).

    Payloads are strings, written in UTF-8, or binary; null ones are empty. ``date`` (``YYYY-MM-DDThh:mm:ssZ``) is that of all records. Null ids
    get a random record id and are read back as null; a null uri has no header line. An empty table has no archive.
    """
    source = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{uri}`").alias("uri"), F.col(f"`{payload}`").alias("payload"))
    rows = with_targets(source, "id", "payload", least).select(
        F.col("id").cast("string"), F.col("uri").cast("string"), F.col("payload").cast("binary"), F.col("refers_to").cast("string")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        files.create_dir(base)
        attempt, number, done = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, []
        out = name = None
        count = size = 0

        def close():
            out.close()
            files.move(f"{base}/{name}.part", f"{base}/{name}")
            done.append((name, count, size))

        for batch in batches:
            for i in range(batch.num_rows):
                key, address, data, target = (c[i].as_py() for c in batch.columns)
                if out is None:
                    name = f"{attempt}-{number:05d}.warc.gz"
                    out, count, size = files.open_output_stream(f"{base}/{name}.part", compression=None), 0, 0
                for piece in member(record(key, address, data or b"", target, date), level):
                    out.write(piece)
                    size += len(piece)
                count += 1
                if size >= archive_bytes:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        paths, counts, sizes = zip(*done) if done else ((), (), ())
        columns = [pa.array([f"{folder}/{p}" for p in paths], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["path", "records", "bytes"])

    return write_table(rows.mapInArrow(tidy(run), "path string, records bigint, bytes bigint"), "archives")


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Response and revisit records of the archives in column ``path``, an archive a task; other record types are passed over.

    ``verified``: block and payload digests are right (a revisit has no payload to verify). Broken framing is an error.
    """
    schema = SCHEMA + (", payload binary" if payloads else "")
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"payload_bytes": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = _filesystem(path)
                rows, held = [], 0
                with files.open_input_stream(at, compression=None) as stream:
                    for fields, block, right in Reader(stream).records():
                        if fields.get("warc-type") not in ("response", "revisit"):
                            continue
                        row, payload = parsed(fields, block, right)
                        rows.append((*row, payload) if payloads else row)
                        held += len(block) if payloads else 200
                        if held >= BATCH_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    tasks = max(1, paths.count())
    return paths.select("path").repartition(tasks).mapInArrow(tidy(run), schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the cluster's shared folder."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
