"""Operator 4, WARC archives as a chunked record table.

Writing: each page becomes one record of a gzip member of its own.  Of the
records with equal payloads of at least ``revisit_from`` bytes the one with
the smallest page is a response and the others are revisits of it; smaller
payloads are always responses.  A task streams its records into archive files
of bounded size under a name that no other attempt uses and reports them; only
the files that finished attempts reported are in the manifest, so a lost
executor or a second attempt leaves nothing that is read.

Reading: archives (gzip members or plain) are read as a stream and each record
comes as rows of record identifier and chunk number.  A row holds at most
``chunk_bytes`` of payload, the bytes so far and the digest so far, so a record
of any size is read, and its digest known on its last row, without ever being
in memory as a whole.

Files go through pyarrow's file systems (local and shared folders, HDFS and
object stores by their address).

Shape: the digests are Column functions; responses are found by a grouped
minimum with partial sums; the join of pages with them has both sides
exchanged, so a payload that a third of all pages share is split by the
skew-join handling.
Defined cases: a null html is an empty payload (response); a null url has no
target header; rows with one page id and payload are all responses; a null page
id gets a record with an identifier of its own and reads back as null; an
empty table writes no archive and reads no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import arrow_schema, cut, schema, shuffle_partitions
from helixframe.session import scratch_path

REVISIT_FROM = 100
CHUNK_BYTES = 1 << 20
FILE_BYTES = 128 << 20
_READ = 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def file_system(address: str):
    """(pyarrow file system, path) of a folder or file address."""
    from pyarrow import fs
    if re.match(r"file:/", address):
        return fs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    if "://" in address:
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address


def record_name(page) -> str:
    """A page id as it stands in a record's URN: percent-encoded, so no id can
    end a header line; a null id is marked and gets a number of its own."""
    return f"null:{uuid.uuid4().hex}" if page is None else quote(str(page), safe="")


def record_head(page, url, digest: str, payload_bytes: int, refers_to, date: str) -> bytes:
    """Header lines and HTTP head of a record; ``refers_to`` makes it a
    revisit, whose block has no payload."""
    revisit = refers_to is not None
    name = record_name(page)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <{_URN}{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <{_URN}{record_name(refers_to)}>", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {payload_bytes}",
              "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(_HTTP) + (0 if revisit else payload_bytes)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + _HTTP


def write_record(out, head: bytes, payload, chunk_bytes: int = CHUNK_BYTES) -> None:
    """One record as a gzip member; the payload (a buffer) goes by chunks."""
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    out.write(gz.compress(head))
    view = memoryview(payload)
    for at in range(0, len(view), chunk_bytes):
        out.write(gz.compress(view[at:at + chunk_bytes]))
    out.write(gz.compress(b"\r\n\r\n"))
    out.write(gz.flush())


def write_archives(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM, file_bytes: int = FILE_BYTES,
                   date: str = "2026-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Writes the archives below ``folder`` and returns the manifest:
    ``path, records``."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                       F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    src = src.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("bigint")})
    first = cut(src.filter(F.col("n") >= revisit_from).groupBy("digest")
                .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
                .select(F.col("digest").alias("d"), "first"), "warc-first")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    todo = src.join(first, src["digest"] == first["d"], "left").select(
        "page_id", "url", "digest", "n", F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"))
    out = schema("path string, records bigint")

    def run(batches) -> Iterator:
        import pyarrow as pa
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        done: dict[str, list] = {"path": [], "records": []}
        stream, n = None, 0
        for batch in batches:
            payloads = batch.column(batch.schema.get_field_index("payload"))
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                    for c in ("page_id", "url", "digest", "n", "refers_to")]
            for k, (page, url, digest, size, refers_to) in enumerate(zip(*cols, strict=True)):
                if stream is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    stream, n = fs.open_output_stream(f"{base}/{name}", compression=None), 0
                payload = payloads[k].as_buffer() if refers_to is None else b""
                write_record(stream, record_head(page, url, digest, size, refers_to, date), payload)
                n += 1
                if stream.tell() >= file_bytes:
                    stream.close()
                    done["path"].append(f"{folder.rstrip('/')}/{name}")
                    done["records"].append(n)
                    stream = None
        if stream is not None:
            stream.close()
            done["path"].append(f"{folder.rstrip('/')}/{name}")
            done["records"].append(n)
        yield pa.RecordBatch.from_pydict(done, schema=arrow_schema(out))

    return cut(todo.mapInArrow(run, out), "warc-manifest")


class ByteStream:
    """What an archive holds, by lines and bounded pieces: gzip members one
    after another are undone on the way, a plain file is read as it is."""

    def __init__(self, raw):
        self.raw, self.held, self.packed = raw, b"", b""
        head = raw.read(2)
        self.gz = zlib.decompressobj(31) if head == b"\x1f\x8b" else None
        if self.gz:
            self.packed = head
        else:
            self.held = head

    def _more(self) -> bool:
        """Adds a piece of at most ``_READ`` bytes to what is held."""
        if self.gz is None:
            piece = self.raw.read(_READ)
            self.held += piece
            return bool(piece)
        while True:
            if self.gz.eof:
                self.packed = self.gz.unused_data or self.packed
                self.gz = zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.raw.read(_READ)
                if not self.packed:
                    return False
            piece = self.gz.decompress(self.packed, _READ)
            self.packed = b"" if self.gz.eof else self.gz.unconsumed_tail
            if piece:
                self.held += piece
                return True

    def line(self) -> bytes | None:
        """Up to the next line end, without it; None at the end."""
        while (at := self.held.find(b"\n")) < 0:
            if not self._more():
                line, self.held = self.held, b""
                return line or None
        line, self.held = self.held[:at], self.held[at + 1:]
        return line.rstrip(b"\r")

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, piece by piece."""
        while n:
            if not self.held and not self._more():
                raise ValueError(f"the archive ends {n} bytes before its record does")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def _fields(stream: ByteStream) -> dict[str, str]:
    out = {}
    while line := stream.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _name(urn: str | None) -> str | None:
    """The page id of a record's URN; null for a null id."""
    name = urn.strip("<>").removeprefix(_URN) if urn else None
    return None if name is None or name.startswith("null:") else unquote(name)


def chunks_of(stream: ByteStream, chunk_bytes: int) -> Iterator[dict]:
    """The chunk rows of one archive."""
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record here: {line[:40]!r}")
        fields = _fields(stream)
        left = int(fields["content-length"])
        body = stream.pieces(left)
        held = b""
        if fields.get("content-type", "").startswith("application/http"):
            # the payload follows the blank line; a body without one has none, and is not gathered to find out
            while (at := held.find(b"\r\n\r\n")) < 0 and (piece := next(body, None)) is not None:
                held = held[-3:] + piece
            held = held[at + 4:] if at >= 0 else b""
        row = {"record_id": _name(fields.get("warc-record-id")), "record_type": fields.get("warc-type"),
               "target_uri": fields.get("warc-target-uri"), "refers_to": _name(fields.get("warc-refers-to")),
               "declared_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
               "declared_bytes": int(fields["payload-length"]) if "payload-length" in fields else None}
        digest, n, number = hashlib.sha256(), 0, 0
        while True:
            while len(held) <= chunk_bytes and (piece := next(body, None)) is not None:
                held += piece
            data, held = held[:chunk_bytes], held[chunk_bytes:]
            digest.update(data)
            n += len(data)
            yield row | {"chunk_no": number, "data": data, "bytes": n, "sha256": digest.copy().hexdigest(),
                         "last": not held}
            number += 1
            if not held:
                break


CHUNKS = ("path string, record_id string, chunk_no bigint, data binary, bytes bigint, sha256 string, last boolean, "
          "record_type string, target_uri string, refers_to string, declared_digest string, declared_bytes bigint")


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in ``manifest`` (column ``path``).
    Without ``with_data`` the rows carry no payload, only counts and digests."""
    out = schema(CHUNKS)
    names = out.names

    def run(batches) -> Iterator:
        import pyarrow as pa
        form = arrow_schema(out)
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as raw:
                    for row in chunks_of(ByteStream(raw), chunk_bytes):
                        size += len(row["data"]) + 500
                        rows.append(row | {"path": path} | ({} if with_data else {"data": None}))
                        if size > 4 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in names}, schema=form)
                            rows, size = [], 0
        yield pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in names}, schema=form)

    return manifest.select("path").repartition(shuffle_partitions(manifest)).mapInArrow(run, out)


def incomplete(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Archives of which fewer or more records were read than the manifest
    says: ``path, records, found``."""
    read = chunks.filter("last").groupBy("path").agg(F.count(F.lit(1)).alias("found"))
    said = manifest.groupBy("path").agg(F.max("records").alias("records"))
    return said.join(read, "path", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("records <> found")


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: ``record_id, record_type,
    refers_to, payload_bytes, payload_digest`` (of the full payload: as read
    for responses, as declared for revisits) and ``intact`` (what was read is
    what the header declares)."""
    revisit = F.col("record_type") == "revisit"
    return chunks.filter("last").select(
        "record_id", "record_type", "refers_to", "target_uri",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("sha256")).alias("payload_digest"),
        F.when(revisit, (F.col("bytes") == 0) & F.col("declared_digest").isNotNull()).otherwise(
            F.col("sha256").eqNullSafe(F.col("declared_digest"))).alias("intact"))


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Writes ``pages`` as archives into the shared folder and reads them
    back: ``page_id, payload_bytes, payload_digest, record_type, refers_to,
    intact``."""
    id_type = pages.schema[how.get("id_col", "page_id")].dataType
    manifest = write_archives(pages, scratch_path(pages.sparkSession, "warc"), **how)
    back = records(read_chunks(manifest))
    number = lambda c: F.expr(f"try_cast({c} AS {id_type.simpleString()})")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       number("refers_to").alias("refers_to"), "intact")
