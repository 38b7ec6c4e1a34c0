"""WARC archives: one gzip member a record, read in sequence."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zedweave.llm import files
from zedweave.llm.common import Scratch, freed

#: Payload bytes after which a task begins another archive, so that reading can be dealt out.
ARCHIVE_BYTES = 64 << 20
#: Bytes read of a stream at a time, those of them inflated at a time, and of the longest header.
CHUNK, SLICE, HEADER = 1 << 20, 1 << 14, 1 << 24

ARCHIVES = "path string, n_records long, n_bytes long"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes | bytearray | memoryview) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as one gzip member. The id of a page is in WARC-Record-ID; a revisit has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        # header fields are lines: what would end one, and the ends that readers strip, are escaped
        line = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {line}")
        if line != url:
            head.append("X-Target-URI-Base64: " + base64.b64encode(url.encode()).decode())
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class Broken(ValueError):
    """An archive that doesn't hold what its records declare."""


class Members:
    """The gzip members of a stream in sequence, inflated piece by piece. Holds a chunk of the stream, and of a member
    what is asked for."""

    def __init__(self, stream):
        self.stream, self.raw, self.at, self.z = stream, b"", 0, None

    def _filled(self) -> bool:
        if self.at >= len(self.raw):
            self.raw, self.at = self.stream.read(CHUNK), 0
        return self.at < len(self.raw)

    def next(self) -> bool:
        """Goes to the next member, if there is one."""
        self.z = zlib.decompressobj(31) if self._filled() else None
        return self.z is not None

    def read(self, most: int) -> bytes:
        """At most so many inflated bytes of this member, none at its end."""
        out = b""
        while not out and not self.z.eof:
            if not self._filled():
                raise Broken("the last member has no end")
            # small slices, since zlib copies what it leaves of each
            piece = self.raw[self.at : self.at + SLICE]
            out = self.z.decompress(piece, most)
            self.at += len(piece) - len(self.z.unused_data if self.z.eof else self.z.unconsumed_tail)
        return out


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; lengths, block digests and payload digests are verified.

    Of a member no more is inflated than a header of HEADER bytes at most and the length that it declares.
    """
    members = Members(stream)
    while members.next():
        b, end = bytearray(), -1
        while (end := b.find(b"\r\n\r\n")) < 0:
            if len(b) > HEADER or not (more := members.read(SLICE)):
                raise Broken("a member doesn't begin with a record's header")
            b += more
        lines = b[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise Broken("a member doesn't begin with a record's header")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        del b[: end + 4]
        while len(b) < n + 5 and (more := members.read(min(CHUNK, n + 5 - len(b)))):
            b += more
        if b[n:] != b"\r\n\r\n":
            raise Broken("the content's length isn't the declared one")
        del b[n:]
        if fields["WARC-Block-Digest"] != f"sha1:{digest(b)}":
            raise Broken("the block's digest isn't the declared one")
        if fields["WARC-Type"] == "response":
            payload = memoryview(b)[b.find(b"\r\n\r\n") + 4 :]
            if fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}" or int(fields["X-Payload-Length"]) != len(payload):
                raise Broken("the payload isn't the declared one")
            payload.release()
        yield fields, bytes(b)


def target_uri(fields: dict[str, str]) -> str | None:
    """The URL that was archived."""
    if own := fields.get("X-Target-URI-Base64"):
        return base64.b64decode(own).decode()
    return fields.get("WARC-Target-URI")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    task, done, stream = TaskContext.get(), [], None
    for batch in batches:
        html = batch.column(2)
        for k, (page, url, refers_to, revisit) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)))):
            if stream is None or done[-1][2] >= ARCHIVE_BYTES:
                if stream:
                    stream.close()
                done.append([f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz", 0, 0])
                stream = files.open_write(done[-1][0])
            payload = (html[k].as_py() or "").encode()
            stream.write(record(page, url, payload, refers_to, revisit))
            done[-1][1] += 1
            done[-1][2] += len(payload)
    if stream:
        stream.close()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "n_records", "n_bytes"])


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row of pages and returns the archives.

    Of rows with equal payloads (html in UTF-8, null: empty) of at least `least` bytes those with the
    smallest id are responses, the others revisits of it; rows that repeat an id and payload are alike. Null
    ids never come first, unless all ids are null: then all rows are responses. Other columns are ignored.
    The result is computed on each use: save it before reading the archives.
    """
    files.make_folder(folder)
    scratch = Scratch(pages.sparkSession, "warc-first")
    html = F.coalesce(F.col(html_col), F.lit(""))
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    # digests find the revisits, without the payloads; these meet the few that revisit by id and digest, so that no payload is a hot key
    digests = scratch.save(slim.select("page_id", F.unhex(F.sha1("html")).alias("d"), F.octet_length("html").alias("n")))
    first = digests.where(F.col("n") >= least).groupBy(F.col("d").alias("_d")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    first = scratch.save(first.where((F.col("_c") > 1) & F.col("_first").isNotNull()).select("_d", "_first"))
    ids = digests.groupBy("page_id", "d").agg(F.count(F.lit(1)).alias("_c"))  # a payload's rows are many ids
    again = ids.join(first, F.col("d") == F.col("_d")).where(~F.col("page_id").eqNullSafe(F.col("_first")))
    again = scratch.save(again.select(F.col("page_id").alias("_page"), "_d", "_first"))
    rows = slim.withColumn("_k", F.unhex(F.sha1("html"))).join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_k") == F.col("_d")), "left")
    rows = rows.select("page_id", "url", "html", F.col("_first").alias("refers_to"), F.col("_first").isNotNull().alias("revisit"))
    return rows.mapInArrow(lambda b: freed(_write(b, folder)), ARCHIVES)


def _page(uri: str) -> int | None:
    return int(x) if (x := uri[len("<urn:page:") : -1]) else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in ROWS.split(", ")]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    for batch in batches:
        for a in batch.to_pylist():
            rows, n = [], 0
            for fields, _ in records(files.open_read(a["path"])):
                n += 1
                rows.append((_page(fields["WARC-Record-ID"]), target_uri(fields), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"],
                             _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None))
                if len(rows) == 10_000:
                    yield make(rows)
                    rows = []
            if n != a["n_records"]:
                raise Broken(f"{a['path']} has {n} records, not {a['n_records']}")
            if rows:
                yield make(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    archives (path, n_records; other columns are ignored) must be saved. Null ids and URLs come back as null; repeated rows
    are records of their own; no archives give no rows. An archive that doesn't hold what it declares fails with Broken.
    """
    return archives.repartition(max(1, archives.count())).mapInArrow(lambda b: freed(_read(b)), ROWS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """write_archives to the shared folder, then read_archives."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read_archives(scratch.save(write_archives(pages, f"{scratch.path}/files", least)))
