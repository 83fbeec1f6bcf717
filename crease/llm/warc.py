"""WARC archives: a distributed writer and a sequential reader.

The writer puts one gzip member per record into rolling ``.warc.gz`` files on
shared storage and returns a manifest (one row per finished file).  Only files
of the manifest are read, so a file left by a lost or retried task is ignored.
The reader walks a file member by member: bytes are inflated incrementally,
the record head is taken up to its blank line, the block by its
``Content-Length``, and block and payload digests are verified on the way.  It
never holds more than a read buffer and, if asked for, one payload.

Records with equal payloads (equal SHA-1) are written once: the row with the
largest page_id is the ``response``, rows with a smaller or null page_id are
``revisit`` records that refer to it.  The HTTP head in the block keeps the
full payload's length, also for revisits.

Defined cases: null html is an empty payload; rows that repeat the largest
page_id are all responses; a null page_id sorts below every other (a group of
null page_ids only has no revisits); a null url leaves the target header out;
control characters in a url are percent-encoded; an empty table gives no file;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import scratch, shared_fs, stage

BLANK = b"\r\n\r\n"
PAGE_URN = "urn:crease:page:"
HEX32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MANIFEST = "path string, records long, bytes long"
RECORDS = ("path string, offset long, record_type string, page_id long, refers_to long, target_uri string, "
           "payload_bytes long, payload_digest string, payload binary, error string")


class WarcError(ValueError):
    """A record that breaks framing or whose digest does not match."""


def base32_sha1(payload):
    """Upper-case base32 SHA-1 of a binary column, by SQL functions (20 bits at a time)."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), HEX32, RFC32)


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses) of every row."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    light = rows.select("page_id", base32_sha1(F.col("payload")).alias("digest"))
    kept = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"),
                                       F.count("*").alias("rows"), F.count("page_id").alias("ids"))
    kept = kept.where("refers_to > least or (ids > 0 and ids < rows)").select("digest", "refers_to")
    again = light.join(kept, "digest").where("page_id is null or page_id < refers_to").distinct()
    # staged: its true size decides whether Spark broadcasts it, and the wide payloads are shuffled only if it is large
    again, _ = stage(again.withColumnsRenamed({"page_id": "_page_id", "digest": "_digest"}), "warc-revisits")
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("digest") == F.col("_digest")),
                     "left").select("page_id", "url", "payload", "digest", "refers_to")


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()


def _record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    head = b"WARC/1.1\r\n" + _head([("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *fields,
                                    ("WARC-Block-Digest", f"sha1:{_b32(hashlib.sha1(block).digest())}"),
                                    ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n" + block + BLANK) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                date: str, level: int) -> bytes:
    """One gzip member: the page's response, or the revisit of an equal payload."""
    if url is not None:
        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    name = f"{PAGE_URN}{'null' if page_id is None else page_id}"
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"),
                                          ("Content-Length", str(len(payload)))]) + b"\r\n"
    fields = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _record("response", name, fields, http + payload, level)
    fields += [("WARC-Refers-To", f"<{PAGE_URN}{refers_to}>"),
               ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
               ("WARC-Truncated", "length")]
    return _record("revisit", name, fields, http, level)


def write_archives(pages: DataFrame, folder: str, target_bytes: int = 64 << 20, level: int = 6,
                   date: str = "1970-01-01T00:00:00Z", **columns: str) -> DataFrame:
    """Write a record per row into ``folder``; return the staged manifest of finished files."""

    def write(batches):
        fs, root = shared_fs(folder)
        fs.create_dir(root, recursive=True)
        out = name = None
        done, records, size = [], 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = _record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("WARC-Date", date), (
                        "Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
                    size = out.write(info)
                size += out.write(page_record(row["page_id"], row["url"], row["payload"], row["digest"],
                                              row["refers_to"], date, level))
                records += 1
                if size >= target_bytes:
                    out.close()
                    done.append({"path": f"{folder}/{name}", "records": records, "bytes": size})
                    out = None
        if out is not None:
            out.close()
            done.append({"path": f"{folder}/{name}", "records": records, "bytes": size})
        if done:
            yield pa.RecordBatch.from_pylist(done)

    manifest, _ = stage(mark_revisits(pages, **columns).mapInArrow(write, MANIFEST), "warc-manifest")
    return manifest


class _Members:
    """Bytes of one gzip member after the other, inflated piece by piece."""

    def __init__(self, stream, piece: int):
        self.stream, self.piece, self.raw, self.at = stream, piece, b"", 0
        self.unpack, self.buffer = None, b""

    def begin(self) -> bool:
        """Start the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(self.piece)
        self.offset = self.at
        self.unpack, self.buffer = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bool:
        """Inflate another piece into the buffer; False when the member has ended."""
        while not self.unpack.eof:
            before = len(self.raw)
            try:
                got = self.unpack.decompress(self.raw, self.piece * 4)
            except zlib.error as e:
                raise WarcError(f"damaged gzip member: {e}") from e
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            self.at += before - len(self.raw)
            if got:
                self.buffer += got
                return True
            if not self.unpack.eof and not self.raw:
                self.raw = self.stream.read(self.piece)
                if not self.raw:
                    raise WarcError("file ends inside a gzip member")
        return False

    def until(self, mark: bytes) -> bytes:
        while (k := self.buffer.find(mark)) < 0:
            if not self.more():
                raise WarcError("record head without its blank line")
        out, self.buffer = self.buffer[:k], self.buffer[k + len(mark):]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise WarcError("block shorter than its Content-Length")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{PAGE_URN}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_archive(stream, piece: int = 1 << 16, payloads: bool = True) -> Iterator[dict]:
    """Records of one archive in file order; a damaged record yields a row with ``error``.

    After a failed digest or frame inside an intact member the next member is
    read on; a broken gzip stream ends the file, as its next member can't be found.
    """
    source = _Members(stream, piece)
    while source.begin():
        out = {"offset": source.offset, "error": None}
        try:
            head = source.until(BLANK)
            if not head.startswith(b"WARC/"):
                raise WarcError("no WARC version line")
            fields = _fields(head)
            out |= {"record_type": fields.get("warc-type"), "page_id": _page(fields.get("warc-record-id")),
                    "refers_to": _page(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri")}
            if not fields.get("content-length", "").isdigit():
                raise WarcError("no Content-Length")
            is_http = fields.get("content-type", "").startswith("application/http")
            block, body, front, kept, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
            http: bytes | None = None if is_http else b""
            for part in source.take(int(fields["content-length"])):
                block.update(part)
                if http is None:
                    front += part
                    if (k := front.find(BLANK)) < 0:
                        continue
                    http, part, front = front[:k], front[k + 4:], b""
                body.update(part)
                size += len(part)
                if payloads:
                    kept.append(part)
            if http is None:
                raise WarcError("HTTP head without its blank line")
            while len(source.buffer) < 4 and source.more():
                pass
            if source.buffer != BLANK or source.more():
                raise WarcError("record does not end after its Content-Length")
            if (want := fields.get("warc-block-digest")) and want != f"sha1:{_b32(block.digest())}":
                raise WarcError("block digest mismatch")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if is_http:
                length = _fields(http).get("content-length", "")
                if out["record_type"] == "response":
                    if digest and digest != _b32(body.digest()):
                        raise WarcError("payload digest mismatch")
                    if length.isdigit() and int(length) != size:
                        raise WarcError("payload shorter or longer than its HTTP length")
                    digest = digest or _b32(body.digest())
                elif length.isdigit():
                    size = int(length)
            out |= {"payload_bytes": size, "payload_digest": digest,
                    "payload": b"".join(kept) if payloads and out["record_type"] != "revisit" else None}
        except WarcError as e:
            out["error"] = str(e)
            try:
                while source.more():
                    source.buffer = b""
            except WarcError:
                yield out
                return
        yield out


def read_archives(manifest: DataFrame, payloads: bool = True, piece: int = 1 << 16,
                  batch_bytes: int = 16 << 20) -> DataFrame:
    """Every record of the manifest's files, one file per task (files are of bounded size)."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    files = manifest.count()

    def read(batches):
        schema = pa.schema([(n, {"payload": pa.binary(), "offset": pa.int64(), "page_id": pa.int64(),
                                 "refers_to": pa.int64(), "payload_bytes": pa.int64()}.get(n, pa.string()))
                            for n in names])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = shared_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for record in read_archive(stream, piece, payloads):
                        rows.append({n: record.get(n) for n in names} | {"path": path})
                        held += 200 + len(record.get("payload") or b"")
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("path").repartition(max(1, files)).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write archives of ``pages`` and return what the reader finds in them; damage raises."""
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"), **columns)
    records = read_archives(manifest, payloads=False).where("record_type <> 'warcinfo' or error is not null")
    bad = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("error"))).cast("string")
    return records.select("page_id", "payload_bytes", "payload_digest",
                          F.when(F.col("error").isNull(), F.col("record_type")).otherwise(bad).alias("record_type"),
                          "refers_to")
