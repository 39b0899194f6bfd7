"""WARC archives: a writer that deduplicates payloads and a sequential reader.

An archive is a run of gzip members, one record each. The reader goes through an
archive's bytes once: it decompresses member by member in bounded steps, frames the
block by Content-Length and verifies the block's and payload's digests.

Archives are held as the binary column ``content`` of a table, one archive a row, as
Spark's binaryFile source gives them too; so they can be in any store that Spark reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices

#: Bytes of an archive after which the next record starts a new one.
ARCHIVE_BYTES = 4 << 20
#: Compressed bytes that the reader hands to zlib at once, and most bytes it takes back in one step.
STEP = 1 << 16
#: Longest header of a record.
MOST_HEAD = 1 << 20
#: Payloads below this many bytes are never revisits.
LEAST_PAYLOAD = 100
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record is cut short, misframed or fails its digest."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response record, or a revisit whose block keeps the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_header(url)}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _header(url: str) -> str:
    """A URL as a header's value: as it is, but for control characters and blanks, which are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else quote(c, safe="") for c in url)


class _Member:
    """The content of one gzip member, inflated as it is read, never more than STEP bytes ahead."""

    def __init__(self, data: memoryview, at: int) -> None:
        self.data, self.at = data, at
        self.unpack, self.buffer = zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflates a step more; False at the end of the member."""
        while not self.unpack.eof:
            step = self.unpack.unconsumed_tail or self.data[self.at : self.at + STEP]
            if not step:
                raise WarcError("the archive ends inside a gzip member")
            if not self.unpack.unconsumed_tail:
                self.at += len(step)
            try:
                out = self.unpack.decompress(step, STEP)
            except zlib.error as e:
                raise WarcError(f"gzip member: {e}") from e
            if out:
                self.buffer += out
                return True
        return False

    def head(self, most: int | None = None) -> bytes | None:
        """What stands before the next empty line, and goes beyond it; None if there is none in so many bytes or the member."""
        at = 0
        while (end := self.buffer.find(b"\r\n\r\n", at)) < 0 or (most is not None and end + 4 > most):
            if end >= 0 or (most is not None and len(self.buffer) >= most) or len(self.buffer) > MOST_HEAD or not self.more():
                return None
            at = max(0, len(self.buffer) - STEP - 3)
        out, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in parts."""
        while n:
            if not self.buffer and not self.more():
                raise WarcError("Content-Length doesn't frame the block")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part

    def end(self) -> int:
        """Where the next member starts; nothing but the record's end may be left."""
        while self.more():
            if len(self.buffer) > 4:
                break
        if self.buffer != b"\r\n\r\n":
            raise WarcError("Content-Length doesn't frame the block")
        return self.at - len(self.unpack.unused_data)


class _Digest:
    """A declared digest, "algorithm:value" with a value in hexadecimal or base32, and what is computed."""

    def __init__(self, declared: str | None) -> None:
        name, _, self.value = (declared or "").partition(":")
        name = name.lower().replace("-", "")
        self.hash = hashlib.new(name) if self.value and name in ("md5", "sha1", "sha256", "sha384", "sha512") else None

    def update(self, part: bytes) -> None:
        if self.hash:
            self.hash.update(part)

    def holds(self) -> bool:
        """Whether it is as declared, or isn't declared in a known algorithm."""
        if not self.hash:
            return True
        raw = self.hash.digest()
        return self.value.lower() == raw.hex() or self.value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in re.sub(r"\r\n[ \t]+", " ", lines.decode("utf-8", "replace")).split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _unchunked(body: bytes) -> bytes | None:
    """A body without its chunked transfer coding; None if it isn't in one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def read_archive(content: bytes | memoryview, with_payload: bool = True) -> Iterator[dict]:
    """Records of one archive, in order, of any type; raises WarcError where one isn't whole.

    A block is inflated, framed by Content-Length and digested in steps; only a payload that
    is asked for is kept, or one in a chunked transfer coding, whose digest may be of what is
    coded. The payload is what follows the HTTP header, or the whole block of records without one.
    """
    data, at = memoryview(content), 0
    while at < len(data):
        member = _Member(data, at)
        first = member.head()
        if first is None or not first.startswith(b"WARC/"):
            raise WarcError("a member doesn't start with a WARC version")
        fields = _headers(first)
        kind, size = fields.get("warc-type", ""), fields.get("content-length", "")
        if not size.isdigit():
            raise WarcError("no Content-Length")
        size = int(size)
        block, payload = _Digest(fields.get("warc-block-digest")), _Digest(fields.get("warc-payload-digest"))
        http: dict[str, str] = {}
        if size and fields.get("content-type", "").startswith("application/http") and (head := member.head(size)) is not None:
            http = _headers(head)
            block.update(head + b"\r\n\r\n")
            size -= len(head) + 4
        whole, kept = hashlib.sha256(), [] if with_payload or "chunked" in http.get("transfer-encoding", "").lower() else None
        for part in member.take(size):
            block.update(part)
            payload.update(part)
            whole.update(part)
            if kept is not None:
                kept.append(part)
        at = member.end()
        if not block.holds():
            raise WarcError("block digest")
        body = b"".join(kept) if kept is not None else None
        if kind != "revisit" and not payload.holds():
            plain, again = _unchunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else None, _Digest(fields.get("warc-payload-digest"))
            again.update(plain or b"")
            if plain is None or not again.holds():
                raise WarcError("payload digest")
        declared = fields.get("warc-payload-digest")
        full = http.get("content-length", "") if kind == "revisit" else str(size)
        yield {
            "page_id": _id(fields.get("warc-record-id")),
            "url": fields.get("warc-target-uri"),
            "record_type": kind,
            "payload_bytes": int(full) if full.isdigit() else None,
            "payload_digest": (declared or "").removeprefix("sha256:") or None if kind == "revisit" else whole.hexdigest(),
            "refers_to": _id(fields.get("warc-refers-to")),
            "record_id": fields.get("warc-record-id"),
            "date": fields.get("warc-date"),
            "content_type": fields.get("content-type"),
            "declared_digest": declared,
            "payload": body if with_payload and kind != "revisit" else None,
        }


def _id(uri: str | None) -> int | None:
    """The page of a record id that this module wrote; others have none."""
    m = re.fullmatch(r"<?urn:page:(-?[0-9]+)>?", uri or "")
    return int(m[1]) if m else None


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, records, content): every row of pages as a record, in archives of about ARCHIVE_BYTES.

    The payload is html in UTF-8, null as empty. Of the rows with equal payloads of at
    least LEAST_PAYLOAD bytes, those with the smallest page_id are responses (all of
    them, if that id is repeated) and the others revisit it; a null page_id is larger
    than any other and, where all are null, all are responses.

    The smallest id of a digest is pre-aggregated, and only digests that occur more
    than once are joined back, salted, so a payload that a third of the pages share
    is dealt over SALTS tasks.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    small = F.octet_length("html") < LEAST_PAYLOAD
    first = rows.filter(~small).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("__n")).filter("__n > 1 AND first IS NOT NULL").drop("__n")
    first = first.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.when(small, F.lit(None)).otherwise(F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).cast("int"))
    marked = salted.join(first, ["digest", "__salt"], "left").select("page_id", "url", "html", "digest", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0
        for batch in slices(batches):
            for i, u, h, d, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members.append(record(i, u, h.encode("utf-8", "surrogatepass"), d, to, to is not None))
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    yield _archive(members)
                    members, size = [], 0
        if members:
            yield _archive(members)

    return marked.mapInArrow(run, "archive string, records int, content binary")


def _archive(members: list[bytes]) -> pa.RecordBatch:
    content = b"".join(members)
    name = hashlib.sha256(content).hexdigest()[:32] + ".warc.gz"
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(members)], pa.int32()), pa.array([content], pa.binary())], names=["archive", "records", "content"])


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of archives in the binary column content, of any type: page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id, date, content_type, declared_digest, payload.

    payload_digest is the SHA-256 in hexadecimal of the payload as read, and of a revisit
    what it declares. Declared digests, in hexadecimal or base32, are verified; without one
    there is nothing to verify. page_id and refers_to are null for records that
    write_archives didn't write. payload is null in revisits. A broken record fails the
    job with WarcError. A null or empty content has no records.
    """
    types = RECORD if with_payload else RECORD[:-1]
    names = [n for n, _ in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                size = 0
                for r in read_archive(memoryview(content.as_buffer()) if content.is_valid else b"", with_payload):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if len(rows) == 256 or size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in types], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in types], names=names)

    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return archives.select("content").mapInArrow(run, ", ".join(f"{n} {sql[t]}" for n, t in types))


RECORD = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), *((n, pa.string()) for n in ("record_id", "date", "content_type", "declared_digest")), ("payload", pa.binary())]


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of the .warc.gz files under a path, through Spark's own file source, a file a row: files of up to 2 GB, as archives of the usual 1 GB are."""
    return read_warc(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path))


def store_and_read(pages: DataFrame) -> DataFrame:
    """Writes pages as archives into the shared folder and reads their records back, without payloads."""
    return read_warc(materialise(write_archives(pages), "warc"), with_payload=False).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
