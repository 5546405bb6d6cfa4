"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Each record is a gzip member of its own, so that a reader can begin at any member. Tasks of the reader scan byte ranges of
the files for the gzip magic, take a place for a member only if it decodes to a record header, and own the records that
begin inside their range; the last one is read to its end wherever that is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, with_small

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range that one reader task scans, bytes that it reads at once, and bytes of a member that it inflates at once
#: (a header may not be longer).
SPLIT, READ, MOST_HELD = 16_000_000, 1 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID, REFERS_TO = "X-Page-Id", "X-Refers-To-Page-Id"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> bytes:
    """A url without white space and control characters, which would break the header."""
    raw = (url or "urn:none").encode("utf-8", "surrogatepass")
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m.group()[0], raw)


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record, not yet compressed. With refers_to it is a revisit: HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"{PAGE_ID}: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"{REFERS_TO}: {refers_to}"]
    head = "\r\n".join(lines).encode() + b"\r\nWARC-Target-URI: " + _uri(url)
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, level: int = 4) -> list[str]:
    """Writes a record for each page to gzip archives in the folder `path` (a uri of a shared file system that pyarrow
    reads); returns the files. Of pages with equal payloads of at least least_bytes bytes, the one with the smallest id
    is a response and the others revisits of it; rows that repeat its id as well are responses too.

    Null payload: empty. Null url: urn:none. Null id: no id header; never the one that others refer to, unless all are.
    Empty table: no records. Further columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 500)
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("_id"), F.col(url).cast("string").alias("_url"), raw.alias("_raw"))
    digest = F.when(F.octet_length("_raw") >= least_bytes, F.sha1("_raw"))
    many = rows.select("_id", digest.alias("_sha")).filter("_sha is not null").groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    many = many.filter("_n > 1 and _first is not null").drop("_n")
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first"))
    rows = with_small(rows.withColumn("_sha", digest), many, "_sha", "left").select("_id", "_url", "_raw", refers.alias("_refers"))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        t = TaskContext.get()
        store, folder = _fs(path)
        name = f"part-{t.partitionId():05d}.warc.gz"
        trial = f"{folder}/.{name}.{t.taskAttemptId()}"
        n = 0
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(trial) as out:
            for b in batches:
                for i, u, raw, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    out.write(member(record(i, u, raw, refers_to), level))
                    n += 1
        # a task that runs twice writes the same records again; the last to end replaces the file as a whole
        store.move(trial, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name if n else None], pa.string())], names=["file"])

    done = rows.mapInArrow(write, "file string").filter("file is not null").collect()  # as many rows as files
    return [f"{path}/{name}" for name in sorted({r["file"] for r in done})]


# ---- reading ----------------------------------------------------------------------------------------------------------


class _Range:
    """Bytes of an open file by their place, read in blocks."""

    def __init__(self, file, block: int) -> None:
        self.file, self.block, self.at, self.data = file, max(block, len(MAGIC)), 0, b""

    def _hold(self, start: int, least: int) -> int:
        """Holds `least` bytes from start on, or all up to the file's end; returns their place in data."""
        if not self.at <= start or start + least > self.at + len(self.data):
            self.file.seek(start)
            parts, size = [], 0
            while size < max(least, self.block) and (part := self.file.read(max(least, self.block) - size)):
                parts.append(part)
                size += len(part)
            self.at, self.data = start, b"".join(parts)
        return start - self.at

    def get(self, start: int, most: int) -> memoryview:
        """Up to `most` bytes from start on (none at the file's end), not copied."""
        i = self._hold(start, 1)
        return memoryview(self.data)[i : i + most]

    def find(self, start: int, end: int) -> int | None:
        """The first place in [start, end) at which MAGIC stands, whole, though it may reach beyond the end or a block."""
        while start < end:
            i = self._hold(start, len(MAGIC))
            hit = self.data.find(MAGIC, i)
            if hit >= 0:
                return self.at + hit if self.at + hit < end else None
            if len(self.data) - i < len(MAGIC):
                return None  # the file ends
            start = self.at + len(self.data) - len(MAGIC) + 1
        return None


class _Member:
    """A gzip member as a stream: some MB are inflated at a time."""

    def __init__(self, r: _Range, start: int) -> None:
        self.r, self.at, self.inflate, self.held = r, start, zlib.decompressobj(31), b""

    def fill(self, n: int) -> bool:
        """Whether n bytes are held, after inflating more if need be. Bad or cut data raise an error."""
        parts, size = [self.held], len(self.held)
        while size < n and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self.r.get(self.at, 65_536)
                if not len(raw):
                    raise zlib.error("the file ends within a member")
                self.at += len(raw)
            parts.append(self.inflate.decompress(raw, MOST_HELD))
            size += len(parts[-1])
        self.held = b"".join(parts)
        return len(self.held) >= n

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is passed; None if it does not come within MOST_HELD bytes."""
        n = 4096
        while (at := self.held.find(mark)) < 0:
            if not self.fill(n) or n > MOST_HELD:
                at = self.held.find(mark)
                break
            n *= 2
        if at < 0:
            return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, some at least unless the member ends."""
        self.fill(min(n, 65_536))
        out, self.held = self.held[:n], self.held[n:]
        return out

    def end(self) -> int:
        """The place behind the member; the rest of it is inflated and checked first."""
        while self.take(MOST_HELD):
            pass
        return self.at - len(self.inflate.unused_data)


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _records(m: _Member, payloads: bool):
    """(headers, HTTP headers, payload length, its SHA-1, payload or None) of the records of a member. Nothing of a payload
    is held unless payloads are wanted."""
    while m.fill(5) and m.held.startswith(b"WARC/"):
        head = m.upto(b"\r\n\r\n")
        if head is None:
            raise zlib.error("a record without an end of its header")
        headers = _headers(head)
        left, http = int(headers.get("content-length") or 0), {}
        digest, kept, size = hashlib.sha1(), [], 0
        if headers.get("content-type", "").startswith("application/http"):
            m.fill(min(left, MOST_HELD))
            at = m.held.find(b"\r\n\r\n", 0, left)
            top = m.held[: at if at >= 0 else left]
            m.held = m.held[at + 4 if at >= 0 else len(top) :]
            left -= len(top) + (4 if at >= 0 else 0)
            http = _headers(top)
        while left > 0 and (part := m.take(left)):
            left -= len(part)
            size += len(part)
            digest.update(part)
            if payloads:
                kept.append(part)
        if left > 0:
            raise zlib.error("a member that ends within a record")
        yield headers, http, size, base64.b32encode(digest.digest()).decode(), b"".join(kept) if payloads else None
        while m.fill(2) and m.held.startswith(b"\r\n"):
            m.held = m.held[2:]


def members(file, start: int, end: int, payloads: bool = True, block: int = READ):
    """(place, records) of the members that begin in [start, end). A place counts if a record header decodes there and
    the member is sound to its end; damaged and cut members are passed over."""
    r, at = _Range(file, block), start
    while (at := r.find(at, end)) is not None:
        m = _Member(r, at)
        try:
            found = list(_records(m, payloads))
            after = m.end() if found else at + 1
        except (zlib.error, ValueError):
            found, after = [], at + 1
        if found:
            yield at, found
        at = after


RECORD = "file string, offset long, record_type string, headers map<string,string>, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, files: list[str], split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """A row for each record of gzip archives: file, offset of its member, type, headers (lower-case names), payload and
    its length and SHA-1 in base 32. A revisit has no payload; its length and digest are those its headers state. Of a
    response both are computed. Without payloads that column is null, and a payload is never held as a whole.

    No files or empty files: no rows. A file that is listed twice gives its records twice. Members that are damaged, cut
    or no WARC records are passed over. A record without a header that a column needs has null there."""
    spark_rows = []
    for f in files:
        store, at = _fs(f)
        size = store.get_file_info(at).size
        spark_rows += [(f, s, min(s + split, size)) for s in range(0, size, split)]
    if not spark_rows:
        return spark.createDataFrame([], RECORD)
    ranges = spark.createDataFrame(spark_rows, "file string, start long, end long").repartition(len(spark_rows))

    def read(batches):
        import pyarrow as pa

        schema = pa.schema(
            [("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        rows, held = [], 0
        for b in batches:
            for f, start, end in zip(*(c.to_pylist() for c in b.columns)):
                store, place = _fs(f)
                with store.open_input_file(place) as file:
                    for offset, found in members(file, start, end, payloads):
                        for headers, http, size, digest, payload in found:
                            kind = headers.get("warc-type")
                            if kind == "revisit":
                                size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
                                digest, payload = headers.get("warc-payload-digest", "").rpartition(":")[2] or None, None
                            elif payloads:
                                held += size
                            rows.append((f, offset, kind, list(headers.items()), size, digest, payload))
                        if len(rows) >= 2000 or held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return ranges.mapInArrow(read, RECORD)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records that write_archives() wrote."""
    header = lambda name: F.col("headers")[name.lower()].cast("long")
    return records.select(header(PAGE_ID).alias("page_id"), "payload_bytes", "payload_digest", "record_type", header(REFERS_TO).alias("refers_to"))


def through_archives(pages: DataFrame, **options) -> DataFrame:
    """page_records() of archives that are written for pages in the shared folder and read back."""
    spark = pages.sparkSession
    return page_records(read_archives(spark, write_archives(pages, new_path(spark, "warc"), **options), payloads=False))
