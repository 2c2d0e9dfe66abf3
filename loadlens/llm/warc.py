"""WARC archives: a writer with revisit records, and a splittable reader.

The writer gives every record a gzip member of its own. Payloads are compared by SHA-1 with
one aggregation; where payloads are equal the record with the smallest id holds it and the
others refer to it. Each task writes the files of its own rows to the target folder through
``pyarrow.fs`` and reports them; a file whose task was lost is not in the returned manifest.

The reader cuts files into byte ranges. A task looks for the gzip magic in its range, takes a
candidate for a member if its first bytes decode to a WARC header, then follows the members;
it owns the records whose member starts inside the range and reads past the end to finish the
last one. Where a member has to begin, at the start of a file or after another, and none can be
read, a row of type ``damaged`` says so; ``missing`` compares what was read with a manifest.
Records of any type are read: those without an HTTP message have their block as payload, chunked
bodies are put together, and a digest that is stated is compared with the payload. Other occurrences of the magic are compressed data and are passed over. (A stored,
uncompressed member that itself holds a gzipped WARC could still mislead a range that starts
inside it; text payloads cannot hold the magic, whose second byte is not valid UTF-8.)

Cases: a null html counts as empty; empty payloads are equal to each other. A null url gives
no target field; a null id is written as empty, revisits the group's smallest id, and is a
response if the group has no other. Repeated rows with the smallest id are responses each.
Empty tables give no archive. Ids are written as text and must not hold white space or ``>``.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loadlens.llm.workers import map_rows, ship
from loadlens.session import write_and_read

ship(__name__)

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, uri: str | None, payload: bytes, refers_to: str | None,
                 date: str) -> bytes:
    """A response record with its payload, or a revisit record without."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if refers_to is None else b"")
    lines = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{URN}{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(
            c if c > " " else f"%{ord(c):02X}" for c in uri))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
              "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_first_holder(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Adds ``refers_to``: the smallest id with the same payload, null for that one itself.

    Only digests that occur more than once are joined back, so the pages are not shuffled
    for a small number of repeats; a large one takes a shuffled join that splits hot digests.
    """
    digest = F.sha1(F.coalesce(F.col(html_col), F.lit("")).cast("binary"))
    repeats = pages.select(digest.alias("_sha"), F.col(id_col).alias("_id")).groupBy("_sha").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    repeats = write_and_read(repeats, "warc-repeats")
    same = F.col(id_col).eqNullSafe(F.col("_first"))
    return pages.withColumn("_sha", digest).join(repeats, "_sha", "left").withColumn(
        "refers_to", F.when(~same, F.col("_first"))).drop("_sha", "_first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", date: str = "1970-01-01T00:00:00Z", level: int = 4,
                   file_bytes: int = 512 << 20) -> DataFrame:
    """Write one record per row; returns the manifest (path, n_bytes, n_records), written."""
    own = with_first_holder(pages.select(id_col, url_col, html_col), id_col, html_col).select(
        F.col(id_col).cast("string").alias("i"), F.col(url_col).alias("u"),
        F.col(html_col).alias("h"), F.col("refers_to").cast("string").alias("r"))

    def rows(batches: Iterator[dict]):
        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, size, count, made = None, 0, 0, 0
        for b in batches:
            for i, u, h, r in zip(b["i"], b["u"], b["h"], b["r"]):
                if out is None:
                    name = (f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
                            f"-{made:04d}.warc.gz")
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                    size, count, made = 0, 0, made + 1
                payload = (h or "").encode("utf-8", "replace")
                data = member(record_bytes(i or "", u, payload, r, date), level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield f"{folder}/{name}", size, count
        if out is not None:
            out.close()
            yield f"{folder}/{name}", size, count

    return write_and_read(map_rows(own, "path string, n_bytes bigint, n_records bigint", rows,
                                   flush=64), "warc-manifest")


class Range:
    """Members of one file that start in [start, end)."""

    def __init__(self, f, start: int, end: int):
        self.f, self.start, self.end = f, start, end
        f.seek(start)
        self.data = bytearray(f.read(end - start + len(MAGIC) - 1))

    def more(self, n: int = 1 << 20) -> bool:
        chunk = self.f.read(n)
        self.data += chunk
        return bool(chunk)

    def inflate(self, at: int, limit: int | None = None) -> tuple[bytes, int] | None:
        """The member at ``at`` and the place after it; with ``limit`` its first bytes only."""
        z, parts, have = zlib.decompressobj(31), [], 0
        # Steps are the same from every range, so that all ranges judge a head alike.
        step = 64 if limit is not None else 1 << 15
        while not z.eof:
            while len(self.data) < at + step and self.more():
                pass
            chunk = bytes(self.data[at:at + step])
            if not chunk:
                return None
            at += len(chunk)
            try:
                parts.append(z.decompress(chunk))
            except zlib.error:
                return None
            have += len(parts[-1])
            if limit is not None and have >= limit:
                break
        return b"".join(parts), at - len(z.unused_data)

    def records(self) -> Iterator[tuple[int, bytes | None]]:
        """(offset, record) per member; None where one has to begin and cannot be read."""
        at, due = 0, self.start == 0
        while True:
            if not due:
                at = self.data.find(MAGIC, at)
            outside = at < 0 or at >= self.end - self.start
            if outside and not due or at >= len(self.data) and not self.more():
                return
            head = self.inflate(at, len(VERSION))
            good = head is not None and head[0].startswith(b"WARC/1.")
            whole = self.inflate(at) if good and not outside else None
            if outside or whole is None:
                if due and not good or good and not outside:
                    yield self.start + at, None
                if outside:
                    return
                at, due = at + 1, False
                continue
            yield self.start + at, whole[0]
            at, due = whole[1], True

    def members(self) -> Iterator[bytes]:
        return (record for _, record in self.records() if record is not None)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    return fields, rest[:int(size)] if size.isdigit() else rest


ROW = ("record_id string, uri string, record_type string, refers_to string, payload_bytes bigint, "
       "payload_digest string, payload binary, intact boolean, path string, at bigint")


def read_archives(manifest: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """One row per record of the files of ``manifest`` (path, n_bytes): record_id, uri,
    record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits), intact,
    path and at (its first byte in the file).

    ``intact`` is whether the payload has the SHA-1 that its record states, null where it states
    none or holds no payload. A payload's digest is the stated one, or else computed.
    """
    cut = F.sequence(F.lit(0).cast("bigint"), F.col("n_bytes") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = manifest.filter("n_bytes > 0").select("path", "n_bytes", F.explode(cut).alias("a"))
    ranges = ranges.select("path", "a", F.least(F.col("a") + range_bytes, "n_bytes").alias("z"))
    tasks = max(1, ranges.count())
    wide = ranges.sparkSession.sparkContext.defaultParallelism
    ranges = ranges.repartition(min(tasks, max(4 * wide, tasks // 8)), "path", "a")

    def rows(batches: Iterator[dict]):
        for b in batches:
            for path, start, end in zip(b["path"], b["a"], b["z"]):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as f:
                    for at, record in Range(f, start, end).records():
                        found = DAMAGED if record is None else _row(*parse(record))
                        yield *found, path, at

    return map_rows(ranges, ROW, rows, flush=128)


def missing(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(path, n_records, n_read, n_damaged) of the files whose records are not all there."""
    read = records.groupBy("path").agg(
        F.count_if(F.col("record_type") != "damaged").alias("n_read"),
        F.count_if(F.col("record_type") == "damaged").alias("n_damaged"))
    none = F.lit(0).cast("bigint")
    return manifest.select("path", "n_records").join(read, "path", "left").select(
        "path", "n_records", F.coalesce("n_read", none).alias("n_read"),
        F.coalesce("n_damaged", none).alias("n_damaged")).filter(
        "n_read <> n_records or n_damaged > 0")


DAMAGED = (None, None, "damaged", None, None, None, None, False)


def unchunked(body: bytes) -> bytes | None:
    """The body of chunked pieces; None if they are not well formed."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip()
        if end < 0 or not size or not all(c in b"0123456789abcdefABCDEF" for c in size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(parts)
        piece = body[end + 2:end + 2 + n]
        if len(piece) < n:
            return None
        parts.append(piece)
        at = end + 2 + n + 2


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields.get("warc-type", "unknown").lower()
    body, headers = block, {}
    if block.startswith(b"HTTP/") or "application/http" in fields.get("content-type", "").lower():
        http, _, body = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower()] = value.strip()
    ways = [body]
    if headers.get(b"transfer-encoding", b"").lower() == b"chunked":
        whole = unchunked(body)
        ways = [body] if whole is None else [whole, body]  # some writers take the digest as sent
    stated = fields.get("warc-payload-digest", "")
    said = stated[5:].upper() if stated.lower().startswith("sha1:") else None
    held = kind != "revisit"
    payload = next((w for w in ways if said and digest_of(w) == said), ways[0])
    length = headers.get(b"content-length", b"")
    size = int(length) if not held and length.isdigit() else len(payload)
    return (_id(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind,
            _id(fields.get("warc-refers-to")), size, said or (digest_of(payload) if held else None),
            payload if held else None, digest_of(payload) == said if said and held else None)


def _id(urn: str | None) -> str | None:
    return urn.strip("<>").removeprefix(URN) or None if urn else None
