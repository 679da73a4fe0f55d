"""WARC archives: one gzip member for each record, written by tasks and read back as a stream.

The writer is a pass over partitions that puts each archive into a folder which all executors reach. The reader
decompresses incrementally, frames records by Content-Length and verifies every digest that a record states. It takes
archives of any writer: every type of record, any form of id, and records without digests or HTTP headers.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged, table

CHUNK = 1 << 18
#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 64 << 20
LEVEL = 4
ID = "urn:page:"
RECORD = "record_id string, page_id long, url string, record_type string, date string, refers_to_id string, refers_to long, block_bytes long, payload_bytes long, payload_digest string, digest_ok boolean"
#: Most bytes of a record's header, and of compressed bytes for a task that reads several archives.
HEADER_BYTES, TASK_BYTES = 1 << 20, 512 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header(first: str, fields: dict[str, object]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields.items() if v is not None), "", ""]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit of `refers_to`: HTTP headers, and the payload unless it is a revisit."""
    block = header("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)})
    revisit = refers_to is not None
    block += b"" if revisit else payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{ID}{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "")),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": f"<{ID}{refers_to}>" if revisit else None,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(header("WARC/1.1", fields) + block + b"\r\n\r\n") + pack.flush()


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """file:, hdfs:, s3:, gs: and others that pyarrow opens."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Archives:
    """Archives of one task. The attempt is in every name: rows reach a task in no fixed order, so a second attempt cuts its archives
    elsewhere and must not overwrite the first one's. Readers use the paths of the attempt that was committed; what another
    attempt left stays unread. An archive gets its name when it is whole."""

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = opened(folder)
        task = TaskContext.get()
        self.part, self.attempt = task.partitionId(), task.taskAttemptId()
        self.n, self.out, self.size, self.done = 0, None, 0, []

    def put(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.folder}/part-{self.part:06d}-{self.n:04d}-{self.attempt}.warc.gz"
            self.out, self.size = self.fs.open_output_stream(f"{self.name}.part", compression=None), 0
        self.out.write(data)
        self.size += len(data)
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.name}.part", self.name)
            self.done.append((self.name.rsplit("/", 1)[1], self.size))
            self.n, self.out = self.n + 1, None


def write_warc(pages: DataFrame, folder: str, date: datetime | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder; return their paths and bytes, a row for each archive.

    A null html is an empty payload and a null url is left out. Of equal payloads that with the largest page_id is
    a response and the others revisit it; rows with the same page_id as the response are responses too; a null
    page_id is written as an empty one and counts as the smallest. Other columns are ignored. An empty table gives
    no archive. A task that runs again writes archives under other names; only those of the committed attempt are returned.
    """
    when = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"))
    # all empty pages have one sha; rows are counted before they move, and the join is one whose large keys AQE splits
    groups = rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("last")), F.lit(None)).otherwise(F.col("last"))
    rows = rows.join(groups, "sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives = Archives(folder)
        archives.fs.create_dir(archives.folder, recursive=True)
        whole = lambda x: None if pd.isna(x) else int(x)
        for batch in batches:
            for page_id, url, html, to in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"], batch["refers_to"].astype("Int64"), strict=True):
                archives.put(record(whole(page_id), url, (html or "").encode(), whole(to), when))
        archives.close()
        yield pd.DataFrame([(f"{folder}/{name}", size) for name, size in archives.done], columns=["path", "bytes"]).astype({"path": str, "bytes": "int64"})

    strings = rows.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))  # longs with nulls would become floats
    return staged(strings.mapInPandas(write, "path string, bytes long"), "archives")


class Inflated:
    """The bytes of a gzip stream, member after member, of which at most CHUNK are inflated ahead."""

    def __init__(self, stream) -> None:
        self.stream, self.packed, self.ready = stream, b"", b""
        self.unpack = zlib.decompressobj(31)
        self.begun = False  # within a member

    def more(self) -> bool:
        """Inflate up to CHUNK bytes more; False at the end of the stream."""
        while True:
            if not self.packed:
                self.packed = self.stream.read(CHUNK)
                if not self.packed:
                    if self.begun:
                        raise EOFError("the archive ends within a member")
                    return False
            self.begun = True
            out = self.unpack.decompress(self.packed, CHUNK)
            self.packed = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.packed = self.unpack.unused_data
                self.unpack, self.begun = zlib.decompressobj(31), False
            if out:
                self.ready += out
                return True

    def upto(self, mark: bytes, most: int) -> bytes | None:
        """What comes before mark, which is skipped; None at the end of the stream."""
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > most:
                raise ValueError(f"no end of a header in {most} bytes")
            if not self.more():
                if self.ready.strip():
                    raise EOFError("the archive ends within a header")
                return None
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.ready and not self.more():
                raise EOFError("the archive ends within a record")
            out, self.ready = self.ready[:n], self.ready[n:]
            n -= len(out)
            yield out


def parse_header(data: bytes) -> tuple[str, dict[str, str]]:
    """First line, and fields by lower-case name; a line that starts with a blank goes on with the one before."""
    first, *lines = data.decode("utf-8", "replace").lstrip("\r\n").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Sums:
    """Running digests of bytes by the algorithms that are asked for."""

    def __init__(self, *stated: str | None) -> None:
        names = {"sha1", *(x.partition(":")[0].lower() for x in stated if x)}
        self.sums = {n: hashlib.new(n) for n in names if n in hashlib.algorithms_available and not n.startswith("shake")}
        self.size = 0

    def update(self, data: bytes) -> None:
        self.size += len(data)
        for x in self.sums.values():
            x.update(data)

    def base32(self, name: str = "sha1") -> str:
        return base64.b32encode(self.sums[name].digest()).decode()

    def agrees(self, stated: str | None) -> bool | None:
        """Whether a stated `algorithm:value`, in base 32 or hex, holds; None if none is stated or the algorithm isn't known."""
        name, _, value = (stated or "").partition(":")
        if name.lower() not in self.sums or not value:
            return None
        own = self.sums[name.lower()]
        return value.lower() == own.hexdigest() or value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def number(record_id: str | None) -> int | None:
    """The page_id of an id of our writer; None for any other."""
    tail = (record_id or "").strip("<>").removeprefix(ID)
    return int(tail) if (record_id or "").strip("<>").startswith(ID) and tail.lstrip("-").isdigit() else None


def read_record(stream: Inflated, with_payload: bool) -> dict[str, object] | None:
    """The next record, framed by its Content-Length; None at the end. The payload is held only if it is asked for.

    digest_ok says whether all digests that it states hold, and is null if it states none that can be verified. The payload is
    what follows the HTTP headers of an HTTP record, else the whole block; payload_bytes is the HTTP Content-Length of a
    revisit, whose payload isn't there, and payload_digest the one it states (without algorithm) or else that of the bytes.
    """
    head = stream.upto(b"\r\n\r\n", HEADER_BYTES)
    if head is None:
        return None
    version, fields = parse_header(head)
    if not version.startswith("WARC/") or not fields.get("content-length", "").isdigit():
        raise ValueError(f"not the header of a record: {version[:80]}")
    size = int(fields["content-length"])
    said = fields.get("warc-payload-digest")
    block, payload, kept = Sums(fields.get("warc-block-digest")), Sums(said), []
    http: dict[str, str] | None = None
    waiting: bytes | None = b"" if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http") else None
    for piece in stream.take(size):
        block.update(piece)
        if waiting is not None:  # still within the HTTP headers
            waiting += piece
            at = waiting.find(b"\r\n\r\n")
            if at < 0 and len(waiting) < min(HEADER_BYTES, size):
                continue
            if at >= 0:
                http, piece = parse_header(waiting[:at])[1], waiting[at + 4 :]
            else:
                piece = waiting
            waiting = None
        payload.update(piece)
        if with_payload:
            kept.append(piece)
    if waiting:
        payload.update(waiting)
        kept.append(waiting)
    kind = fields.get("warc-type")
    if b"".join(stream.take(4)) != b"\r\n\r\n":
        raise ValueError(f"a record isn't framed by its Content-Length: {fields.get('warc-record-id')}")
    revisit, stated_length = kind == "revisit", (http or {}).get("content-length", "")
    checks = [block.agrees(fields.get("warc-block-digest"))]
    if not (revisit and not payload.size):
        checks += [payload.agrees(said)]
        checks += [int(stated_length) == payload.size] if stated_length.isdigit() and kind == "response" and "content-encoding" not in http and "transfer-encoding" not in http else []
    checks = [x for x in checks if x is not None]
    length = int(stated_length) if revisit and stated_length.isdigit() else payload.size
    uri, refers = fields.get("warc-target-uri"), fields.get("warc-refers-to")
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>") or None, "page_id": number(fields.get("warc-record-id")), "url": None if uri is None else urllib.parse.unquote(uri.strip("<>")), "record_type": kind,
        "date": fields.get("warc-date"), "refers_to_id": refers and refers.strip("<>"), "refers_to": number(refers), "block_bytes": size, "payload_bytes": length,
        "payload_digest": said.partition(":")[2] if said else payload.base32(), "digest_ok": all(checks) if checks else None, "payload": None if revisit else b"".join(kept),
    }


def read_warc(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """paths (path, bytes) -> a row for each record, with `payload` as binary if asked for.

    A task inflates a piece of a record at a time, and holds a payload only if it is asked for. A record that isn't framed
    as it says stops the job; one whose digests don't hold has digest_ok false, one that states none has null. No path
    gives an empty result; a null path stops the job.
    """
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for path in batch["path"]:
                fs, name = opened(path)
                with fs.open_input_stream(name, compression=None) as file:
                    stream = Inflated(file)
                    while (found := read_record(stream, with_payload)) is not None:
                        rows.append(found)
                        size += 1000 + len(found["payload"] or b"")
                        if size > 8 << 20:
                            yield frame(rows)
                            rows, size = [], 0
        if rows:
            yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "block_bytes": "int64", "payload_bytes": "int64", "digest_ok": "boolean"})

    n, size = paths.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, 4 * paths.sparkSession.sparkContext.defaultParallelism), -(-size // TASK_BYTES))
    return paths.select("path").repartition(min(tasks, max(1, n))).mapInPandas(read, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    found = read_warc(paths)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to, true AS digest_ok FROM m
"""
