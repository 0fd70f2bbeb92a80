"""Deterministic sharded WARC writer, and its reader.

Records are range-sorted by id over shards whose bounds depend on the keys alone. Each record
is a gzip member of its own, a file is rolled when its compressed size reaches a limit, every
header and digest is made anew from the payload, and files get their names by renaming.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.staging import ready_for_python, new_folder, open_folder, publish, range_bounds, range_shard, shards_for, written

#: Payload bytes of a shard and compressed bytes of a file.
SHARD_BYTES, FILE_BYTES = 64 << 20, 32 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
# Names of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(data: bytes) -> str:
    """Upper-case base32 of the SHA-1 digest."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    """The same for the same row in every run; ``copy`` tells repeated rows apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url or '', digest, copy)))}>"


def _one_line(text: str | None) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, copy: int = 0, revisited: tuple[int | None, str] | None = None) -> bytes:
    """One WARC record, uncompressed. A revisit, of the page and url given, has HTTP headers but no payload."""
    revisit = revisited is not None
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest, copy)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_one_line(url)}", "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{digest32(block)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(*revisited, digest)}"]
        if revisited[0] is not None:
            lines.append(f"Refers-To-Page-Id: {revisited[0]}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Result row of one record; raises if a length or digest does not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (size != len(payload) or digest != digest32(payload)):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("Page-Id"), size, digest, kind, number("Refers-To-Page-Id")


class _Roller:
    """Writes the files of one shard, each under a temporary name until it is complete."""

    def __init__(self, folder: str, shard: int, limit: int) -> None:
        self.files, self.place = open_folder(folder)
        self.shard, self.limit, self.number, self.done = shard, limit, 0, []
        self.out = None

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.place}/.{self.name}.{os.urandom(8).hex()}.tmp"
            self.out, self.size, self.rows, self.crc = self.files.open_output_stream(self.temporary), 0, 0, 0
        data = gzip.compress(raw, LEVEL, mtime=0)
        self.out.write(data)
        self.size, self.rows, self.crc = self.size + len(data), self.rows + 1, zlib.crc32(data, self.crc)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            publish(self.files, self.temporary, f"{self.place}/{self.name}")
            self.done.append({"path": self.name, "records": self.rows, "bytes": self.size, "crc32": self.crc})
            self.out, self.number = None, self.number + 1


def write_warc(
    pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES
) -> None:
    """Writes ``pages`` (``page_id, url, html``) as WARC files and, last, their manifest.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest
    page id is a response and the others are revisits of it; with equal ids, the first in order
    of url. A null id sorts first and counts as larger than all others; null html is an empty
    payload; repeated rows become records of their own; an empty table gives a manifest without
    files. Other columns are ignored. Payloads are compared by SHA-1 and length, and only
    digests are grouped: a payload that many pages share leaves each task as one row.
    """
    spark = pages.sparkSession
    ready_for_python(spark)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.sha1(payload).alias("sha1"), payload.alias("payload"),
    )
    keys = written(rows.select("page_id", "url", "sha1", F.octet_length("payload").cast("long").alias("size")), "warc-keys")
    shards = shards_for(keys.agg(F.sum("size")).first()[0] or 0, shard_bytes)
    bounds = range_bounds(keys, "page_id", shards)
    large = keys.where(F.col("size") >= least_bytes)
    groups = large.groupBy("sha1", "size").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count("*").alias("n"))
    marks = large.join(groups.where("n > 1"), ["sha1", "size"]).select("page_id", "url", "sha1", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")).distinct()
    # A mark sorts just before the rows it belongs to, so that payloads are shuffled once only.
    nothing = F.lit(None)
    marked = rows.withColumns({"mark": F.lit(1), "first_id": nothing.cast("long"), "first_url": nothing.cast("string")}).unionByName(
        marks.withColumns({"mark": F.lit(0), "payload": nothing.cast("binary")})
    ).select(range_shard("page_id", bounds).alias("shard"), "page_id", "url", "sha1", "mark", "payload", "first_id", "first_url")
    files, place = open_folder(folder)
    files.create_dir(place, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, now, first, copy, done = None, None, None, 0, []
        for batch in batches:
            for shard, page_id, url, sha1, mark, payload, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (page_id, url, sha1):
                    now, first, copy = (page_id, url, sha1), None, 0
                if mark == 0:
                    first = first_id, first_url
                    continue
                if roller is None or roller.shard != shard:
                    if roller:
                        roller.close()
                        done += roller.done
                    roller = _Roller(folder, shard, file_bytes)
                response = first is None or copy == 0 and first == (page_id, url)
                roller.add(record(page_id, url, payload, copy, None if response else first))
                copy += 1
        if roller:
            roller.close()
            done += roller.done
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64())]))

    dealt = marked.repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "url", "sha1", "mark")
    found = sorted(dealt.mapInArrow(write, "path string, records long, bytes long, crc32 long").collect())
    temporary = f"{place}/.manifest.{os.urandom(8).hex()}.tmp"
    with files.open_output_stream(temporary) as out:
        out.write(json.dumps([r.asDict() for r in found]).encode())
    files.move(temporary, f"{place}/manifest.json")


def read_warc(spark, folder: str) -> DataFrame:
    """A row per record of the files in the manifest: payload length and digest, type and reference."""
    ready_for_python(spark)
    files, place = open_folder(folder)
    manifest = json.loads(files.open_input_file(f"{place}/manifest.json").read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                disk, at = open_folder(folder)
                rows = []
                with disk.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    decoder, raw, data = zlib.decompressobj(31), [], stream.read(1 << 20)
                    while data:
                        raw.append(decoder.decompress(data))
                        data = decoder.unused_data if decoder.eof else b""
                        if decoder.eof:
                            rows.append(_parsed(b"".join(raw)))
                            decoder, raw = zlib.decompressobj(31), []
                        if len(rows) >= 2000:
                            yield _as_batch(rows)
                            rows = []
                        data = data or stream.read(1 << 20)
                    if raw:
                        raise ValueError(f"{name} ends within a record")
                yield _as_batch(rows)

    names = [(e["path"],) for e in manifest]
    return spark.createDataFrame(names, "path string").repartition(max(1, len(names))).mapInArrow(read, RECORD)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], schema=pa.schema(kinds))


def archived_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder and reads every record back from them."""
    folder = new_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, least_bytes)
    return read_warc(pages.sparkSession, folder)
