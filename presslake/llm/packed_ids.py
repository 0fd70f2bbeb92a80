"""Token ids in files of fixed-width bit fields, with block offsets for random access.

A file holds the documents of one range of ``doc_id``:

* head, 16 bytes: magic, version (u16), bits of an id (u16), ids of a block (u32), 4 spare bytes;
* blocks: ``block_ids`` ids each (the last one fewer), id ``i`` of a block in bits
  ``i * bits`` to ``(i + 1) * bits - 1``, least significant bit first;
* index: block offsets (u64), document ids (i64), ids before each document (i64, one more than
  documents), one byte per document that is 1 if its id is null;
* tail, 40 bytes: offset of the index, blocks, documents, ids (i64 each), magic and 4 spare bytes.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.encoding import default_tokenizer, encoder
from presslake.llm.staging import ready_for_python, new_folder, open_folder, publish, range_bounds, range_shard, shards_for

MAGIC, VERSION = b"PKID", 1
BLOCK_IDS = 1 << 16
SHARD_BYTES = 32 << 20
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long, crc32 long"


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of ``bits`` bits."""
    wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return wide[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed ``data``."""
    raw = np.frombuffer(data, np.uint8)
    wide = np.zeros((count, 4), np.uint8)
    if bits % 8 == 0:
        wide[:, : bits // 8] = raw[: count * bits // 8].reshape(count, bits // 8)
    else:
        fields = np.unpackbits(raw, bitorder="little", count=count * bits).reshape(count, bits)
        wide[:, : -(-bits // 8)] = np.packbits(fields, axis=1, bitorder="little")
    return wide.view("<u4").ravel()


class PackedWriter:
    """Writes one file under a temporary name and gives it its own at the end."""

    def __init__(self, folder: str, name: str, bits: int, block_ids: int) -> None:
        self.files, self.folder = open_folder(folder)
        self.final, self.temporary = f"{self.folder}/{name}", f"{self.folder}/.{name}.{os.urandom(8).hex()}.tmp"
        self.out = self.files.open_output_stream(self.temporary)
        self.bits, self.block_ids, self.crc = bits, block_ids, 0
        self.waiting, self.n_waiting = [], 0
        self.offsets, self.docs, self.nulls, self.starts = [], [], [], [np.zeros(1, np.int64)]
        self.n_ids = self.written = 0
        self._put(struct.pack("<4sHHI4x", MAGIC, VERSION, bits, block_ids))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.written += len(data)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order, and their ids one after another."""
        self.docs.append(np.array([x or 0 for x in doc_ids], "<i8"))
        self.nulls.append(np.array([x is None for x in doc_ids], np.uint8))
        self.starts.append(self.n_ids + np.cumsum(counts, dtype=np.int64))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            self._blocks(self.n_waiting // self.block_ids * self.block_ids)

    def _blocks(self, count: int) -> None:
        ids = np.concatenate(self.waiting)
        for i in range(0, count, self.block_ids):
            self.offsets.append(self.written)
            self._put(pack(ids[i : min(i + self.block_ids, count)], self.bits))
        self.waiting, self.n_waiting = [ids[count:]], len(ids) - count

    def close(self) -> tuple[str, int, int, int, int]:
        """Path, documents, ids, bytes and crc32 of the finished file."""
        if self.n_waiting:
            self._blocks(self.n_waiting)
        at, docs = self.written, np.concatenate(self.docs)
        self._put(np.array(self.offsets, "<u8").tobytes())
        self._put(docs.tobytes())
        self._put(np.concatenate(self.starts).astype("<i8").tobytes())
        self._put(np.concatenate(self.nulls).tobytes())
        self._put(struct.pack("<qqqq4s4x", at, len(self.offsets), len(docs), self.n_ids, MAGIC))
        self.out.close()
        publish(self.files, self.temporary, self.final)
        return self.final.removeprefix(f"{self.folder}/"), len(docs), self.n_ids, self.written, self.crc


class PackedFile:
    """Random access to one file; reads its index, then only the blocks asked for."""

    def __init__(self, folder: str, name: str) -> None:
        files, path = open_folder(folder)
        self.file = files.open_input_file(f"{path}/{name}")
        magic, version, self.bits, self.block_ids = struct.unpack("<4sHHI4x", self.file.read_at(16, 0))
        size = self.file.size()
        at, blocks, docs, self.n_ids, end = struct.unpack("<qqqq4s4x", self.file.read_at(40, size - 40))
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError(f"{name} is no file of packed ids")
        index = self.file.read_at(size - 40 - at, at)
        self.offsets = np.frombuffer(index, "<u8", blocks)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.starts = np.frombuffer(index, "<i8", docs + 1, 8 * (blocks + docs))
        self.nulls = np.frombuffer(index, np.uint8, docs, 8 * (blocks + 2 * docs + 1))

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last - 1`` of the file."""
        low, high = first // self.block_ids, -(-last // self.block_ids)
        parts = [np.zeros(0, "<u4")]
        for block in range(low, high):
            count = min(self.block_ids, self.n_ids - block * self.block_ids)
            data = self.file.read_at(-(-count * self.bits // 8), int(self.offsets[block]))
            parts.append(unpack(data, self.bits, count))
        return np.concatenate(parts)[first - low * self.block_ids : last - low * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_packed(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0,
    block_ids: int = BLOCK_IDS, shard_bytes: int = SHARD_BYTES,
) -> list[dict]:
    """Encodes ``text``, appends ``end_id`` to each document and writes the ids in order of ``doc_id``.

    Rows with the same ``doc_id`` are kept as documents of their own, in order of their text;
    a null ``doc_id`` comes first; null and empty texts are documents of the end id alone; an
    empty table gives no file. Other columns are ignored. Every file is written under a
    temporary name and renamed; a repeated task writes the same bytes. The manifest, a row per
    file (20,000 at most), is written last: a folder without it is not complete.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    ready_for_python(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards_for(total, shard_bytes)
    bounds = range_bounds(docs, "doc_id", shards)
    files, place = open_folder(folder)
    files.create_dir(place, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, out, now, done = encoder(path), None, None, []
        for batch in batches:
            shard_of = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(shard_of)) + 1).tolist(), len(shard_of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if now != shard_of[a]:
                    if out:
                        done.append((now, *out.close()))
                    now = int(shard_of[a])
                    out = PackedWriter(folder, f"ids-{now:05d}.bin", bits_for(tokens.vocabulary), block_ids)
                for c in range(a, b, 500):
                    part = batch.slice(c, min(500, b - c))
                    ids, counts = tokens.encode(part.column(2).to_pylist())
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    out.add(part.column(1).to_pylist(), counts + 1, ids)
        if out:
            done.append((now, *out.close()))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("shard", "path", "n_docs", "n_ids", "n_bytes", "crc32"), x)) for x in done],
            pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("crc32", pa.int64())]),
        )

    dealt = docs.select(range_shard("doc_id", bounds).alias("shard"), "doc_id", "text")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "text")
    manifest = sorted((r.asDict() for r in dealt.mapInArrow(write, MANIFEST).collect()), key=lambda x: x["shard"])
    first = 0
    for entry in manifest:
        entry["first"] = first
        first += entry["n_ids"]
    temporary = f"{place}/.manifest.{os.urandom(8).hex()}.tmp"
    with files.open_output_stream(temporary) as out:
        out.write(json.dumps(manifest).encode())
    files.move(temporary, f"{place}/manifest.json")
    return manifest


def read_packed(spark, folder: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``; reads whole files block by block."""
    ready_for_python(spark)
    files, place = open_folder(folder)
    manifest = json.loads(files.open_input_file(f"{place}/manifest.json").read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                packed = PackedFile(folder, entry["path"])
                for low in range(0, len(packed.doc_ids), 512):
                    high = min(low + 512, len(packed.doc_ids))
                    starts = packed.starts[low : high + 1]
                    raw = memoryview(packed.ids(int(starts[0]), int(starts[-1])).tobytes())
                    cut = ((starts - starts[0]) * 4).tolist()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(packed.doc_ids[low:high], mask=packed.nulls[low:high].astype(bool)),
                        pa.array(entry["first"] + starts[:-1]), pa.array(np.diff(starts)),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])], pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(e["path"], e["first"]) for e in manifest]
    table = spark.createDataFrame(rows, "path string, first long").repartition(max(1, len(rows)))
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the packed files to the shared folder and reads every document back from them."""
    folder = new_folder(docs.sparkSession, "packed-ids")
    write_packed(docs, folder, tokenizer)
    return read_packed(docs.sparkSession, folder)
