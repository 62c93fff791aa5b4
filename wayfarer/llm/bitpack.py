"""Token-id files with fixed-width bit packing.

Each id takes the least bits that hold any id of the vocabulary. A shard holds, in this order,
blocks of BLOCK ids, the tables, and a trailer that tells where the tables begin:

    payload   id k of a block in bits [k * width, (k + 1) * width), least bit first
    tables    byte offset of each block (and of the end), crc32 of each block,
              number of ids before each document (and of all), doc_ids, which of them are null
    trailer   magic, width, ids in a block, numbers of documents, ids and blocks, offset of the tables

Any range of ids is read by fetching only the blocks that hold it; unpacking works on whole numpy
columns. Ids that don't fit the width are refused.

Null doc_ids come first, with null kept; null texts count as empty (the end id alone); repeated
doc_ids, null ones too, are each written, in order of a hash of their texts, and may take several shards. An empty table gives no shard and no row.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, new_folder, open_store, to_batch, written
from .tokens import encoder

BLOCK = 8192
MAGIC = b"WFPACK01"
TRAILER = struct.Struct("<8sIIQQQQ")
_READ_IDS = 1 << 20


def width_of(vocabulary: int) -> int:
    """Least number of bits for ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids to width bits each; the last byte is filled with zero bits."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and width < 32 and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} does not fit {width} bits")
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first n ids of packed data. Eight ids fill width bytes, so each of the eight is a fixed mix of byte columns."""
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    groups = -(-n // 8)
    cells = np.zeros((groups, width + 4), np.uint64)
    raw = np.zeros(groups * width, np.uint8)
    raw[: min(len(data), len(raw))] = np.frombuffer(data, np.uint8)[: len(raw)]
    cells[:, :width] = raw.reshape(groups, width)
    out = np.empty((groups, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        word = sum(cells[:, byte + k] << np.uint64(8 * k) for k in range(5))
        out[:, j] = (word >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


class ShardWriter:
    """Writes one shard; holds a block of ids and the documents' table in memory."""

    def __init__(self, sink, vocabulary: int):
        self.sink, self.width = sink, width_of(vocabulary)
        self.held, self.held_n = [], 0
        self.starts, self.doc_ids, self.offsets, self.crcs = [0], [], [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= BLOCK:
            self._flush(self.held_n // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held)
        for at in range(0, n, BLOCK):
            data = pack(ids[at : min(at + BLOCK, n)], self.width)
            self.sink.write(data)
            self.crcs.append(zlib.crc32(data))
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.held_n = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.held_n:
            self._flush(self.held_n)
        nulls = np.array([d is None for d in self.doc_ids], np.uint8)
        for table in (np.array(self.offsets, "<i8"), np.array(self.crcs, "<u4"), np.array(self.starts, "<i8"), np.array([d or 0 for d in self.doc_ids], "<i8"), nulls):
            self.sink.write(table.tobytes())
        self.sink.write(TRAILER.pack(MAGIC, self.width, BLOCK, len(self.doc_ids), self.starts[-1], len(self.crcs), self.offsets[-1]))


class ShardReader:
    """Random access to a shard: ids(a, b) and document(i) fetch only the blocks they need."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.width, self.block, n_docs, self.n_ids, n_blocks, tables = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a packed shard")
        raw, at = source.read_at(size - TRAILER.size - tables, tables), 0

        def table(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            return found

        self.offsets, self.crcs, self.starts = table("<i8", n_blocks + 1), table("<u4", n_blocks), table("<i8", n_docs + 1)
        ids, nulls = table("<i8", n_docs), table("u1", n_docs)
        self.doc_ids = [None if null else int(i) for i, null in zip(ids, nulls)]

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.empty(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block + 1
        base = int(self.offsets[first])
        data = self.source.read_at(int(self.offsets[last]) - base, base)
        for k in range(first, last):
            if zlib.crc32(data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base]) != self.crcs[k]:
                raise ValueError(f"block {k} is damaged")
        n = min(last * self.block, self.n_ids) - first * self.block
        return unpack(data, self.width, n)[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the shard, ids), about _READ_IDS ids fetched at a time."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + _READ_IDS, "right")) - 1)
            base = int(self.starts[i])
            ids = self.ids(base, int(self.starts[j]))
            for k in range(i, j):
                yield self.doc_ids[k], int(self.starts[k]), ids[int(self.starts[k]) - base : int(self.starts[k + 1]) - base]
            i = j


def write_shards(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int | None = None, cuts: str = "word", folder: str | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write a shard for each range of doc_ids.

    Returns the manifest, already written: shard, path, n_docs, n_ids, start (ids in the shards
    before). Each attempt of a task writes a file of its own, and the manifest names those of the
    attempts that counted, so a lost executor or a second attempt does no harm.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    folder = folder or new_folder(spark, "ids")
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(tokenizer, cuts).encode_with_end, None
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        for batch in batches:
            if writer is None and batch.num_rows:
                store, path = open_store(uri)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(path)
                writer = ShardWriter(sink, vocabulary)
            ids, offsets = encode(batch.column(1), end_id)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                writer.add(doc_id, ids[a:b])
        if writer is not None:
            writer.close()
            sink.close()
            yield to_batch([(shard, uri, len(writer.doc_ids), writer.starts[-1])], schema)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = written(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "ids-manifest")
    # One row a shard: the window holds as many rows as there are files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the shards in a manifest: doc_id, start, n_tokens, ids_crc32, shard, place (in the shard)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64()), ("place", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as source:
                    rows = []
                    for place, (doc_id, start, ids) in enumerate(ShardReader(source).documents()):
                        rows.append((doc_id, row["start"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"], place))
                        if len(rows) == 20_000:
                            yield to_batch(rows, schema)
                            rows = []
                    if rows:
                        yield to_batch(rows, schema)

    shards = max(1, manifest.count())
    dealt = manifest.select("shard", "path", "start").repartitionByRange(shards, "shard")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, place long")


def read_documents(manifest: DataFrame, places: DataFrame) -> DataFrame:
    """Random access: ids of the documents named by places (shard, place), reading only their blocks.

    Returns shard, place, doc_id, ids array<long>. Places that no shard has give no row.
    """
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != at:
                    store, path = open_store(row["path"])
                    at, reader = row["path"], ShardReader(store.open_input_file(path))
                if 0 <= row["place"] < len(reader.doc_ids):
                    rows.append((row["shard"], row["place"], reader.doc_ids[row["place"]], reader.document(row["place"]).tolist()))
            if rows:
                yield to_batch(rows, schema)

    wanted = places.select("shard", "place").join(manifest.select("shard", "path"), "shard").sortWithinPartitions("shard", "place")
    return wanted.select("shard", "place", "path").mapInArrow(read, "shard long, place long, doc_id long, ids array<bigint>")
