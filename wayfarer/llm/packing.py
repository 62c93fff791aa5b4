"""Best-fit packing of documents into sequences of a fixed number of tokens, in a tree of rounds.

A document longer than the capacity is cut into pieces of the capacity; what is over is its first
piece. Whole pieces are sequences of their own. The others are packed best-fit, longest first, in
each partition. Bins that are nearly full are done; the others, as items of their whole fill, are
dealt to fewer partitions and packed best-fit again, until one partition holds what is left. Where
that would be more than a task should hold, bins are dealt anew from round to round until a round saves
none. Every other round saves a bin at least, so rounds come to an end.

Null texts count as empty: the end id alone. Null and repeated doc_ids are packed like others. An
empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, rows_per_batch, written
from .tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Pieces, or the pieces of bins, that one task packs at a time.
PER_TASK = 50_000
#: Shares of the partitions that go on from round to round.
FAN_IN = 8


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, with what is over in front."""
    if n <= capacity:
        return [(0, n)]
    over = n % capacity
    return [(0, over)] * bool(over) + [(s, capacity) for s in range(over, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, cuts: str = "byte") -> DataFrame:
    """Tokenise whole documents (doc_id, text) and cut them: a row for each piece."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cuts).encode_with_end
        for batch in batches:
            ids, offsets = encode(batch.column(1), end_id)
            raw = memoryview(ids.astype("<u4")).cast("B")
            rows = [(i, k, start, length, zlib.crc32(raw[4 * (a + start) : 4 * (a + start + length)])) for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())) for k, (start, length) in enumerate(cut(b - a, capacity))]
            if rows:
                i, *columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), *(pa.array(c, t.type) for c, t in zip(columns, [*_PIECE_ARROW][1:]))], schema=_PIECE_ARROW)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit in the order given: bin and offset of each item, room left in each bin.

    Bins stand in a list for each amount of room left; a bit of one integer tells which lists have
    any, so the tightest bin that an item fits is found in a few steps whatever their number.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    bins, offsets, room = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, size in enumerate(sizes.tolist()):
        fits = some >> size << size
        if fits:
            r = (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        left = room[b] = r - size
        by_room[left].append(b)
        some |= 1 << left
    return bins, offsets, room


def pack_round(items: DataFrame, capacity: int, number: int, nearly: int, parts: int) -> DataFrame:
    """One round over (PIECE, bin, at, fill): packs the bins of each partition into new ones.

    Adds done: the new bin has at most ``nearly`` tokens of room. All pieces of a bin are in one
    partition. Results depend on a partition's rows alone, not on their order.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        order = np.lexsort([table.column(c).to_numpy() if c != "doc_id" else table.column(c).fill_null(-1).to_numpy() for c in ("ids_crc32", "start", "doc_id", "at", "bin")])
        table = table.take(pa.array(order))
        old, at, fill = (table.column(c).to_numpy() for c in ("bin", "at", "fill"))
        heads = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        item = np.cumsum(np.r_[False, old[1:] != old[:-1]])
        by_size = np.argsort(-fill[heads], kind="stable")
        new, offset, room = best_fit(fill[heads][by_size], capacity)
        back = np.empty(len(heads), np.int64)
        back[by_size] = np.arange(len(heads))
        new, offset, room = new[back][item], offset[back][item], np.array(room, np.int64)
        name = (np.int64(number) << np.int64(48)) | (np.int64(TaskContext.get().partitionId()) << np.int64(28))
        cols = {"bin": new + name, "at": at + offset, "fill": capacity - room[new], "done": room[new] <= nearly}
        for c, values in cols.items():
            table = table.set_column(columns.index(c), c, pa.array(values)) if c in columns else table.append_column(c, pa.array(values))
        yield from table.combine_chunks().to_batches(20_000)

    dealt = items.select(*columns).repartition(parts, "bin")
    return dealt.mapInArrow(pack, PIECE + ", bin long, at long, fill long, done boolean")


def pack(cut_pieces: DataFrame, capacity: int, nearly: int | None = None, per_task: int = PER_TASK) -> DataFrame:
    """Sequence and offset for every piece: PIECE, sequence_id, offset.

    nearly: tokens of room with which a bin counts as nearly full, by default a 256th of the
    capacity. per_task: pieces that one task may hold.
    """
    nearly = capacity // 256 if nearly is None else nearly
    with rows_per_batch(cut_pieces.sparkSession, 500):  # whole texts
        source = written(cut_pieces, "pieces")
    done = source.filter(F.col("length") >= capacity).select(*PIECE.replace(",", "").split()[::2], F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = source.filter(F.col("length") < capacity).select("*", F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("at"), F.col("length").alias("fill"))
    left, bins = items.count(), None
    parts, number = max(1, -(-left // per_task)), 0
    while left:
        number += 1
        packed = written(pack_round(items, capacity, number, nearly, parts), f"round{number}")
        figures = packed.filter("not done").agg(F.count("*"), F.sum((F.col("at") == 0).cast("long"))).first()
        left, now = figures[0], figures[1] or 0
        last = parts == 1 or not left or (bins is not None and now >= bins and parts == max(1, -(-left // per_task)))
        over = packed if last else packed.filter("done")
        done = done.unionByName(over.select(*PIECE.replace(",", "").split()[::2], F.col("bin").alias("sequence_id"), F.col("at").alias("offset")))
        if last:
            break
        items, bins = packed.filter("not done"), now
        parts = max(1, -(-left // per_task), -(-parts // FAN_IN) if left <= per_task * parts // FAN_IN else 1)
    return done
