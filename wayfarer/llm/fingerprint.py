"""Exact digests of canonical texts, and groups of equal ones confirmed byte by byte.

Canonical: Unicode NFKC, full case folding, NFKC again, runs of white space to one space, none at
the ends. The fingerprint is the xxh3-128 of the canonical bytes and their number. A bucket holds the
texts of one fingerprint and one second digest (BLAKE2b), which is not shown. with_groups() compares
the bytes of every bucket of two or more: a task compares what it reads and passes on one text for each
bucket, those are compared in order of bucket, and a bucket whose bytes differ is split by its
bytes. Thus no bucket is gathered, and only texts in buckets of two or more are read again.

Null texts count as empty. Rows with equal doc_ids, null ones too, are ordered by a hash of the text,
and each has the group of its own text. Null doc_ids come last. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, batches_of, release, to_batch, with_group_figures, written

#: Documents in buckets of two or more whose ids are broadcast; beyond, ids meet texts in a shuffle.
BROADCAST_IDS = 500_000
#: Bytes of canonical texts that a task holds to compare others with.
HELD_BYTES = 8 << 20
#: Of canonical bytes: the fingerprint and a second digest.
Digests = Callable[[bytes], tuple[str, str]]


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def fingerprint(canon: bytes) -> str:
    return f"{xxhash.xxh3_128_hexdigest(canon)}{len(canon):x}"


def second_digest(canon: bytes) -> str:
    return hashlib.blake2b(canon, digest_size=16).hexdigest()


def digests(canon: bytes) -> tuple[str, str]:
    return fingerprint(canon), second_digest(canon)


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as much of the next document's start as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _row(doc_id: int | None, text: str, canon: bytes, mark: str, after: str, after_canon: bytes) -> tuple:
    changed = edited(text, after)
    changed_canon = canonical(changed)
    changed_mark = fingerprint(changed_canon)
    # Equal fingerprints count as equal texts only if the bytes agree.
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, changed_mark, float(changed_canon == canon), float(after_canon == canon), second_digest(canon)


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("second", pa.string())])
_ROW_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, second string"


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint every document and its edited text, with the next document in descending doc_id.

    Documents are range-partitioned by doc_id and hash of the text, so that a doc_id with many rows takes
    many partitions, and run through in order. A partition's last document lacks its next: its text, and
    the partition's first one, are passed on as rows of their own, two a task. Column second: second_digest().
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    schema = pa.schema([*_ROW, ("part", pa.int64()), ("first", pa.string()), ("last", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        first, last = None, None

        def rows() -> Iterator[tuple]:
            nonlocal first, last
            for batch in batches:
                for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = value.as_py()
                    canon = canonical(text)
                    if last is None:
                        first = text
                    else:
                        yield *_row(*last, text, canon), None, None, None
                    last = doc_id, text, canon, fingerprint(canon)

        yield from batches_of(rows(), schema, 2000)
        if last is not None:
            yield to_batch([(last[0], *[None] * (len(_ROW) - 1), TaskContext.get().partitionId(), first, last[1])], schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ordered = slim.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = written(ordered.mapInArrow(run, _ROW_SQL + ", part long, first string, last string"), "fingerprints")
    # Which task comes next is told from numbers alone, a row a task.
    parts = found.filter("part is not null").select("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    ends = found.filter("part is not null")
    edges = ends.select("doc_id", "part", "last").join(after, "part").join(ends.select(F.col("part").alias("next"), "first"), "next").select("doc_id", "last", "first")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, last, first in zip(*(c.to_pylist() for c in batch.columns)):
                    canon = canonical(last)
                    yield _row(doc_id, last, canon, fingerprint(canon), first, canonical(first))

        yield from batches_of(rows(), _ROW)

    edges = written(edges.mapInArrow(finish, _ROW_SQL), "edges")
    return found.filter("part is null").select(*_ROW.names).unionByName(edges)


def _canons(texts: DataFrame, digests: Digests) -> DataFrame:
    """doc_id, fingerprint, second, canon of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canon = [canonical(t.as_py()) for t in batch.column(1)]
            marks = [digests(c) for c in canon]
            columns = pa.array([m[0] for m in marks], pa.string()), pa.array([m[1] for m in marks], pa.string()), pa.array(canon, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "fingerprint", "second", "canon"])

    return texts.mapInArrow(run, "doc_id long, fingerprint string, second string, canon binary")


def _bucket() -> Column:
    return F.concat_ws(":", "fingerprint", "second")


def differing(texts: DataFrame, digests: Digests = digests) -> DataFrame:
    """Buckets (column bucket) of the rows (doc_id, text) whose canonical bytes differ."""
    schema = pa.schema([("bucket", pa.string()), ("canon", pa.binary())])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One text of each bucket, and every one that differs from it."""
        release()
        held, size = {}, 0
        for batch in batches:
            out = []
            for value in batch.column(1):
                canon = canonical(value.as_py())
                bucket = ":".join(digests(canon))
                if held.get(bucket) == canon:
                    continue
                out.append((bucket, canon))
                if bucket not in held:
                    held[bucket], size = canon, size + len(canon)
                if size > HELD_BYTES:
                    held, size = {}, 0
            if out:
                yield to_batch(out, schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, canon, told = None, None, False
        for batch in batches:
            found = []
            for now, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = value.as_py()
                if now != bucket:
                    bucket, canon, told = now, raw, False
                elif raw != canon and not told:
                    told = True
                    found.append(now)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["bucket"])

    one = texts.mapInArrow(thin, "bucket string, canon binary")
    return one.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "bucket string")


def with_groups(docs: DataFrame, rows: DataFrame, digests: Digests = digests) -> DataFrame:
    """rows with group_id (least doc_id of equal canonical texts) and group_size, without second.

    rows: (doc_id, fingerprint, second, ...) of docs; it is read several times.
    """
    arrow_limits(docs.sparkSession)
    figures = {"group_id": (F.col("doc_id"), "min"), "group_size": (F.lit(1).cast("long"), "sum")}
    columns = [*(c for c in rows.columns if c != "second"), "group_id", "group_size"]
    sized = written(with_group_figures(rows.withColumn("bucket", _bucket()), "bucket", F.col("doc_id"), figures), "groups")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    many = sized.filter("group_size > 1").select(F.col("doc_id").alias("id")).distinct()
    many = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    # Rows that share a doc_id with one of a bucket come along, which does no harm.
    odd = written(differing(slim.join(many, slim["doc_id"].eqNullSafe(many["id"]), "left_semi"), digests), "odd")
    if odd.isEmpty():
        return sized.select(*columns)
    # Different texts with equal digests: groups by the bytes. The row that has an id, and the bytes that it has, are told by both.
    odd_rows = sized.join(odd, "bucket", "left_semi").drop("group_id", "group_size")
    ids = odd_rows.select(F.col("doc_id").alias("id")).distinct()
    canons = _canons(slim.join(ids, slim["doc_id"].eqNullSafe(ids["id"]), "left_semi"), digests).withColumn("bucket", _bucket()).join(odd, "bucket", "left_semi")
    sums = canons.groupBy("doc_id", "bucket", "canon").agg(F.count("*").alias("n"))
    split = with_group_figures(sums.withColumn("whole", F.concat(F.encode("bucket", "UTF-8"), F.col("canon"))), "whole", F.col("doc_id"), {"group_id": (F.col("doc_id"), "min"), "group_size": (F.col("n"), "sum")})
    # Rows of one doc_id in one bucket differ in their bytes alone, so any of them may have either text; each text is given as often as it is there.
    place = Window.partitionBy("doc_id", "bucket")
    texts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc_id", "bucket", "group_id", "group_size", F.row_number().over(place.orderBy("canon", "k")).alias("place"))
    given = odd_rows.withColumn("place", F.row_number().over(place.orderBy(*[c for c in rows.columns if c not in ("doc_id", "second")])))
    t = texts.withColumnsRenamed({"doc_id": "t_id", "bucket": "t_bucket", "place": "t_place"})
    split = given.join(t, given["doc_id"].eqNullSafe(t["t_id"]) & (given["bucket"] == t["t_bucket"]) & (given["place"] == t["t_place"]), "left")
    return sized.join(odd, "bucket", "left_anti").select(*columns).unionByName(split.select(*columns))


def groups(docs: DataFrame, digests: Digests = digests) -> DataFrame:
    """Per document: doc_id, fingerprint, group_id, group_size."""
    arrow_limits(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_groups(docs, written(_canons(slim, digests).select("doc_id", "fingerprint", "second"), "marks"), digests)
