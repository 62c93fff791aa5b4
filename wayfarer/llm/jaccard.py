"""Exact Jaccard self-join of documents on word n-grams, and its connected components.

Documents with equal n-gram sets are one class and are represented by one document. Classes meet
through a partition of the universe: for the sizes of a band, n-grams are dealt by hash to segments.
Sets that are similar enough differ in at most H n-grams, so with weights of H + 1 + z in all they
agree in segments of a weight over z. A plain segment (weight 1) is indexed by its content; a segment
of weight 2 also by its contents less one n-gram, so it agrees up to one difference. How many of
either kind a band has, and z, is chosen by an estimate of cost.

A document may leave out segments that tell little, as long as their weight is at most z: those with
(almost) no content, and those whose bucket is large. Pairs that both leave out more than z (the
heavy ones) are met in the large buckets, or in buckets for segments without content. So no pair is lost,
while a passage that many documents share does not bring all of them together.

Buckets are not turned into all their pairs. Within a map task the documents of a bucket are hung on
the least of them, and only that one goes on to the bucket's own task; there the least of all is the
pivot. First every document is compared with its most frequent pivot, and the links found give
components. Then only documents of a bucket that are still in different components are compared, in
rounds: with the pivot first, with each other last, until nothing is left to compare. Of the last, two are
compared if they also share one of their rarest n-grams, as alike sets must: of n n-grams all but
the ceil(t * n) - 1 last in an order of how common they are. Before sets are moved to be compared, a bound on
what they can share, from the numbers of n-grams in CELLS cells, drops pairs that can't be alike. All
comparisons are exact, on 64-bit n-gram hashes.

Null and empty texts, and texts without words, have no n-grams and are linked with nothing. Rows with
the same doc_id count as one document. Rows with a null doc_id are linked with nothing; their
component_id is null. An empty table gives no row.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import arrow_limits, drop_written, free_shuffles, release, rows_per_batch, shuffles_end, unused, with_group_figures
from .common import written as stored

#: Ids that are broadcast to choose documents; beyond, they meet the documents in a shuffle.
BROADCAST_IDS = 500_000
#: A bucket of more documents is large.
LARGE_BUCKET = 64
#: Keys that a map task combines at a time, and that the task of a part of the index gets, about.
FLUSH_KEYS, PART_KEYS = 1 << 18, 3 << 17
#: Counters of how common n-grams are; of 4 bytes each, on the driver and with every task.
COUNTERS = 1 << 19
#: Cells of a set's histogram, a byte each, and pairs that one row of a set meets.
CELLS, MEETS = 128, 512
_U = np.uint64
_ODD = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def written(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder; the shuffle files that it took go when it is there."""
    with shuffles_end(df.sparkSession):
        return stored(df, label)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers one to one."""
    x = (x ^ (x >> _U(33))) * _ODD[5]
    x = (x ^ (x >> _U(29))) * _ODD[6]
    return x ^ (x >> _U(32))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Hashes of the distinct k-word n-grams of a text in UTF-8, in ascending order.

    bytes.lower() folds A-Z alone, bytes.split() parts at space and U+0009 to U+000D alone.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = (total ^ (total >> _U(31))) * _ODD[0] + w[j : j + n]
    return np.unique(mix(total))


def _times(n: int, x: np.uint64) -> np.uint64:
    return _U(n * int(x) & 0xFFFFFFFFFFFFFFFF)


class Scheme(NamedTuple):
    """How sets of a band, and their larger partners, are cut into segments."""

    number: int
    most: int  # largest set that takes part
    plain: int
    double: int
    share: int  # slots of a segment of weight 2, against one of a plain one
    z: int


def _poisson_over(mean: float, z: int) -> float:
    """Chance of more than z events."""
    term = total = math.exp(-mean)
    for i in range(1, z + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def allocate(low: int, differ: int) -> tuple[int, int, int, int]:
    """(plain, double, share, z) of least estimated cost for sets of at least low n-grams that differ in at most ``differ``.

    Cost: keys of a document; documents that are heavy for want of content, which meet each other;
    plain segments that lie wholly in what documents of a fifth in common share.
    """
    best = None
    for z in range(0, max(13, differ // 6), max(1, differ // 60)):
        weight = differ + 1 + z
        for double in range(0, weight // 2 + 1, max(1, weight // 16)):
            plain, share = weight - 2 * double, 3
            u = low / (plain + share * double)
            v = share * u
            thin = plain * math.exp(-u) + 2 * double * math.exp(-v) * (1 + v)
            heavy = _poisson_over(thin, z)
            cost = plain + double * (1 + v) + 3e4 * max(heavy, 0) + 20 * (plain * math.exp(-0.8 * u) + 2 * double * math.exp(-0.8 * v) * (1 + v)) / (1 + z)
            if best is None or cost < best[0]:
                best = cost, (plain, double, share, z)
    return best[1]


@lru_cache(maxsize=8)
def _bands(num: int, den: int) -> list[int]:
    return [1]


@lru_cache(maxsize=4096)
def scheme(number: int, num: int, den: int) -> Scheme | None:
    """Scheme of a band; None if sets there must be equal."""
    bounds = _bands(num, den)
    while len(bounds) < number + 2:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * den // num + 1))
    low, high = bounds[number], bounds[number + 1] - 1
    most = high * den // num
    sums = np.arange(2 * low, high + most + 1, dtype=np.int64)
    differ = int((sums - 2 * -(-num * sums // (num + den))).max())
    return None if differ <= 0 else Scheme(number, most, *allocate(low, differ))


def schemes_of(n: int, num: int, den: int) -> list[Scheme]:
    """Schemes that a set of n takes part in: its band's, and that of the band below if that reaches up to n."""
    bounds = _bands(num, den)
    while bounds[-1] <= n:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * den // num + 1))
    band = int(np.searchsorted(bounds, n, "right")) - 1
    found = [scheme(b, num, den) for b in (band - 1, band) if b >= 0]
    return [s for s in found if s and n <= s.most]


def keys_of(grams: np.ndarray, s: Scheme) -> tuple[np.ndarray, int]:
    """Keys of a set in a scheme, and what weight of large buckets it may still leave out (-1: none, it is heavy)."""
    spread = mix(grams + _times(s.number + 1, _ODD[1]))
    slot = (spread % _U(s.plain + s.share * s.double)).astype(np.int64)
    segment = np.where(slot < s.plain, slot, s.plain + (slot - s.plain) // s.share) if s.double else slot
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], mix(grams[order] * _ODD[2])
    heads = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    sizes, total, own = np.diff(np.r_[heads, len(segment)]), np.add.reduceat(value, heads), segment[heads]
    name = own.astype(np.uint64) * _ODD[3] + _times(s.number, _ODD[4])
    keys = [mix(total + name + sizes.astype(np.uint64) * _ODD[0])]
    thin = s.plain - int((own < s.plain).sum())
    if s.double:
        at = np.repeat(np.arange(len(heads)), sizes)
        less = (segment >= s.plain) & (sizes[at] > 1)
        keys.append(mix(total[at][less] - value[less] + name[at][less] + (sizes[at][less] - 1).astype(np.uint64) * _ODD[0]))
        thin += 2 * (s.double - int(((own >= s.plain) & (sizes > 1)).sum()))
    if thin > s.z:
        full = np.zeros(s.plain + s.double, bool)
        full[own[(own < s.plain) | (sizes > 1)]] = True
        keys.append(mix(np.flatnonzero(~full).astype(np.uint64) * _ODD[3] + _times(s.number, _ODD[4]) + _ODD[6]))
    return np.concatenate(keys), max(-1, s.z - thin)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_hash", pa.binary())])
#: route is a row's key, or a hash by which it is dealt; then own has the key. info: size, scheme, allow.
_KEYS = pa.schema([("route", pa.int64()), ("own", pa.int64()), ("id", pa.int64()), ("info", pa.int64()), ("pivot", pa.int64()), ("held", pa.int32())])
_KEYS_SQL = "route long, own long, id long, info long, pivot long, held int"
_N_BIT, _SCHEME_BIT = 32, 20


def _text(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _slim(docs: DataFrame) -> DataFrame:
    arrow_limits(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_hashes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the set), set_hash (128 bits of it) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sets = [shingles(_text(t), k) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())], schema=_SETS)

    return _slim(docs).mapInArrow(run, "doc_id long, n long, set_hash binary")


def histogram(grams: np.ndarray) -> bytes:
    """Numbers of n-grams in CELLS cells, 255 at most."""
    return np.minimum(np.bincount((grams % _U(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, n, cells (the histogram) and grams (the set, eight bytes each) of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [shingles(_text(t), k) for t in batch.column(1)]
            columns = pa.array([len(g) for g in found], pa.int64()), pa.array(map(histogram, found), pa.binary()), pa.array([g.tobytes() for g in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "cells", "grams"])

    return chosen(_slim(docs), ids.select(F.col("id").alias("doc_id")), "left_semi").mapInArrow(run, "id long, n long, cells binary, grams binary")


def chosen(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) these distinct doc_ids: by broadcast if they are few, else by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def index(docs: DataFrame, k: int, num: int, den: int, parts: int) -> DataFrame:
    """Buckets of two or more documents: key, id, n, scheme, allow, pivot, and size of the bucket.

    A row with id <> pivot and size null hangs on the pivot of its map task; that one's own row has
    the size. Only pivots of map tasks are dealt by key, the other rows by key and id.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, n_keys = [], 0

        def combine() -> Iterator[pa.RecordBatch]:
            counts = np.array([len(h[0]) for h in held])
            key = np.concatenate([h[0] for h in held]).view(np.int64)
            ids, info = (np.repeat(np.array([h[i] for h in held], np.int64), counts) for i in (1, 2))
            order = np.lexsort((ids, key))
            key, ids, info = key[order], ids[order], info[order]
            first = np.r_[True, key[1:] != key[:-1]]
            once = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
            run = np.cumsum(first) - 1
            spread = mix(key.view(np.uint64) + ids.view(np.uint64) * _ODD[0]).view(np.int64)
            rest = ~first[once]
            columns = [
                pa.array(np.where(first, key, spread)[once]),
                pa.array(key[once], mask=~rest),
                pa.array(ids[once]),
                pa.array(info[once]),
                pa.array(ids[first][run][once], mask=~rest),
                pa.array(np.where(first, np.bincount(run, once)[run], 0)[once].astype(np.int32)),
            ]
            yield from pa.Table.from_arrays(columns, schema=_KEYS).to_batches(1 << 15)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = shingles(_text(text), k) if doc_id is not None else ()
                for s in schemes_of(len(grams), num, den) if len(grams) else ():
                    keys, allow = keys_of(grams, s)
                    held.append((keys, doc_id, (len(grams) << _N_BIT) | (s.number << _SCHEME_BIT) | (allow + 1)))
                    n_keys += len(keys)
                if n_keys >= FLUSH_KEYS:
                    yield from combine()
                    held, n_keys = [], 0
        if held:
            yield from combine()
        held = []
        release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        for b in batches:
            route, own, ids, info, pivot, held = b.columns
            hung = held.to_numpy() == 0
            key = np.where(hung, own.fill_null(0).to_numpy(), route.to_numpy())
            for column, values in zip(found, (key, ids.to_numpy(), info.to_numpy(), np.where(hung, pivot.fill_null(0).to_numpy(), 0), held.to_numpy())):
                column.append(values)
        if not sum(map(len, found[0])):
            return
        key, ids, info, pivot, held = (np.concatenate(c) for c in found)
        found.clear()
        order = np.lexsort((ids, held == 0, key))
        key, ids, info, pivot, held = (c[order] for c in (key, ids, info, pivot, held))
        first = np.r_[True, key[1:] != key[:-1]]
        run = np.cumsum(first) - 1
        own = held > 0
        size = np.bincount(run, held)[run].astype(np.int64)
        # The first row of a key with rows of its own is the least pivot.
        pivot = np.where(own, ids[first][run], pivot)
        live = ~own | (size > 1)
        n, number, allow = info >> _N_BIT, (info >> _SCHEME_BIT) & 0xFFF, (info & 0xFFFFF) - 1
        columns = [key[live], ids[live], n[live].astype(np.int32), number[live].astype(np.int32), allow[live].astype(np.int32), pivot[live]]
        whole = pa.Table.from_arrays([*map(pa.array, columns), pa.array(size[live], mask=~own[live])], names=["key", "id", "n", "scheme", "allow", "pivot", "size"])
        del key, ids, info, pivot, held, order, run, size, columns
        yield from whole.to_batches(1 << 15)
        release()

    keys = docs.mapInArrow(emit, _KEYS_SQL)
    return keys.repartition(parts, "route").mapInArrow(gather, "key long, id long, n int, scheme int, allow int, pivot long, size long")


def rarest(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """gram, id, comp, n, at: of each member (id, comp) the n-grams of which alike sets share one, rarest first.

    How common n-grams are among the members is told from COUNTERS counters, whatever their number;
    where n-grams share one only the order, the same for all sets, is less good.
    """
    spark = members.sparkSession
    held = sets.join(few(members), "id").select("id", "comp", "grams")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for grams in batch.column(0):
                np.add.at(total, (np.frombuffer(_text(grams), np.uint64) % _U(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "many"])

    counts = held.select("grams").mapInArrow(tally, "cell int, many long").groupBy("cell").agg(F.least(F.sum("many"), F.lit(1 << 30)).cast("int").alias("many")).filter("many > 1").toArrow()
    many = np.ones(COUNTERS, np.int32)
    many[counts.column("cell").to_numpy()] = counts.column("many").to_numpy()
    shared = spark.sparkContext.broadcast(many)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = [], []
            for i, grams in enumerate(batch.column(2)):
                g = np.frombuffer(_text(grams), np.uint64)
                first = np.lexsort((g, shared.value[(g % _U(COUNTERS)).astype(np.int64)]))[: len(g) - -(-num * len(g) // den) + 1]
                out.append(g[first])
                rows.append((i, len(g), len(first)))
            if rows:
                at, n, k = (np.array(c, np.int64) for c in zip(*rows))
                where = np.repeat(at, k)
                place = np.concatenate([np.arange(x) for x in k])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), batch.column(0).take(pa.array(where)), batch.column(1).take(pa.array(where)), pa.array(np.repeat(n, k).astype(np.int32)), pa.array(place.astype(np.int32))], ["gram", "id", "comp", "n", "at"])

    return held.mapInArrow(order, "gram long, id long, comp long, n int, at int")


def rare_pairs(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b: members (id, comp) of different comp that share one of their rarest n-grams, and enough after it to be alike."""
    rare = rarest(members, sets, num, den)
    x, y = (rare.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "comp", "n", "at")]) for side in "ab")
    # What two sets share comes after their first shared n-gram in either; it must be enough.
    enough = (num + den) * F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= num * (F.col("n_a") + F.col("n_b"))
    fit = (F.col("comp_a") < F.col("comp_b")) & _sizes_fit("n_a", "n_b", num, den) & enough
    return x.join(y, "gram").filter(fit).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _sizes_fit(x: str, y: str, num: int, den: int) -> Column:
    return den * F.least(x, y) >= num * F.greatest(x, y)


def few(df: DataFrame) -> DataFrame:
    """df, which is written, to be broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough. pairs and sets are written tables.

    Pairs go to the sets of b where these lie, if they are few. Only pairs that pass the bound from
    the histograms move a set, which goes to a's. A set that many pairs need is there once for each MEETS of them.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [np.frombuffer(b"".join(_text(c) for c in batch.column(i)), np.uint8).reshape(-1, CELLS).astype(np.int16) for i in (4, 5)]
            apart = np.abs(cells[0] - cells[1]).sum(1, dtype=np.int64)
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            good = (num + den) * (sizes - apart) >= 2 * num * sizes
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(_text(x), np.uint64), np.frombuffer(_text(y), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(den * same >= num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    def dealt(pairs: DataFrame) -> DataFrame:
        """pairs with part: at most about MEETS pairs share (a, part)."""
        many = pairs.groupBy("a").agg(F.count("*").alias("many")).filter(F.col("many") > MEETS)
        hot = pairs.join(F.broadcast(many) if many.count() <= BROADCAST_IDS else many, "a", "left")
        return hot.select("a", "b", F.when(F.col("many").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / MEETS))).cast("int").alias("part"))

    def met(pairs: DataFrame, held: list[str]) -> DataFrame:
        """a, b and what sets hold of both."""
        pairs = dealt(pairs)
        x, y = (sets.select(F.col("id").alias(c), *[F.col(h).alias(f"{h}_{c}") for h in held]) for c in "ab")
        needed = x.join(few(pairs.select("a", "part").distinct()), "a")
        return y.join(few(pairs), "b").join(needed, ["a", "part"]).select("a", "b", *[f"{h}_{c}" for h in held for c in "ab"])

    close = written(met(pairs, ["n", "cells"]).mapInArrow(near, "a long, b long"), "close")
    return met(close, ["grams"]).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the least id that links (a, b) lead to, of every id in a link. Ends when nothing changes.

    Each round takes the least label among neighbours, then the label of that label.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id", "left").select("id", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("comp").alias("far"))
        step = written(step.join(jump, "new", "left").select("id", F.col("comp").alias("old"), F.least("new", "far").alias("comp")), "labels")
        drop_written(labels)
        labels = step.select("id", "comp")
        if step.filter("old <> comp").isEmpty():
            drop_written(both)
            return labels


def clusters(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, large: int = LARGE_BUCKET) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least doc_id that links lead to).

    Documents link when den * common n-grams >= num * n-grams of either.
    """
    passing: dict[str, DataFrame] = {}

    def keep(df: DataFrame, label: str, rows: int = 2000) -> DataFrame:
        """Write a table; the last one of this label goes. rows: of an Arrow batch, fewer where rows hold whole sets."""
        with rows_per_batch(docs.sparkSession, rows):
            table = written(df, label)
        if label in passing:
            drop_written(passing[label])
        passing[label] = table
        return table

    thin = written(set_hashes(docs, k), "sets")
    known = thin.filter("doc_id is not null and n > 0")
    classes = keep(with_group_figures(known, "set_hash", F.col("doc_id"), {"rep": (F.col("doc_id"), "min")}).select("doc_id", "n", "rep"), "classes")
    # A doc_id may have several rows with different sets; it is left out only if none of them represents its class.
    by_id = classes.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("rep")).cast("int")).alias("is_rep"))
    reps = chosen(_slim(docs), by_id.filter("is_rep = 0").select("doc_id"), "left_anti")
    total = classes.filter("rep = doc_id").agg(F.sum("n")).first()[0] or 0
    live = keep(index(reps, k, num, den, max(8, int(total * 2.4 * (den - num) / num) // PART_KEYS + 1)), "buckets")

    # All rows of live buckets, each with its bucket's size.
    heads = live.filter("size is not null")
    whole = heads.groupBy("key").agg(F.max("size").alias("all"))
    small = F.broadcast if heads.count() <= BROADCAST_IDS else (lambda x: x)
    rows = heads.select("key", "id", "n", "scheme", "allow", F.col("size").alias("all"))
    hung = live.filter("size is null").join(small(whole), "key").select("key", "id", "n", "scheme", "allow", "all")
    rows = rows.unionByName(hung).distinct()
    # Large buckets count only for documents that have too many of them.
    large_rows = rows.filter(F.col("all") > large)
    heavy = large_rows.groupBy("id", "scheme").agg(F.count("*").alias("many"), F.max("allow").alias("allow")).filter("many > allow").select("id", "scheme")
    rows = rows.filter(F.col("all") <= large).unionByName(large_rows.join(heavy, ["id", "scheme"], "left_semi"))
    members = keep(rows.select("key", "id", "n"), "members")
    drop_written(passing.pop("buckets"))
    pivots = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("top"), F.count("*").alias("left")).filter("left > 1")
    base = keep(members.join(pivots.select("key", F.col("top.id").alias("top"), F.col("top.n").alias("top_n")), "key"), "apart")
    drop_written(passing.pop("members"))
    sets = keep(sets_of(reps, keep(base.select("id").distinct(), "ids"), k), "grams", rows=500)
    fit = _sizes_fit("n", "top_n", num, den)
    spokes = base.filter((F.col("id") != F.col("top")) & fit).groupBy("id", "top").count().groupBy("id").agg(F.max_by("top", F.struct("count", -F.col("top"))).alias("top"))
    tried = keep(spokes.select(F.col("top").alias("a"), F.col("id").alias("b")), "pairs0")
    links = keep(verify(tried, sets, num, den), "found0", rows=500)
    repeats = classes.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    for number, step in enumerate(("pivot", "pivot", "all"), 1):
        free_shuffles(docs.sparkSession)
        comps = keep(components(links), "comps")
        placed = base.select("key", "id", "n").join(few(comps), "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
        # The pivot of a bucket is now the least id of its least component. Other buckets have nothing left to compare.
        apart = placed.groupBy("key").agg(F.max("comp").alias("hi"), F.min(F.struct("comp", "id", "n")).alias("top")).filter("top.comp <> hi")
        apart = apart.select("key", F.col("top.comp").alias("lo"), F.col("top.id").alias("top"), F.col("top.n").alias("top_n"))
        base = keep(placed.join(apart, "key"), "apart")
        if base.isEmpty():
            break
        if step == "pivot":
            pairs = base.filter((F.col("comp") != F.col("lo")) & fit).select(F.least("top", "id").alias("a"), F.greatest("top", "id").alias("b")).distinct()
        else:
            pairs = rare_pairs(keep(base.groupBy("id").agg(F.min("comp").alias("comp")), "left"), sets, num, den)
        pairs = keep(pairs.join(tried, ["a", "b"], "left_anti"), f"pairs{number}")
        links, tried = links.unionByName(keep(verify(pairs, sets, num, den), f"found{number}", rows=500)), tried.unionByName(pairs)
    comps = components(links.unionByName(repeats))
    for table in passing.values():  # all that is needed of them is in comps
        drop_written(table)
    # A row's component: that of its class, or itself.
    labelled = thin.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Every link, and per row of docs its class and number of links.

    Links (a, b), a < b, are all pairs of alike representatives, one of each class of equal sets (its least
    doc_id). Alike sets share one of their rarest n-grams, so no link is lost. Of rows: doc_id, representative
    (null without n-grams or doc_id), n_links: those of the representative to other classes.
    """
    thin = written(set_hashes(docs, k), "sets")
    known = thin.filter("doc_id is not null and n > 0")
    classes = written(with_group_figures(known, "set_hash", F.col("doc_id"), {"rep": (F.col("doc_id"), "min")}).select("doc_id", "set_hash", "rep"), "classes")
    reps = written(classes.select(F.col("rep").alias("id")).distinct(), "ids")
    sets = written(sets_of(docs, reps, k), "grams")
    pairs = written(rare_pairs(written(reps.select("id", F.col("id").alias("comp")), "left"), sets, num, den), "pairs")
    links = written(verify(pairs, sets, num, den).distinct(), "found")
    many = links.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("n_links"))
    of = classes.select("doc_id", F.col("set_hash"), F.col("rep").alias("representative")).distinct()
    rows = thin.join(of, ["doc_id", "set_hash"], "left").join(many, "representative", "left")
    for table in (sets, pairs):
        drop_written(table)
    return links, rows.select("doc_id", "representative", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component, its least doc_id, with all columns.

    Of rows with one doc_id and equal sets of n-grams one stays; rows with one doc_id and other sets stay.
    Rows without n-grams or doc_id stay.
    """
    found = clusters(docs, k, num, den)
    gone = written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    stay = chosen(docs, gone, "left_anti")
    again = written(found.filter("doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return stay
    few_rows, mark = chosen(docs, again, "left_semi"), unused("set_hash", docs.columns)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = batch_columns.index("text")
        for batch in batches:
            sets = [shingles(_text(t.cast(pa.string())), k) for t in batch.column(at)]
            # Rows without n-grams differ from each other.
            marks = [xxhash.xxh3_128_digest(g.tobytes()) if len(g) else uuid.uuid4().bytes for g in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], [*batch_columns, mark])

    batch_columns = docs.columns
    schema = StructType([*docs.schema.fields, StructField(mark, BinaryType())])
    once = chosen(few_rows, gone, "left_anti").select(*docs.columns).mapInArrow(hashed, schema).dropDuplicates(["doc_id", mark])
    return chosen(stay, again, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
