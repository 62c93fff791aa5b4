"""SentencePiece encoding with N-best segmentation, and decoding.

The piece lattice of a text has a node between any two characters and an edge for every piece. Forward
Viterbi gives each node the best score of a way to it. Backward A* runs from the end: a partial way
scores what it has so far plus the forward score of its node, which is exactly the best it can reach,
so ways come out in order of score and the first N to reach the start are the N best.

No piece goes on over white space into a word's second one, so the lattice of a text parts, at each mark of
white space after another character, into lattices of chunks (a run of marks and the word after it). The
forward pass over a chunk, which keeps two scores a node, is kept in a bounded cache. It tells
how much a chunk's second way loses; the N best of a text differ only where that is least, and only
there the search runs. They are the N best sums of those chunks' ways, found best first. A vocabulary that doesn't allow this
is treated as one chunk.

Scores: a unigram model's own; for a byte-pair vocabulary, whose scores are only merge ranks, Zipf's
law turns rank r into log((r + SHIFT) ** -1), normalised. Characters without a piece are spelled in bytes, each at a score
below all pieces. Equal scores: the way whose last pieces are longer comes first.

Null texts count as empty: one segmentation, without pieces, of score 0. A text with fewer than N
segmentations gives them all. Null and repeated doc_ids are rows like others.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, arrow_limits, batches_of

#: The vocabulary's mark of white space; here it is a space, which keeps most chunks at a byte a character.
MARK = "▁"
SHIFT = 20.0
#: Chunks kept in each of two generations of the cache; longer ones than KEPT_CHARS are not. N best kept.
KEPT, KEPT_CHARS, KEPT_WAYS = 700_000, 64, 20_000
_CHUNK = re.compile(" +[^ ]*|[^ ]+")
#: Marks before which a chunk that ends in a letter also ends, unless some piece joins the two.
ENDS = ",.;:!?|"
#: Scores are whole numbers of millionths, so sums are exact and equal ways are known as equal.
UNIT = 1_000_000
_NEVER = 1 << 60
#: Score, ids and loss of the second way of a chunk.
Head = tuple[int, bytes, int]
Way = tuple[int, bytes]  # score in millionths; ids as little-endian unsigned 32-bit integers


class PieceModel:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str, scores: str = "auto"):
        import sentencepiece

        self.processor = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b""] * n
        self.byte_ids = [m.unk_id()] * 256
        own: dict[str, tuple[int, float]] = {}
        for i, name in enumerate(names):
            if m.is_byte(i):
                b = int(name[3:5], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                name = name.replace(MARK, " ")
                own[name] = i, m.get_score(i)
                self.bytes_of[i] = name.encode()
        ranks = scores == "rank" or (scores == "auto" and all(s == int(s) for _, s in own.values()))
        if ranks:
            total = np.log(sum(1 / (SHIFT + r) for r in range(len(own))))
            # Runs of white space stand outside the ranking, below all.
            own = {p: (i, float(-np.log(min(-s, n) + SHIFT) - total)) for p, (i, s) in own.items()}
        own = {p: (i, round(s * UNIT)) for p, (i, s) in own.items()}
        self.pieces = own
        self.longest = max(map(len, own), default=1)
        #: The pieces' characters as a tree: character -> (id or -1, score, what may follow).
        self.tree: dict[str, tuple] = {}
        for p in sorted(own):  # beginnings come before what they begin
            at = self.tree
            for c in p[:-1]:
                at = at.setdefault(c, (-1, 0, {}))[2]
            at[p[-1]] = (*own[p], {})
        self.byte_score = min((s for _, s in own.values()), default=0) - 10 * UNIT
        self.parts = not any(" " in p.lstrip(" ") for p in own)
        # Characters that some piece joins to a mark of ENDS.
        joined = "".join(sorted({a for p in own for a, b in zip(p, p[1:]) if b in ENDS and a.isalnum()}))
        self.chunk_of = re.compile(rf" *[^ {ENDS}]+(?<![\W\d_{joined}])(?![^ {ENDS}])|{_CHUNK.pattern}").findall
        self.cache: dict[str, Head] = {}
        self.old: dict[str, Head] = {}
        self.ways: dict[tuple[str, int], list[Way]] = {}

    def normalize(self, text: str) -> str:
        """The model's own normalisation, with marks as spaces."""
        return self.processor.normalize(text).replace(MARK, " ")

    def chunks(self, text: str) -> list[str]:
        return self.chunk_of(text) if self.parts else [text]

    def edges(self, text: str) -> list[list[tuple[int, int | bytes, int]]]:
        """For every node the edges that end there, longest first: (start, id or bytes, score)."""
        n, find, longest = len(text), self.pieces.get, self.longest
        into: list[list[tuple[int, int | bytes, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + longest) + 1):
                hit = find(text[i:j])
                if hit is not None:
                    into[j].append((i, hit[0], hit[1]))
            if text[i] not in self.pieces:
                raw = text[i].encode()
                into[i + 1].append((i, raw, self.byte_score * len(raw)))
        return into

    def _ids(self, tail: tuple | None) -> bytes:
        found: list[int] = []
        while tail is not None:
            found += [self.byte_ids[b] for b in tail[0]] if isinstance(tail[0], bytes) else [tail[0]]
            tail = tail[1]
        return np.array(found, "<u4").tobytes()

    def lattice_best(self, text: str, n: int) -> list[Way]:
        """The n best ways through a text's lattice, best first.

        A partial way reaches the start at exactly the score it is ranked by, and different partial ways end in
        different whole ones. So the agenda needs no more than the n best partial ways.
        """
        into = self.edges(text)
        ahead = [0] * (len(text) + 1)
        for j in range(1, len(text) + 1):
            ahead[j] = max([ahead[i] + s for i, _, s in into[j]])
        # Entries, in ascending order: what it can reach, order of making, node, score so far, way
        # back to the end. Among equals the one made last is the greatest and taken first.
        agenda: list[tuple[int, int, int, int, tuple | None]] = [(ahead[-1], 0, len(text), 0, None)]
        found: list[Way] = []
        made, room = 0, n
        while agenda:
            _, _, node, score, tail = agenda.pop()
            if node == 0:
                found.append((score, self._ids(tail)))
                room -= 1
                if not room:
                    break
                continue
            for i, what, s in reversed(into[node]):
                total = score + s
                reach = total + ahead[i]
                if len(agenda) < room:
                    made += 1
                    insort(agenda, (reach, made, i, total, (what, tail)))
                elif reach >= agenda[0][0]:
                    made += 1
                    insort(agenda, (reach, made, i, total, (what, tail)))
                    del agenda[0]
        return found

    def viterbi(self, text: str) -> Head:
        """The best way through a text's lattice, and how much less the second best has.

        Every node keeps its two best forward scores. Of equal edges that end at a node the longest counts.
        """
        n, tree, low = len(text), self.tree, -_NEVER
        best, second, back, what = [low] * (n + 1), [low] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0
        for i in range(n):
            here, kids, j = best[i], tree, i
            for c in text[i : i + self.longest]:
                node = kids.get(c)
                if node is None:
                    break
                j += 1
                name, score, kids = node
                if name >= 0:
                    new = here + score
                    if new > second[j]:
                        if new > best[j]:
                            other = second[i] + score
                            second[j] = best[j] if best[j] > other else other
                            best[j], back[j], what[j] = new, i, name
                        else:
                            second[j] = new
            c = text[i]
            if c not in tree or tree[c][0] < 0:
                raw = c.encode()
                score, j = self.byte_score * len(raw), i + 1
                new = here + score
                if new > second[j]:
                    if new > best[j]:
                        second[j] = max(best[j], second[i] + score)
                        best[j], back[j], what[j] = new, i, raw
                    else:
                        second[j] = new
        ids: list[int] = []
        j = n
        while j:
            w = what[j]
            ids += [w] if isinstance(w, int) else [self.byte_ids[b] for b in reversed(w)]
            j = back[j]
        ids.reverse()
        return best[n], pack(f"<{len(ids)}I", *ids), best[n] - second[n] if second[n] > low // 2 else _NEVER

    def head(self, chunk: str) -> Head:
        found = self.old.get(chunk)
        if found is None:
            found = self.viterbi(chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self.cache) >= KEPT:
                self.old, self.cache = self.cache, {}
            self.cache[chunk] = found
        return found

    def chunk_best(self, chunk: str, n: int) -> list[Way]:
        """lattice_best() of a chunk, with a cache of its own."""
        found = self.ways.get((chunk, n))
        if found is None:
            found = self.lattice_best(chunk, n)
            if len(self.ways) >= KEPT_WAYS:
                self.ways = {}
            self.ways[chunk, n] = found
        return found

    def best(self, text: str | None, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a whole text: (score, ids), best first."""
        if not text:
            return [(0.0, b"")]
        return self.best_of(self.normalize(text), n)

    def best_of(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """best() of a text that has been normalised."""
        if not text:
            return [(0.0, b"")]
        chunks = self.chunks(text)
        get, head = self.cache.get, self.head
        heads = [get(c) or head(c) for c in chunks]
        scores, ids, losses = zip(*heads)
        first, score = b"".join(ids), sum(scores)
        if n == 1:
            return [(score / UNIT, first)]
        # Any of the n best differs only in chunks whose second way is among the n - 1 least losses.
        loss = np.array(losses, np.int64)
        near = [int(k) for k in _least(loss, n - 1) if loss[k] < _NEVER]
        ways = [self.chunk_best(chunks[k], n) for k in near]
        found, at = [], None
        for lost, pick in _least_sums([[w[0][0] - x[0] for x in w] for w in ways], n):
            if not any(pick):
                found.append((score / UNIT, first))
                continue
            if at is None:
                at = np.r_[0, np.cumsum([len(x) for x in ids])]
            out, done = [], 0
            for k, w, i in sorted(zip(near, ways, pick), key=lambda x: x[0]):
                if i:
                    out += [first[done : at[k]], w[i][1]]
                    done = int(at[k + 1])
            found.append(((score - lost) / UNIT, b"".join([*out, first[done:]])))
        return found

    def decode(self, ids: np.ndarray | bytes) -> str:
        """Ids back to the normalised text, marks as spaces, without the one put in front."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values; of equals the first."""
    if len(values) > 4 * n:
        edge = np.partition(values, n - 1)[n - 1]
        places = np.flatnonzero(values <= edge)
        return places[np.argsort(values[places], kind="stable")][:n]
    return np.argsort(values, kind="stable")[:n]


def _least_sums(lists: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n least sums of one entry from each ascending list, with the entries taken."""
    start = (0,) * len(lists)
    heap, seen, found = [(0, start)], {start}, []
    while heap and len(found) < n:
        total, pick = heapq.heappop(heap)
        found.append((total, pick))
        for k, i in enumerate(pick):
            if i + 1 < len(lists[k]):
                new = (*pick[:k], i + 1, *pick[k + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (total - lists[k][i] + lists[k][i + 1], new))
    return found


@lru_cache(maxsize=2)
def model(path: str, scores: str = "auto") -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(path, scores)


CACHES.append(model.cache_clear)

_ROW = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str, n: int = 1) -> DataFrame:
    """doc_id, rank (from 0), score, ids array<int>: a row for each of the n best segmentations of every whole text."""
    arrow_limits(docs.sparkSession, 500)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        m = model(path)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for rank, (score, ids) in enumerate(m.best(text.as_py(), n)):
                    yield doc_id, rank, score, np.frombuffer(ids, "<u4").astype(np.int32)

    return _slim(docs).mapInArrow(lambda b: batches_of(rows(b), _ROW, 200), "doc_id long, rank int, score double, ids array<int>")


def decode(segmented: DataFrame, path: str) -> DataFrame:
    """doc_id, rank and text of rows (doc_id, rank, ids); null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        m = model(path)
        for batch in batches:
            for doc_id, rank, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                yield doc_id, rank, m.decode(ids.values.to_numpy()) if ids.is_valid else None

    slim = segmented.select(F.col("doc_id").cast("long"), F.col("rank").cast("int"), F.col("ids").cast("array<int>"))
    return slim.mapInArrow(lambda b: batches_of(rows(b), schema, 200), "doc_id long, rank int, text string")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("ids_crc32", pa.list_(pa.int64())), ("decoded", pa.bool_())])


def digest(docs: DataFrame, path: str, n: int) -> DataFrame:
    """encode() and decode() in one pass, of which only figures are kept.

    doc_id; number of pieces, score and crc32 (of the ids as little-endian unsigned 32-bit integers) of each of
    the n best, best first; decoded: whether the best decodes to the normalised text.
    """
    arrow_limits(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        m = model(path)
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                text = m.normalize(text) if text else ""
                ways = m.best_of(text, n)
                yield doc_id, [len(w) // 4 for _, w in ways], [round(s, 6) for s, _ in ways], [zlib.crc32(w) for _, w in ways], m.decode(ways[0][1]) == text.removeprefix(" ")

    return _slim(docs).mapInArrow(lambda b: batches_of(rows(b), _DIGEST, 5000), "doc_id long, n_pieces array<long>, scores array<double>, ids_crc32 array<long>, decoded boolean")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
