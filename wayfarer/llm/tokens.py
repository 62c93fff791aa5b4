"""Whole texts to token ids with the tokenizers library, a chunk at a time through a bounded cache.

Texts are cut only where no token can cross and where what stands on the other side cannot matter,
so the ids are those of the whole text. Repeated chunks, by far the most of a corpus, cost a look-up.

BatchEncoder takes Arrow batches: chunks are found, looked up and replaced by ids as arrays, about
SLICE bytes of text at a time; only chunks not seen before reach the library one by one. Texts with
unusual white space, NUL or what looks like a special token go through ChunkEncoder instead.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa

from .common import CACHES, release, trim

#: Where whole texts may be cut. "word": the tokenizer drops white space. "byte": a run of white
#: space belongs to what follows it, and a chunk starts at such a run after something else.
CUTS = ("word", "byte")
_ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\u180e]")
_BYTE_ODD = re.compile(r"(?<=[^\s\x1c-\x1f\u180e])(?=[ \n])")
#: What ends in a letter or digit may also be cut from the common punctuation that follows it.
_BYTE_PLAIN = re.compile(r" ?[^ \n,.;:!?|]+(?<![\W_])(?![^ \n,.;:!?|])|[ \n]*[^ \n]+|[ \n]+")
_WORD = re.compile(r"[^ \n,.;:!?|]+(?<![\W_])(?![^ \n,.;:!?|])|[^ \n]+")
_LIMIT = 250_000


def _byte_letters() -> dict[int, str]:
    """Byte -> its letter in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(0x100)}


_LETTERS = _byte_letters()
_SPACE = _LETTERS[0x20]


class ChunkEncoder(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers; made when first asked for. Two generations of at
    most ``limit`` chunks are held.

    Both kinds are byte-level vocabularies; "word" ones fold case. Strings of special tokens in a
    text become those tokens, as the library does by default.
    """

    def __init__(self, path: str, cuts: str, limit: int = _LIMIT):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if cuts not in CUTS:
            raise ValueError(f"cuts must be one of {CUTS}")
        super().__init__()
        self.tokenizer, self.cuts, self.limit = Tokenizer.from_file(path), cuts, limit
        self.model, self.old = self.tokenizer.model, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:  # what was asked for since the last time lives on
            self.old = dict(self)
            self.clear()
        if (ids := self.old.get(chunk)) is not None:
            self[chunk] = ids
            return ids
        found = self.ids_of(chunk)
        ids = pack(f"<{len(found)}I", *found)
        if len(chunk) <= 256:
            self[chunk] = ids
        return ids

    def ids_of(self, chunk: str) -> list[int]:
        """Ids from the library."""
        letters = chunk if self.cuts == "word" else chunk.removeprefix(" ")
        if letters.isalpha() and len(chunk) <= 64 and (letters.isascii() or max(letters) < "\u0250" and "\u0130" not in letters):
            # One word of letters: only the merges are left to do.
            if not letters.isascii():
                word = (chunk.lower() if self.cuts == "word" else chunk).encode().decode("latin-1").translate(_LETTERS)
            elif self.cuts == "word":
                word = chunk.lower()
            else:  # letters stand for themselves
                word = letters if len(letters) == len(chunk) else _SPACE + letters
            return [t.id for t in self.model.tokenize(word)]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def chunks(self, text: str) -> list[str]:
        if self.cuts == "word" and "\u0130" in text:  # in lower case it ends with a mark, which joins punctuation
            return text.replace("\n", " ").split(" ")
        if self.cuts == "word":
            return _WORD.findall(text.lower() if text.isascii() and "<|" not in text else text)
        if _ODD_SPACE.search(text):
            return _BYTE_ODD.split(text)
        return _BYTE_PLAIN.findall(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null counts as empty."""
        return b"".join(map(self.__getitem__, self.chunks(text))) if text else b""


#: Bytes of text worked on at a time; entries and ids that a table holds before it is emptied.
SLICE, MOST_ENTRIES, MOST_IDS = 1 << 18, 700_000, 1 << 22
_U = np.uint64


def _bytes_table(chosen: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chosen)] = True
    return table


_WS, _PUNCT = _bytes_table(b" \n"), _bytes_table(b",.;:!?|")
_ALNUM = _bytes_table(bytes(b for b in range(128) if chr(b).isalnum()))
#: Second byte of the letters U+00C0 to U+00FF, whose first one is 0xC3; the others are a multiplication and a division sign.
_LATIN = _bytes_table(bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)))
#: Bytes with which something may begin that the arrays don't deal with.
_ODD = _bytes_table(bytes([*range(10), *range(0x0B, 0x20), ord("<"), 0xC2, 0xE1, 0xE2, 0xE3]))
_ODD_TEXT = re.compile(r"[^\S \n]|[\x00-\x09\x0b-\x1f\u180e]|<\|")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


class ChunkTable:
    """Chunks of at most 16 bytes, as two numbers, -> entries. Open addressing in arrays that double as they fill."""

    def __init__(self):
        self.n = 0
        self._make(1 << 14)

    def _make(self, slots: int) -> None:
        self.low, self.high, self.entry = np.zeros(slots, _U), np.zeros(slots, _U), np.full(slots, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * _U(0x9E3779B97F4A7C15))) * _U(0xC2B2AE3D27D4EB4F)
        return ((x ^ (x >> _U(29))) * _U(0x165667B19E3779F9) >> _U(33)).astype(np.int64) & (len(self.entry) - 1)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entries of chunks; -1 for those that are not there."""
        at = self._slot(low, high)
        found = self.entry[at]
        left = np.flatnonzero((found >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.entry) - 1)
            now = at[left]
            found[left] = self.entry[now]
            left = left[(found[left] >= 0) & ((self.low[now] != low[left]) | (self.high[now] != high[left]))]
        return found

    def add(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        """Add chunks that are not there, each once."""
        self.n += len(entry)
        if self.n > 0.7 * len(self.entry):
            held = self.entry >= 0
            low, high, entry = (np.concatenate([a[held], b]) for a, b in ((self.low, low), (self.high, high), (self.entry, entry)))
            slots = len(self.entry)
            while self.n > 0.7 * slots:
                slots *= 2
            self._make(slots)
        at, left = self._slot(low, high), np.arange(len(entry))
        while len(left):
            free = left[self.entry[at[left]] < 0]
            self.entry[at[free]] = entry[free]  # of several, the last one stays
            won = free[self.entry[at[free]] == entry[free]]
            self.low[at[won]], self.high[at[won]] = low[won], high[won]
            left = left[self.entry[at[left]] != entry[left]]
            at[left] = (at[left] + 1) & (len(self.entry) - 1)


class BatchEncoder:
    """Arrow batches of texts to ids. What it has learnt is bounded by MOST_ENTRIES and MOST_IDS, and then forgotten."""

    def __init__(self, path: str, cuts: str):
        self.single, self.cuts = ChunkEncoder(path, cuts, limit=20_000), cuts
        self._forget()

    def _forget(self) -> None:
        self.short, self.long, self.n = ChunkTable(), {}, 0
        self.first, self.count, self.ids, self.n_ids = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 15, np.uint32), 0

    def _learn(self, chunks: list[bytes]) -> None:
        """Give each chunk the next entry."""
        found = [self.single.ids_of(c.decode()) for c in chunks]
        counts = np.fromiter(map(len, found), np.int32, len(found))
        n, n_ids = self.n + len(found), self.n_ids + int(counts.sum())
        if n > len(self.count):
            self.first, self.count = (np.concatenate([a, np.zeros(n, np.int32)]) for a in (self.first, self.count))
        if n_ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(n_ids, np.uint32)])
        self.count[self.n : n] = counts
        self.first[self.n : n] = self.n_ids + np.cumsum(counts) - counts
        self.ids[self.n_ids : n_ids] = np.fromiter(chain.from_iterable(found), np.uint32, n_ids - self.n_ids)
        self.n, self.n_ids = n, n_ids

    def _starts(self, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where chunks start: at a run of white space, at common punctuation after a letter or digit, and after
        white space if that is dropped ("word") or a single line end."""
        ws = _WS[b]
        start = np.zeros(len(b), bool)
        start[bounds[:-1][bounds[:-1] < len(b)]] = True
        start[1:] |= ws[1:] & ~ws[:-1]
        left = _ALNUM[b]
        left[1:] |= _LATIN[b[1:]] & (b[:-1] == 0xC3)
        start[1:] |= _PUNCT[b[1:]] & left[:-1]
        if self.cuts == "word":
            start[1:] |= ~ws[1:] & ws[:-1]
        else:
            start[2:] |= ~ws[2:] & (b[1:-1] == 10) & ~ws[:-2]
        return np.flatnonzero(start)

    def _plain(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, places in them where texts begin and end) of texts without anything odd."""
        if self.n > MOST_ENTRIES or self.n_ids > MOST_IDS:
            self._forget()
        size = int(bounds[-1] - bounds[0])
        b, bounds = np.concatenate([data[bounds[0] : bounds[-1]], np.zeros(16, np.uint8)]), bounds - bounds[0]
        if self.cuts == "word":
            b = _LOWER[b]
        at = self._starts(b[:size], bounds)
        length = np.diff(at, append=size)
        if self.cuts == "word":
            kept = ~_WS[b[at]]
            at, length = at[kept], length[kept]
        window = np.ndarray((len(b) - 7,), "<u8", buffer=b, strides=(1,))
        low, high = window[at] & _MASK[np.minimum(length, 8)], window[at + 8] & _MASK[np.clip(length - 8, 0, 8)]
        entry = self.short.find(low, high)
        over = np.flatnonzero(length > 16)
        entry[over] = 0
        new = np.flatnonzero(entry < 0)
        if len(new):
            new = new[np.lexsort((high[new], low[new]))]
            once = np.r_[True, (low[new[1:]] != low[new[:-1]]) | (high[new[1:]] != high[new[:-1]])]
            base, raw = self.n, memoryview(b)
            heads = new[once]
            self._learn([bytes(raw[i : i + k]) for i, k in zip(at[heads].tolist(), length[heads].tolist())])
            entry[new] = base + np.cumsum(once) - 1
            self.short.add(low[heads], high[heads], entry[heads])
        if len(over):
            raw = memoryview(b)
            chunks = [bytes(raw[i : i + k]) for i, k in zip(at[over].tolist(), length[over].tolist())]
            unseen = [c for c in dict.fromkeys(chunks) if c not in self.long]
            base = self.n
            self._learn(unseen)
            self.long.update((c, base + k) for k, c in enumerate(unseen))
            entry[over] = [self.long[c] for c in chunks]
        count = self.count[entry].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.first[entry] - (ends - count), count) + np.arange(total)]
        return ids, np.r_[0, ends][np.searchsorted(at, bounds)]

    def _whole(self, data: np.ndarray, a: int, b: int) -> tuple[list[np.ndarray], int]:
        """Ids of one long text, about a slice at a time."""
        parts, n = [], 0
        while a < b:
            end = b
            if b - a > SLICE:
                # A single space between others: a chunk starts there.
                raw = data[a : a + SLICE]
                places = np.flatnonzero((raw[1:] == 32) & ~_WS[raw[:-1]])
                end = a + int(places[-1]) + 1 if len(places) else b
            ids, _ = self._plain(data, np.array([a, end]))
            parts.append(ids)
            n += len(ids)
            a = end
        return parts, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i] : offsets[i + 1]]. Null texts count as empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        n = len(texts)
        _, places, raw = texts.buffers()
        bounds = np.frombuffer(places, np.int32, n + 1, 4 * texts.offset).astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        odd = {i for i in np.unique(np.searchsorted(bounds, bounds[0] + np.flatnonzero(_ODD[data[bounds[0] : bounds[-1]]]), "right") - 1).tolist() if _ODD_TEXT.search(texts[i].as_py())}
        parts, offsets, i, total = [], np.zeros(n + 1, np.int64), 0, 0
        stops = [*sorted(odd), n]
        while i < n:
            if i in odd or bounds[i + 1] - bounds[i] > SLICE:
                if i in odd:
                    found = [np.frombuffer(self.single.encode(texts[i].as_py()), "<u4")]
                    k = len(found[0])
                else:
                    found, k = self._whole(data, int(bounds[i]), int(bounds[i + 1]))
                parts += found
                total += k
                offsets[i + 1] = total
                i += 1
                continue
            while stops[0] <= i:
                stops.pop(0)
            j = min(stops[0], max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, "right")) - 1))
            ids, ends = self._plain(data, bounds[i : j + 1])
            parts.append(ids)
            offsets[i : j + 1] = total + ends
            total += len(ids)
            i = j
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), offsets

    def encode_with_end(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """encode(), with an id after each text."""
        ids, offsets = self.encode(texts)
        if end_id is None:
            return ids, offsets
        return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))


@lru_cache(maxsize=1)
def encoder(path: str, cuts: str) -> BatchEncoder:
    """One encoder for each Python worker, over all tasks that it runs; what other operators left there goes first."""
    release()
    made = BatchEncoder(path, cuts)
    trim()  # reading the vocabulary takes more than holding it
    return made


CACHES.append(encoder.cache_clear)
