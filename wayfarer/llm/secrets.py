"""Secrets in texts: listed patterns, and a linear-chain conditional random field for the others.

The field tags every token of a text as begin (B), inside (I) or outside (O) of a secret. Tokens are
runs of letters, digits and ``_+/~-``, with full stops between letters or digits; any other mark is a token
of its own, and so is a line end, which is always O and parts a text into chains. Features: the
token's shape, the kinds of the two tokens before it and the one after it on its line, whether a
keyword stands shortly before, whether it touches its neighbours, and the kind of file. Weights are
fitted by gradient ascent on the likelihood of LINES lines made by rule; they are trained on the
driver and go along with the tasks.

Scores are worked out as arrays, for whole lines of about SLICE bytes at a time. Against the path of
all O, a run of B and I gains at most the sum of its tokens' bounds and that of its end. So a token
that is in no run whose bound reaches 0 is O on the best path; the others fall into runs with O on both
sides, and Viterbi on each gives the best path of the whole text. Nothing is left out.

Base spans come from patterns alone, and always count. A span of the field that overlaps one is
dropped. Null texts count as empty; null and repeated doc_ids are rows like others. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, arrow_limits, batches_of, release
from .tokens import ChunkTable

#: Fixed patterns of the contract; {16,} and {24,} are its lengths, as the runs are maximal.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "secret")
_NAMED = (b"password", b"passwd", b"secret", b"token", b"api")

#: Lines that the field is trained on, and steps of the training.
LINES, ROUNDS = 2400, 80
STATES = ("O", "B", "I")
#: Words that speak for a secret nearby, in lower case.
KEYWORDS = frozenset("password passwd pwd pass passphrase passcode pin secret token key apikey api_key auth authorization bearer basic credential credentials private access_key secret_key client_secret signature login".split())
#: Tokens on the line before that may hold the keyword.
NEAR = 6
SLICE, MOST_ENTRIES = 1 << 20, 700_000
NEVER = -1e4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the listed patterns, by start, then kind."""
    found = []
    raw = text.encode().lower()
    if any(n in raw for n in _NAMED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# Tokens

_KIND_NAMES = ["line", "keyword", "number", "word", "mixed", *(f"mark{chr(c)}" for c in range(33, 127) if not chr(c).isalnum()), "control"]
_KIND = {name: i for i, name in enumerate(_KIND_NAMES)}
_LINE = _KIND["line"]
_ALNUM = np.zeros(256, bool)
_ALNUM[[b for b in range(256) if b >= 0x80 or chr(b).isalnum()]] = True
_WORD = _ALNUM.copy()
_WORD[list(b"_+/~-")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\x0b\x0c\r")] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def split(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) in bytes of the tokens of a text in UTF-8, in order."""
    word = _WORD[b]
    dot = np.flatnonzero(b[1:-1] == ord(".")) + 1 if len(b) > 2 else np.zeros(0, np.int64)
    word[dot[_ALNUM[b[dot - 1]] & _ALNUM[b[dot + 1]]]] = True
    start = ~_BLANK[b]
    start[1:] &= ~(word[1:] & word[:-1])
    at = np.flatnonzero(start)
    stop = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    length = np.ones(len(at), np.int64)
    length[word[at]] = stop - at[word[at]]
    return at, length


def kind(token: str) -> str:
    """What neighbours are told about a token."""
    if token == "\n":
        return "line"
    if len(token) == 1 and f"mark{token}" in _KIND:
        return f"mark{token}"
    low = token.lower()
    if low in KEYWORDS or any(p in KEYWORDS for p in re.split(r"[_./+~-]", low)):
        return "keyword"
    if token.isalpha():
        return "word"
    return "number" if re.fullmatch(r"[0-9.]+", token) else "mixed" if any(c.isalnum() for c in token) else "control"


def evenness(token: str) -> float:
    """Entropy of the characters in bits."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _size(n: int) -> int:
    return sum(n >= k for k in (2, 4, 6, 8, 12, 16, 20, 24, 32, 40))


def _looks_spoken(low: str) -> bool:
    """Whether letters read like a word: vowels enough, and no long runs without one."""
    vowels = sum(c in "aeiouyàâäáãåæèéêëìíîïòóôöõøùúûüœ" for c in low)
    return 0.2 <= vowels / len(low) <= 0.75 and not re.search("[bcdfghjklmnpqrstvwxz]{5}", low)


def shape(token: str) -> list[str]:
    """Features of a token's own form."""
    if len(token) == 1 and not token.isalnum():
        return [f"mark:{token}"]
    if token.isalpha() and (token[1:].islower() or token.isupper() or len(token) == 1):
        cases = "capitals" if token.isupper() else "first" if token[0].isupper() else "small"
        return ["letters", f"plain:{_size(len(token))}", f"spoken:{_looks_spoken(token.lower())}:{len(token) > 15}", f"plain cases:{cases}", f"plain cases:{cases}:{_size(len(token))}"]
    if not token.isascii():  # letters by case, digits, and others
        token = "".join(c if c.isascii() else "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else "_" for c in token)
    digits, upper, lower = (sum(map(f, token)) for f in (str.isdigit, str.isupper, str.islower))
    marks = len(token) - digits - upper - lower
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    inner = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:]))
    letters = re.sub("[^a-z]", "", token.lower())
    form = "other"
    for name, pattern in (
        ("number", r"[0-9.]+"), ("date", r"\d{4}-\d\d-\d\d.*"), ("parts", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), ("version", r"[A-Za-z]?\d+(\.\d+)+([-+~].*)?"), ("dashed", r"([A-Za-z]+[-_])+[A-Za-z]*\d{0,5}"),
        ("path", r".*/.*/.*|/.*|.*\.[a-z]{2,4}"), ("word_number", r"[A-Za-z]+[-_]?\d{1,4}"), ("number_word", r"\d+[A-Za-z]{1,4}"), ("camel", r"[A-Z]?[a-z]{2,}([A-Z][a-z]{2,})+"), ("capitals", r"[A-Z_-]+"),
    ):
        if re.fullmatch(pattern, token):
            form = name
            break
    known = re.match(r"ghp_|sk-|sk_|pk_|xox|eyJ|AIza|glpat-", token) is not None
    return [
        f"form:{form}",
        f"form:{form}:{_size(len(token))}",
        f"len:{_size(len(token))}",
        f"even:{int(min(evenness(token), 5) * 2)}:{len(token) > 11}",
        f"digits:{min(5, 10 * digits // len(token) // 2)}",
        f"turns:{min(6, turns)}",
        f"cases:{(upper > 0) + 2 * (lower > 0)}:{digits > 0}",
        f"marks:{min(marks, 3)}",
        f"inner:{min(inner, 4)}",
        f"spoken:{bool(letters) and _looks_spoken(letters)}",
        f"known:{known}",
    ]


class Found(NamedTuple):
    """Tokens of a piece of text, and what the context features are made of, as arrays."""

    at: np.ndarray
    length: np.ndarray
    entry: np.ndarray
    before: np.ndarray
    before2: np.ndarray
    after: np.ndarray
    near: np.ndarray
    glue: np.ndarray


class Lexicon:
    """Distinct tokens -> entries; of each its kind and whatever ``learn`` gives for it. Forgets when it is full."""

    def __init__(self, learn):
        self.learn = learn
        self.forget()

    def forget(self) -> None:
        self.short, self.long, self.kinds, self.own = ChunkTable(), {}, np.zeros(0, np.int16), []
        self.values: np.ndarray | None = None

    def _add(self, tokens: list[bytes]) -> int:
        texts = [t.decode(errors="replace") for t in tokens]
        base = len(self.kinds)
        self.kinds = np.concatenate([self.kinds, np.array([_KIND[kind(t)] for t in texts], np.int16)])
        new = self.learn(texts)
        self.values = new if self.values is None or not base else np.concatenate([self.values, new])
        return base

    def find(self, b: np.ndarray) -> Found:
        """Tokens of bytes that end with a line, or with the text."""
        if len(self.kinds) > MOST_ENTRIES:
            self.forget()
        at, length = split(b)
        padded = np.concatenate([b, np.zeros(16, np.uint8)])
        window = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
        low, high = window[at] & _MASK[np.minimum(length, 8)], window[at + 8] & _MASK[np.clip(length - 8, 0, 8)]
        entry = self.short.find(low, high)
        # A table knows chunks by their bytes alone, so NUL goes the other way.
        over = np.flatnonzero((length > 16) | (b[at] == 0))
        entry[over] = 0
        new = np.flatnonzero(entry < 0)
        raw = memoryview(padded)
        if len(new):
            new = new[np.lexsort((high[new], low[new]))]
            once = np.r_[True, (low[new[1:]] != low[new[:-1]]) | (high[new[1:]] != high[new[:-1]])]
            heads = new[once]
            base = self._add([bytes(raw[i : i + k]) for i, k in zip(at[heads].tolist(), length[heads].tolist())])
            entry[new] = base + np.cumsum(once) - 1
            self.short.add(low[heads], high[heads], entry[heads])
        if len(over):
            tokens = [bytes(raw[i : i + k]) for i, k in zip(at[over].tolist(), length[over].tolist())]
            unseen = [t for t in dict.fromkeys(tokens) if t not in self.long]
            if unseen:
                base = self._add(unseen)
                self.long.update((t, base + k) for k, t in enumerate(unseen))
            entry[over] = [self.long[t] for t in tokens]
        kinds = self.kinds[entry]
        before = np.r_[np.int16(_LINE), kinds[:-1]]
        before2 = np.where(before == _LINE, _LINE, np.r_[np.int16(_LINE), before[:-1]])
        after = np.r_[kinds[1:], np.int16(_LINE)]
        # The last keyword before a token, and the last line end.
        place = np.arange(len(at))
        last = [np.r_[-(NEAR + 2), np.maximum.accumulate(np.where(kinds == k, place, -(NEAR + 2)))[:-1]] if len(at) else place for k in (_KIND["keyword"], _LINE)]
        near = (place - last[0] <= NEAR) & (last[0] > last[1])
        touches = np.r_[False, at[1:] == at[:-1] + length[:-1]]
        glue = (touches & (before != _LINE)) + 2 * np.r_[touches[1:] & (kinds[1:] != _LINE), False].astype(int)
        return Found(at, length, entry, before, before2, after, near, glue)


def code_file(raw: bytes) -> bool:
    """Whether a text looks like code."""
    return 40 * sum(map(raw.count, (b"=", b"{", b"}", b";"))) > len(raw)


# The field


class Field:
    """Scores of the field: of a token's own features by name, of each context, and of each pair of states."""

    def __init__(self, own: dict[str, np.ndarray], context: dict[str, np.ndarray], moves: np.ndarray):
        self.own, self.context, self.moves = own, context, moves
        self.name = hashlib.md5(pickle.dumps((own, context, moves))).hexdigest()
        self._lexicon: Lexicon | None = None

    def __reduce__(self):
        return _known_field, (self.name, self.own, self.context, self.moves)

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            known: dict[tuple[str, ...], np.ndarray] = {}

            def learn(tokens: list[str]) -> np.ndarray:
                out = np.empty((len(tokens), 3))
                for i, t in enumerate(tokens):
                    names = tuple(shape(t))
                    if (score := known.get(names)) is None:
                        score = known[names] = sum((self.own[n] for n in names if n in self.own), np.zeros(3))
                    out[i] = (0, NEVER, NEVER) if t == "\n" else score
                return out

            self._lexicon = Lexicon(learn)
        return self._lexicon

    def scores(self, found: Found, code: np.ndarray) -> np.ndarray:
        """Scores of the states of every token; code: whether it is in a file of code, 0 or 1."""
        c = self.context
        total = self.lexicon.values[found.entry] + c["before"][found.before] + c["before2"][found.before2] + c["after"][found.after]
        return total + c["near"][found.near * len(_KIND_NAMES) + found.before] + c["glue"][found.glue] + c["file"][code]

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi: the best states, from O to O. I can't follow O."""
        best, back = self.moves[0] + scores[0], []
        for s in scores[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(0))
            best = step.max(0) + s
        states = [int((best + self.moves[:, 0]).argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]

    def runs(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """Runs of tokens that may be something else than O on the best path, by the bound of the module's docstring."""
        m = self.moves
        gain = np.maximum(scores[:, 1] + m[:, 1].max(), scores[:, 2] + m[1:, 2].max()) - scores[:, 0] - m[0, 0]
        gain = np.maximum(gain, NEVER)
        end = max(m[1, 0], m[2, 0]) - m[0, 0]
        sums = np.cumsum(gain)
        up_to = sums - np.minimum.accumulate(np.r_[0, sums[:-1]])  # best sum of a run that ends here
        back = np.cumsum(gain[::-1])
        from_here = (back - np.minimum.accumulate(np.r_[0, back[:-1]]))[::-1]
        may = np.flatnonzero(up_to + from_here - gain + end >= -1e-3)
        if not len(may):
            return []
        heads = np.flatnonzero(np.r_[True, np.diff(may) > 1])
        return list(zip(may[heads].tolist(), (may[np.r_[heads[1:] - 1, len(may) - 1]] + 1).tolist()))

    def batch_spans(self, raws: list[bytes]) -> list[list[tuple[int, int]]]:
        """(start, end) in bytes of the secrets of texts in UTF-8. Pieces of whole lines are worked on together."""
        out: list[list[tuple[int, int]]] = [[] for _ in raws]
        held: list[tuple[int, int, bytes, bool]] = []  # text, offset in it, piece, code
        size = 0

        def work() -> None:
            starts = np.cumsum([0, *(len(h[2]) + 1 for h in held)])
            found = self.lexicon.find(np.frombuffer(b"\n".join(h[2] for h in held), np.uint8))
            if not len(found.at):
                return
            piece = np.searchsorted(starts, found.at, "right") - 1
            scores = self.scores(found, np.array([h[3] for h in held], np.int64)[piece])
            for first, last in self.runs(scores):
                doc, offset, *_ = held[piece[first]]
                shift = offset - int(starts[piece[first]])
                for i, state in enumerate(self.decode(scores[first:last]), first):
                    end = shift + int(found.at[i] + found.length[i])
                    if state == 1:
                        out[doc].append((shift + int(found.at[i]), end))
                    elif state == 2:
                        out[doc][-1] = out[doc][-1][0], end

        for doc, raw in enumerate(raws):
            code, at = code_file(raw), 0
            while at < len(raw):
                end = len(raw)
                if end - at > SLICE:
                    end = raw.rfind(b"\n", at, at + SLICE) + 1 or raw.find(b"\n", at + SLICE) + 1 or end
                held.append((doc, at, raw[at:end], code))
                size, at = size + end - at, end
                if size >= SLICE:
                    work()
                    held, size = [], 0
        if held:
            work()
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) in code points of the secrets of a text."""
        raw = text.encode(errors="replace")
        return in_code_points(raw, self.batch_spans([raw])[0])


#: The field of a Python worker, over all tasks that it runs, with the tokens that it knows.
_fields: dict[str, Field] = {}
CACHES.append(_fields.clear)


def _known_field(name: str, own: dict[str, np.ndarray], context: dict[str, np.ndarray], moves: np.ndarray) -> Field:
    if name not in _fields:
        release()
        _fields[name] = Field(own, context, moves)
    return _fields[name]


def in_code_points(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in bytes of a text in UTF-8, in code points."""
    out, at, n = [], 0, 0
    for a, b in spans:
        start = n + len(raw[at:a].decode())
        at, n = b, start + len(raw[a:b].decode())
        out.append((start, n))
    return out


def lines_by_rule(n: int = LINES, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Lines, with the places of their secrets: {} in a template stands for one, {w} for a word, {x} for something harmless, {z} for noise."""
    r = random.Random(seed)
    upper, lower, digits, marks = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!@#$%^&*?"
    beginnings, middles, ends = ("b br c d f g gr h l m n p pr r s st t tr v w".split() + [""], "a e i o u ai ea ou io".split(), "n r s t l nd nt lk ng".split() + [""] * 4)

    def chars(alphabet: str, k: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(k))

    def both(alphabet: str, k: int) -> str:
        while True:
            s = chars(alphabet, k)
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
                return s

    def word() -> str:
        return "".join(r.choice(beginnings) + r.choice(middles) + r.choice(ends) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def leet() -> str:
        s = word() + r.choice(("", word()))
        s = "".join({"a": "@", "s": "$", "o": "0", "e": "3", "i": "1"}.get(c, c) if r.random() < 0.6 else c for c in s)
        return s.capitalize() + chars(digits, r.randint(0, 3)) + r.choice(marks)

    def noise() -> str:
        """Words and runs of marks, as in markup, code and junk."""
        out = []
        for _ in range(r.randint(2, 7)):
            run = r.choice("#$%&*!@^~=|<>_-+?/") * r.choice((1, 1, 2, 3, 3, 4))
            w = r.choice((word(), word(), word().capitalize(), chars(digits, r.randint(1, 3))))
            out.append(r.choice((w + run, w + run, run + w, run, w, run + w + run)) + r.choice(("", "", "", ",", ".", ":")))
        return " ".join(out).upper() if r.random() < 0.2 else " ".join(out)

    alnum = upper + lower + digits
    strong = [  # told by their form, wherever they stand
        lambda: both(alnum + "+/", r.choice((24, 32, 40, 44))),
        lambda: r.choice(("ghp_", "sk-", "sk_live_", "glpat-", "xoxb-")) + both(alnum, r.choice((20, 24, 32, 36))),
        lambda: both(lower + digits, r.choice((20, 24, 32))),
        lambda: both(alnum, r.choice((16, 20, 22))),
        lambda: "eyJ" + both(alnum, 20) + "." + both(alnum + "-_", 40) + "." + both(alnum + "-_", 30),
    ]
    weak = [  # told by what stands before them
        lambda: chars(upper + lower, r.choice((10, 16, 24, 32))),
        lambda: chars(digits, r.choice((4, 6, 8, 12, 16))),
        leet,
        leet,
        lambda: word() + word() + chars(digits, r.randint(1, 4)),
        lambda: word() + r.choice(marks) + word(),
        lambda: both(alnum, r.choice((6, 8, 10, 12))),
        lambda: word() + word(),
        lambda: "-".join(word() for _ in range(r.randint(3, 5))),
    ]
    harmless = [
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}" + r.choice(("", f"T{r.randint(10, 23)}")),
        lambda: f"{word()}-{r.randint(1, 9999)}",
        lambda: f"{word()}{r.randint(1, 999)}",
        lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}" + r.choice(("", f"-rc{r.randint(1, 9)}")),
        lambda: f"www.{word()}.example/{word()}/{r.randint(1, 999)}",
        lambda: f"https://{word()}.{word()}.example/{word()}/{word()}.html?id={r.randint(1, 9999)}&{word()}={word()}",
        lambda: f"{word()}_{word()}_{r.randint(1, 99)}",
        lambda: f"{word()}_{word()}({word()}, {word()})",
        lambda: "-".join(chars("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: f"{word()}.{word()}{r.randint(1, 99)}.{word()}",
        lambda: f"{r.randint(100, 999)}{word()}{r.randint(1, 9)}",
        lambda: f"{chars(upper, 3)}-{r.randint(1000, 2030)}-{r.randint(1000, 99999)}",
        lambda: f"{word()}@{word()}.example",
        lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}",
        lambda: f"+{r.randint(1, 99)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}",
        lambda: " ".join(chars(digits, 4) for _ in range(4)),
        lambda: str(r.randint(0, 10**r.randint(1, 9))),
        lambda: f"{word()}{word().capitalize()}{word().capitalize()}",
        lambda: word().upper(),
        lambda: f"#{word()} & {word()}!",
        lambda: f"{word()}{r.choice(marks)}",
        lambda: f"$ {r.randint(1, 9999)},{r.randint(10, 99)}",
        lambda: "*" * r.randint(1, 9) + " " + "|#%&<>"[r.randint(0, 5)],
    ]
    told = [
        'pwd = "{}"', "pwd: {}", "pwd={}", "Authorization: Bearer {}", "authorization: Basic {}", "bearer {}", "client_secret: '{}'", "export AUTH_KEY={}", "AUTH_KEY={}", "auth: '{}'", "passphrase = \"{}\"", "passcode: {}", "PIN: {}", "pin = {}",
        "credential={}", "credentials: {w} / {}", "login {w} pass {}", "{w} {w} private key is {}", "access_key '{}';", "secret_key = {}", "signature={}&{w}={w}", '"client_secret": "{}",', "the pwd for {w} is {}", "your passcode is {} {w} {w}", "--pass {} --{w} {w}", "my pin is {}, {w}", "{w}_pwd = '{}'",
    ]
    untold = ["{w} {w} {} {w}", "{w} = {};", "{w}: {}", "key {}", "{w} key is {} {w} {w}", "{}", "{w}({})", "{w}={}&{w}={w}"]
    plain = [
        "{w} {w} {x} {w} {w}", "{w}: {x}", "{w} = {x};", "({x}) {w}", "{w} {x}", "{x}, {w}, {w}", "{w} | {x} | {w}", "key {w} {w} {x}", "{w} version {x}", "id={x}", "{x}", "{w} {w} {w}. {W} {w} {w}, {w} {w} {w} {w}.", "{W} {w} {w} {w}", "{w}, {w} {w}; {w} {w}?", "the key {w} {w} {w}", "a private {w} {w}", "pass the {w} {w}",
        "login {w} {w} page", "{w} signature {w} on {x}", "access key {w} {w}", "{w} {w} pin {w} {w}", "credentials {w} {w} {x}", "bearer of {w} {w}", "{W} {w} auth {w}.", "basic {w} {w} {w}", "pin {w} to {w}", "{w}.{w}({w}, {x})", "if ({w} == {x}) {{ {w} = {w}; }}", "the pwd {w} {w} {w}", "{w} pass {w} {w}, {w}", "keyword {w}: {w}", "{x} {x}", "{w}! {w}? {w} - {w}",
        "{z}", "{z}", "{z}", "{w} {z}", "{z} {w} {w}", "{W} {w}. {z}", "{w} = {z}", "key {z}", "the pass {z}", "{w}: {z}", "| {w} | {x} | {z} |",
    ]
    for i in range(n):
        if i % 2 == 0:
            text, what = (r.choice(told), r.choice(strong + weak + weak)()) if i % 4 == 0 or r.random() < 0.3 else (r.choice(untold), r.choice(strong)())
        else:
            text, what = r.choice(plain), None
        while "{z}" in text:
            text = text.replace("{z}", noise(), 1)
        while "{x}" in text:
            text = text.replace("{x}", r.choice(harmless)(), 1)
        while "{w}" in text:
            text = text.replace("{w}", word(), 1)
        while "{W}" in text:
            text = text.replace("{W}", word().capitalize(), 1)
        text = text.replace("{{", "{").replace("}}", "}")
        if what is None:
            yield text, []
        else:
            at = text.index("{}")
            yield text.replace("{}", what), [(at, at + len(what))]


@lru_cache(maxsize=1)
def train(n: int = LINES, rounds: int = ROUNDS, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Maximum likelihood on lines_by_rule(n), a chain a line, padded to the longest; Adam steps."""
    names: dict[str, int] = {}
    index = lambda name: names.setdefault(name, len(names))
    own_names: list[list[int]] = []

    def learn(tokens: list[str]) -> np.ndarray:
        own_names.extend([index(f"own {s}") for s in shape(t)] for t in tokens)
        return np.zeros((len(tokens), 3))

    lexicon, chains, tags = Lexicon(learn), [], []
    for text, secrets in lines_by_rule(n):
        found, code = lexicon.find(np.frombuffer(text.encode(), np.uint8)), code_file(text.encode())
        context = [[index(f"before {x}"), index(f"before2 {y}"), index(f"after {z}"), index(f"near {near * len(_KIND_NAMES) + x}"), index(f"glue {g}"), index(f"file {int(code)}")] for x, y, z, near, g in zip(*(c.tolist() for c in found[3:]))]
        chains.append([own_names[e] + c for e, c in zip(found.entry.tolist(), context)])
        tags.append([next((1 if a == s else 2 for s, e in secrets if s <= a and a + k <= e), 0) for a, k in zip(found.at.tolist(), found.length.tolist())])
    count, longest, most = len(chains), max(map(len, chains)), max(len(t) for c in chains for t in c)
    width = len(names)  # the last place is for padding
    x, mask, gold = np.full((count, longest, most), width, np.int32), np.zeros((count, longest), bool), np.zeros((count, longest), np.int64)
    for i, (chain, tag) in enumerate(zip(chains, tags)):
        mask[i, : len(tag)], gold[i, : len(tag)] = True, tag
        for j, f in enumerate(chain):
            x[i, j, : len(f)] = f
    flat = x[mask]
    no = np.array([[0, 0, NEVER], [0, 0, 0], [0, 0, 0.0]])  # I can't follow O
    seen = np.zeros((3, 3))
    for tag in tags:
        np.add.at(seen, ([0, *tag], [*tag, 0]), 1)
    truth = np.eye(3)[gold]
    params = np.zeros(((width + 1) + 3, 3))
    mean, square = np.zeros_like(params), np.zeros_like(params)

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        m = a.max(axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        weights, t = params[: width + 1], params[width + 1 :] + no
        s = np.zeros((count, longest, 3))
        s[mask] = weights[flat].sum(1)
        s[~mask] = [0, NEVER, NEVER]  # beyond the end: O
        a, b = [t[0] + s[:, 0]], [np.tile(t[:, 0], (count, 1))]
        for j in range(1, longest):
            a.append(lse(a[-1][:, :, None] + t, 1) + s[:, j])
        for j in range(longest - 1, 0, -1):
            b.append(lse(t + (s[:, j] + b[-1])[:, None, :], 2))
        b.reverse()
        z = lse(a[-1] + b[-1], 1)
        p = np.exp(np.stack(a, 1) + np.stack(b, 1) - z[:, None, None])
        pair = np.zeros((3, 3))
        pair[0] += p[:, 0].sum(0)
        for j in range(1, longest):
            both = np.exp(a[j - 1][:, :, None] + t + (s[:, j] + b[j])[:, None, :] - z[:, None, None])
            pair += both[mask[:, j]].sum(0)
        pair[:, 0] += p[np.arange(count), mask.sum(1) - 1].sum(0)
        off = (truth - p)[mask]
        grad = np.stack([np.bincount(flat.ravel(), np.repeat(off[:, k], most), width + 1) for k in range(3)], 1)
        grad = np.concatenate([grad, seen - pair]) / count - decay * params
        grad[width] = 0
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        params += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.round(params[: width + 1], 4)
    of = {name: weights[i] for name, i in names.items()}
    kinds = len(_KIND_NAMES)
    context = {what: np.array([of.get(f"{what} {i}", np.zeros(3)) for i in range(k)]) for what, k in (("before", kinds), ("before2", kinds), ("after", kinds), ("near", 2 * kinds), ("glue", 4), ("file", 2))}
    return Field({name[4:]: w for name, w in of.items() if name.startswith("own ")}, context, np.round(params[width + 1 :], 4) + no)


_ROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: doc_id, numbers of base spans by kind, a digest of them, all spans."""
    arrow_limits(docs.sparkSession)
    field = field or train()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            texts = [value.as_py() or "" for value in batch.column(1)]
            raws = [text.encode() for text in texts]
            for doc_id, text, raw, found in zip(batch.column(0).to_pylist(), texts, raws, field.batch_spans(raws)):
                base = base_spans(text)
                more = [(a, 3, b) for a, b in in_code_points(raw, found) if not any(a < e and s < b for s, _, e in base)] if found else []
                n = Counter(k for _, k, _ in base)
                yield doc_id, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda b: batches_of(rows(b), _ROW), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
