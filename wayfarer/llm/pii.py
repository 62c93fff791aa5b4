"""Personal data: patterns propose spans, checksums confirm them, context words weigh them.

Built from DataFrame functions alone. A kind's pattern is applied twice to a text: once for the
matches and once for what lies between them, so positions follow from lengths, and nothing has to
look for a match again. Positions count code points.

Kinds with ``base`` count wherever pattern and check agree. The others are ambiguous by shape: their
score (``weight``, and ``lift`` more for a context word in the 60 characters before or the 30 after)
must reach 0.5, and they must not overlap a base span.

Patterns start only where a run of their first characters starts or the previous match ended (\\G),
and repeat possessively: the same matches as the plain forms, in linear time and constant stack.

Running figures, such as positions, go along matches in fold(): BLOCK at a time, so that results are not
copied once for each match, and the time is linear in the matches.

Null texts count as empty; null and repeated doc_ids are rows like others; other columns, whatever
their names, are left alone. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

BEFORE, AFTER, ENOUGH = 60, 30, 0.5
#: No pattern matches fewer characters.
SHORTEST = 4
#: Characters of a ``rest``, at most: 30 with a space before each.
LONGEST_REST = 60
#: Results that fold() gathers before it hands them on.
BLOCK = 128


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn check digit."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 when divided by 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _ip_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.ltrim(part, F.lit("0"))
        return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))

    return F.forall(F.split(match, "[.]"), small)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: Callable[[Column], Column]
    gate: str  # a text without a match of this cheap pattern has no span
    context: str  # words that raise the score, in lower case
    weight: float
    lift: float = 0.3
    base: bool = True
    rest: str | None = None  # what may follow the pattern's match; spans end within it, at the last place that passes


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "@", "mail|contact|write", 0.7),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip_parts, r"[0-9]\.[0-9]", "ip|host|server|address", 0.6),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])", lambda m: luhn(_digits(m)), r"[0-9](?:[\x20-]?[0-9]){11}", "card|visa|credit|pay", 0.6),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), r"\+", "phone|tel|call|fax|mobile", 0.6),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?+[A-Z0-9]){11})", mod97, "[A-Z]{2}[0-9]{2}", "iban|account|bank", 0.6, base=False, rest=r"(?=((?:\x20?+[A-Z0-9]){11,30}+[A-Za-z0-9]?+))"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), "[0-9]{3}-[0-9]{2}-", "ssn|social security|national id|tax id", 0.3, base=False),
    Kind("local_phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", lambda m: F.lit(True), r"[0-9]{3}[\x20.-][0-9]{4}", "phone|tel|call|fax|mobile", 0.3, base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)
_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"
_CUT = "struct<start:int,end:int,kind:string>"


def fold(count: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]]) -> Column:
    """Array of the values that step(state, i) gives, for i from 0 to count - 1: (next state, whether it gives one, value)."""
    none = F.array().cast(f"array<{kind}>")

    def one(so_far: Column, i: Column) -> Column:
        after, gives, value = step(so_far, i)
        held = F.when(gives, F.concat(so_far["held"], F.array(value))).otherwise(so_far["held"])
        return F.struct(*[after[k].alias(k) for k in state], held.alias("held"))

    def block(so_far: Column, b: Column) -> Column:
        first = F.struct(*[so_far[k].alias(k) for k in state], none.alias("held"))
        inner = F.aggregate(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, count) - 1), first, one)
        # An array of one, so that what the block gives is worked out once.
        done = F.transform(F.array(inner), lambda x: F.struct(*[x[k].alias(k) for k in state], F.concat(so_far["blocks"], F.array(x["held"])).alias("blocks")))
        return F.element_at(done, 1)

    start = F.struct(*[v.alias(k) for k, v in state.items()], F.array().cast(f"array<array<{kind}>>").alias("blocks"))
    run = F.aggregate(F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int")), start, block, lambda x: F.flatten(x["blocks"]))
    return F.when(count > 0, run).otherwise(none)


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(BEFORE)), F.lit("\n"), F.left(after, F.lit(AFTER))))
    return F.lit(kind.weight) + F.when(near.rlike(rf"\b(?:{kind.context})"), kind.lift).otherwise(0.0)


def _whole(kind: Kind, head: Column, rest: Column) -> Column:
    """The longest of head and a part of rest, up to the end of a word, that passes the check; null if none does."""
    compact = lambda n: F.concat(head, F.replace(F.left(rest, n), F.lit(" "), F.lit("")))

    def ends(n: Column) -> Column:
        fits = F.left(rest, n).rlike("[A-Z0-9]$") & ~F.substring(rest, n + 1, F.lit(1)).rlike("[A-Za-z0-9]") & F.length(compact(n)).between(15, 34)
        return F.when(fits, kind.check(compact(n))).otherwise(False)

    best = F.array_max(F.filter(F.sequence(F.lit(11), F.length(rest)), ends))
    return F.concat(head, F.left(rest, best))


def _spans(kind: Kind, rank: int, between: Column, matches: Column, rests: Column | None) -> Column:
    """Spans of a kind that pass, in order. A running position and the last characters go along the matches."""

    def ahead(i: Column, reach: int) -> Column:
        """The text after match i, later matches included: enough pieces for ``reach`` characters."""
        pieces = F.transform(F.sequence(F.lit(1), F.lit(-(-reach // SHORTEST))), lambda j: F.array(F.left(F.get(between, i + j), F.lit(reach)), F.get(matches, i + j)))
        return F.left(F.array_join(F.flatten(pieces), ""), F.lit(reach))

    def step(so_far: Column, i: Column) -> tuple[dict[str, Column], Column, Column]:
        gap, match = F.get(between, i), F.get(matches, i)
        before = F.right(F.concat(so_far["before"], gap), F.lit(BEFORE))
        after = ahead(i, AFTER)
        start = so_far["at"] + F.length(gap)
        at = end = start + F.length(match)
        if rests is None:
            passed = kind.check(match)
        else:  # a span starts after the last one's end
            found = _whole(kind, match, F.get(rests, i))
            longer = F.coalesce(F.length(found), F.length(match))
            end, after = start + longer, F.substring(ahead(i, AFTER + LONGEST_REST), longer - F.length(match) + 1, F.lit(AFTER))
            passed = found.isNotNull() & (start >= so_far["end"])
        score = _score(kind, before, after)
        passed = passed if kind.base else passed & (score >= ENOUGH)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
        last = F.when(passed, end).otherwise(so_far["end"])
        return {"at": at, "end": last, "before": F.right(F.concat(before, match), F.lit(BEFORE))}, passed, span

    return fold(F.size(matches), {"at": F.lit(0), "end": F.lit(0), "before": F.lit("")}, _SPAN, step)


def _apart_left(spans: Column) -> Column:
    """Spans in order, with ok: no base span that starts before a span that isn't base, or with it, reaches into it."""

    def step(so_far: Column, i: Column) -> tuple[dict[str, Column], Column, Column]:
        x = F.get(spans, i)
        base = x["rank"] < len(BASE)
        value = F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "score")], (base | (so_far["reach"] <= x["start"])).alias("ok"))
        return {"reach": F.when(base, F.greatest(so_far["reach"], x["end"])).otherwise(so_far["reach"])}, F.lit(True), value

    return fold(F.size(spans), {"reach": F.lit(0)}, _SPAN.replace(">", ",ok:boolean>"), step)


def _apart_right(spans: Column) -> Column:
    """Of spans in reverse order those that are ok and that no later base span begins within."""

    def step(so_far: Column, i: Column) -> tuple[dict[str, Column], Column, Column]:
        x = F.get(spans, i)
        base = x["rank"] < len(BASE)
        value = F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "score")])
        return {"next": F.when(base, x["start"]).otherwise(so_far["next"])}, base | (x["ok"] & (so_far["next"] >= x["end"])), value

    return fold(F.size(spans), {"next": F.lit((1 << 31) - 1)}, _SPAN, step)


def find(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Add the accepted spans of every whole text: array of (start, rank, end, kind, score), by start, then kind as listed."""
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    m, b, r, s = ({k.name: unused(f"{what}_{k.name}", [*docs.columns, into]) for k in KINDS} for what in ("matches", "between", "rests", "found"))
    every, left = (unused(n, [*docs.columns, into]) for n in ("every_span", "spans_apart"))
    out = docs.withColumns({m[k.name]: F.when(body.rlike(k.gate), F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")) for k in KINDS})
    out = out.withColumns({b[k.name]: F.when(F.size(m[k.name]) > 0, F.split(body, k.pattern, -1)) for k in KINDS})
    out = out.withColumns({r[k.name]: F.when(F.size(m[k.name]) > 0, F.regexp_extract_all(body, F.lit(k.pattern + k.rest), F.lit(1))) for k in KINDS if k.rest})
    out = out.withColumns({s[k.name]: _spans(k, i, F.col(b[k.name]), F.col(m[k.name]), F.col(r[k.name]) if k.rest else None) for i, k in enumerate(KINDS)})
    of = lambda base: [F.size(s[k.name]) for k in KINDS if k.base == base]
    mixed = (sum(of(True), F.lit(0)) > 0) & (sum(of(False), F.lit(0)) > 0)
    out = out.withColumn(every, F.array_sort(F.concat(*[F.col(s[k.name]) for k in KINDS])))
    out = out.withColumn(left, F.when(mixed, F.reverse(_apart_left(F.col(every)))))
    return out.select(*kept, F.when(F.col(left).isNotNull(), F.reverse(_apart_right(F.col(left)))).otherwise(F.col(every)).alias(into))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(name: str, x: Column) -> Column:
    return x["kind"] == name


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the numbers of base spans, a digest of them, all spans, their scores."""
    found = find(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "spans")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    numbers = [F.size(F.filter("spans", partial(_of_kind, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *numbers, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.transform("spans", lambda x: x["score"]).alias("scores"))


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Replace every accepted span by its kind in angle brackets; overlapping spans by the first's.

    Texts are cut as four-byte code points, so each cut costs only its own length. A text without
    spans, null included, stays as it is. n_chars, where the table has it, follows the new text.
    """
    spans, cuts, wide = (unused(n, docs.columns) for n in ("spans", "cuts", "wide"))
    found = find(docs, text, spans)

    def merge(so_far: Column, i: Column) -> tuple[dict[str, Column], Column, Column]:
        x, last = F.get(spans, i), F.struct(*[so_far[c].alias(c) for c in ("start", "end", "kind")])
        wider = (i < F.size(spans)) & (so_far["end"] > x["start"])
        after = {c: F.when(wider, F.greatest(so_far["end"], x["end"]) if c == "end" else so_far[c]).otherwise(x[c]) for c in ("start", "end", "kind")}
        return after, ~wider & (so_far["end"] >= 0), last

    # One step more than there are spans gives the last cut.
    merged = found.withColumn(cuts, F.when(F.size(spans) > 0, fold(F.size(spans) + 1, {"start": F.lit(-1), "end": F.lit(-1), "kind": F.lit("")}, _CUT, merge)))
    merged = merged.withColumn(wide, F.when(F.col(cuts).isNotNull(), F.encode(text, "UTF-32")))

    def part(start: Column, length: Column) -> Column:
        # A character in front keeps a byte-order mark at the cut from being dropped.
        raw = F.concat(F.lit(bytearray(b"\0\0\0x")), F.substring(F.col(wide), start * 4 + 1, length * 4))
        return F.substring(F.decode(raw, "UTF-32"), F.lit(2), length)

    def piece(x: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(F.col(cuts), i - 1)["end"])
        return F.concat(part(begin, x["start"] - begin), F.lit("<"), F.upper(x["kind"]), F.lit(">"))

    tail = F.element_at(cuts, -1)["end"]
    rest = part(tail, F.length(text) - tail)
    new = F.when(F.col(cuts).isNotNull(), F.concat(F.array_join(F.transform(cuts, piece), ""), rest)).otherwise(F.col(text))
    out = merged.withColumn(text, new)
    if n_chars and n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.col(cuts).isNotNull(), F.length(text).cast(kind)).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)
