"""Reproducible random numbers: a function of seed, purpose, walk and step.

``r(tag, walk, step)`` is the number in the first fifteen hex digits of md5('<seed>:<tag>:<walk>:<step>'),
in [0, 2**60), so that a remainder by any number of vertices or sum of weights in use is as good as uniform. Any
engine with md5 gives the same walk, in whatever order and partition it runs, and a task that runs twice
draws the same again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 15
SPAN = 1 << 4 * DIGITS
#: What is drawn: source vertex, teleport test, neighbour, vertex jumped to, alias acceptance.
SOURCE, TELEPORT, NEIGHBOUR, JUMP, ACCEPT = "s", "t", "k", "v", "a"


def draw(seed: int, tag: str, walk: Column, step: Column) -> Column:
    text = F.concat(F.lit(f"{seed}:{tag}:"), walk.cast("string"), F.lit(":"), step.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def draw_value(seed: int, tag: str, walk: int, step: int) -> int:
    """The same in plain Python."""
    return int(hashlib.md5(f"{seed}:{tag}:{walk}:{step}".encode()).hexdigest()[:DIGITS], 16)


def draw_sql(seed: int, tag: str, walk: str, step: str) -> str:
    """The same in DuckDB SQL."""
    return f"CAST(('0x' || substr(md5(concat('{seed}:{tag}:', CAST({walk} AS VARCHAR), ':', CAST({step} AS VARCHAR))), 1, {DIGITS})) AS BIGINT)"


def teleport_limit(teleport: float) -> int:
    """A walk follows an edge if its draw is over this, which is a strict test of U > teleport."""
    return int(teleport * SPAN)
