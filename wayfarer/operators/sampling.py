"""Tables for weighted neighbours: prefix sums, totals, alias tables.

Sums of fractions depend on the order they are added in, so weights are turned into whole units first:
whole-number weights stand for themselves, others are rounded to the nearest multiple of 1 / SCALE. A weight that
is negative, not a number, 2**36 or more, or over 0 but under 1 / SCALE is an error. Without weights every edge counts 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NullType, ShortType

from wayfarer.operators.structure import Graph

SCALE = 1 << 24
_GREATEST = float(1 << 36)


def units(edges: DataFrame) -> Column:
    """Weights of edges in whole units."""
    w = F.col("weight")
    if isinstance(edges.schema["weight"].dataType, (ByteType, ShortType, IntegerType, LongType, NullType)):
        bad, value = w < 0, w.cast("long")
    else:
        w = w.cast("double")
        bad, value = F.isnan(w) | (w < 0) | (w >= _GREATEST) | ((w > 0) & (w < 1 / SCALE)), F.floor(w * SCALE + 0.5).cast("long")
    error = F.raise_error(F.concat(F.lit("a weight that can't be used: "), F.col("weight").cast("string"))).cast("long")
    return F.when(bad, error).otherwise(F.coalesce(value, F.lit(1)))


def weight_accumulate(g: Graph) -> DataFrame:
    """src, pos, acc: units of a vertex's neighbours up to and with this one."""
    up_to = Window.partitionBy("src").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.edges.select("src", "pos", F.sum(units(g.edges)).over(up_to).alias("acc"))


def weight_total(g: Graph) -> DataFrame:
    """src, total in units."""
    return g.edges.groupBy("src").agg(F.sum(units(g.edges)).alias("total"))


def alias_slots(weights: list[int]) -> tuple[list[int], list[int]]:
    """(prob, alias) for one vertex: slot i is kept with prob[i] of total, else its alias is taken.

    Slots hold weight times degree; those below the total are filled up, first come first served,
    from those above. A slot that nothing had to fill keeps the total and the alias ``degree``.
    """
    n, total = len(weights), sum(weights)
    held = [w * n for w in weights]
    prob, alias = [total] * n, [n] * n
    small = [i for i, h in enumerate(held) if h < total]
    large = [i for i, h in enumerate(held) if h >= total]
    s = k = 0
    while s < len(small) and k < len(large):
        low, high = small[s], large[k]
        s, k = s + 1, k + 1
        prob[low], alias[low] = held[low], high
        held[high] -= total - held[low]
        (small if held[high] < total else large).append(high)
    return prob, alias


_ALIAS = pa.schema([(c, pa.int64()) for c in ("src", "pos", "prob", "alias", "total", "degree")])


def alias_table(g: Graph) -> DataFrame:
    """src, pos, prob, alias, total, degree: linear work for each vertex, many vertices a task, in order of src and pos.

    A vertex whose edges reach into the next batch is carried over to it.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_src, open_weights = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def tables(src: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(src):
                return
            cuts = [0, *(np.flatnonzero(src[1:] != src[:-1]) + 1).tolist(), len(src)]
            values, prob, alias, total, degree = weights.tolist(), [], [], [], []
            for a, b in zip(cuts, cuts[1:]):
                p, other = alias_slots(values[a:b])
                prob += p
                alias += other
                total.append(sum(values[a:b]))
                degree.append(b - a)
            sizes = np.array(degree)
            pos = np.arange(len(src)) - np.repeat(cuts[:-1], sizes)
            columns = src, pos, np.array(prob, np.int64), np.array(alias, np.int64), np.repeat(np.array(total, np.int64), sizes), np.repeat(sizes, sizes)
            yield from pa.Table.from_arrays([pa.array(c) for c in columns], schema=_ALIAS).to_batches(1 << 15)

        for batch in batches:
            if not batch.num_rows:
                continue
            src, weights = (np.concatenate([a, c.to_numpy()]) for a, c in zip((open_src, open_weights), batch.columns))
            last = int(np.searchsorted(src, src[-1]))
            yield from tables(src[:last], weights[:last])
            open_src, open_weights = src[last:], weights[last:]
        yield from tables(open_src, open_weights)

    slim = g.edges.select("src", "pos", units(g.edges).alias("units"))
    ordered = slim.repartition("src").sortWithinPartitions("src", "pos").select("src", "units")
    return ordered.mapInArrow(build, ", ".join(f"{c} long" for c in _ALIAS.names))


def alias_marginals(table: DataFrame) -> DataFrame:
    """src, pos, mass: what slots give to a neighbour in all, which is its weight in units times the degree."""
    own = table.select("src", "pos", F.col("prob").alias("mass"))
    lent = table.filter("alias < degree").select("src", F.col("alias").alias("pos"), (F.col("total") - F.col("prob")).alias("mass"))
    return own.unionByName(lent).groupBy("src", "pos").agg(F.sum("mass").alias("mass"))
