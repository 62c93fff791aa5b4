"""Blocks: contiguous vertex ranges with at most a budget of edges; a larger hub has one of its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.operators.structure import Graph, csr_offsets, out_degree
from wayfarer.shared import drop_written, written

BLOCK_BYTES = 64 << 20
DEFAULT_BUDGET = BLOCK_BYTES // 4


def greedy_starts(totals: np.ndarray, budget: int) -> list[int]:
    """First units of the blocks; totals[i] is the number of edges before unit i, with the sum at the end."""
    starts, s, n = [], 0, len(totals) - 1
    while s < n:
        starts.append(s)
        s = max(s + 1, int(np.searchsorted(totals, totals[s] + budget, "right")) - 1)
    return starts


#: Vertices whose offsets the driver looks at together (16 bytes each).
SEGMENT = 1 << 22


def split_blocks(g: Graph, budget: int = DEFAULT_BUDGET, segment: int = SEGMENT) -> DataFrame:
    """blk, start_vert, nverts, start_edge, nedges.

    Each cut depends on the one before. So the driver steps from cut to cut, over the written offsets of one
    segment of vertices at a time: a job for each segment, whatever the number of blocks. It holds a segment and the blocks.
    """
    spark, n, edges = g.spark, g.nvertices, g.nedges
    schema = "blk long, start_vert long, nverts long, start_edge long, nedges long"
    if not n:
        return spark.createDataFrame([], schema)
    offsets = written(csr_offsets(g).select(F.col("id").alias("v"), F.col("beg_pos").alias("b")).repartitionByRange("v").sortWithinPartitions("v"), "offsets")
    verts, begins = [0], [0]
    for low in range(0, n, segment):
        high = min(low + segment, n)
        found = offsets.filter((F.col("v") >= low) & (F.col("v") <= high)).toArrow()
        b = np.empty(high - low + 1, np.int64)
        b[-1] = edges  # stays only at the very end
        b[found.column("v").to_numpy() - low] = found.column("b").to_numpy()
        while True:
            v = verts[-1]
            # The last vertex that an open block may end before.
            fits = low + int(np.searchsorted(b, begins[-1] + budget, "right")) - 1
            after = max(v + 1, fits)
            if after >= high:
                # A hub of its own may end with the segment; all else is told by the next one.
                if fits <= v and after == high and high < n:
                    verts.append(after)
                    begins.append(int(b[after - low]))
                break
            verts.append(after)
            begins.append(int(b[after - low]))
    drop_written(offsets)
    ends, end_edges = [*verts[1:], n], [*begins[1:], edges]
    return spark.createDataFrame([(i, v, e - v, x, y - x) for i, (v, e, x, y) in enumerate(zip(verts, ends, begins, end_edges))], schema)


def block_ranges(starts: DataFrame, nvertices: int) -> DataFrame:
    """blk, start_vert, end_vert of boundaries (blk, start_vert): each ends where the next starts."""
    after = F.lead("start_vert", 1, nvertices).over(Window.orderBy("blk"))
    return starts.select("blk", "start_vert", after.cast("long").alias("end_vert"))


def block_of(vertex, starts: list[int]):
    """Column: block of a vertex, from the sorted first vertices of the blocks."""
    known = F.array(*[F.lit(s).cast("long") for s in starts])
    return (F.size(F.filter(known, lambda s: s <= vertex)) - 1).cast("long")


def vertex_block(rows: DataFrame, blocks: DataFrame, vertex: str, into: str = "blk") -> DataFrame:
    """rows with the block of a vertex column: an equi-join on chunks of ids that ranges reach, then the range.

    A block is repeated for each chunk it reaches into, so the join partitions like any other.
    """
    size = 1 << 16
    ranges = blocks.select(F.col("blk").alias("__blk"), F.col("start_vert").alias("__lo"), (F.col("start_vert") + F.col("nverts")).alias("__hi"))
    ranges = ranges.filter("__hi > __lo").withColumn("__chunk", F.explode(F.sequence(F.floor(F.col("__lo") / size), F.floor((F.col("__hi") - 1) / size))))
    keyed = rows.withColumn("__c", F.floor(F.col(vertex) / size))
    hit = (F.col("__c") == F.col("__chunk")) & (F.col(vertex) >= F.col("__lo")) & (F.col(vertex) < F.col("__hi"))
    return keyed.join(ranges, hit, "left").select(*[F.col(c) for c in rows.columns if c != into], F.col("__blk").alias(into))


def intra_block_ratio(g: Graph, blocks: DataFrame) -> DataFrame:
    """id, inside (out-edges that stay in the vertex's block), degree."""
    both = vertex_block(vertex_block(g.edges.select("src", "dst"), blocks, "src", "sb"), blocks, "dst", "db")
    some = both.groupBy("src").agg(F.sum((F.col("sb") == F.col("db")).cast("long")).alias("inside"))
    every = out_degree(g)
    return every.join(some, every["id"] == some["src"], "left").select("id", F.coalesce("inside", F.lit(0)).alias("inside"), "degree")
