"""Directed multigraphs as edges with a position among their source's neighbours.

Vertices are 0 .. nvertices - 1; ids that no edge names have degree 0. Self-loops are dropped before
vertices are counted. Equal edges are all kept. A null or negative id is an error; a table without edges is a graph without
vertices. Other columns than src, dst, weight and those of the order are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.shared import written

#: Vertices whose offsets are added up in one window.
CHUNK = 1 << 16


class Graph:
    """edges (src, dst, weight, pos); numbers of vertices and edges are worked out when first asked for."""

    def __init__(self, edges: DataFrame, nvertices: int | None = None, nedges: int | None = None):
        self.edges, self._counts = edges, None if nvertices is None else (nvertices, nedges)

    @property
    def spark(self):
        return self.edges.sparkSession

    def meta(self) -> DataFrame:
        """One row: nvertices (largest id + 1), nedges."""
        if self._counts is not None:
            return self.spark.createDataFrame([self._counts], "nvertices long, nedges long")
        return self.edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("nvertices"), F.count("*").alias("nedges"))

    def _count(self) -> tuple[int, int]:
        if self._counts is None:
            row = self.meta().first()
            self._counts = row.nvertices, row.nedges
        return self._counts

    @property
    def nvertices(self) -> int:
        return self._count()[0]

    @property
    def nedges(self) -> int:
        return self._count()[1]

    def vertices(self) -> DataFrame:
        return self.spark.range(self.nvertices)


def graph(edges: DataFrame, order: Sequence[str] = ("ord",), spread: bool = False) -> Graph:
    """Graph of rows (src, dst[, weight]) with neighbours in the given total order; self-loops are dropped.

    Positions are row numbers in a window for each source. With ``spread``, for graphs where one source may have a large
    share of all edges, they come from a sort of all edges by range instead.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(None).cast("long")
    # Bad ids are told when rows are made, not in the filter, which the optimizer may put before filters of the edges' own.
    kept = edges.filter("src <> dst or src is null or dst is null")
    bad = F.col("src").isNull() | F.col("dst").isNull() | (F.col("src") < 0) | (F.col("dst") < 0)
    error = F.raise_error(F.lit("an edge needs two ids that are not negative")).cast("long")
    if spread:
        placed = _spread_positions(kept, order)
    else:
        placed = kept.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy(*order)).cast("long") - 1)
    return Graph(placed.select(F.when(bad, error).otherwise(F.col("src").cast("long")).alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"), "pos"))


def _spread_positions(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """edges with pos: row number in the source's part of a range partition, and what earlier partitions have of it."""
    ranged = written(edges.repartitionByRange("src", *order).withColumn("__part", F.spark_partition_id()), "ranged")
    inner = F.row_number().over(Window.partitionBy("__part", "src").orderBy(*order)).cast("long") - 1
    shares = ranged.groupBy("__part", "src").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("src").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = shares.select("__part", "src", before.alias("__before"))
    return ranged.withColumn("pos", inner).join(shares, ["__part", "src"]).withColumn("pos", F.col("pos") + F.col("__before"))


def sinks_out(g: Graph) -> DataFrame:
    """src, degree of the vertices with out-edges."""
    return g.edges.groupBy("src").agg(F.count("*").alias("degree"))


def out_degree(g: Graph) -> DataFrame:
    """id, degree of every vertex, 0 for those without out-edges."""
    some = sinks_out(g)
    return g.vertices().join(some, F.col("id") == some["src"], "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def csr_offsets(g: Graph) -> DataFrame:
    """id, degree, beg_pos (edges of all vertices before).

    Degrees are added up within chunks of ids; only the chunks' sums, one for CHUNK vertices, go
    through a window of their own.
    """
    degrees = out_degree(g).withColumn("chunk", F.floor(F.col("id") / CHUNK))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    chunks = degrees.groupBy("chunk").agg(F.sum("degree").alias("total"))
    chunks = chunks.select("chunk", F.coalesce(F.sum("total").over(before.orderBy("chunk")), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("degree").over(before.partitionBy("chunk").orderBy("id")), F.lit(0))
    return degrees.withColumn("inner", inner).join(chunks, "chunk").select("id", "degree", (F.col("base") + F.col("inner")).alias("beg_pos"))


def csr_edges(g: Graph) -> DataFrame:
    """Every edge with its place in the whole: idx, src, dst."""
    offsets = csr_offsets(g).select(F.col("id").alias("src"), "beg_pos")
    return g.edges.join(offsets, "src").select((F.col("beg_pos") + F.col("pos")).alias("idx"), "src", "dst")


def adjacency(g: Graph) -> DataFrame:
    """src, nbrs, weights: neighbour arrays. A hub's array is as long as its degree; walks don't use it."""
    held = F.array_sort(F.collect_list(F.struct("pos", "dst", "weight")))
    rows = g.edges.groupBy("src").agg(held.alias("held"))
    return rows.select("src", F.transform("held", lambda x: x["dst"]).alias("nbrs"), F.transform("held", lambda x: x["weight"]).alias("weights"))


def neighbours(g: Graph, vertex: int) -> DataFrame:
    """The slice of one vertex: pos, dst."""
    return g.edges.filter(F.col("src") == vertex).select("pos", "dst")
