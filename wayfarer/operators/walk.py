"""Random walks: many independent walks of a fixed number of hops, with teleport.

A hop: if the vertex has out-edges and the draw is over the teleport limit, the walk goes to a
neighbour (uniform, or by weight); otherwise it jumps, to a uniform vertex or back to its source. A
jump uses up a hop. The second-order rule weighs neighbours by whether they are the previous vertex
(1/p), its neighbour (1), or neither (1/q); after a jump there is no previous vertex. A rule of one's
own is a function of the neighbour and the walk that gives a whole-number weight.

Draws depend only on seed, walk and hop, so every strategy gives the same walks:

* ``join``: neighbours are packed PACK to a row. A vertex with fewer has its degree, total weight and all its neighbours in
  one row, so a hop is one equi-join of the walks with rows that are dealt and sorted once. The rows of other
  vertices (hubs) lie in many partitions, and the walks that stand there meet them on (vertex, row) in a second join,
  which is only planned if there are hubs. A vertex where a third of the walks stand is split by adaptive skew joins.
* ``local``: the graph goes to every task as flat arrays and walks don't move between tasks. Taken
  only if the graph has at most LOCAL_EDGES edges and LOCAL_VERTICES vertices, which are counted first.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.draws import ACCEPT, DIGITS, JUMP, NEIGHBOUR, SOURCE, TELEPORT, draw, teleport_limit
from wayfarer.operators.sampling import alias_table, units, weight_accumulate
from wayfarer.operators.structure import Graph
from wayfarer.shared import written

LOCAL_EDGES, LOCAL_VERTICES = 4_000_000, 4_000_000
#: Hops after which the join strategy writes the walks, to keep plans short.
HOPS_PER_WRITE = 5
#: Neighbours in a row; a vertex with as many or more is a hub.
PACK = 128
WEIGHTINGS = ("uniform", "prefix", "alias", "second_order")
#: (neighbour: pos, dst, units; walk: source, prev, pos, step; whether prev has an edge to the neighbour) -> weight.
Weigh = Callable[[Column, Column, Column], Column]

log = logging.getLogger("wayfarer.walk")


@dataclass(frozen=True)
class WalkSpec:
    """num_walks walks of ``steps`` hops. weighting: one of WEIGHTINGS, or a function (Weigh). bias: second-order weights
    as whole numbers (back, near, far)."""

    num_walks: int = 10_000
    steps: int = 25
    teleport: float = 0.15
    target: str = "uniform"  # or source
    weighting: str | Weigh = "uniform"
    seed: int = 42
    bias: tuple[int, int, int] = (4, 2, 1)

    def __post_init__(self):
        if self.target not in ("uniform", "source"):
            raise ValueError("target must be uniform or source")
        if self.weighting not in WEIGHTINGS and not callable(self.weighting):
            raise ValueError(f"weighting must be a function or one of {WEIGHTINGS}")

    @property
    def weigh(self) -> Weigh | None:
        """The rule that weighs each neighbour anew at each hop, if it is of that kind."""
        if callable(self.weighting):
            return self.weighting
        if self.weighting != "second_order":
            return None
        back, near, far = self.bias

        def weigh(x: Column, walk: Column, known: Column) -> Column:
            return x["units"] * F.when(walk["prev"].isNull(), 1).when(x["dst"] == walk["prev"], back).when(known, near).otherwise(far)

        return weigh


def sources(g: Graph, spec: WalkSpec) -> DataFrame:
    """walk_id, source, prev, pos, step, hop (hops left), past (vertices since the last write): sources are uniform over all vertices, with replacement."""
    if g.nvertices == 0:
        raise ValueError("a graph without vertices has no walks")
    walk = F.col("id")
    start = draw(spec.seed, SOURCE, walk, F.lit(0)) % g.nvertices
    return g.spark.range(spec.num_walks).select(walk.alias("walk_id"), start.alias("source"), F.lit(None).cast("long").alias("prev"), start.alias("pos"), F.lit(0).alias("step"), F.lit(spec.steps).alias("hop"), F.array(start).alias("past"))


@dataclass(frozen=True)
class Tables:
    """vertices: src, degree, total, cells (null for hubs), sorted by src; hubs: src, row, cells, low, high (sums of units before and
    with the row), or None without hubs; known: distinct (src, dst), for hubs under a rule that weighs."""

    vertices: DataFrame
    hubs: DataFrame | None
    known: DataFrame | None
    nvertices: int

    def release(self) -> None:
        for table in (self.vertices, self.hubs):
            if table is not None:
                table.unpersist()


def tables(g: Graph, spec: WalkSpec) -> Tables:
    """Edges packed for the joins. Two shuffles: by vertex and row, and of the rows by vertex."""
    edges = g.edges.select("src", "pos", "dst", units(g.edges).alias("units"))
    parts = int(g.spark.conf.get("spark.sql.shuffle.partitions"))
    held = ["pos", "dst"]
    if spec.weighting == "alias":
        edges, held = edges.join(alias_table(g).select("src", "pos", "prob", "alias"), ["src", "pos"]), [*held, "prob", "alias"]
    elif spec.weighting == "prefix":
        edges, held = edges.join(weight_accumulate(g), ["src", "pos"]), [*held, "acc"]
    elif spec.weigh:
        held.append("units")
    row = F.floor(F.col("pos") / PACK).alias("row")
    rows = edges.groupBy("src", row).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("cells"), F.sum("units").alias("sum"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    lone = (F.col("row") == 0) & (F.size("cells") < PACK)
    small = rows.filter(lone).select("src", F.size("cells").cast("long").alias("degree"), F.col("sum").alias("total"), "cells")
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("src").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hubs = rows.filter(~lone)
    if hubs.isEmpty():
        hubs, vertices = None, small
    else:
        none = F.lit(None).cast(rows.schema["cells"].dataType)
        totals = hubs.groupBy("src").agg(F.sum(F.size("cells")).alias("degree"), F.sum("sum").alias("total")).withColumn("cells", none)
        vertices = small.unionByName(totals)
        bounds = hubs.select("src", "row", "sum").withColumn("low", before).select("src", "row", "low", (F.col("low") + F.col("sum")).alias("high"))
        hubs = hubs.drop("sum").join(bounds, ["src", "row"]).repartition(parts, "src", "row").persist(StorageLevel.MEMORY_AND_DISK)
        hubs.count()
    vertices = vertices.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
    vertices.count()
    known = written(g.edges.select("src", "dst").distinct(), "known") if hubs is not None and spec.weigh else None
    rows.unpersist()
    return Tables(vertices, hubs, known, g.nvertices)


def _jump(spec: WalkSpec, nvertices: int) -> Column:
    return F.col("source") if spec.target == "source" else draw(spec.seed, JUMP, F.col("walk_id"), F.col("step")) % nvertices


def _taken_by_sum(cells: Column, value: Callable[[Column], Column], want: Column) -> Column:
    """dst of the first cell with which the running sum of value is over want."""

    def step(so_far: Column, x: Column) -> Column:
        left = so_far["left"] - value(x)
        found = F.when(so_far["to"].isNull() & (left < 0), x["dst"]).otherwise(so_far["to"])
        return F.struct(left.alias("left"), found.alias("to"))

    start = F.struct(want, F.lit(None).cast("long")).cast("struct<left:bigint,to:bigint>")
    return F.aggregate(cells, start, step, lambda x: x["to"])


def advance(walks: DataFrame, t: Tables, spec: WalkSpec) -> DataFrame:
    """One hop of every walk, by joins."""
    walk, step = F.col("walk_id"), F.col("step")
    v = t.vertices.withColumnsRenamed({"src": "v_src"})
    at = walks.join(v, walks["pos"] == F.col("v_src"), "left")
    some = F.col("degree").isNotNull() & ((F.col("total") > 0) if spec.weighting != "uniform" else F.lit(True))
    at = at.withColumns({"follows": some & (draw(spec.seed, TELEPORT, walk, step) > teleport_limit(spec.teleport)), "r": draw(spec.seed, NEIGHBOUR, walk, step)})
    on_hub = F.col("follows") & F.col("cells").isNull()
    h = None if t.hubs is None else t.hubs.withColumnsRenamed({"src": "h_src", "row": "h_row", "cells": "h_cells"})
    if spec.weigh:
        return _weighed(at, t, spec)
    if spec.weighting == "prefix":
        at = at.withColumn("want", F.when(F.col("follows"), F.col("r") % F.col("total")))
        first = lambda cells: F.get(F.filter(cells, lambda x: x["acc"] > F.col("want")), F.lit(0))["dst"]
        to = F.when(F.col("want").isNotNull() & F.col("cells").isNotNull(), first("cells"))
        if h is not None:
            at = at.join(h, on_hub & (F.col("pos") == F.col("h_src")) & (F.col("want") >= F.col("low")) & (F.col("want") < F.col("high")), "left")
            to = F.coalesce(to, F.when(F.col("want").isNotNull() & F.col("h_cells").isNotNull(), first("h_cells")))
        return _moved(at.withColumn("to", to), spec, t.nvertices)

    def look(at: DataFrame, slot: str, into: str) -> DataFrame:
        """at with the cell at a position."""
        cell = F.get("cells", F.col(slot).cast("int"))
        if h is None:
            return at.withColumn(into, cell)
        here = on_hub & (F.col("pos") == F.col("h_src")) & (F.floor(F.col(slot) / PACK) == F.col("h_row"))
        both = at.join(h, here, "left")
        return both.withColumn(into, F.coalesce(cell, F.get("h_cells", (F.col(slot) % PACK).cast("int")))).drop(*h.columns)

    at = look(at.withColumn("slot", F.when(F.col("follows"), F.col("r") % F.col("degree"))), "slot", "cell")
    if spec.weighting == "alias":
        kept = F.when(F.col("follows"), draw(spec.seed, ACCEPT, walk, step) % F.col("total") < F.col("cell")["prob"])
        at = look(at.withColumn("other", F.when(kept, F.col("slot")).otherwise(F.col("cell")["alias"])), "other", "cell")
    return _moved(at.withColumn("to", F.col("cell")["dst"]), spec, t.nvertices)


def _moved(at: DataFrame, spec: WalkSpec, nvertices: int) -> DataFrame:
    """Walks after a hop to column ``to``; where it is null they jump."""
    to = F.coalesce("to", _jump(spec, nvertices))
    columns = ["walk_id", "source", F.when(F.col("to").isNotNull(), F.col("pos")).alias("prev"), to.alias("next"), (F.col("step") + 1).alias("step"), (F.col("hop") - 1).alias("hop"), "past"]
    if "around" in at.columns:
        at = at.withColumn("around", F.when(F.col("to").isNotNull(), F.transform("cells", lambda x: x["dst"])))
        columns.append("around")
    moved = at.select(*columns).withColumn("past", F.concat("past", F.array("next")))
    return moved.withColumnsRenamed({"next": "pos"}).select("walk_id", "source", "prev", "pos", "step", "hop", "past", *columns[7:])


def _weighed(at: DataFrame, t: Tables, spec: WalkSpec) -> DataFrame:
    """A hop by a rule that weighs every neighbour: the first whose running weight is over r % total is taken.

    A walk carries its previous vertex's neighbours, unless that is a hub. Where hubs have a part, neighbours
    become rows, and edges from the previous vertex are looked up.
    """
    as_walk = F.struct("source", "prev", "pos", "step")
    near = lambda x: F.coalesce(F.array_contains("around", x["dst"]), F.lit(False))
    simple = F.col("cells").isNotNull() & (F.col("prev").isNull() | F.col("around").isNotNull())
    weights = F.when(F.col("follows") & simple, F.transform("cells", lambda x: F.struct(x["dst"].alias("dst"), spec.weigh(x, as_walk, near(x)).cast("long").alias("w"))))
    at = at.withColumn("weighed", weights)
    at = at.withColumn("sum", F.when(F.size("weighed") > 0, F.aggregate("weighed", F.lit(0).cast("long"), lambda s, x: s + x["w"])))
    at = at.withColumn("want", F.when(F.col("sum") > 0, F.col("r") % F.col("sum")))
    to = F.when(F.col("want").isNotNull() & (F.size("weighed") > 0), _taken_by_sum(F.col("weighed"), lambda x: x["w"], F.col("want")))
    at = at.withColumn("to", to)
    if t.hubs is None:
        return _moved(at, spec, t.nvertices)
    hard = at.filter(F.col("follows") & ~simple).select("walk_id", "source", "prev", "pos", "step", "r", "cells")
    wide = t.hubs.select(F.col("src").alias("h_src"), F.col("cells").alias("h_cells"))
    one = hard.filter("cells is not null").withColumn("x", F.explode("cells")).drop("cells")
    many = hard.filter("cells is null").drop("cells").join(wide, F.col("pos") == F.col("h_src")).withColumn("x", F.explode("h_cells")).drop("h_src", "h_cells")
    known = t.known.select(F.col("src").alias("k_src"), F.col("dst").alias("k_dst"))
    seen = one.unionByName(many).join(known, (F.col("prev") == F.col("k_src")) & (F.col("x")["dst"] == F.col("k_dst")), "left")
    seen = seen.withColumn("w", spec.weigh(F.col("x"), as_walk, F.col("k_src").isNotNull()).cast("long"))
    of = Window.partitionBy("walk_id")
    seen = seen.withColumns({"cum": F.sum("w").over(of.orderBy("x.pos").rowsBetween(Window.unboundedPreceding, 0)), "tot": F.sum("w").over(of)})
    took = seen.filter((F.col("tot") > 0) & (F.col("cum") > F.col("r") % F.col("tot"))).groupBy(F.col("walk_id").alias("t_id")).agg(F.min_by("x.dst", "x.pos").alias("t_to"))
    return _moved(at.join(took, F.col("walk_id") == F.col("t_id"), "left").withColumn("to", F.coalesce("to", "t_to")), spec, t.nvertices)


@dataclass(frozen=True)
class LocalGraph:
    """A small graph as flat arrays: neighbours of v at offsets[v] .. offsets[v + 1]."""

    offsets: np.ndarray
    targets: np.ndarray


def local_graph(g: Graph) -> LocalGraph:
    """Arrays of a graph whose size has been checked."""
    if g.nedges > LOCAL_EDGES or g.nvertices > LOCAL_VERTICES:
        raise ValueError("the graph is too large to be held by every task")
    rows = g.edges.select("src", "pos", "dst").toArrow()
    src, pos, dst = (rows.column(c).to_numpy() for c in ("src", "pos", "dst"))
    offsets = np.zeros(g.nvertices + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=g.nvertices), out=offsets[1:])
    targets = np.empty(len(src), np.int32)
    targets[offsets[src] + pos] = dst
    return LocalGraph(offsets, targets)


_PATH = pa.schema([("walk_id", pa.int64()), ("source", pa.int64()), ("step", pa.int32()), ("pos", pa.int64())])


def local_paths(g: Graph, spec: WalkSpec) -> DataFrame:
    """Paths of uniform walks, each task with its own walks and the whole graph."""
    spark, n, limit = g.spark, g.nvertices, teleport_limit(spec.teleport)
    shared = spark.sparkContext.broadcast(local_graph(g))

    def draws(tag: str, ids: np.ndarray, step: int) -> np.ndarray:
        head, tail = f"{spec.seed}:{tag}:", f":{step}"
        return np.array([int(md5(f"{head}{i}{tail}".encode()).hexdigest()[:DIGITS], 16) for i in ids.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = source = draws(SOURCE, ids, 0) % n
            for step in range(spec.steps + 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(source), pa.array(np.full(len(ids), step, np.int32)), pa.array(at)], schema=_PATH)
                if step == spec.steps:
                    break
                begin = held.offsets[at]
                degree = held.offsets[at + 1] - begin
                follows = (degree > 0) & (draws(TELEPORT, ids, step) > limit)
                to = np.empty(len(ids), np.int64)
                f, j = np.flatnonzero(follows), np.flatnonzero(~follows)
                to[f] = held.targets[begin[f] + draws(NEIGHBOUR, ids[f], step) % degree[f]]
                to[j] = source[j] if spec.target == "source" else draws(JUMP, ids[j], step) % n
                at = to

    return spark.range(spec.num_walks).mapInArrow(run, "walk_id long, source long, step int, pos long")


def _begun(walks: DataFrame, spec: WalkSpec) -> DataFrame:
    return walks.withColumn("around", F.lit(None).cast("array<long>")) if spec.weigh and "around" not in walks.columns else walks


def run(g: Graph, spec: WalkSpec) -> tuple[DataFrame, DataFrame]:
    """Walks by joins: (state after the last hop, paths).

    The vertices that a walk visits go along with it, and every few hops they are written with the
    state. So plans stay short, each hop is worked out once, and a lost executor costs a few hops.
    """
    held = tables(g, spec)
    # With hubs, a rule that weighs reads the walks twice; unwritten, the work would double from hop to hop.
    every = 1 if held.known is not None else HOPS_PER_WRITE
    walks, parts, first, began = _begun(sources(g, spec), spec), [], 0, time.perf_counter()
    for k in range(1, spec.steps + 1):
        walks = advance(walks, held, spec)
        if k % every == 0 or k == spec.steps:
            walks = written(walks, "walks")
            parts.append((first, walks))
            walks, first = walks.withColumn("past", F.array().cast("array<long>")), k + 1
            log.info("%d of %d hops of %d walks, %.1f s", k, spec.steps, spec.num_walks, time.perf_counter() - began)
    if parts:  # all hops are written
        held.release()
    else:
        parts.append((0, walks))
    rows = [w.select("walk_id", "source", F.posexplode("past").alias("k", "pos")).select("walk_id", "source", (F.col("k") + at).cast("int").alias("step"), "pos") for at, w in parts]
    whole = rows[0]
    for part in rows[1:]:
        whole = whole.unionByName(part)
    return walks.select("walk_id", "source", "prev", "pos", "step", "hop"), whole


def run_until_done(g: Graph, spec: WalkSpec, walks: DataFrame | None = None) -> DataFrame:
    """State (walk_id, source, prev, pos, step, hop) when no walk has hops left.

    walks: a state to go on from, in which walks may have different numbers of hops left; by default new walks.
    Finished walks wait where they stand and are not moved any more.
    """
    state = ["walk_id", "source", "prev", "pos", "step", "hop"]
    none = F.array().cast("array<long>").alias("past")
    start = sources(g, spec).select(*state) if walks is None else walks.select(*state)
    held, done, active, began = tables(g, spec), [], _begun(start.select("*", none), spec), time.perf_counter()
    while True:
        done.append(active.filter("hop <= 0").select(*state))
        active = active.filter("hop > 0")
        if active.isEmpty():
            break
        active = written(advance(active, held, spec).withColumn("past", F.array().cast("array<long>")), "active")
        log.info("a hop of the walks that have any left, %.1f s", time.perf_counter() - began)
    held.release()
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def paths(g: Graph, spec: WalkSpec, strategy: str = "auto") -> DataFrame:
    """walk_id, source, step, pos: every vertex of every walk, its source as step 0."""
    if g.nvertices == 0:
        raise ValueError("a graph without vertices has no walks")
    small = spec.weighting == "uniform" and g.nedges <= LOCAL_EDGES and g.nvertices <= LOCAL_VERTICES
    if strategy == "local" or (strategy == "auto" and small):
        return local_paths(g, spec)
    return run(g, spec)[1]


def state_after(g: Graph, spec: WalkSpec, hops: int) -> DataFrame:
    """walk_id, source, pos, step, hop (hops left) after some hops."""
    at = paths(g, replace(spec, steps=hops)).filter(F.col("step") == hops)
    return at.select("walk_id", "source", "pos", "step", F.lit(spec.steps - hops).alias("hop"))
