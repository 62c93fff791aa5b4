"""Walks against plain Python with the same draws, and their statistics."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wayfarer.functions.draws import ACCEPT, JUMP, NEIGHBOUR, SOURCE, TELEPORT, draw, draw_value, teleport_limit
from wayfarer.operators import results, schedule, structure, walk
from wayfarer.operators.sampling import SCALE
from wayfarer.operators.walk import WalkSpec
from wayfarer.plans.fixtures import customer_part, customer_supplier


def plain(edges, n, spec):
    """Walks in plain Python."""
    nbrs, weights = {}, {}
    for src, dst, w, _ in sorted(edges, key=lambda e: (e[0], e[3])):
        w = w if isinstance(w, int) else math.floor(w * SCALE + 0.5)
        nbrs.setdefault(src, []).append(dst)
        weights.setdefault(src, []).append(w)
    known = {(e[0], e[1]) for e in edges}
    from wayfarer.operators.sampling import alias_slots
    tables = {v: alias_slots(w) for v, w in weights.items()} if spec.weighting == "alias" else {}
    out = []
    for i in range(spec.num_walks):
        pos = source = draw_value(spec.seed, SOURCE, i, 0) % n
        prev = None
        out.append((i, 0, pos))
        for k in range(spec.steps):
            near = nbrs.get(pos, [])
            r = draw_value(spec.seed, NEIGHBOUR, i, k)
            if near and (spec.weighting == "uniform" or sum(weights[pos])) and draw_value(spec.seed, TELEPORT, i, k) > teleport_limit(spec.teleport):
                if spec.weighting == "uniform":
                    to = near[r % len(near)]
                elif spec.weighting == "alias":
                    prob, alias = tables[pos]
                    s = r % len(near)
                    to = near[s if draw_value(spec.seed, ACCEPT, i, k) % sum(weights[pos]) < prob[s] else alias[s]]
                else:
                    w = weights[pos]
                    if spec.weighting == "second_order":
                        rule = lambda d: 1 if prev is None else spec.bias[0] if d == prev else spec.bias[1] if (prev, d) in known else spec.bias[2]
                        w = [a * rule(d) for a, d in zip(w, near)]
                    left = r % sum(w)
                    j = 0
                    while left >= w[j]:
                        left -= w[j]
                        j += 1
                    to = near[j]
                prev = pos
            else:
                to, prev = (source if spec.target == "source" else draw_value(spec.seed, JUMP, i, k) % n), None
            pos = to
            out.append((i, k + 1, pos))
    return sorted(out)


@pytest.fixture(scope="module")
def g(spark, sf):
    g = customer_part(spark, sf)
    return structure.Graph(g.edges.persist(), g.nvertices, g.nedges)


@pytest.mark.parametrize("weighting,target,strategy", [("uniform", "uniform", "local"), ("uniform", "source", "local"), ("uniform", "uniform", "join"), ("prefix", "source", "join"), ("alias", "uniform", "join"), ("second_order", "uniform", "join")])
def test_walks_equal_plain_ones(g, weighting, target, strategy):
    spec = WalkSpec(60, 7, 0.15, target, weighting, seed=3)
    got = sorted(tuple(r) for r in walk.paths(g, spec, strategy).select("walk_id", "step", "pos").collect())
    assert got == plain([tuple(r) for r in g.edges.select("src", "dst", "weight", "pos").collect()], g.nvertices, spec)


def test_line_graph_is_walked_to_its_end(spark):
    edges = spark.createDataFrame([(0, 1, 0), (1, 2, 1), (2, 3, 2)], "src long, dst long, ord long")
    g = structure.graph(edges)
    rows = walk.paths(g, WalkSpec(20, 4, 0.0), "join").collect()
    by = {(r.walk_id, r.step): r.pos for r in rows}
    assert len(rows) == 100
    assert all(by[i, k + 1] == by[i, k] + 1 for i in range(20) for k in range(4) if by[i, k] < 3)


def test_second_order_with_hubs(spark, sf):
    g = customer_supplier(spark, sf)
    spec = WalkSpec(30, 3, 0.1, weighting="second_order", seed=9)
    got = sorted(tuple(r) for r in walk.paths(g, spec).select("walk_id", "step", "pos").collect())
    assert got == plain([tuple(r) for r in g.edges.select("src", "dst", "weight", "pos").collect()], g.nvertices, spec)


@pytest.mark.parametrize("weighting", ["uniform", "prefix", "alias", "second_order"])
def test_walks_over_hubs_equal_plain_ones(spark, sf, weighting, monkeypatch):
    """With few neighbours to a row most vertices are hubs."""
    monkeypatch.setattr(walk, "PACK", 16)
    g = customer_supplier(spark, sf)
    g = structure.Graph(g.edges.withColumn("weight", (F.col("dst") * 7 % 5).cast("long")).persist(), g.nvertices, g.nedges)
    spec = WalkSpec(40, 4, 0.1, weighting=weighting, seed=9)
    got = sorted(tuple(r) for r in walk.paths(g, spec, "join").select("walk_id", "step", "pos").collect())
    assert got == plain([tuple(r) for r in g.edges.select("src", "dst", "weight", "pos").collect()], g.nvertices, spec)


@pytest.mark.parametrize("weighting", ["prefix", "alias", "second_order"])
def test_fractional_weights(spark, weighting):
    """Shares by chi-square, and walks against plain ones."""
    weights = [0.25, 0.75, 0.1, 1.9, 0.0, 3.0]
    g = structure.graph(spark.createDataFrame([(0, i + 1, w, i) for i, w in enumerate(weights)] + [(i + 1, 0, 0.5, 0) for i in range(6)], "src long, dst long, weight double, ord long"))
    spec = WalkSpec(3000, 4, 0.0, weighting=weighting, seed=1, bias=(1, 1, 1))
    rows = [tuple(r) for r in walk.paths(g, spec, "join").select("walk_id", "step", "pos").collect()]
    assert sorted(rows) == plain([tuple(r) for r in g.edges.select("src", "dst", "weight", "pos").collect()], 7, spec)
    at = {(i, k): pos for i, k, pos in rows}
    hits = [0] * 7
    for (i, k), pos in at.items():
        if k and at[i, k - 1] == 0:
            hits[pos] += 1
    total = sum(hits)
    assert hits[5] == 0 and total > 4000
    assert sum((hits[i + 1] - total * w / 6) ** 2 / (total * w / 6) for i, w in enumerate(weights) if w) < 18.5  # 4 degrees of freedom, 0.001


def test_weights_that_cannot_be_used_are_refused(spark):
    for bad in (-1.0, float("nan"), float("inf"), 1e-12, 1e12):
        g = structure.graph(spark.createDataFrame([(0, 1, bad, 0)], "src long, dst long, weight double, ord long"))
        with pytest.raises(PySparkException):
            walk.paths(g, WalkSpec(1, 1, weighting="prefix")).collect()


def test_all_weights_zero_means_a_jump(spark):
    g = structure.graph(spark.createDataFrame([(0, 1, 0.0, 0), (1, 0, 0.0, 0)], "src long, dst long, weight double, ord long"))
    for weighting in ("prefix", "alias", "second_order"):
        assert walk.paths(g, WalkSpec(5, 3, 0.0, weighting=weighting)).count() == 20


def test_a_rule_of_ones_own(spark, g):
    """Whole-number weights from the neighbour and the walk: here never back, and only even vertices."""

    def rule(x, at, known):
        return F.when((x["dst"] == at["prev"]) | (x["dst"] % 2 == 1), 0).otherwise(x["units"])

    spec = WalkSpec(100, 6, 0.1, weighting=rule, seed=2)
    near = {}
    for r in g.edges.orderBy("src", "pos").collect():
        near.setdefault(r.src, []).append((r.dst, r.weight))
    want = []
    for i in range(100):
        pos, prev = draw_value(2, SOURCE, i, 0) % g.nvertices, None
        want.append((i, 0, pos))
        for k in range(6):
            w = [0 if d == prev or d % 2 else x for d, x in near.get(pos, [])]
            if sum(w) and draw_value(2, TELEPORT, i, k) > teleport_limit(0.1):
                left, j = draw_value(2, NEIGHBOUR, i, k) % sum(w), 0
                while left >= w[j]:
                    left, j = left - w[j], j + 1
                pos, prev = near[pos][j][0], pos
            else:
                pos, prev = draw_value(2, JUMP, i, k) % g.nvertices, None
            want.append((i, k + 1, pos))
    assert sorted((r.walk_id, r.step, r.pos) for r in walk.paths(g, spec).collect()) == want


def test_walks_run_until_none_has_hops_left(spark, sf, g):
    spec = WalkSpec(60, 7, 0.15, seed=3)
    want = {i: pos for i, k, pos in plain([tuple(r) for r in g.edges.select("src", "dst", "weight", "pos").collect()], g.nvertices, spec) if k == 7}
    rows = walk.run_until_done(g, spec).collect()
    assert {r.walk_id: r.pos for r in rows} == want and all(r.hop == 0 and r.step == 7 for r in rows)
    uneven = walk.sources(g, spec).withColumn("hop", (F.col("walk_id") % 4).cast("int"))
    rows = walk.run_until_done(g, spec, uneven).collect()
    assert len(rows) == 60 and all(r.step == r.walk_id % 4 and r.hop == 0 for r in rows)


def test_draws_reach_every_vertex(spark):
    """Also of graphs with more than 2**32 vertices."""
    assert max(draw_value(1, "s", i, 0) % 10**12 for i in range(200)) > 9 * 10**11
    rows = spark.range(200).select((draw(1, "s", F.col("id"), F.lit(0)) % 10**12).alias("r")).collect()
    assert [r.r for r in rows] == [draw_value(1, "s", i, 0) % 10**12 for i in range(200)]


def test_empty_graph_has_no_walks(spark):
    g = structure.graph(spark.createDataFrame([], "src long, dst long, ord long"))
    with pytest.raises(ValueError):
        walk.paths(g, WalkSpec(1, 1))
    for bad in ({"target": "x"}, {"weighting": "x"}):
        with pytest.raises(ValueError):
            WalkSpec(**bad)


def test_no_hops_gives_sources(g):
    assert walk.paths(g, WalkSpec(5, 0), "join").count() == walk.paths(g, WalkSpec(5, 0), "local").count() == 5


def test_draws_agree(spark):
    rows = spark.range(50).select(draw(4, "k", F.col("id"), F.lit(3)).alias("r")).collect()
    assert [r.r for r in rows] == [draw_value(4, "k", i, 3) for i in range(50)]


def test_uniform_neighbours_by_chi_square(spark):
    g = structure.graph(spark.createDataFrame([(0, i, i) for i in range(1, 9)] + [(i, 0, 0) for i in range(1, 9)], "src long, dst long, ord long"))
    hits = walk.paths(g, WalkSpec(2000, 6, 0.0)).filter("pos > 0 and step > 1").groupBy("pos").count().collect()
    total = sum(r["count"] for r in hits)
    assert sum((r["count"] - total / 8) ** 2 / (total / 8) for r in hits) < 24.3  # 7 degrees of freedom, 0.001


def test_visits_match_pagerank(spark, sf):
    """Visit shares against power iteration, on a small graph with a sink."""
    edges = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (2, 4)]
    g = structure.graph(spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src long, dst long, ord long"))
    p = [0.2] * 5
    for _ in range(100):
        new = [0.0] * 5
        for v in range(5):
            out = [d for s, d in edges if s == v]
            for u in range(5):
                new[u] += p[v] * (0.15 / 5 + 0.85 * out.count(u) / len(out) if out else 1 / 5)
        p = new
    hits = {r.vertex: r.hits for r in results.pagerank(walk.paths(g, WalkSpec(5000, 25, 0.15)), 10).collect()}
    total = sum(hits.values())
    assert all(abs(hits[v] / total - p[v]) < 0.01 for v in range(5))


def test_scheduler_choices(spark):
    counts = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "blk long, nwalks long")
    assert schedule.arg_max(counts, "nwalks").first().blk == 2
    hops = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "blk long, max_hop long")
    assert schedule.max_hops_block(counts, hops).first().blk == 2
    hops = spark.createDataFrame([(1, 4), (2, 3)], "blk long, max_hop long")
    assert schedule.max_hops_block(counts, hops).first().blk == 1
    ranks = spark.createDataFrame([(0, 0), (1, 7), (2, 3), (3, 7)], "blk long, rank long")
    assert [r.blk for r in schedule.top_ranked(ranks, 5).collect()] == [1, 2, 3]
    slots = spark.createDataFrame([(0, 2), (1, None), (2, 1)], "slot long, blk long")
    assert schedule.evict(slots, counts).first().slot == 1
    assert schedule.evict(slots.filter("blk is not null"), counts).first().slot == 2
    row = spark.range(1).select(schedule.choose(F.lit(0.1), 0.2, F.lit("h"), F.lit("w")).alias("c")).first()
    assert row.c == "h"
