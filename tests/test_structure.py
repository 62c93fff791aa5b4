"""Hand-written micro graphs, invariants, and round trips."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wayfarer.operators import blocks, sampling, structure
from wayfarer.plans.fixtures import LINE_ORDER, customer_part, customer_part_edges
from wayfarer.sources.edge_list import parse_lines, read_edge_list, write_edge_list
from wayfarer.sources import store
from wayfarer.sources.store import load_block, load_blocks, load_graph, save_graph


def of_lines(spark, lines, **kw):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n long, value string")
    return structure.graph(parse_lines(df, order="n", **kw))


def test_parse_skips_comments_and_self_loops(spark):
    g = of_lines(spark, ["# c", "% c", "0 1", "0,2", "0\t3", "0  ,\t4", "5 5", "  1 0"])
    assert g.meta().first() == (5, 5)
    assert [tuple(r) for r in g.edges.select("src", "pos", "dst").orderBy("src", "pos").collect()] == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (1, 0, 0)]


def test_strict_lines_fail_and_others_are_skipped(spark):
    for bad in ("", "7", "a b"):
        with pytest.raises(PySparkException):
            of_lines(spark, ["0 1", bad]).edges.collect()
    assert of_lines(spark, ["0 1", "", "7", "a b"], strict=False).nedges == 1
    with pytest.raises(PySparkException):
        of_lines(spark, ["0 1"], weighted=True).edges.collect()


def test_gaps_have_degree_zero(spark):
    g = of_lines(spark, ["2 7"])
    assert [tuple(r) for r in structure.csr_offsets(g).orderBy("id").collect()] == [(i, int(i == 2), int(i > 2)) for i in range(8)]


def test_multi_edges_are_kept_in_order(spark):
    g = of_lines(spark, ["0 1", "0 1", "0 2"])
    assert structure.adjacency(g).first().nbrs == [1, 1, 2]
    assert [r.dst for r in structure.neighbours(g, 0).orderBy("pos").collect()] == [1, 1, 2]


def test_spread_positions_are_the_same(spark, sf):
    edges = customer_part_edges(spark, sf).withColumn("src", F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("src")))
    one, other = (structure.graph(edges, LINE_ORDER, spread=s).edges for s in (False, True))
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_empty_graph(spark):
    g = of_lines(spark, ["# nothing"])
    assert (g.nvertices, g.nedges) == (0, 0)
    assert blocks.split_blocks(g, 4).count() == 0


def test_hub_has_its_own_block(spark):
    g = of_lines(spark, [f"0 {i}" for i in range(1, 10)] + ["3 4", "4 5"])
    rows = blocks.split_blocks(g, 4).orderBy("blk").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 1, 0, 9), (1, 9, 9, 2)]


def test_split_follows_the_greedy_rule(spark, sf):
    g = customer_part(spark, sf)
    deg = [r.degree for r in structure.out_degree(g).orderBy("id").collect()]
    totals = np.r_[0, np.cumsum(deg)]
    for budget in (1, 50, 700, 10**6):
        want = blocks.greedy_starts(totals, budget)
        if len(want) > 30:
            continue
        got = blocks.split_blocks(g, budget).orderBy("blk").collect()
        assert [r.start_vert for r in got] == want
        assert sum(r.nverts for r in got) == g.nvertices and sum(r.nedges for r in got) == g.nedges
        assert all(r.nedges <= budget or r.nverts == 1 for r in got)


def test_alias_table_marginals(spark):
    prob, alias = sampling.alias_slots([1, 2, 3, 4])
    mass = list(prob)
    for p, a in zip(prob, alias):
        if a < 4:
            mass[a] += 10 - p
    assert mass == [4, 8, 12, 16]
    assert sampling.alias_slots([5])[1] == [1]


def test_alias_tables_reach_over_batches(spark, sf):
    g = customer_part(spark, sf)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")
        few = sorted(map(tuple, sampling.alias_table(g).collect()))
    finally:
        spark.conf.set(key, kept)
    by = {}
    for r in g.edges.orderBy("src", "pos").collect():
        by.setdefault(r.src, []).append(r.weight)
    want = sorted((v, i, p, a, sum(w), len(w)) for v, w in by.items() for i, (p, a) in enumerate(zip(*sampling.alias_slots(w))))
    assert few == want


def test_files_keep_the_order_of_lines(spark, tmp_path):
    """Also where Spark reads the largest file first, and over the splits of a file."""
    (tmp_path / "a.txt").write_text("0 5\n0 4\n")
    (tmp_path / "b.txt").write_text("".join(f"0 {i}\n" for i in range(6, 3000)))
    key = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(key)
    try:
        for size in (kept, "1k"):
            spark.conf.set(key, size)
            g = structure.graph(read_edge_list(spark, str(tmp_path)))
            assert [r.dst for r in g.edges.orderBy("pos").collect()] == [5, 4, *range(6, 3000)]
    finally:
        spark.conf.set(key, kept)


def test_odd_lines_and_empty_tables(spark, tmp_path):
    for bad in ("-1 2", "1 -2", "1 x"):
        with pytest.raises(PySparkException):
            of_lines(spark, [bad]).edges.collect()
        assert of_lines(spark, [bad, "0 1 2 3 4"], strict=False).nedges == 1
    with pytest.raises(PySparkException):
        structure.graph(spark.createDataFrame([(None, 1, 0)], "src long, dst long, ord long")).edges.collect()
    none = structure.graph(spark.createDataFrame([], "src long, dst long, weight double, ord long"))
    assert sampling.alias_table(none).count() == sampling.weight_accumulate(none).count() == 0
    save_graph(none, f"{tmp_path}/none", 10)
    assert load_graph(spark, f"{tmp_path}/none").nedges == 0


def test_segments_give_the_same_blocks(spark, sf):
    g = customer_part(spark, sf)
    for budget in (1, 60, 700, 10**6):
        want = sorted(map(tuple, blocks.split_blocks(g, budget).collect()))
        assert sorted(map(tuple, blocks.split_blocks(g, budget, segment=37).collect())) == want


def test_store_refuses_replaces_and_deletes(spark, sf, tmp_path):
    g, folder = customer_part(spark, sf), f"{tmp_path}/store"
    assert not store.exists(spark, folder)
    save_graph(g, folder, 1000)
    with pytest.raises(FileExistsError):
        save_graph(g, folder, 1000, replace=False)
    assert store.exists(spark, folder) and store.delete_graph(spark, folder) and not store.exists(spark, folder)


def test_text_and_parquet_round_trips(spark, sf, tmp_path):
    g = customer_part(spark, sf)
    write_edge_list(g.edges, f"{tmp_path}/text", weighted=True)
    back = read_edge_list(spark, f"{tmp_path}/text", weighted=True)
    again = structure.graph(back).edges.withColumn("weight", F.col("weight").cast("long"))
    assert again.exceptAll(g.edges).isEmpty() and g.edges.exceptAll(again).isEmpty()
    save_graph(g, f"{tmp_path}/store", 1000)
    h = load_graph(spark, f"{tmp_path}/store")
    assert (h.nvertices, h.nedges) == (g.nvertices, g.nedges)
    assert h.edges.exceptAll(g.edges).isEmpty() and g.edges.exceptAll(h.edges).isEmpty()
    first = load_blocks(spark, f"{tmp_path}/store").filter("blk = 1").first()
    one = load_block(spark, f"{tmp_path}/store", 1)
    assert one.count() == first.nedges
    assert "PartitionFilters: [isnotnull(blk" in one._jdf.queryExecution().toString()
    assert load_block(spark, f"{tmp_path}/store", 1, "offsets").count() == first.nverts


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = structure.sinks_out(customer_part(spark, sf))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint" in plan and "l_comment" not in plan


def test_passing_tables_are_deleted(spark):
    import os
    from urllib.parse import urlparse

    from wayfarer import shared

    file = lambda df: urlparse(df.inputFiles()[0]).path
    stays = shared.written(spark.range(5), "stays")
    with shared.passing(spark):
        goes = shared.written(stays.select("id"), "goes")
        path = file(goes)
        assert goes.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path) and stays.count() == 5
    path = file(stays)
    shared.drop_written(stays)
    assert not os.path.exists(path)
