"""One query for each operator of the graph engine, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.draws import ACCEPT, JUMP, NEIGHBOUR, SOURCE, TELEPORT, draw_sql, draw_value, teleport_limit
from wayfarer.operators import blocks, results, sampling, schedule, structure, walk
from wayfarer.operators.walk import WalkSpec
from wayfarer.plans.fixtures import customer_part, customer_part_priced, customer_supplier, event_transitions
from wayfarer.shared import new_folder
from wayfarer.sources import store
from wayfarer.sources.edge_list import parse_lines, read_edge_list, write_edge_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The reference's default workload, for every rule.
WALKS = WalkSpec(10_000, 25, 0.15)
RESTART = WalkSpec(10_000, 25, 0.15, target="source", seed=7)
PREFIX = WalkSpec(10_000, 25, 0.15, target="source", weighting="prefix", seed=11)
ALIAS = WalkSpec(10_000, 25, 0.15, weighting="alias", seed=13)
SECOND = WalkSpec(10_000, 25, 0.15, weighting="second_order", seed=17)
#: The same rules over fractions as weights.
PRICED = {rule: WalkSpec(10_000, 25, 0.15, weighting=rule, seed=seed) for rule, seed in (("prefix", 19), ("alias", 23), ("second_order", 29))}
#: Blocks of queries hold an eighth of the edges each.
BLOCK_SHARE = 8
#: Hops after which schedule queries look at the walks.
LOOK = 5

EDGES = """raw AS (
  SELECT o_custkey AS src, l_partkey AS dst, CAST(l_quantity AS BIGINT) AS weight, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_partkey),
e AS MATERIALIZED (
  SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos FROM raw),
m AS MATERIALIZED (SELECT CAST(max(greatest(src, dst)) + 1 AS BIGINT) AS v, CAST(count(*) AS BIGINT) AS n FROM raw),
d AS MATERIALIZED (SELECT src, CAST(count(*) AS BIGINT) AS degree, CAST(sum(weight) AS BIGINT) AS total FROM e GROUP BY src)"""

#: Units of weights that are fractions.
PRICED_EDGES = EDGES.replace("CAST(l_quantity AS BIGINT) AS weight", f"CAST(floor(l_extendedprice / 1000.0 * {sampling.SCALE} + 0.5) AS BIGINT) AS weight")

#: Alias tables by their rule: first come first served, a step of every vertex at a time.
SLOTS_SQL = """, al AS (
  SELECT src, degree AS n, total, list(weight * degree ORDER BY pos) AS held, coalesce(list(pos ORDER BY pos) FILTER (weight * degree < total), CAST([] AS BIGINT[])) AS small,
    coalesce(list(pos ORDER BY pos) FILTER (weight * degree >= total), CAST([] AS BIGINT[])) AS large, list(total ORDER BY pos) AS prob, list(degree ORDER BY pos) AS alias
  FROM e JOIN d USING (src) GROUP BY src, degree, total
  UNION ALL
  SELECT src, n, total, list_concat(list_concat(held[1:g], [nv]), held[g + 2:]), CASE WHEN nv < total THEN list_append(small[2:], g) ELSE small[2:] END,
    CASE WHEN nv < total THEN large[2:] ELSE list_append(large[2:], g) END, list_concat(list_concat(prob[1:s], [held[s + 1]]), prob[s + 2:]), list_concat(list_concat(alias[1:s], [g]), alias[s + 2:])
  FROM (SELECT *, small[1] AS s, large[1] AS g, held[large[1] + 1] - (total - held[small[1] + 1]) AS nv FROM al WHERE len(small) > 0 AND len(large) > 0)),
sl AS MATERIALIZED (SELECT src, unnest(range(n)) AS pos, unnest(prob) AS prob, unnest(alias) AS alias FROM al WHERE len(small) = 0 OR len(large) = 0)"""

OFFSETS = """, o AS MATERIALIZED (
  SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beg_pos
  FROM (SELECT range AS id, coalesce(degree, 0) AS degree FROM range((SELECT v FROM m)) LEFT JOIN d ON src = range))"""

BLOCKS = (
    OFFSETS
    + f""", beg AS MATERIALIZED (SELECT id AS v, beg_pos AS b FROM o UNION ALL SELECT v, n FROM m),
starts AS (
  SELECT CAST(0 AS BIGINT) AS s
  UNION ALL
  SELECT nxt FROM (SELECT greatest(starts.s + 1, (SELECT max(v) FROM beg WHERE v >= starts.s AND b - (SELECT b FROM beg WHERE v = starts.s) <= (SELECT n // {BLOCK_SHARE} FROM m))) AS nxt FROM starts WHERE starts.s < (SELECT v FROM m)) WHERE nxt < (SELECT v FROM m)),
blk AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY s) - 1 AS blk, s AS start_vert, coalesce(lead(s) OVER (ORDER BY s), (SELECT v FROM m)) AS end_vert FROM starts)"""
)


def walks_sql(spec: WalkSpec) -> str:
    """Recursive walk w(walk_id, source, pos, step); needs EDGES."""

    def r(tag: str) -> str:
        return draw_sql(spec.seed, tag, "w.walk_id", "w.step")

    if spec.weighting == "alias":
        return _alias_walks_sql(spec)
    jump = "w.source" if spec.target == "source" else f"{r(JUMP)} % (SELECT v FROM m)"
    want = f"{r(NEIGHBOUR)} % d.degree = e.pos" if spec.weighting == "uniform" else f"e.acc > {r(NEIGHBOUR)} % d.total AND e.acc - e.weight <= {r(NEIGHBOUR)} % d.total"
    edges = "e" if spec.weighting == "uniform" else "acc"
    follows = f"d.degree IS NOT NULL AND {r(TELEPORT)} > {teleport_limit(spec.teleport)}"
    return f""", acc AS MATERIALIZED (SELECT src, dst, weight, pos, CAST(sum(weight) OVER (PARTITION BY src ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS acc FROM e),
start AS (SELECT range AS walk_id, {draw_sql(spec.seed, SOURCE, "range", "0")} % (SELECT v FROM m) AS pos FROM range({spec.num_walks})),
w AS (
  SELECT walk_id, pos AS source, pos, 0 AS step FROM start
  UNION ALL
  SELECT w.walk_id, w.source, CASE WHEN {follows} THEN e.dst ELSE {jump} END, w.step + 1
  FROM w LEFT JOIN d ON d.src = w.pos LEFT JOIN {edges} e ON e.src = w.pos AND {want}
  WHERE w.step < {spec.steps})"""


def _alias_walks_sql(spec: WalkSpec) -> str:
    r = lambda tag: draw_sql(spec.seed, tag, "w.walk_id", "w.step")
    follows = f"d.degree IS NOT NULL AND {r(TELEPORT)} > {teleport_limit(spec.teleport)}"
    return SLOTS_SQL + f""",
start AS (SELECT range AS walk_id, {draw_sql(spec.seed, SOURCE, "range", "0")} % (SELECT v FROM m) AS pos FROM range({spec.num_walks})),
w AS (
  SELECT walk_id, pos AS source, pos, 0 AS step FROM start
  UNION ALL
  SELECT w.walk_id, w.source, CASE WHEN {follows} THEN e.dst ELSE {r(JUMP)} % (SELECT v FROM m) END, w.step + 1
  FROM w LEFT JOIN d ON d.src = w.pos LEFT JOIN sl ON sl.src = w.pos AND sl.pos = {r(NEIGHBOUR)} % d.degree
    LEFT JOIN e ON e.src = w.pos AND e.pos = CASE WHEN {r(ACCEPT)} % d.total < sl.prob THEN sl.pos ELSE sl.alias END
  WHERE w.step < {spec.steps})"""


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cut(g: structure.Graph) -> DataFrame:
    return blocks.split_blocks(g, g.nedges // BLOCK_SHARE)


@query(f"WITH {EDGES} SELECT src, dst, weight FROM raw")
def edge_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are made from all edges, self-loops too, with mixed separators and a comment for each tenth."""
    from wayfarer.plans.fixtures import customer_part_edges

    raw = customer_part_edges(spark, sf_dir).withColumn("k", F.monotonically_increasing_id())
    mark = F.when(F.col("k") % 3 == 0, "\t").when(F.col("k") % 3 == 1, ",").otherwise(" ,\t")
    lines = raw.select(F.col("k"), F.concat(F.when(F.col("k") % 5 == 0, "  ").otherwise(""), "src", mark, "dst", mark, "weight").alias("value"))
    notes = raw.filter("k % 10 = 0").select("k", F.concat(F.when(F.col("k") % 20 == 0, "# ").otherwise("% "), "src", F.lit(" "), "dst").alias("value"))
    parsed = parse_lines(lines.unionByName(notes), weighted=True, order="k")
    return parsed.select("src", "dst", F.col("weight").cast("long").alias("weight"))


@query(f"WITH {EDGES} SELECT src, dst, CAST(weight AS DOUBLE) AS weight, pos FROM e")
def edge_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as text files and read back: neighbours keep their order."""
    folder = new_folder(spark, "text")
    write_edge_list(customer_part(spark, sf_dir).edges, folder, weighted=True)
    return structure.graph(read_edge_list(spark, folder, weighted=True)).edges


def stored(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the graph, stored in blocks with its tables."""
    g, folder = customer_part(spark, sf_dir), new_folder(spark, "graph")
    store.save_graph(g, folder, g.nedges // BLOCK_SHARE)
    store.save_tables(store.load_graph(spark, folder), folder)
    return folder


@query(f"WITH {EDGES} SELECT src, dst, weight, pos FROM e")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, folder = customer_part(spark, sf_dir), new_folder(spark, "graph")
    store.save_graph(g, folder, g.nedges // BLOCK_SHARE)
    return store.load_graph(spark, folder).edges


@query(f"WITH RECURSIVE {EDGES}{BLOCKS} SELECT src, dst, weight, e.pos AS pos, beg_pos + e.pos AS idx FROM e JOIN o ON o.id = src JOIN blk ON src >= start_vert AND src < end_vert WHERE blk = 2")
def store_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and offsets of one block, each read from its own folder."""
    folder = stored(spark, sf_dir)
    offsets = store.load_block(spark, folder, 2, store.OFFSETS).select(F.col("id").alias("src"), "beg_pos")
    return store.load_block(spark, folder, 2).join(offsets, "src").select("src", "dst", "weight", "pos", (F.col("beg_pos") + F.col("pos")).alias("idx"))


@query(f"WITH {EDGES} SELECT src, dst, pos FROM e WHERE src BETWEEN 100 AND 120")
def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.load_range(spark, stored(spark, sf_dir), 100, 120).select("src", "dst", "pos")


@query(
    f"""WITH RECURSIVE {EDGES}{BLOCKS}{SLOTS_SQL}, a AS (SELECT src, pos, CAST(sum(weight) OVER (PARTITION BY src ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS acc FROM e),
i AS (
  SELECT src, CAST(sum(CASE WHEN a.blk = b.blk THEN 1 ELSE 0 END) AS BIGINT) AS inside
  FROM e JOIN blk a ON src >= a.start_vert AND src < a.end_vert JOIN blk b ON dst >= b.start_vert AND dst < b.end_vert GROUP BY src)
SELECT src, pos, acc, prob, alias, inside FROM a JOIN sl USING (src, pos) JOIN i USING (src)"""
)
def store_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix sums, alias tables and shares within the block, written by block and read back."""
    folder = stored(spark, sf_dir)
    prefix, alias, ratio = (store.load_table(spark, folder, t) for t in (store.PREFIX, store.ALIAS, store.RATIO))
    both = prefix.join(alias.select("src", "pos", "prob", "alias"), ["src", "pos"])
    return both.join(ratio.select(F.col("id").alias("src"), "inside"), "src").select("src", "pos", "acc", "prob", "alias", "inside")


@query(f"WITH {EDGES} SELECT v AS nvertices, n AS nedges FROM m")
def graph_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_part(spark, sf_dir).meta()


@query(f"WITH {EDGES} SELECT src, dst, weight, pos FROM e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_part(spark, sf_dir).edges


@query(f"WITH {EDGES}{OFFSETS} SELECT id, degree FROM o")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.out_degree(customer_part(spark, sf_dir))


@query(f"WITH {EDGES}{OFFSETS} SELECT id, degree, beg_pos FROM o")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.csr_offsets(customer_part(spark, sf_dir))


@query(f"WITH {EDGES}{OFFSETS} SELECT beg_pos + pos AS idx, src, dst FROM e JOIN o ON id = src")
def csr_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.csr_edges(customer_part(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src, degree AS n, (SELECT CAST(sum((pos + 1) * dst) AS BIGINT) FROM e WHERE e.src = d.src) AS checksum FROM d")
def adjacency_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = structure.adjacency(customer_part(spark, sf_dir))
    sums = F.aggregate(F.transform("nbrs", lambda x, i: (i + 1) * x), F.lit(0).cast("long"), lambda t, x: t + x)
    return a.select("src", F.size("nbrs").cast("long").alias("n"), sums.alias("checksum"))


@query(f"WITH RECURSIVE {EDGES}{BLOCKS} SELECT blk, start_vert, end_vert - start_vert AS nverts, (SELECT b FROM beg WHERE beg.v = start_vert) AS start_edge, (SELECT b FROM beg WHERE beg.v = end_vert) - (SELECT b FROM beg WHERE beg.v = start_vert) AS nedges FROM blk")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(customer_part(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}{BLOCKS} SELECT blk, start_vert, end_vert FROM blk")
def block_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = customer_part(spark, sf_dir)
    return blocks.block_ranges(cut(g).select("blk", "start_vert"), g.nvertices)


@query(f"WITH RECURSIVE {EDGES}{BLOCKS} SELECT id, blk FROM o JOIN blk ON id >= start_vert AND id < end_vert")
def vertex_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = customer_part(spark, sf_dir)
    return blocks.vertex_block(g.vertices(), cut(g), "id")


@query(f"WITH RECURSIVE {EDGES}{BLOCKS} SELECT blk, CAST(count(*) AS BIGINT) AS n, CAST(sum(dst) AS BIGINT) AS dst_sum FROM e JOIN blk ON src >= start_vert AND src < end_vert GROUP BY blk")
def block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = customer_part(spark, sf_dir)
    return blocks.vertex_block(g.edges, cut(g), "src").groupBy("blk").agg(F.count("*").alias("n"), F.sum("dst").alias("dst_sum"))


@query(
    f"""WITH RECURSIVE {EDGES}{BLOCKS}, i AS (
  SELECT src, CAST(sum(CASE WHEN a.blk = b.blk THEN 1 ELSE 0 END) AS BIGINT) AS inside
  FROM e JOIN blk a ON src >= a.start_vert AND src < a.end_vert JOIN blk b ON dst >= b.start_vert AND dst < b.end_vert GROUP BY src)
SELECT id, coalesce(inside, 0) AS inside, degree FROM o LEFT JOIN i ON src = id"""
)
def intra_block_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = customer_part(spark, sf_dir)
    return blocks.intra_block_ratio(g, cut(g))


@query(f"WITH {EDGES} SELECT src, pos, CAST(sum(weight) OVER (PARTITION BY src ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS acc FROM e")
def weight_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weight_accumulate(customer_part(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src, total FROM d")
def weight_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weight_total(customer_part(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src, pos, weight * degree AS mass FROM e JOIN d USING (src)")
def alias_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.alias_marginals(sampling.alias_table(customer_part(spark, sf_dir)))


@query(f"WITH RECURSIVE {EDGES}{SLOTS_SQL} SELECT src, pos, prob, alias, total, degree FROM sl JOIN d USING (src)")
def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.alias_table(customer_part(spark, sf_dir))


@query(f"WITH {PRICED_EDGES} SELECT src, pos, weight * degree AS mass FROM e JOIN d USING (src)")
def alias_marginals_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.alias_marginals(sampling.alias_table(customer_part_priced(spark, sf_dir)))


@query(f"WITH {EDGES} SELECT src, degree, total FROM d")
def alias_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sampling.alias_table(customer_part(spark, sf_dir))
    return table.groupBy("src").agg(F.max("degree").alias("degree"), F.max("total").alias("total"))


EVENTS = """p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
ids AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events))"""


@query(f"WITH {EVENTS} SELECT x.id AS src, y.id AS dst, CAST(count(*) AS BIGINT) AS weight FROM p JOIN ids x ON a = x.event_type JOIN ids y ON b = y.event_type WHERE a <> b GROUP BY 1, 2")
def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_transitions(spark, sf_dir).edges.select("src", "dst", "weight")


@query("WITH x AS (SELECT DISTINCT o_custkey AS c, l_suppkey + (SELECT max(c_custkey) + 1 FROM customer) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT src, CAST(count(*) AS BIGINT) AS degree FROM (SELECT c AS src FROM x UNION ALL SELECT s FROM x) GROUP BY src")
def hub_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sinks_out(customer_supplier(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}{walks_sql(WALKS)} SELECT walk_id, source FROM w WHERE step = 0")
def walk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.sources(customer_part(spark, sf_dir), WALKS).select("walk_id", "source")


@query(f"WITH RECURSIVE {EDGES}{walks_sql(WALKS)} SELECT walk_id, step, pos FROM w")
def walk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.paths(customer_part(spark, sf_dir), WALKS).select("walk_id", "step", "pos")


JOINED = WalkSpec(10_000, 25, 0.15, seed=5)


@query(f"WITH RECURSIVE {EDGES}{walks_sql(JOINED)} SELECT walk_id, step, pos FROM w")
def walk_paths_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join strategy, whatever the graph's size."""
    return walk.paths(customer_part(spark, sf_dir), JOINED, "join").select("walk_id", "step", "pos")


@query(f"WITH RECURSIVE {EDGES}{walks_sql(WALKS)} SELECT walk_id, source, pos FROM w WHERE step = {WALKS.steps}")
def walk_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.endpoints(walk.paths(customer_part(spark, sf_dir), WALKS), WALKS.steps)


@query(f"WITH RECURSIVE {EDGES}{walks_sql(WALKS)} SELECT pos AS vertex, CAST(count(*) AS BIGINT) AS visits FROM w GROUP BY pos")
def walk_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.visits(walk.paths(customer_part(spark, sf_dir), WALKS))


@query(f"WITH RECURSIVE {EDGES}{walks_sql(RESTART)} SELECT walk_id, step, pos FROM w")
def walk_restart_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.paths(customer_part(spark, sf_dir), RESTART).select("walk_id", "step", "pos")


@query(f"WITH RECURSIVE {EDGES}{walks_sql(PREFIX)} SELECT walk_id, step, pos FROM w")
def walk_weighted_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.paths(customer_part(spark, sf_dir), PREFIX).select("walk_id", "step", "pos")


@query(f"WITH RECURSIVE {EDGES}{walks_sql(ALIAS)} SELECT walk_id, step, pos FROM w")
def walk_weighted_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.paths(customer_part(spark, sf_dir), ALIAS).select("walk_id", "step", "pos")


@query(f"WITH RECURSIVE {PRICED_EDGES}{walks_sql(PRICED['prefix'])} SELECT walk_id, step, pos FROM w")
def walk_priced_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.paths(customer_part_priced(spark, sf_dir), PRICED["prefix"]).select("walk_id", "step", "pos")


@query(f"WITH RECURSIVE {PRICED_EDGES}{walks_sql(PRICED['alias'])} SELECT walk_id, step, pos FROM w")
def walk_priced_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.paths(customer_part_priced(spark, sf_dir), PRICED["alias"]).select("walk_id", "step", "pos")


def second_order_sql(spec: WalkSpec, edges: str = EDGES) -> str:
    back, near, far = spec.bias
    parts = [f"WITH {edges}, ed AS MATERIALIZED (SELECT DISTINCT src, dst FROM e), s0 AS MATERIALIZED (SELECT range AS walk_id, {draw_sql(spec.seed, SOURCE, 'range', '0')} % (SELECT v FROM m) AS cur, CAST(NULL AS BIGINT) AS prev FROM range({spec.num_walks}))"]
    for k in range(spec.steps):
        r = lambda tag: draw_sql(spec.seed, tag, "s.walk_id", str(k))  # noqa: B023, E731
        parts.append(
            f"""c{k} AS (SELECT s.walk_id, e.dst, e.pos, e.weight * CASE WHEN s.prev IS NULL THEN 1 WHEN e.dst = s.prev THEN {back} WHEN ed.src IS NOT NULL THEN {near} ELSE {far} END AS w, {r(NEIGHBOUR)} AS r
  FROM s{k} s JOIN e ON e.src = s.cur LEFT JOIN ed ON ed.src = s.prev AND ed.dst = e.dst WHERE {r(TELEPORT)} > {teleport_limit(spec.teleport)}),
x{k} AS (SELECT *, sum(w) OVER (PARTITION BY walk_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY walk_id) AS tot FROM c{k}),
h{k} AS (SELECT walk_id, arg_min(dst, pos) AS nxt FROM x{k} WHERE cum > r % tot GROUP BY walk_id),
s{k + 1} AS MATERIALIZED (SELECT s.walk_id, coalesce(nxt, {r(JUMP)} % (SELECT v FROM m)) AS cur, CASE WHEN nxt IS NULL THEN NULL ELSE s.cur END AS prev FROM s{k} s LEFT JOIN h{k} h ON h.walk_id = s.walk_id)"""
        )
    return ", ".join(parts) + f" SELECT walk_id, cur AS pos, prev FROM s{spec.steps}"


@query(second_order_sql(SECOND))
def walk_second_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.run(customer_part(spark, sf_dir), SECOND)[0].select("walk_id", "pos", "prev")


@query(second_order_sql(PRICED["second_order"], PRICED_EDGES))
def walk_priced_second_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.run(customer_part_priced(spark, sf_dir), PRICED["second_order"])[0].select("walk_id", "pos", "prev")


@query(f"WITH RECURSIVE {EDGES}{walks_sql(WALKS)} SELECT walk_id, source, pos, CAST({WALKS.steps} AS INTEGER) AS step, CAST(0 AS INTEGER) AS hop FROM w WHERE step = {WALKS.steps}")
def walk_until_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops until no walk has any left."""
    return walk.run_until_done(customer_part(spark, sf_dir), WALKS).select("walk_id", "source", "pos", "step", "hop")


PLACED = f", pl AS (SELECT walk_id, step, pos, {WALKS.steps} - step AS hop, blk FROM w JOIN blk ON pos >= start_vert AND pos < end_vert WHERE step <= {LOOK})"
COUNTS = f"SELECT blk, CAST(count(*) AS BIGINT) AS nwalks FROM pl WHERE step = {LOOK} AND hop > 0 GROUP BY blk"
RANKS = f"SELECT blk, CAST(count(*) AS BIGINT) AS rank FROM (SELECT step, blk, lag(blk) OVER (PARTITION BY walk_id ORDER BY step) AS before FROM pl) WHERE before IS NULL OR before <> blk GROUP BY blk"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks after LOOK hops with their block."""
    g = customer_part(spark, sf_dir)
    return blocks.vertex_block(walk.state_after(g, WALKS, LOOK), cut(g), "pos")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    g = customer_part(spark, sf_dir)
    way = walk.paths(g, WalkSpec(WALKS.num_walks, LOOK, WALKS.teleport, seed=WALKS.seed))
    on = blocks.vertex_block(way, cut(g), "pos").withColumn("before", F.lag("blk").over(Window.partitionBy("walk_id").orderBy("step")))
    return schedule.block_rank(on)


def sched(tail: str) -> str:
    return f"WITH RECURSIVE {EDGES}{BLOCKS}{walks_sql(WALKS)}{PLACED}, cnt AS ({COUNTS}), mh AS (SELECT blk, CAST(max(hop) AS BIGINT) AS max_hop FROM pl WHERE step = {LOOK} GROUP BY blk), rk AS ({RANKS}) {tail}"


@query(sched("SELECT blk, nwalks FROM cnt"))
def walk_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.block_counts(placed(spark, sf_dir))


@query(sched("SELECT blk, max_hop FROM mh"))
def walk_block_max_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.block_max_hop(placed(spark, sf_dir))


@query(sched("SELECT blk, rank FROM rk"))
def walk_block_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir)


@query(sched("SELECT blk, nwalks FROM cnt ORDER BY nwalks DESC, blk LIMIT 1"))
def sched_max_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.arg_max(schedule.block_counts(placed(spark, sf_dir)), "nwalks")


@query(sched("SELECT mh.blk, max_hop, coalesce(nwalks, 0) AS nwalks FROM mh LEFT JOIN cnt ON cnt.blk = mh.blk ORDER BY max_hop DESC, CASE WHEN max_hop = 0 THEN -coalesce(nwalks, 0) ELSE 0 END, mh.blk LIMIT 1"))
def sched_max_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(spark, sf_dir)
    return schedule.max_hops_block(schedule.block_counts(p), schedule.block_max_hop(p))


@query(sched("SELECT blk, rank FROM (SELECT blk, rank FROM rk WHERE rank > 0 ORDER BY rank DESC, blk LIMIT 3) ORDER BY blk"))
def sched_topk_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.top_ranked(ranked(spark, sf_dir), 3)


SLOTS = ((0, 3), (1, 1), (2, 5))


@query(sched("SELECT slot, s.blk, coalesce(nwalks, 0) AS nwalks FROM (VALUES (CAST(0 AS BIGINT), CAST(3 AS BIGINT)), (1, 1), (2, 5)) s(slot, blk) LEFT JOIN cnt ON cnt.blk = s.blk ORDER BY coalesce(nwalks, 0), slot LIMIT 1"))
def sched_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.evict(spark.createDataFrame(SLOTS, "slot long, blk long"), schedule.block_counts(placed(spark, sf_dir)))


@query(sched("SELECT blk, nwalks FROM cnt WHERE blk IN (1, 3, 5)"))
def cached_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.cached(schedule.block_counts(placed(spark, sf_dir)), spark.createDataFrame(SLOTS, "slot long, blk long"))


@query(sched(f"SELECT CAST(count(*) AS BIGINT) AS nwalks, CAST(count(*) FILTER (WHERE hop = 0) AS BIGINT) AS finished FROM pl WHERE step = {LOOK}"))
def walk_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(spark, sf_dir)
    return p.agg(F.count("*").alias("nwalks"), F.count_if(F.col("hop") == 0).alias("finished"))


@query(f"WITH RECURSIVE {EDGES}{walks_sql(WALKS)} SELECT walk_id, pos FROM w WHERE step = 0 UNION ALL SELECT walk_id, pos FROM w WHERE step = {LOOK}")
def walk_union_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = customer_part(spark, sf_dir)
    at = walk.paths(g, WALKS)
    return at.filter("step = 0").select("walk_id", "pos").unionByName(at.filter(F.col("step") == LOOK).select("walk_id", "pos"))


@query(f"WITH RECURSIVE {EDGES}{walks_sql(WALKS)} SELECT pos AS vertex, CAST(count(*) AS BIGINT) AS hits FROM w WHERE step >= 5 GROUP BY pos")
def pagerank_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.pagerank(walk.paths(customer_part(spark, sf_dir), WALKS), 5)


@query(f"WITH RECURSIVE {EDGES}{walks_sql(RESTART)}, h AS (SELECT source, pos AS vertex, CAST(count(*) AS BIGINT) AS hits FROM w GROUP BY 1, 2) SELECT source, vertex, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits DESC, vertex) AS rank FROM h) WHERE rank <= 5")
def ppr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.ppr_topk(walk.paths(customer_part(spark, sf_dir), RESTART), 5)


@query(
    sched("""SELECT CAST(b AS BIGINT) AS blk, coalesce((SELECT min(slot) FROM s WHERE s.blk = b), (SELECT slot FROM ev)) AS slot, EXISTS (SELECT 1 FROM s WHERE s.blk = b) AS cached,
  CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.blk = b) THEN (SELECT blk FROM ev) END AS evicted FROM ch""").replace("), mh AS", """), s AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(3 AS BIGINT)), (1, 1), (2, 5)) x(slot, blk)),
ev AS (SELECT slot, s.blk AS blk FROM s LEFT JOIN cnt ON cnt.blk = s.blk ORDER BY coalesce(nwalks, 0), slot LIMIT 1),
ch AS (SELECT coalesce((SELECT blk FROM cnt ORDER BY nwalks DESC, blk LIMIT 1), 0) AS b), mh AS""")
)
def sched_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state-aware scheduler's decision; this seed's draw goes by walks."""
    p = placed(spark, sf_dir)
    u = draw_value(WALKS.seed, "q", 0, LOOK) / (1 << 60)
    return schedule.decide(schedule.block_counts(p), schedule.block_max_hop(p), spark.createDataFrame(SLOTS, "slot long, blk long"), max(u, 0.2), 0.2)


@query(sched("SELECT row_number() OVER (ORDER BY blk) - 1 AS slot, blk FROM (SELECT blk, rank FROM rk WHERE rank > 0 ORDER BY rank DESC, blk LIMIT 4)"))
def sched_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.refill(ranked(spark, sf_dir), 4)


@query(sched("SELECT from_blk, to_blk, CAST(count(*) AS BIGINT) AS walks FROM (SELECT blk AS from_blk, lead(blk) OVER (PARTITION BY walk_id ORDER BY step) AS to_blk FROM pl) WHERE to_blk <> from_blk GROUP BY 1, 2"))
def walk_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = customer_part(spark, sf_dir)
    way = walk.paths(g, WalkSpec(WALKS.num_walks, LOOK, WALKS.teleport, seed=WALKS.seed))
    return schedule.migrations(blocks.vertex_block(way, cut(g), "pos"))
