"""Graph analytics over edge tables: PageRank, bounded search, components, coupling, layers.

Iterations are joins and sums over DataFrames. Each round is written to the shared folder, which cuts the lineage; only
one number, the change or a count, comes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..shared import dealt, discard, written
from ..sources.tables import table


def supplier_edges(spark, sf_dir) -> DataFrame:
    """The edges used below: suppliers whose parts follow each other in an order, weighted by how often."""
    follows = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    l = table(spark, sf_dir, "lineitem")
    rows = l.count()
    l = dealt(l.select("l_orderkey", "l_linenumber", "l_suppkey"), rows, "l_orderkey").select(F.col("l_suppkey").alias("src"), follows.alias("dst"))
    return dealt(l.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst"), rows, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


_EDGES = """
    e AS (SELECT src, dst, count(*) AS weight FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS dst FROM lineitem)
      WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY 1, 2)
"""


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def pagerank(edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, personalised: DataFrame | None = None, dangling: str = "uniform", total_tolerance: bool = True) -> DataFrame:
    """``node``, ``rank``. Mass of nodes without out-edges goes to all nodes alike (``uniform``, even if personalised) or to
    those that have some (``linked``). Stops when the change in total is below ``tolerance`` (times n if ``total_tolerance``)."""
    spark = edges.sparkSession
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = written(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "share")
    nodes = nodes_of(edges).join(out.select(F.col("src").alias("node"), F.lit(1.0).alias("linked")), "node", "left").withColumn("linked", F.coalesce("linked", F.lit(0.0)))
    if personalised is None:
        nodes = nodes.withColumn("p", F.lit(None).cast("double"))
    else:
        total = personalised.agg(F.sum("weight")).first()[0] or 1.0
        nodes = nodes.join(personalised.select("node", (F.col("weight") / total).alias("p")), "node", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    nodes = written(nodes, "nodes")
    n, n_linked = nodes.agg(F.count("*"), F.sum("linked")).first()
    if not n:
        return spark.createDataFrame([], "node long, rank double")
    rank = nodes.select("node", F.lit(1.0 / n).alias("rank"))
    loose = 1.0 if n_linked < n else 0.0
    for round_no in range(rounds):
        lost = nodes.where("linked = 0").join(rank, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0] if loose else 0.0
        moved = share.join(rank, share.src == rank.node).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        spread = F.lit(alpha * lost / n) if dangling == "uniform" else F.col("linked") * (alpha * lost / max(n_linked, 1))
        base = (1 - alpha) * F.coalesce("p", F.lit(1.0 / n))
        new = nodes.join(moved, nodes.node == moved.dst, "left").select("node", (alpha * F.coalesce("got", F.lit(0.0)) + spread + base).alias("rank"))
        new = written(new, "rank")
        change = new.join(rank.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        if round_no:
            discard(rank)  # the first one was never written
        rank = new
        if change < tolerance * (n if total_tolerance else 1):
            break
    return rank


@query("pagerank_uniform")
def pagerank_uniform(spark, sf_dir):
    return pagerank(supplier_edges(spark, sf_dir)).select("node", F.round("rank", 6).alias("rank"))


@query("pagerank_personalised")
def pagerank_personalised(spark, sf_dir):
    e = supplier_edges(spark, sf_dir)
    return pagerank(e, personalised=nodes_of(e).where("node <= 5").withColumn("weight", F.lit(1.0))).select("node", F.round("rank", 6).alias("rank"))


@query("call_graph_centrality")
def call_graph_centrality(spark, sf_dir):
    """Dangling mass goes to nodes with out-edges; order by rounded rank, degree and name."""
    e = supplier_edges(spark, sf_dir)
    rank = pagerank(e, rounds=50, dangling="linked", total_tolerance=False)
    degree = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("weight").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).cast("long").alias("o"), F.col("weight").alias("i")))).alias("x")).groupBy("x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return rank.join(degree, "node").select("node", F.round("rank", 6).alias("rank"), "in_degree", "out_degree").orderBy(F.desc("rank"), F.desc(F.col("in_degree") + F.col("out_degree")), "node").limit(50)


def bounded_bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``node``, ``depth``: everything reachable from ``seeds`` in at most ``depth`` steps, at its least distance."""
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        near = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = written(near.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "front")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


@query(
    "bounded_callees",
    "WITH RECURSIVE" + _EDGES + ", w AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY 1",
)
def bounded_callees(spark, sf_dir):
    return bounded_bfs(supplier_edges(spark, sf_dir), spark.createDataFrame([(1,)], "node long"), 3)


@query(
    "blast_radius",
    "WITH RECURSIVE" + _EDGES + ", w AS (SELECT 2::BIGINT AS node, 0 AS depth UNION SELECT e.src, depth + 1 FROM w JOIN e ON e.dst = w.node WHERE depth < 3), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1) SELECT count(*) FILTER (depth > 0) AS dependents, CASE WHEN count(*) FILTER (depth > 0) = 0 THEN 'none' WHEN count(*) FILTER (depth > 0) <= 3 THEN 'low' WHEN count(*) FILTER (depth > 0) <= 10 THEN 'medium' ELSE 'high' END AS risk FROM m",
)
def blast_radius(spark, sf_dir):
    """Everything that depends on a node within three steps back, as a risk tier."""
    e = supplier_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reach = bounded_bfs(e, spark.createDataFrame([(2,)], "node long"), 3).where("depth > 0")
    return reach.agg(F.count("*").alias("dependents")).select("dependents", F.when(F.col("dependents") == 0, "none").when(F.col("dependents") <= 3, "low").when(F.col("dependents") <= 10, "medium").otherwise("high").alias("risk"))


@query(
    "coupling_instability",
    "WITH" + _EDGES + ", o AS (SELECT src AS node, count(DISTINCT dst) AS ce FROM e GROUP BY 1), i AS (SELECT dst AS node, count(DISTINCT src) AS ca FROM e GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)), 4) AS instability FROM o FULL JOIN i ON o.node = i.node",
)
def coupling_instability(spark, sf_dir):
    """Ca, Ce and Ce / (Ca + Ce); both directions are counted in one aggregation."""
    e = supplier_edges(spark, sf_dir).select("src", "dst").distinct()
    both = e.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))))
    g = both.groupBy("node").agg(F.count_if(F.col("out") == 0).alias("ca"), F.count_if(F.col("out") == 1).alias("ce"))
    return g.select("node", "ca", "ce", F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 4).alias("instability"))


@query("dead_nodes", "SELECT p_partkey AS node, p_name AS name FROM part WHERE p_size > 1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09)")
def dead_nodes(spark, sf_dir):
    """Nodes that nothing refers to and that are no entry points."""
    p = table(spark, sf_dir, "part").where("p_size > 1")
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.09")
    return p.join(used, p.p_partkey == used.l_partkey, "left_anti").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))


@query("reverse_adjacency", "WITH" + _EDGES + "SELECT dst AS node, count(*) AS importers, CAST(sum(weight) AS BIGINT) AS weight, string_agg(src, ',' ORDER BY src) AS sources FROM e GROUP BY 1")
def reverse_adjacency(spark, sf_dir):
    e = supplier_edges(spark, sf_dir)
    return e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("importers"), F.sum("weight").alias("weight"), F.array_join(F.sort_array(F.collect_list("src")), ",").alias("sources"))


@query("module_topology", "WITH" + _EDGES + "SELECT src % 10 AS src_module, dst % 10 AS dst_module, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS edges FROM e WHERE src % 10 <> dst % 10 GROUP BY 1, 2")
def module_topology(spark, sf_dir):
    """Edges rolled up to modules."""
    return supplier_edges(spark, sf_dir).groupBy((F.col("src") % 10).alias("src_module"), (F.col("dst") % 10).alias("dst_module")).agg(F.sum("weight").alias("weight"), F.count("*").alias("edges")).where("src_module <> dst_module")


#: Edges of a part, about: a task of ``topological_layers`` and ``strong_components`` has one.
PART_EDGES = 2_000_000


def _nodes_as_long(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def _in_parts(edges: DataFrame, part_edges: int) -> DataFrame:
    """The written ``edges`` with their ``part``, a range of targets; all edges into a node are in one."""
    parts = max(1, math.ceil(edges.count() / part_edges))
    return written(edges.repartitionByRange(parts, "dst").withColumn("part", F.spark_partition_id()).withColumn("known", F.lit(None).cast("int")), "edges")


def _turned(edges: DataFrame) -> DataFrame:
    return written(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc")


def _within(own: np.ndarray, src: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that start at a node in ``own`` (sorted), by source: their targets, and where each source's begin; ``at``: targets as places in ``own``."""
    source = np.searchsorted(own, src)
    inside = own[np.minimum(source, len(own) - 1)] == src
    source, target = source[inside], at[inside]
    order = np.argsort(source, kind="stable")
    return target[order], np.searchsorted(source[order], np.arange(len(own) + 1))


def _steps(front: np.ndarray, target: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The targets of all edges of ``front``, and how many each of its nodes has."""
    many = first[front + 1] - first[front]
    return target[np.repeat(first[front] - (np.cumsum(many) - many), many) + np.arange(many.sum())], many


def _peeled(edges: pa.Table) -> pa.Table:
    """``node``, ``layer`` of the targets in ``edges`` (``src``, ``dst``, ``known``: the source's layer or null) that can be settled from these edges.

    All edges into a target are there. Each edge is followed once, a front of nodes at a time.
    """
    src, dst = edges.column("src").to_numpy(), edges.column("dst").to_numpy()
    known = edges.column("known").fill_null(-1).to_numpy()
    own, at = np.unique(dst, return_inverse=True)
    layer, waits = np.zeros(len(own), np.int64), known < 0
    np.maximum.at(layer, at[~waits], known[~waits] + 1)
    degree = np.bincount(at[waits], minlength=len(own))
    target, first = _within(own, src[waits], at[waits])
    front, out = np.flatnonzero(degree == 0), []
    while len(front):
        out.append(front)
        reached, many = _steps(front, target, first)
        np.maximum.at(layer, reached, np.repeat(layer[front] + 1, many))
        np.subtract.at(degree, reached, 1)
        front = np.unique(reached)
        front = front[degree[front] == 0]
    done = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pa.table({"node": own[done], "layer": layer[done].astype(np.int32)})


def _peeled_off(e: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of ``node``, ``layer`` of all nodes that no cycle leads to, and the edges of ``e`` (in parts) into other nodes."""
    new = written(e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("layer", F.lit(0)), "layer")
    out = [new]
    while e.limit(1).count():
        told = e.join(new.select(F.col("node").alias("src"), F.col("layer").alias("now")), "src", "left")
        told = written(told.select("src", "dst", "part", F.coalesce("known", "now").alias("known")), "edges")
        discard(e)
        new = written(told.groupBy("part").applyInArrow(_peeled, "node long, layer int"), "layer")
        if not new.limit(1).count():
            return out, told
        out.append(new)
        e = written(told.join(new.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "part", "known"), "edges")
        discard(told)
    return out, e


def _lowered(edges: pa.Table) -> pa.Table:
    """``node``, ``value`` of the targets in ``edges`` (``src``, ``dst`` and their values ``a``, ``b``) that a smaller value reaches along these edges."""
    src, dst, a = (edges.column(c).to_numpy() for c in ("src", "dst", "a"))
    own, place, at = np.unique(dst, return_index=True, return_inverse=True)
    was = edges.column("b").to_numpy()[place]
    value = was.copy()
    np.minimum.at(value, at, a)
    target, first = _within(own, src, at)
    front = np.flatnonzero(value < was)
    while len(front):
        reached, many = _steps(front, target, first)
        carried, before = np.repeat(value[front], many), value[reached]
        np.minimum.at(value, reached, carried)
        front = np.unique(reached[value[reached] < before])
    less = value < was
    return pa.table({"node": own[less], "value": value[less]})


def _least_values(edges: DataFrame, values: DataFrame, part_edges: int) -> DataFrame:
    """``node`` and the smallest ``value`` of the nodes that reach it, itself included; ``values`` hold all nodes of ``edges``."""
    values = written(values, "values")
    e = _in_parts(edges, part_edges)
    while True:
        both = e.join(values.select(F.col("node").alias("src"), F.col("value").alias("a")), "src").join(values.select(F.col("node").alias("dst"), F.col("value").alias("b")), "dst")
        low = written(both.select("src", "dst", "part", "a", "b").groupBy("part").applyInArrow(_lowered, "node long, value long"), "low")
        if not low.limit(1).count():
            break
        new = written(values.join(low.withColumnRenamed("value", "low"), "node", "left").select("node", F.coalesce("low", "value").alias("value")), "values")
        for old in (values, low):
            discard(old)
        values = new
    discard(e)
    return values


def strong_components(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """``node``, ``component`` (smallest member) of components with two members or more.

    Forward and backward labels: each node takes the smallest id that reaches it; among nodes with one such label those
    that its root is reached from form a component, and they leave; the others go on against the arrows, by turns. Nodes
    that cannot be on a cycle are cut first, from both ends. Cutting and labels go on within a part as far as its own edges
    lead, so a round is a step between parts, not an edge.
    """
    spark = edges.sparkSession
    e, found = written(_nodes_as_long(edges).where("src <> dst").distinct(), "scc"), []
    while True:
        for _ in range(2):
            # what leads on from no cycle goes first; then, turned round, what leads to none
            _, left = _peeled_off(_in_parts(e, part_edges))
            e = _turned(left.where("known IS NULL"))
            discard(left)
        if not e.limit(1).count():
            break
        label = _least_values(e, nodes_of(e).withColumn("value", F.col("node")), part_edges)
        ends = [label.select(F.col("node").alias(end), F.col("value").alias(name)) for end, name in (("src", "a"), ("dst", "b"))]
        same = written(e.join(ends[0], "src").join(ends[1], "dst").where("a = b").select("src", "dst"), "scc")
        discard(e)
        back = _turned(same)
        met = _least_values(back, label.withColumn("value", F.when(F.col("node") == F.col("value"), 0).otherwise(1).cast("long")), part_edges)
        members = written(label.join(met.where("value = 0").select("node"), "node").select("node", F.col("value").alias("label")), "members")
        found.append(members)
        done = members.select("node")
        # no component has members of two labels: edges between labels are not needed again
        e = written(back.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"), "scc")
        for old in (same, back, label, met):
            discard(old)
    if not found:
        return spark.createDataFrame([], "node long, component long")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    sizes = every.groupBy("label").agg(F.count("*").alias("n")).where("n >= 2")
    return every.join(sizes, "label").select("node", F.col("label").alias("component"))


@query("import_cycles")
def import_cycles(spark, sf_dir):
    e = supplier_edges(spark, sf_dir).where("src < dst OR weight >= 4")
    return strong_components(e).groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list("node")), ",").alias("members"))


def topological_layers(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """``node`` (long), ``layer``: Kahn's peel; raises if there is a cycle.

    Edges are dealt by ranges of their targets. A round peels each part as far as its own edges and the layers settled before
    allow, not one layer alone: there are as many rounds as the longest path enters parts, where ids follow the order as
    many as parts at most, and never more than layers.
    """
    out, left = _peeled_off(_in_parts(written(_nodes_as_long(edges).distinct(), "edges"), part_edges))
    if left.limit(1).count():
        raise ValueError("the graph has a cycle")
    every = out[0]
    for f in out[1:]:
        every = every.unionByName(f)
    return every


@query(
    "topological_layers",
    "WITH RECURSIVE" + _EDGES + ", d AS (SELECT src, dst FROM e WHERE src // 10 < dst // 10), n AS (SELECT src AS node FROM d UNION SELECT dst FROM d), w AS (SELECT node, 0 AS layer FROM n UNION SELECT d.dst, layer + 1 FROM w JOIN d ON d.src = w.node) SELECT node, max(layer) AS layer FROM w GROUP BY 1",
)
def topological_layers_query(spark, sf_dir):
    return topological_layers(supplier_edges(spark, sf_dir).where("floor(src / 10) < floor(dst / 10)"))


@query(
    "change_risk",
    "WITH" + _EDGES + ", r AS (SELECT dst AS node, count(DISTINCT src) AS blast FROM e GROUP BY 1), c AS (SELECT l_suppkey AS node, count(*) AS churn, avg(l_quantity) AS size, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS gap FROM lineitem GROUP BY 1) SELECT s_nationkey AS change, round(max(0.40 * coalesce(blast, 0) / (coalesce(blast, 0) + 10.0) + 0.25 * least(1, churn / 2000.0) + 0.15 * least(1, size / 50) + 0.20 * gap), 6) AS risk FROM supplier JOIN c ON c.node = s_suppkey LEFT JOIN r ON r.node = s_suppkey GROUP BY 1",
)
def change_risk(spark, sf_dir):
    """Blast radius, churn, complexity and test gap, weighted; a change is as risky as its riskiest file."""
    r = supplier_edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("blast"))
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("churn"), F.avg("l_quantity").alias("size"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("gap"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("change")).join(c, "node").join(r, "node", "left")
    blast, one = F.coalesce("blast", F.lit(0)), F.lit(1.0)
    risk = 0.40 * blast / (blast + 10.0) + 0.25 * F.least(one, F.col("churn") / 2000.0) + 0.15 * F.least(one, F.col("size") / 50) + 0.20 * F.col("gap")
    return s.groupBy("change").agg(F.round(F.max(risk), 6).alias("risk"))
