"""Breadth-first levels, components, distances and what follows from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ordograph.functions import kernels
from ordograph.operators.graph import adjacency, degrees, induced, simple, twins, vertices
from ordograph.plans.storage import discard, written

#: Sources that a task of distances() holds beside the instance's edges.
BLOCK = 64


def bfs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(instance, root, v, level, parent) from roots (instance, root), one round a level for all roots at once.

    parent: the smallest vertex of the level before. Each round's frontier is a written table.
    """
    adj = written(adjacency(edges).distinct(), "adjacency")
    front = written(roots.select("instance", "root", F.col("root").alias("v"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("parent")), "front")
    done = front
    while not front.isEmpty():
        step = front.join(adj, (front.instance == adj.instance) & (front.v == adj.src)).select(front.instance, "root", F.col("dst").alias("v"), (F.col("level") + 1).alias("level"), F.col("src").alias("parent"))
        new = step.groupBy("instance", "root", "v", "level").agg(F.min("parent").alias("parent"))
        front = written(new.join(done.select("instance", "root", "v"), ["instance", "root", "v"], "left_anti").select(*done.columns), "front")
        done = done.unionByName(front)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(instance, v, component): the smallest vertex of each vertex's component, by labels that travel and jump."""
    adj = written(adjacency(edges).distinct(), "adjacency")
    kept = written(adj.groupBy("instance", F.col("src").alias("v")).agg(F.least("src", F.min("dst")).alias("component")), "labels")
    while True:
        now = kept.select("instance", "v", "component")
        near = adj.join(now.withColumnRenamed("v", "dst"), ["instance", "dst"]).groupBy("instance", F.col("src").alias("v")).agg(F.min("component").alias("near"))
        step = now.join(near, ["instance", "v"]).select("instance", "v", F.least("component", "near").alias("c"), F.col("component").alias("was"))
        up = now.select("instance", F.col("v").alias("c"), F.col("component").alias("up"))
        step = written(step.join(up, ["instance", "c"], "left").select("instance", "v", F.least("c", F.coalesce("up", "c")).alias("component"), "was"), "labels")
        discard(kept)
        if step.filter("component <> was").isEmpty():
            discard(adj)
            return step.select("instance", "v", "component")
        kept = step


def component_sizes(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("instance", "component").agg(F.count("*").alias("size"))


def _largest(parts: DataFrame) -> DataFrame:
    sizes = parts.groupBy("instance", "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy("instance").agg(F.count("*").alias("components"), F.max(F.struct("size", -F.col("component"))).alias("m"))
    return best.select("instance", "components", (-F.col("m.col2")).alias("component"), F.col("m.size").alias("size"))


def largest_component(edges: DataFrame) -> DataFrame:
    return _largest(components(edges))


def distances(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(instance, src, dst, d) for reachable pairs; a task holds one instance's edges and BLOCK sources."""
    plain = simple(edges)
    roots = vertices(edges).withColumnRenamed("v", "src") if sources is None else sources
    n = roots.groupBy("instance").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = roots.join(n, "instance").select("instance", "src", F.pmod(F.xxhash64("src"), F.col("blocks")).cast("int").alias("block"))
    copies = plain.join(n, "instance").select(F.col("instance").alias("of"), "u", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))

    def run(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(pairs):
            names, where = np.unique(np.concatenate([pairs.u, pairs.v, own.src]), return_inverse=True)
            g = kernels.Graph(len(names), where[: len(pairs)], where[len(pairs) : 2 * len(pairs)])
            for s, x in zip(own.src, where[2 * len(pairs) :], strict=True):
                d = g.levels(x)
                hit = np.flatnonzero(d >= 0)
                out.append(pd.DataFrame({"instance": own.instance.iloc[0], "src": s, "dst": names[hit], "d": d[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"instance": [], "src": [], "dst": [], "d": []})

    return dealt.groupBy("instance", "block").cogroup(copies.groupBy("of", "part")).applyInPandas(run, "instance string, src int, dst int, d int")


def _packed(batches):
    """Rows (instance, sized, u, v) with u and v as bytes, four a number, one row for those of a batch that go together."""
    for pdf in batches:
        rows = [(*key, own.u.to_numpy("<i4").tobytes(), own.v.to_numpy("<i4").tobytes()) for key, own in pdf.groupby(["instance", "sized"])]
        yield pd.DataFrame(rows, columns=["instance", "sized", "u", "v"])


def distance_counts(edges: DataFrame, classes: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(instance, rep, size, d, n): for each vertex of the class of twins() that rep names, which has size vertices, how
    many vertices are at distance d. A written table; with sources (instance, src) their classes alone.

    A task holds the edges between an instance's classes, some 16 bytes each, and one block of them; blocks have BLOCK
    classes or, where that makes more of them than a few for each core, more."""
    classes = twins(edges) if classes is None else classes
    reps = classes.filter("v = rep").select("instance", "rep", "size")
    roots = reps if sources is None else reps.join(sources.select("instance", F.col("src").alias("v")).join(classes, ["instance", "v"]).select("instance", "rep"), ["instance", "rep"], "left_semi")
    most = 4 * max(8, edges.sparkSession.sparkContext.defaultParallelism)
    n = roots.groupBy("instance").agg(F.least(F.ceil(F.count("*") / BLOCK), F.lit(most)).cast("int").alias("blocks"))
    dealt = roots.join(n, "instance").select("instance", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    links = induced(simple(edges), reps.select("instance", F.col("rep").alias("v"))).select("instance", F.lit(False).alias("sized"), "u", "v")
    both = links.union(reps.select("instance", F.lit(True), "rep", F.col("size").cast("int")))
    packed = written(both.mapInPandas(_packed, "instance string, sized boolean, u binary, v binary"), "packed")
    copies = packed.join(n, "instance").select(F.col("instance").alias("of"), "sized", "u", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    kept = pa.schema({"instance": pa.string(), "rep": pa.int32(), "size": pa.int64(), "d": pa.int32(), "n": pa.int64()})

    def run(own: pa.Table, parts: pa.Table) -> pa.Table:
        if not own.num_rows:
            return kept.empty_table()
        pairs, sizes = [], []
        for sized, *ends in zip(parts["sized"], parts["u"], parts["v"], strict=True):
            (sizes if sized.as_py() else pairs).append([np.frombuffer(x.as_buffer(), "<i4") for x in ends])
        names, size = np.concatenate(sizes, axis=1)
        order = np.argsort(names)
        names, size = names[order], size[order].astype(np.int64)
        dst, at = kernels.arcs(names, pairs)
        where = np.searchsorted(names, own["rep"].to_numpy())
        k, d, count = np.array(kernels.level_counts(dst, at, size, where)).T
        return pa.table([pa.repeat(own["instance"][0].as_py(), len(k)), names[where[k]], size[where[k]], d.astype(np.int32), count], schema=kept)

    out = written(dealt.groupBy("instance", "block").cogroup(copies.groupBy("of", "part")).applyInArrow(run, "instance string, rep int, size long, d int, n long"), "counts")
    discard(packed)
    return out


def mean_distance(edges: DataFrame) -> DataFrame:
    """(instance, aspl): mean distance of all pairs of vertices, null where some have no path or there is one vertex."""
    return _mean(distance_counts(edges))


def _mean(counts: DataFrame) -> DataFrame:
    nodes, pairs, total = F.sum(F.when(F.col("d") == 0, F.col("size"))), F.sum(F.col("size") * F.col("n")), F.sum(F.col("size") * F.col("d") * F.col("n"))
    return counts.groupBy("instance").agg(F.when(pairs == nodes * nodes, F.try_divide(total, nodes * (nodes - 1))).alias("aspl"))


def density(edges: DataFrame) -> DataFrame:
    n = vertices(edges).groupBy("instance").agg(F.count("*").alias("nodes"))
    m = simple(edges).groupBy("instance").agg(F.count("*").alias("edges"))
    return n.join(m, "instance").withColumn("density", F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)))


def per_instance(edges: DataFrame, run, schema: str) -> DataFrame:
    """run(instance, names, graph) -> pandas for each instance, one task each; vertices are numbered by rank."""

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        names, where = np.unique(np.concatenate([pdf.u, pdf.v]), return_inverse=True)
        return run(pdf.instance.iloc[0], names, kernels.Graph(len(names), where[: len(pdf)], where[len(pdf) :]))

    return simple(edges).groupBy("instance").applyInPandas(task, schema)


def connectivity(edges: DataFrame) -> DataFrame:
    """(instance, node_conn, edge_conn, alg_conn)."""

    def run(name, names, g):
        return pd.DataFrame({"instance": [name], "node_conn": [kernels.node_connectivity(g)], "edge_conn": [kernels.edge_connectivity(g)], "alg_conn": [kernels.algebraic_connectivity(g)]})

    return per_instance(edges, run, "instance string, node_conn int, edge_conn int, alg_conn double")


def topology(edges: DataFrame, with_connectivity: bool = False) -> DataFrame:
    """Nodes, edges, components, diameter of the largest component, density, average path length (null if
    disconnected)."""
    edges = written(edges.select("instance", "u", "v").distinct(), "edges")
    d = distance_counts(edges)
    parts = written(components(edges), "components")
    big = written(_largest(parts), "largest")
    inside = d.join(parts.select("instance", F.col("v").alias("rep"), "component"), ["instance", "rep"]).join(big.select("instance", "component"), ["instance", "component"], "left_semi")
    diameter = inside.groupBy("instance").agg(F.max("d").alias("diameter"))
    out = density(edges).join(big.select("instance", F.col("components").alias("num_comp"), F.col("size").alias("largest_comp")), "instance").join(diameter, "instance").join(_mean(d), "instance")
    return out.join(connectivity(edges), "instance") if with_connectivity else out


def min_degree(edges: DataFrame) -> DataFrame:
    """All vertices of smallest degree."""
    d = degrees(edges)
    least = d.groupBy("instance").agg(F.min("degree").alias("degree"))
    return d.join(least, ["instance", "degree"]).select("instance", "v", "degree")


def degree_order(edges: DataFrame) -> DataFrame:
    """(instance, component, v, place): each component's vertices by ascending degree, ties to the smaller id."""
    place = F.row_number().over(W.partitionBy("instance", "component").orderBy("degree", "v"))
    return degrees(simple(edges)).join(components(edges), ["instance", "v"]).select("instance", "component", "v", place.alias("place"))
