"""Graph views of edge tables (instance, u, v), and graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ordograph.functions.scalars import draw
from ordograph.plans.storage import dense_ids, discard, numbered, table, written


def edges_of(coo: DataFrame) -> DataFrame:
    """Off-diagonal entries as edges u < v; repeated entries stay."""
    return coo.filter("i <> j").withColumns({"u": F.least("i", "j"), "v": F.greatest("i", "j")}).drop("i", "j", "val", "im")


def simple(edges: DataFrame) -> DataFrame:
    return edges.select("instance", "u", "v").filter("u <> v").distinct()


def adjacency(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(instance, src, dst): both directions of each edge; kind '+' or '-' keeps only out- or in-neighbours."""
    out = edges.select("instance", F.col("u").alias("src"), F.col("v").alias("dst"))
    into = edges.select("instance", F.col("v").alias("src"), F.col("u").alias("dst"))
    return out if kind == "+" else into if kind == "-" else out.unionByName(into)


def vertices(edges: DataFrame) -> DataFrame:
    return adjacency(edges).select("instance", F.col("src").alias("v")).distinct()


def all_vertices(instances: DataFrame) -> DataFrame:
    """1 to nrows, isolated ones included."""
    return instances.select("instance", F.explode(F.sequence(F.lit(1), F.col("nrows"))).alias("v"))


def neighbours(edges: DataFrame, closed: bool = False) -> DataFrame:
    """(instance, v, near): sorted neighbour lists, with v itself if closed."""
    adj = adjacency(edges)
    if closed:
        adj = adj.union(vertices(edges).select("instance", "v", "v"))
    return adj.groupBy("instance", F.col("src").alias("v")).agg(F.array_sort(F.collect_list("dst")).alias("near"))


def adjacent(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (instance, a, b) with `adjacent`."""
    adj = adjacency(edges).distinct().select("instance", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("adjacent"))
    return pairs.join(adj, ["instance", "a", "b"], "left").fillna(False, ["adjacent"])


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("instance", "u", "v"), ["instance", "u", "v"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("instance", F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def twins(edges: DataFrame) -> DataFrame:
    """(instance, v, rep, size): each vertex's class of those with the same neighbours, by its smallest vertex, and how
    many they are; vertices without neighbours stay alone. A written table.

    Exchanging two such vertices maps the graph onto itself, so distances and centralities are the same for a class.
    Neighbours are compared by their number and 128 bits of hashes, so that no list of a hub's neighbours is made.
    """
    every = vertices(edges)
    bits = [F.bit_xor(F.xxhash64(F.lit(k), "dst")).alias(f"h{k}") for k in (1, 2)]
    near = adjacency(simple(edges)).groupBy("instance", F.col("src").alias("v")).agg(F.count("*").alias("k"), *bits)
    near = every.join(near, ["instance", "v"], "left").select("instance", "v", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("h1", "v").alias("h1"), F.coalesce("h2", F.lit(0)).alias("h2"))
    key = ["instance", "k", "h1", "h2"]
    near = written(near, "neighbours")
    out = written(near.join(near.groupBy(*key).agg(F.min("v").alias("rep"), F.count("*").alias("size")), key).select("instance", "v", "rep", "size"), "twins")
    discard(near)
    return out


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among chosen (instance, v)."""
    one = edges.join(chosen.select("instance", F.col("v").alias("u")), ["instance", "u"], "left_semi")
    return one.join(chosen.select("instance", "v"), ["instance", "v"], "left_semi")


def insertion_order(edges: DataFrame) -> DataFrame:
    """(path, v, pos): vertices by their first appearance in edges (path, ord, i, j as u, v), from 0."""
    ends = edges.select("path", "v0", "ord", F.lit(0).alias("slot")) if "v0" in edges.columns else edges.select("path", F.col("u").alias("x"), F.col("ord"), F.lit(0).alias("slot")).union(edges.select("path", "v", "ord", F.lit(1)))
    first = ends.groupBy("path", "x").agg(F.min(F.struct("ord", "slot")).alias("first"))
    return first.select("path", F.col("x").alias("v"), (F.row_number().over(W.partitionBy("path").orderBy("first")) - 1).alias("pos"))


def transitivity(edges: DataFrame) -> DataFrame:
    """(instance, triangles, triads, transitivity): closed and all paths of two edges.

    Edges go from the vertex of smaller (degree, id), so that a hub has few outgoing ones and no path is listed twice.
    """
    plain = simple(edges)
    d = degrees(plain)
    ends = plain.join(d.select("instance", F.col("v").alias("u"), F.col("degree").alias("du")), ["instance", "u"]).join(d.select("instance", "v", F.col("degree").alias("dv")), ["instance", "v"])
    swap = F.struct("du", "u") > F.struct("dv", "v")
    way = written(ends.select("instance", F.when(swap, F.col("v")).otherwise(F.col("u")).alias("a"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("b")), "oriented")
    two = way.join(way.select("instance", "a", F.col("b").alias("c")), ["instance", "a"]).filter("b < c")
    closed = way.select("instance", F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    triangles = two.join(closed, ["instance", "b", "c"]).groupBy("instance").agg(F.count("*").alias("triangles"))
    triads = d.groupBy("instance").agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).cast("long").alias("triads"))
    out = triads.join(triangles, "instance", "left").fillna(0, ["triangles"])
    return out.select("instance", "triangles", "triads", F.coalesce(F.try_divide(3.0 * F.col("triangles"), F.col("triads")), F.lit(0.0)).alias("transitivity"))


def random_connected(spark: SparkSession, n: int, seed: int = 1, instance: str = "random") -> DataFrame:
    """A chain of n vertices and n / 2 further edges with drawn ends."""
    chain = spark.range(1, n).select(F.lit(instance).alias("instance"), F.col("id").cast("int").alias("u"), (F.col("id") + 1).cast("int").alias("v"))
    a, b = ((F.floor(draw(seed, s, F.col("id")) * n) + 1).cast("int") for s in ("a", "b"))
    more = spark.range(n // 2).select(F.lit(instance), F.least(a, b), F.greatest(a, b)).toDF("instance", "u", "v").filter("u <> v")
    return chain.union(more)


def tree_graph(spark: SparkSession, d: str) -> DataFrame:
    nation, region, customer = (table(spark, d, t) for t in ("nation", "region", "customer"))
    top = nation.join(region, nation.n_regionkey == region.r_regionkey).select((F.col("r_regionkey") + 1).cast("int").alias("u"), (F.col("n_nationkey") + 6).cast("int").alias("v"))
    leaf = numbered(customer.select("c_custkey", "c_nationkey"), ["c_custkey"], "k").select((F.col("c_nationkey") + 6).cast("int"), (F.col("k") + 30).cast("int"))
    return top.union(leaf).select(F.lit("tree").alias("instance"), "u", "v")


def _bipartite(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    left = written(dense_ids(rows, a, "u"), name)
    n = left.count()
    right = dense_ids(rows, b, "v").withColumn("v", (F.col("v") + n).cast("int"))
    return rows.select(a, b).distinct().join(left, a).join(right, b).select(F.lit(name).alias("instance"), "u", "v")


def supplier_part_graph(spark: SparkSession, d: str) -> DataFrame:
    return _bipartite(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "sp")


def user_graph(spark: SparkSession, d: str) -> DataFrame:
    return _bipartite(table(spark, d, "events"), "user_id", "event_type", "user")


def sequence_graph(spark: SparkSession, d: str) -> DataFrame:
    """User to next user by time; repeated edges stay."""
    at = written(numbered(table(spark, d, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"], "k").select("k", (F.col("user_id") + 1).cast("int").alias("x")), "sequence")
    after = at.select((F.col("k") - 1).alias("k"), F.col("x").alias("y"))
    return at.join(after, "k").filter("x <> y").select(F.lit("seq").alias("instance"), F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
