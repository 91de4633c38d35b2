"""Bandwidth of labellings (instance, solution, v, label) and what local search needs to know of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ordograph.functions.scalars import draw_key
from ordograph.operators.graph import adjacency, vertices
from ordograph.plans.storage import numbered

KEYS = ["instance", "solution"]


def identity_labels(edges: DataFrame, solution: str = "identity") -> DataFrame:
    return vertices(edges).select("instance", F.lit(solution).alias("solution"), "v", F.col("v").alias("label"))


def reversed_labels(labels: DataFrame) -> DataFrame:
    n = labels.groupBy(*KEYS).agg(F.max("label").alias("n"))
    return labels.join(n, KEYS).select("instance", F.lit("reversed").alias("solution"), "v", (F.col("n") + 1 - F.col("label")).alias("label"))


def random_labels(edges: DataFrame, seed: int, solution: str = "random") -> DataFrame:
    """A permutation by md5 of seed and vertex, for one instance."""
    drawn = vertices(edges).withColumn("k", draw_key(seed, F.col("v")))
    return numbered(drawn, ["k", "v"], "label").select("instance", F.lit(solution).alias("solution"), "v", "label")


def labels_from_order(order: DataFrame) -> DataFrame:
    """labels for (instance, solution, order: array of vertices)."""
    return order.select(*KEYS, F.posexplode("order").alias("p", "v")).select(*KEYS, "v", (F.col("p") + 1).alias("label"))


def order_from_labels(labels: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("label", "v")))
    return labels.groupBy(*KEYS).agg(F.transform(listed, lambda x: x["v"]).alias("order"))


def stretched(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(instance, solution, src, dst, fs, fd, d) for both directions of each edge."""
    adj = adjacency(edges)
    one = adj.join(labels.select(*KEYS, F.col("v").alias("src"), F.col("label").alias("fs")), ["instance", "src"])
    return one.join(labels.select(*KEYS, F.col("v").alias("dst"), F.col("label").alias("fd")), [*KEYS, "dst"]).withColumn("d", F.abs(F.col("fs") - F.col("fd")))


def bandwidth(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(instance, solution, bandwidth); 0 for an instance without edges."""
    one = edges.join(labels.select(*KEYS, F.col("v").alias("u"), F.col("label").alias("fu")), ["instance", "u"])
    both = one.join(labels.select(*KEYS, "v", F.col("label").alias("fv")), [*KEYS, "v"])
    got = both.groupBy(*KEYS).agg(F.max(F.abs(F.col("fu") - F.col("fv"))).alias("bandwidth"))
    return labels.select(*KEYS).distinct().join(got, KEYS, "left").fillna(0, ["bandwidth"])


def full_bandwidth(edges: DataFrame, labels: DataFrame) -> DataFrame:
    return bandwidth(edges, labels).withColumn("full_bandwidth", 2 * F.col("bandwidth") + 1).drop("bandwidth")


def node_bandwidth(edges: DataFrame, labels: DataFrame) -> DataFrame:
    return stretched(edges, labels).groupBy(*KEYS, F.col("src").alias("v")).agg(F.max("d").alias("bandwidth"))


def critical(edges: DataFrame, labels: DataFrame, by_node: bool = False) -> DataFrame:
    """Directed edges that attain the bandwidth, for each solution or for each vertex."""
    d = stretched(edges, labels)
    top = d.groupBy(*KEYS).agg(F.max("d").alias("top"))
    marked = d.join(top, KEYS).withColumn("c", (F.col("d") == F.col("top")).cast("long"))
    keys = [*KEYS, F.col("src").alias("v")] if by_node else KEYS
    return marked.groupBy(*keys).agg(F.sum("c").alias("critical"))


def critical_of_pair(edges: DataFrame, labels: DataFrame, a: int, b: int) -> DataFrame:
    """Critical edges at a or b, an edge between them counted once."""
    d = stretched(edges, labels)
    top = d.groupBy(*KEYS).agg(F.max("d").alias("top"))
    at = d.join(top, KEYS).filter(F.col("d") == F.col("top")).filter(F.col("src").isin(a, b))
    once = F.when((F.col("src") == b) & (F.col("dst") == a), 0).otherwise(1)
    return at.groupBy(*KEYS).agg(F.sum(once).alias("critical"))


def rho(one: DataFrame, two: DataFrame) -> DataFrame:
    """Vertices whose labels differ."""
    both = one.select("instance", "v", F.col("label").alias("x")).join(two.select("instance", "v", F.col("label").alias("y")), ["instance", "v"])
    return both.groupBy("instance").agg(F.sum((F.col("x") != F.col("y")).cast("long")).alias("rho"))


def move(edges: DataFrame, now: DataFrame, new: DataFrame, alpha: int) -> DataFrame:
    """(instance, accept): whether new has less bandwidth, or as much with fewer critical edges, or is far enough."""
    told = []
    for labels, tag in ((now, "1"), (new, "2")):
        told.append(bandwidth(edges, labels).join(critical(edges, labels), KEYS, "left").select("instance", F.col("bandwidth").alias("b" + tag), F.coalesce("critical", F.lit(0)).alias("c" + tag)))
    both = told[0].join(told[1], "instance").join(rho(now, new), "instance")
    accept = (F.col("b2") < F.col("b1")) | ((F.col("b2") == F.col("b1")) & ((F.col("c2") < F.col("c1")) | (F.col("rho") > alpha)))
    return both.select("instance", accept.alias("accept"))


def neighbour_extremes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """For each vertex the neighbours with the largest and smallest label, and the middle of the two."""
    got = stretched(edges, labels).groupBy(*KEYS, F.col("src").alias("v")).agg(F.max_by("dst", "fd").alias("max_vertex"), F.max("fd").alias("max_label"), F.min_by("dst", "fd").alias("min_vertex"), F.min("fd").alias("min_label"))
    return got.withColumn("mid", F.floor((F.col("max_label") + F.col("min_label")) / 2).cast("int"))


def mid_neighbours(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(…, v, near): neighbours whose label is nearer to the middle than v's own."""
    mid = neighbour_extremes(edges, labels).select(*KEYS, F.col("v").alias("src"), "mid")
    closer = stretched(edges, labels).join(mid, [*KEYS, "src"]).filter(F.abs(F.col("mid") - F.col("fd")) < F.abs(F.col("mid") - F.col("fs")))
    return closer.select(*KEYS, F.col("src").alias("v"), F.col("dst").alias("near")).distinct()


def swapped(labels: DataFrame, a: int, b: int) -> DataFrame:
    pair = labels.filter(F.col("v").isin(a, b)).groupBy(*KEYS).agg(F.sum("label").alias("both"))
    return labels.join(pair, KEYS).select(*KEYS, "v", F.when(F.col("v").isin(a, b), F.col("both") - F.col("label")).otherwise(F.col("label")).cast("int").alias("label"))


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between labels; repeated ones stay."""
    one = edges.join(labels.select(*KEYS, F.col("v").alias("u"), F.col("label").alias("fu")), ["instance", "u"])
    both = one.join(labels.select(*KEYS, "v", F.col("label").alias("fv")), [*KEYS, "v"])
    return both.select(*KEYS, F.least("fu", "fv").alias("u"), F.greatest("fu", "fv").alias("v"))


def spy(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(…, row, col): the non-zeros behind a picture of the reordered matrix."""
    e = relabelled(edges, labels)
    return e.select(*KEYS, F.col("u").alias("row"), F.col("v").alias("col")).union(e.select(*KEYS, "v", "u")).distinct()
