"""Vertex centralities (instance, name, v, value), a registry of them, and start-vertex selectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ordograph.functions import kernels
from ordograph.operators.graph import adjacency, degrees, simple, twins, vertices
from ordograph.operators.traverse import distance_counts, per_instance
from ordograph.plans.storage import discard, written

REGISTRY: dict[str, tuple] = {}


def register(name: str, function, reverse: bool = True) -> None:
    """Adds a centrality: function(edges) -> (instance, v, value); reverse: larger values first in level orders."""
    REGISTRY[name] = (function, reverse)


def compute(edges: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The long table of several centralities."""
    out = None
    for name in names or list(REGISTRY):
        one = REGISTRY[name][0](edges).select("instance", F.lit(name).alias("name"), "v", "value")
        out = one if out is None else out.unionByName(one)
    return out


def _sizes(edges: DataFrame) -> DataFrame:
    return vertices(edges).groupBy("instance").agg(F.count("*").alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    return degrees(simple(edges)).join(_sizes(edges), "instance").select("instance", "v", F.try_divide(F.col("degree").cast("double"), F.col("n") - 1).alias("value"))


def _drawn(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """k vertices of each instance, the first by md5 of seed and vertex."""
    from pyspark.sql import Window as W

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("v").cast("string")))
    nth = F.row_number().over(W.partitionBy("instance").orderBy(key, "v"))
    return vertices(edges).withColumn("nth", nth).filter(F.col("nth") <= k).select("instance", F.col("v").alias("src"))


def closeness(edges: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """Reachable vertices over their distances, scaled by their share; with k, 0 for all but k drawn vertices."""
    edges = written(edges.select("instance", "u", "v").distinct(), "edges")
    classes, drawn = twins(edges), _drawn(edges, k, seed) if k else None
    d = distance_counts(edges, classes, drawn)
    own = d.groupBy("instance", "rep").agg(F.sum(F.col("d") * F.col("n")).alias("s"), (F.sum("n") - 1).alias("r"))
    got = classes.join(own, ["instance", "rep"]).join(_sizes(edges), "instance")
    got = got.select("instance", "v", F.coalesce(F.try_divide(F.col("r"), F.col("s")) * F.try_divide(F.col("r"), F.col("n") - 1), F.lit(0.0)).alias("value"))
    return got if k is None else vertices(edges).join(got.join(drawn.withColumnRenamed("src", "v"), ["instance", "v"], "left_semi"), ["instance", "v"], "left").fillna(0.0, ["value"])


def harmonic(edges: DataFrame) -> DataFrame:
    edges = written(edges.select("instance", "u", "v").distinct(), "edges")
    classes = twins(edges)
    own = distance_counts(edges, classes).groupBy("instance", "rep").agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("n") / F.col("d"))), F.lit(0.0)).alias("value"))
    return classes.join(own, ["instance", "rep"]).select("instance", "v", "value")


def _kernel(function):
    def run(name, names, g):
        return pd.DataFrame({"instance": name, "v": names, "value": function(g)})

    return lambda edges: per_instance(edges, run, "instance string, v int, value double")


def betweenness(edges: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """With k, from k drawn sources, scaled up."""

    def function(g):
        if k is None or k >= g.n:
            return kernels.betweenness(g)
        order = sorted(range(g.n), key=lambda x: hashlib.md5(f"{seed}:{x}".encode()).hexdigest())
        return kernels.betweenness(g, order[:k])

    return _kernel(function)(edges)


current_flow_betweenness = _kernel(kernels.current_flow_betweenness)
percolation = _kernel(kernels.percolation)
eigenvector_dense = _kernel(kernels.eigenvector_dense)


def _steps(edges: DataFrame, rounds: int, start, step, tol: float | None) -> DataFrame:
    """Repeated products of the adjacency table with a vertex table; every fourth round is written.

    With tol, ends once the values of each instance move by less than n * tol in a round, in all; if that takes more than
    `rounds` rounds, an error says so rather than values that haven't converged. Without, exactly `rounds` rounds.
    """
    adj = written(adjacency(simple(edges)), "adjacency")
    every = written(vertices(edges).join(degrees(simple(edges)), ["instance", "v"]).join(_sizes(edges), "instance"), "vertices")
    now, before, converged = every.withColumn("x", start), None, tol is None
    for r in range(1, rounds + 1):
        flow = adj.join(now.select("instance", F.col("v").alias("src"), "x", "degree"), ["instance", "src"])
        came = flow.groupBy("instance", F.col("dst").alias("v")).agg(F.sum("x").alias("plain"), F.sum(F.col("x") / F.col("degree")).alias("shared"))
        new = every.join(came, ["instance", "v"]).join(now.select("instance", "v", F.col("x").alias("old")), ["instance", "v"])
        new = step(new)
        if r % 4 == 0 or r == rounds:
            new = written(new, "step")
            if before is not None:
                discard(before)
            before = new
            if tol is not None and new.groupBy("instance").agg(F.sum(F.abs(F.col("x") - F.col("old"))).alias("moved"), F.first("n").alias("n")).filter(F.col("moved") >= F.col("n") * tol).isEmpty():
                now, converged = new.select("instance", "v", "degree", "n", "x"), True
                break
        now = new.select("instance", "v", "degree", "n", "x")
    if not converged:
        raise RuntimeError(f"not converged to {tol} after {rounds} rounds")
    return now.select("instance", "v", F.col("x").alias("value"))


def _unit(df: DataFrame) -> DataFrame:
    norm = df.groupBy("instance").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return df.join(norm, "instance").withColumn("x", F.col("x") / F.col("norm")).drop("norm")


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 1000, tol: float | None = 1e-6) -> DataFrame:
    return _steps(edges, rounds, 1 / F.col("n"), lambda d: d.withColumn("x", alpha * F.col("shared") + (1 - alpha) / F.col("n")), tol)


def katz(edges: DataFrame, alpha: float = 0.005, beta: float = 1.0, rounds: int = 2000, tol: float | None = 1e-6) -> DataFrame:
    got = _steps(edges, rounds, F.lit(0.0), lambda d: d.withColumn("x", alpha * F.col("plain") + beta), tol)
    return _unit(got.withColumnRenamed("value", "x")).select("instance", "v", F.col("x").alias("value"))


def eigenvector(edges: DataFrame, rounds: int = 1000, tol: float | None = 1e-6) -> DataFrame:
    """By powers of A + I, which doesn't swing on bipartite graphs."""
    return _steps(edges, rounds, 1 / F.sqrt("n"), lambda d: _unit(d.withColumn("x", F.col("plain") + F.col("old"))), tol)


for _name, _function in (("Degree", degree), ("Closeness", closeness), ("Betweenness", betweenness), ("Eigenvector", eigenvector), ("Katz Centrality", katz), ("PageRank", pagerank), ("Harmonic Centrality", harmonic)):
    register(_name, _function)


def extreme_vertex(values: DataFrame, largest: bool = True) -> DataFrame:
    """(instance, v): the vertex with the largest or smallest value, ties to the smaller id."""
    key = F.struct((-F.col("value") if largest else F.col("value")).alias("k"), "v")
    return values.groupBy("instance").agg(F.min(key)["v"].alias("v"))


def as_matrix(values: DataFrame) -> dict[str, np.ndarray]:
    """Values by name, aligned with ascending vertices, for one small instance."""
    return {name: part.sort_values("v").value.to_numpy() for name, part in values.toPandas().groupby("name")}
