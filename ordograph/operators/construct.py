"""Level-by-level labellings and the restricted candidate lists that order a level.

Level tables are (instance, attempt, v, level, value); within a level, smaller vertices queue first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ordograph.functions import kernels
from ordograph.functions.scalars import draw, draw_key
from ordograph.operators.bandwidth import bandwidth
from ordograph.operators.graph import vertices
from ordograph.operators.traverse import bfs, per_instance

LEVEL = ["instance", "attempt", "level"]


def split_list(levels: DataFrame, alpha: float, descending: bool = True) -> DataFrame:
    """with in_list: whether v is among the first floor(size * alpha) of its level by value."""
    order = F.col("value").desc() if descending else F.col("value").asc()
    w = W.partitionBy(*LEVEL)
    ranked = levels.withColumns({"rn": F.row_number().over(w.orderBy(order, "v")), "cnt": F.count("*").over(w)})
    return ranked.withColumn("in_list", F.col("rn") <= F.floor(F.col("cnt") * alpha)).drop("rn", "cnt")


def threshold_list(levels: DataFrame, alpha: float) -> DataFrame:
    """Rows with a value of at most max + alpha (min - max) of their level."""
    w = W.partitionBy(*LEVEL)
    top = F.max("value").over(w)
    return levels.withColumn("limit", top + alpha * (F.min("value").over(w) - top)).filter("value <= limit").drop("limit")


def top_list(levels: DataFrame, alpha: float) -> DataFrame:
    """The first max(1, floor(size * alpha)) of each level by descending value."""
    w = W.partitionBy(*LEVEL)
    ranked = levels.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("value"), "v")), "cnt": F.count("*").over(w)})
    return ranked.filter(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("cnt") * alpha))).drop("rn", "cnt")


def scored_list(levels: DataFrame, alpha: float, seed: int) -> DataFrame:
    """with score: (1 - alpha) * value + alpha * a draw."""
    return levels.withColumn("score", (1 - alpha) * F.col("value") + alpha * draw(seed, F.col("attempt"), F.col("v")))


def ordered_labels(levels: DataFrame, *within: Column) -> DataFrame:
    """(instance, solution, v, label): numbers by level, then `within`, then v; solution is the attempt."""
    label = F.row_number().over(W.partitionBy("instance", "attempt").orderBy("level", *within, "v"))
    return levels.select("instance", F.col("attempt").cast("string").alias("solution"), "v", label.alias("label"))


def level_labels(levels: DataFrame, descending: bool = True) -> DataFrame:
    return ordered_labels(levels, F.col("value").desc() if descending else F.col("value").asc())


def rotated_labels(levels: DataFrame, seed: int) -> DataFrame:
    """Each level in queue order, rotated by a drawn offset."""
    w = W.partitionBy(*LEVEL)
    placed = levels.withColumns({"pos": F.row_number().over(w.orderBy("v")) - 1, "width": F.count("*").over(w)})
    offset = F.floor(draw(seed, F.col("attempt"), F.col("level")) * F.col("width"))
    return ordered_labels(placed.withColumn("turn", F.pmod(F.col("pos") - offset, F.col("width"))), F.col("turn"))


def list_labels(levels: DataFrame, alpha: float, seed: int, descending: bool = True) -> DataFrame:
    """The list of each level first, then the rest, both shuffled."""
    return ordered_labels(split_list(levels, alpha, descending), F.desc("in_list"), draw_key(seed, F.col("attempt"), F.col("v")))


def roulette_roots(values: DataFrame, attempts: int, seed: int) -> DataFrame:
    """(instance, attempt, root): drawn with a probability in proportion to the value (uniform if all are 0)."""
    total = values.groupBy("instance").agg(F.sum("value").alias("total"))
    weight = values.join(total, "instance").withColumn("w", F.when(F.col("total") > 0, F.col("value")).otherwise(F.lit(1.0)))
    cum = weight.withColumn("cum", F.sum("w").over(W.partitionBy("instance").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    tries = weight.groupBy("instance").agg(F.sum("w").alias("all")).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    due = tries.withColumn("due", draw(seed, F.col("attempt")) * F.col("all"))
    return cum.join(due, "instance").filter("cum > due").groupBy("instance", "attempt").agg(F.min("v").alias("root"))


def levels_from(edges: DataFrame, roots: DataFrame, values: DataFrame) -> DataFrame:
    """The level table of attempts (instance, attempt, root); vertices that a root doesn't reach come last, as level
    2147483647."""
    found = bfs(edges, roots.select("instance", "root").distinct()).select("instance", "root", "v", "level")
    every = roots.join(vertices(edges), "instance").join(found, ["instance", "root", "v"], "left")
    return every.join(values.select("instance", "v", "value"), ["instance", "v"], "left").select("instance", "attempt", "v", F.coalesce("level", F.lit(2147483647)).alias("level"), F.coalesce("value", F.lit(0.0)).alias("value"))


def best_attempts(edges: DataFrame, values: DataFrame, attempts: int = 3, alpha: float = 0.3, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels of all attempts, log of bandwidths, best attempt of each instance)."""
    labels = list_labels(levels_from(edges, roulette_roots(values, attempts, seed), values), alpha, seed)
    log = bandwidth(edges, labels)
    best = log.groupBy("instance").agg(F.min(F.struct("bandwidth", F.col("solution").cast("int").alias("attempt"))).alias("m")).select("instance", "m.attempt", "m.bandwidth")
    return labels, log, best


def random_level_search(edges: DataFrame, tables: dict[str, np.ndarray] | None = None, alpha: float = 0.5, tries: int = 10, seed: int = 0) -> DataFrame:
    """Best of several breadth-first orders with a random centrality for each level; one instance a task. Without
    tables: degree and betweenness."""

    def run(name, names, g):
        values = np.stack(list(tables.values())) if tables else np.stack([g.degree.astype(float), kernels.betweenness(g)])
        rng, best = np.random.default_rng(seed), None
        for _ in range(tries):
            label = kernels.labels_of(kernels.level_order(g, values, alpha, rng, pick=lambda size, left: int(rng.integers(len(values)))))
            if best is None or g.bandwidth(label) < g.bandwidth(best):
                best = label
        return pd.DataFrame({"instance": name, "solution": "levels", "v": names, "label": best})

    return per_instance(edges, run, "instance string, solution string, v int, label int")
