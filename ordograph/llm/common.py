"""What the corpus operators share: tables in the shared folder, connected components, prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ordograph.plans.storage import discard, running_totals, table, written

__all__ = ["components", "discard", "fresh", "running_totals", "table", "written"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of df's columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
        taken.add(name)
    return out


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest id connected with each node of edges (a, b). Nodes without an edge don't appear.

    Minimum labels travel along edges, with pointer jumping; each round is a written table. Minima are combined
    before each shuffle, and joins on a hub's id are left to adaptive skew handling.
    """
    both = edges.select("a", "b").filter("a <> b and a is not null and b is not null")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    kept = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), label)
    while True:
        now = kept.select("node", "root")
        hop = both.join(now, both.b == now.node).groupBy("a").agg(F.min("root").alias("near"))
        near = now.join(hop, now.node == hop.a).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = now.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        step = near.join(up, near.root == up.up, "left").select("node", F.least("root", F.coalesce("up_root", "root")).alias("root"), "was")
        step = written(step, label)
        discard(kept)
        if step.filter("root <> was").isEmpty():
            discard(both)
            return step.select("node", "root")
        kept = step
