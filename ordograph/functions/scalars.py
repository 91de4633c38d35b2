"""Column functions: bounds, rewards, state bands, reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def draw(*parts) -> Column:
    """A number in [0, 1) from the md5 of its parts joined by colons; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def draw_key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def bw_lower_bound(n: Column, m: Column) -> Column:
    """Smallest b with m <= b (2n - b - 1) / 2."""
    inside = F.pow(2 * n - 1, 2) - 8 * m
    return F.when((m > 0) & (inside >= 0), F.ceil(n - (1 + F.sqrt(inside)) / 2)).otherwise(F.lit(0)).cast("long")


def bw_bound_ref(n: Column, m: Column) -> Column:
    """The published formula, the largest of four roots; it exceeds n - 1 and so bounds nothing."""
    roots = []
    for s in (-1, 1):
        inside = F.pow(2 * n + s, 2) - 8 * m
        for t in (-1, 1):
            roots.append(F.when(inside >= 0, n + t * (1 + F.sqrt(inside)) / 2))
    return F.coalesce(F.greatest(*roots), F.lit(0.0))


def bandwidth_reward(bw: Column, n: Column, bound: Column) -> Column:
    return -F.greatest(F.lit(0.0), bw - bound) / F.greatest(F.lit(1), n)


def decay_pct(initial: Column, final: Column) -> Column:
    return F.bround(F.try_divide(100.0 * (initial - final), initial), 2)


def step_reward(cost: Column, best: Column, previous: Column) -> Column:
    return F.when((cost <= best) & (cost <= previous), 10).when(cost <= previous, 5).otherwise(-2)


def state_bins_fixed(size: Column, left: Column) -> tuple[Column, Column]:
    """Level-size band 0 to 5 and unvisited-share band 0 to 4 with fixed limits."""
    level = F.when(size == 0, 0).when(size <= 2, 1).when(size <= 5, 2).when(size <= 10, 3).when(size <= 20, 4).otherwise(5)
    share = F.when(left <= 0.1, 0).when(left <= 0.25, 1).when(left <= 0.5, 2).when(left <= 0.75, 3).otherwise(4)
    return level, share


def state_bins_equal(size: Column, n: Column, left: Column) -> tuple[Column, Column]:
    """The same with five equally wide bands each."""
    level = F.when(size == 0, 0).otherwise(F.least(F.lit(5), F.ceil(size * 5 / n))).cast("int")
    share = F.greatest(F.lit(0), F.least(F.lit(4), F.ceil(left * 5) - 1)).cast("int")
    return level, share


def recommended_centrality(density: Column, diameter: Column, aspl: Column, components: Column) -> Column:
    """Rules of thumb from topology to the centrality to begin with."""
    return (
        F.when(components > 1, "Harmonic Centrality").when(density >= 0.1, "Katz Centrality").when((diameter > 30) | (aspl > 11), "Degree").when(density < 0.01, "PageRank").otherwise("Closeness")
    )
