"""Roll-ups of a run log (run_id, instance, episode, attempt, centrality, bandwidth, initial_bandwidth, …)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ordograph.functions.scalars import decay_pct

# Centralities in their order, with abbreviations.
ORDER = ["Degree", "Closeness", "Betweenness", "Eigenvector", "Katz Centrality", "PageRank", "Harmonic Centrality"]
SHORT = ["DC", "CC", "BC", "EC", "KC", "PR", "HC"]


def dimension(runs: DataFrame) -> DataFrame:
    return runs.sparkSession.createDataFrame([(i, n, s) for i, (n, s) in enumerate(zip(ORDER, SHORT, strict=True))], "ordinal int, centrality string, short string")


def abbreviated(runs: DataFrame) -> DataFrame:
    """with ordinal and short name; null for a centrality that isn't listed."""
    return runs.join(F.broadcast(dimension(runs)), "centrality", "left")


def best_with_ties(runs: DataFrame) -> DataFrame:
    least = runs.groupBy("instance").agg(F.min("bandwidth").alias("bandwidth"))
    return runs.dropDuplicates().join(least, ["instance", "bandwidth"], "left_semi")


def keep_first(runs: DataFrame) -> DataFrame:
    """Of each instance's best rows the one with the smallest run_id."""
    key = F.struct("bandwidth", "run_id")
    first = runs.groupBy("instance").agg(F.min(key).alias("m")).select("instance", F.col("m.run_id").alias("run_id"))
    return runs.join(first, ["instance", "run_id"], "left_semi")


def repeated(runs: DataFrame) -> DataFrame:
    """Instances with several best rows, and how many."""
    return best_with_ties(runs).groupBy("instance").agg(F.count("*").alias("n")).filter("n > 1")


def frequency(runs: DataFrame, zero_fill: bool = False) -> DataFrame:
    """(instance, centrality, n) of best rows, optionally with all listed centralities."""
    n = best_with_ties(runs).groupBy("instance", "centrality").agg(F.count("*").alias("n"))
    if not zero_fill:
        return n
    every = runs.select("instance").distinct().withColumn("centrality", F.explode(F.array(*map(F.lit, ORDER))))
    return every.join(n, ["instance", "centrality"], "left").fillna(0, ["n"])


def decay(runs: DataFrame) -> DataFrame:
    """(instance, initial_bandwidth, final, decay_pct_ref, decay_pct): in the published units, and bandwidth on both
    sides."""
    first = keep_first(runs)
    b0 = (F.col("initial_bandwidth") - 1) / 2
    return first.select("instance", "initial_bandwidth", F.col("bandwidth").alias("final"), decay_pct(F.col("initial_bandwidth"), F.col("bandwidth")).alias("decay_pct_ref"), decay_pct(b0, F.col("bandwidth")).alias("decay_pct"))


def quantile_edges(df: DataFrame, metric: str, q: int = 5) -> DataFrame:
    """One row: distinct exact quantiles, to nine digits."""
    shares = [i / q for i in range(q + 1)]
    raw = df.agg(F.percentile(F.col(metric), F.array(*map(F.lit, shares))).alias("p"))
    return raw.select(F.array_distinct(F.transform("p", lambda x: F.round(x, 9))).alias("edges"))


def binned(df: DataFrame, metric: str, q: int = 5) -> DataFrame:
    """df with bin (from 1), lo and hi: right-closed quantile bins, the lowest edge included."""
    edges = F.broadcast(quantile_edges(df, metric, q))  # one row
    x = F.round(F.col(metric).cast("double"), 9)
    k = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < x)))
    return df.crossJoin(edges).withColumn("bin", k).withColumns({"lo": F.get("edges", F.col("bin") - 1), "hi": F.get("edges", F.col("bin"))}).drop("edges")


def bin_counts(df: DataFrame, metric: str, q: int = 5) -> DataFrame:
    """(bin, n) for every bin, empty ones included."""
    n = binned(df, metric, q).groupBy("bin").agg(F.count("*").alias("n"))
    every = quantile_edges(df, metric, q).select(F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("edges") - 1))).alias("bin"))
    return every.join(n, "bin", "left").fillna(0, ["n"])


def interval_label(df: DataFrame) -> DataFrame:
    return df.withColumn("interval", F.format_string("(%.3f, %.3f]", "lo", "hi"))


def violin(runs: DataFrame) -> DataFrame:
    p = F.percentile("bandwidth", F.array(*map(F.lit, [0.0, 0.25, 0.5, 0.75, 1.0])))
    got = runs.groupBy("instance", "centrality").agg(p.alias("p"), F.avg("bandwidth").alias("mean"), F.stddev_samp("bandwidth").alias("sd"), F.count("*").alias("n"))
    return got.select("instance", "centrality", *[F.col("p")[i].alias(c) for i, c in enumerate(("lowest", "q1", "median", "q3", "highest"))], "mean", "sd", "n")


def pivoted(runs: DataFrame, loops: int = 3) -> DataFrame:
    """A row for each instance with the best bandwidth of each attempt 0 to loops - 1."""
    return runs.filter(F.col("attempt") < loops).groupBy("instance").pivot("attempt", list(range(loops))).agg(F.min("bandwidth")).toDF("instance", *[f"band{i}" for i in range(loops)])


def first_values(runs: DataFrame, columns: list[str]) -> DataFrame:
    return runs.groupBy("instance").agg(*[F.min_by(c, "run_id").alias(c) for c in columns])


def cumulative_score(log: DataFrame) -> DataFrame:
    w = W.partitionBy("instance").orderBy("episode").rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("score", F.sum("reward").over(w))


def pending(instances: DataFrame, runs: DataFrame) -> DataFrame:
    """The instances that a log doesn't have yet, from which a stopped batch goes on."""
    return instances.join(runs.select("instance").distinct(), "instance", "left_anti")


def enriched(runs: DataFrame, topology: DataFrame) -> DataFrame:
    """runs with the topology of their instance; runs of unknown instances stay."""
    return runs.join(topology, "instance", "left")


def ordered_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """df with the columns of `first` that it has in front, the others as they were."""
    front = [c for c in first if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in front])


def compared(runs: DataFrame) -> DataFrame:
    """(instance, initial_bandwidth, best, worst, mean, wins): a row a file, wins by centrality as text."""
    best = runs.groupBy("instance").agg(F.min_by("initial_bandwidth", "run_id").alias("initial_bandwidth"), F.min("bandwidth").alias("best"), F.max("bandwidth").alias("worst"), F.round(F.avg("bandwidth"), 6).alias("mean"))
    won = frequency(runs).groupBy("instance").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "centrality", F.col("n").cast("string")))), ", ").alias("wins"))
    return best.join(won, "instance")
