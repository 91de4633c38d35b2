"""Profile statistics of matrices (instance, ord, i, j, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def counts(coo: DataFrame) -> DataFrame:
    return coo.groupBy("instance").agg(F.count("*").alias("entries"), *[F.count_if(F.expr(c)).alias(n) for n, c in (("diagonal", "i = j"), ("below", "i > j"), ("above", "i < j"))])


def per_line(coo: DataFrame, axis: str, size: int | None = None) -> DataFrame:
    """(instance, line, nonzeros): of each row (axis 'i') or column ('j'), with empty ones if size is given."""
    got = coo.filter("val <> 0").groupBy("instance", F.col(axis).alias("line")).agg(F.count("*").alias("nonzeros"))
    if size is None:
        return got
    every = coo.select("instance").distinct().withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(size))))
    return every.join(got, ["instance", "line"], "left").fillna(0, ["nonzeros"])


def line_summary(lines: DataFrame) -> DataFrame:
    """Least and most non-zeros with the first line that has them, mean and population deviation."""
    return lines.groupBy("instance").agg(
        F.min("nonzeros").alias("least"), F.min(F.struct("nonzeros", "line"))["line"].alias("least_at"), F.max("nonzeros").alias("most"),
        F.max(F.struct("nonzeros", -F.col("line")))["col2"].alias("minus_at"), F.avg("nonzeros").alias("mean"), F.stddev_pop("nonzeros").alias("deviation"),
    ).withColumn("most_at", -F.col("minus_at")).drop("minus_at")


def last_values(coo: DataFrame) -> DataFrame:
    """One value a cell: the last one stored."""
    return coo.groupBy("instance", "i", "j").agg(F.max_by("val", "ord").alias("val"))


def transpose(coo: DataFrame) -> DataFrame:
    return coo.withColumns({"i": F.col("j"), "j": F.col("i")})


def asymmetry(cells: DataFrame) -> DataFrame:
    """Frobenius norm of A - A' for cells (instance, i, j, val)."""
    other = cells.select("instance", F.col("j").alias("i"), F.col("i").alias("j"), F.col("val").alias("b"))
    both = cells.join(other, ["instance", "i", "j"], "full")
    diff = F.coalesce("val", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return both.groupBy("instance").agg(F.sqrt(F.sum(diff * diff)).alias("asymmetry"))


def row_reach(coo: DataFrame) -> DataFrame:
    """(instance, i, lower, upper): distance of a row's first and last entry from the diagonal, possibly negative."""
    return coo.groupBy("instance", "i").agg((F.col("i") - F.min("j")).alias("lower"), (F.max("j") - F.col("i")).alias("upper"))


def reach_summary(reach: DataFrame) -> DataFrame:
    return reach.groupBy("instance").agg(*[f(c).alias(f"{n}_{c}") for c in ("lower", "upper") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("dev", F.stddev_pop))])
