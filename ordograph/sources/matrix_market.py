"""Matrix-Market, edge-list and adjacency-list files as DataFrames, and writers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ordograph.plans.storage import numbered


def lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, instance, kind, ord, line): lines of each file, from 0; kind is the parent directory's name."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    whole = reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.split("path", "/")
    return whole.select("path", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("instance"), F.element_at(parts, -2).alias("kind"), F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))


def _tokens() -> Column:
    return F.split(F.trim("line"), r"\s+")


def headers(text: DataFrame) -> DataFrame:
    """(path, instance, kind, object, format, field, symmetry, typecode, nrows, ncols, nnz_header, head, valid)

    valid: whether the banner's combination is one the format allows, or there is no banner; nnz_header is null for
    dense arrays and for headers of two numbers.
    """
    banner = text.filter("ord = 0").select("path", *[F.lower(F.regexp_extract("line", r"^%%MatrixMarket\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)", i + 1)).alias(c) for i, c in enumerate(("object", "format", "field", "symmetry"))])
    data = text.filter((~F.col("line").startswith("%")) & (F.trim("line") != ""))
    first = data.groupBy("path", "instance", "kind").agg(F.min_by("line", "ord").alias("line"), F.min("ord").alias("head"))
    t = F.transform(_tokens(), lambda x: x.try_cast("double").cast("long"))
    out = first.join(banner, "path", "left").select("path", "instance", "kind", "object", "format", "field", "symmetry", F.concat_ws(" ", "object", "format", "field", "symmetry").alias("typecode"), F.get(t, 0).cast("int").alias("nrows"), F.get(t, 1).cast("int").alias("ncols"), F.get(t, 2).alias("nnz_header"), "head")
    no_banner = F.coalesce(F.col("object"), F.lit("")) == ""
    wrong = (F.col("object") != "matrix") | ((F.col("format") == "array") & (F.col("field") == "pattern")) | ((F.col("field") == "real") & (F.col("symmetry") == "hermitian")) | ((F.col("field") == "pattern") & F.col("symmetry").isin("hermitian", "skew-symmetric"))
    return out.withColumn("valid", no_banner | (~wrong & F.col("format").isin("coordinate", "array") & F.col("field").isin("real", "complex", "pattern", "integer")))


def read_coo(spark: SparkSession, paths, glob: str | None = None, strict: bool = False, base: int = 1, legacy: bool = False) -> DataFrame:
    """(path, instance, kind, ord, i, j, val, im): stored entries, indices as in the file less 1 - base.

    strict: two whole numbers a line and no comments, else an error. legacy: also headers of two numbers (n, entries).
    Files with neither, and dense arrays, are left out (see read_vector).
    """
    text = lines(spark, paths, glob)
    head = headers(text).filter((F.coalesce("format", F.lit("")) != "array") & F.col("valid") & (F.col("nnz_header").isNotNull() | F.lit(legacy)))
    if strict:
        bad = F.col("line").startswith("%") | ((F.trim("line") != "") & ~F.trim("line").rlike(r"^\d+\s+\d+(\s+\d+)?$"))
        text = text.withColumn("line", F.when(bad, F.raise_error(F.concat(F.lit("not a strict line: "), "line"))).otherwise(F.col("line")))
    body = text.join(head.select("path", "head", "field"), "path").filter((F.col("ord") > F.col("head")) & ~F.col("line").startswith("%") & (F.trim("line") != ""))
    t = _tokens()
    shift = base - 1
    return body.select("path", "instance", "kind", (F.col("ord") - F.col("head")).cast("long").alias("ord"), (F.get(t, 0).cast("double").cast("int") + shift).alias("i"), (F.get(t, 1).cast("double").cast("int") + shift).alias("j"), F.when(F.col("field") == "pattern", F.lit(1.0)).otherwise(F.get(t, 2).try_cast("double")).alias("val"), F.get(t, 3).try_cast("double").alias("im"))


def read_vector(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """(path, instance, v, val): dense array files of one column as vertex attributes."""
    text = lines(spark, paths, glob)
    head = headers(text).filter("format = 'array' and valid").select("path", "head")
    body = text.join(head, "path").filter((F.col("ord") > F.col("head")) & (F.trim("line") != "") & ~F.col("line").startswith("%"))
    v = F.row_number().over(W.partitionBy("path").orderBy("ord"))
    return body.select("path", "instance", v.alias("v"), F.trim("line").cast("double").alias("val"))


def symmetric(coo: DataFrame) -> DataFrame:
    """Stored entries with the mirror image of those off the diagonal, for files that store one triangle."""
    other = coo.filter("i <> j").withColumns({"i": F.col("j"), "j": F.col("i")})
    return coo.unionByName(other)


def read_edge_list(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """(a, b): two vertex names a line; comments begin with #."""
    text = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    t = F.split(F.trim("value"), r"\s+" if sep == " " else sep)
    return text.select(F.get(t, 0).alias("a"), F.get(t, 1).alias("b"))


def read_adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """(a, b): a vertex name followed by its neighbours a line."""
    text = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    t = F.split(F.trim("value"), r"\s+")
    # the name is a column of its own before the rows are made, else each of them splits its whole line again
    named = text.select(F.get(t, 0).alias("a"), F.slice(t, F.lit(2), F.greatest(F.lit(0), F.size(t) - 1)).alias("near"))
    return named.select("a", F.explode("near").alias("b"))


def with_ids(named: DataFrame) -> DataFrame:
    """(u, v) for named edges (a, b): names numbered from 1 in their order."""
    ids = numbered(named.select(F.col("a").alias("name")).union(named.select("b")).distinct(), ["name"], "id")
    return named.join(ids.select(F.col("name").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("name").alias("b"), F.col("id").alias("y")), "b").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def as_lines(coo: DataFrame, nrows: int, ncols: int, field: str = "real", symmetry: str = "general") -> DataFrame:
    """(ord, line): banner, sizes and entries in Matrix-Market form."""
    body = {"pattern": F.format_string("%d %d", "i", "j"), "integer": F.format_string("%d %d %d", "i", "j", F.col("val").cast("long")), "real": F.format_string("%d %d %20.16e", "i", "j", "val"), "complex": F.format_string("%d %d %20.16e %20.16e", "i", "j", "val", "im")}[field]
    spark = coo.sparkSession
    top = spark.createDataFrame([(-2, f"%%MatrixMarket matrix coordinate {field} {symmetry}"), (-1, f"{nrows} {ncols} {coo.count()}")], "ord long, line string")
    return top.union(coo.select(F.col("ord").cast("long"), body)).orderBy("ord")


def write_matrix_market(coo: DataFrame, path: str, nrows: int, ncols: int, field: str = "real", symmetry: str = "general") -> None:
    """One text file, as the format asks for; for matrices that one task can hold."""
    as_lines(coo, nrows, ncols, field, symmetry).coalesce(1).sortWithinPartitions("ord").select("line").write.text(path)


def write_runs(runs: DataFrame, path: str, format: str = "json") -> None:  # noqa: A002
    writer = runs.write.partitionBy("instance").mode("overwrite")
    writer.json(path) if format == "json" else writer.option("header", True).csv(path) if format == "csv" else writer.parquet(path)


RUNS = "run_id long, instance string, episode int, attempt int, centrality string, bandwidth int, local_time double, initial_bandwidth int, global_time double"


def read_runs(spark: SparkSession, path: str, array: bool = False, format: str = "json") -> DataFrame:  # noqa: A002
    reader = spark.read.schema(RUNS)
    return reader.option("multiLine", array).json(path) if format == "json" else reader.option("header", True).csv(path) if format == "csv" else reader.parquet(path)


def read_harwell_boeing(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """(path, instance, i, j, val): assembled matrices in column-compressed form (types RUA, RSA, PUA, PSA).

    Four header lines, a fifth if there are right-hand sides, then column starts, row numbers and values; numbers are
    read by the field widths that the fourth line gives.
    """

    def parsed(rows):
        for pdf in rows:
            out = []
            for path, text in zip(pdf.path, pdf.value, strict=True):
                lines = text.splitlines()
                counts = [int(x) for x in lines[1].split()]
                kind, (nrow, ncol, nnz) = lines[2][:3].upper(), [int(x) for x in lines[2][3:].split()[:3]]
                widths = [int(w) for w in re.findall(r"[IEDFG](\d+)", lines[3].upper())]
                body = lines[5:] if len(counts) > 4 and counts[4] > 0 else lines[4:]

                def numbers(n, width, body=body):
                    got = []
                    while len(got) < n:
                        line = body.pop(0)
                        got += [x for x in (line[k : k + width].strip() for k in range(0, len(line), width)) if x]
                    return got[:n]

                starts = [int(x) for x in numbers(ncol + 1, widths[0])]
                own = [int(x) for x in numbers(nnz, widths[1])]
                val = [1.0] * nnz if kind[0] == "P" else [float(x.upper().replace("D", "E")) for x in numbers(nnz, widths[2])]
                out += [(path, own[k], j + 1, val[k]) for j in range(ncol) for k in range(starts[j] - 1, starts[j + 1] - 1)]
            yield pd.DataFrame(out, columns=["path", "i", "j", "val"])

    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    whole = reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    coo = whole.mapInPandas(parsed, "path string, i int, j int, val double")
    return coo.withColumn("instance", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
