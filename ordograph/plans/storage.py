"""Written tables, numbering and prefix sums that hold at any size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Rows in a range of running_totals(), at least and at most.
FEW_ROWS, MANY_ROWS = 20_000, 500_000

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder, which driver and executors share.

    Where neither is set, a local session gets a folder of its own, removed at exit; any other one an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    set_one = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found or set_one.isDefined():
        return (found or set_one.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="ordograph-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return _own_folders[app]


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder; lineage ends there. What a failed job wrote is removed."""
    path = f"{shared_folder(df.sparkSession)}/ordograph/{label}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path, compression=compression)
    except BaseException:
        _remove(df.sparkSession, path)
        raise
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() returned, once nothing reads them any more."""
    for t in tables:
        _remove(t.sparkSession, t._written_to)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_written(spark: SparkSession) -> None:
    """Removes all tables in the shared folder, those of lost sessions too; for use when no job runs."""
    _remove(spark, f"{shared_folder(spark)}/ordograph")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_totals(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over all rows before this one by `order`, by ranges of `order`.

    A range has MANY_ROWS rows, or fewer so that all cores have one of FEW_ROWS; the driver gets a row a range.
    """
    rows = df.count()
    n = max(1, -(-rows // MANY_ROWS), min(-(-rows // FEW_ROWS), df.sparkSession.sparkContext.defaultParallelism))
    ranged = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    base, total = [], 0
    for r in ranged.groupBy("_range").agg(F.sum(value).alias("s")).orderBy("_range").collect():  # a row for MANY_ROWS
        base.append((r["_range"], total))
        total += r["s"] or 0
    bases = df.sparkSession.createDataFrame(base or [(0, 0)], "_range int, _base long")
    within = F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return ranged.join(F.broadcast(bases), "_range").withColumn(out, F.col("_base") + F.coalesce(within, F.lit(0))).drop("_range", "_base")


def numbered(df: DataFrame, order: list, out: str, start: int = 1) -> DataFrame:
    """df with its rows' numbers by `order`, without a window over all rows."""
    return running_totals(df.withColumn("_one", F.lit(1)), order, "_one", out).withColumn(out, (F.col(out) + start).cast("int")).drop("_one")


def dense_ids(df: DataFrame, key: str, out: str, start: int = 1) -> DataFrame:
    return numbered(df.select(key).distinct(), [key], out, start)
