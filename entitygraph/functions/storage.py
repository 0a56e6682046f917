"""Reading tables, cutting lineage and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is named, a local session (tests) gets a temporary one; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='ckpt-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def settle(df: DataFrame, name: str = "stage", compact: bool = False, heavy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors.

    ``compact`` is for tables of ids, which iterations write again and again: two files a
    core of the cluster at most, however many partitions the shuffle had.  Where making the rows
    is ``heavy``, they are shuffled into these files, so that the work keeps its own partitions.
    """
    spark = df.sparkSession
    if compact:
        files = 2 * max(1, spark.sparkContext.defaultParallelism)
        df = df.repartition(files) if heavy else df.coalesce(files)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def in_place(rows: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, which is ``rows`` with other values and no shuffle, marked with the files it reads (``_base``) and how many such steps
    lie between, if ``rows`` are files or were made of files in this way."""
    base = getattr(rows, "_base", (rows, 0) if hasattr(rows, "_settled") else None)
    if base is not None:
        after._base = base[0], base[1] + 1
    return after


def at_hand(rows: DataFrame) -> bool:
    """Whether reading the rows again costs a scan of files, and no shuffle."""
    return hasattr(rows, "_settled") or hasattr(rows, "_base")


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames made by :func:`settle` that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast behind a check of the size (counted unless given); beyond ``limit`` rows the join shuffles."""
    if rows is None:
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with the place of every row in a total order, from 0, without sorting everything in one task.

    Rows are dealt by ranges of the order and written with their part, so that counting
    the parts and ranking within them see the same ranges.
    """
    placed = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "placed")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_c"))
    ahead = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_ahead"))  # one row a part
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_within", rank).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_within")).drop("_part", "_within", "_ahead")


def running_sum(df: DataFrame, order: list[str], column: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``column`` over all rows ahead in a total order, found range by range as in :func:`numbered`."""
    placed = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "placed")
    sums = placed.groupBy("_part").agg(F.sum(column).alias("_s"))
    ahead = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_ahead"))  # one row a part
    within = F.sum(column).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(column)
    return placed.withColumn("_within", within).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_within")).drop("_part", "_within", "_ahead")
