"""Tables written on the way: the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only where that is unset and the master is local, a temporary one is made, once per
    application; on a cluster no machine's own folder would do, so its absence raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir(spark.sparkContext.applicationId)


@functools.lru_cache(maxsize=8)
def _own_dir(_app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="answerloom-")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/answerloom-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written once and read back, which cuts its lineage for good."""
    path = path or new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: Sequence[str] = (), ord: str = "ord") -> DataFrame:
    """df with its place, from 1, in the order of the columns by, or as it is read; ties in any order.

    Rows are dealt into ranges of the order and numbered where they lie; only the ranges'
    sizes, one row a range, are summed up together. The numbers are written, since another
    run could draw the ranges elsewhere.
    """
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by) if by else df
    rows = written(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    met = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return met.withColumn(ord, F.col("__before") + place + 1).drop("__at", "__part", "__before")
