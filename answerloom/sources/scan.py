"""Rows that make much work, spread over the cores whatever their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks a core that a spread scan gets.
WAVES = 2


def spread(df: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """df dealt out by a hash of key, if it is too small to occupy the cores by itself.

    A file is cut at its row groups, so a table of one group is one task however much
    work each row makes. An input that has less than one split for each core is
    therefore dealt out, columns pruned, before that work; a larger one is left as it
    is. The move is at most one split a core, and a grouping by key needs no other.

    With most, a table of any size is dealt out, in parts of about so many bytes of its
    file: for a grouping by key and more, which holds in memory what its part has, and
    would otherwise move more than the table itself.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if most:
        return df.repartition(max(WAVES * cores, -(-size // most)), key)
    return df.repartition(WAVES * cores, key) if size < cores * split else df


def even_out(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt out by a hash of keys, before they turn into much work.

    Adaptive execution joins partitions of few bytes into one, whose task would then
    do all that follows; a partition number asked for is kept.
    """
    spark = df.sparkSession
    n = max(WAVES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
