"""What the operators of this subpackage share: tables, shared folder, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.sources.shared import shared_dir

#: Documents' columns, which every filtering stage of the pipeline hands on.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Holds what is materialised meanwhile in one folder, deleted at the end.

    Only for callers that write their result inside the block: a result that is still
    to be computed needs its tables.
    """
    folder = f"{shared_dir(spark)}/answerloom-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        delete_path(spark, folder)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df once into the shared folder and reads it back.

    Cuts the lineage in a way that outlives any executor; costs disk, so it is
    used on narrow tables only.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new folder name for a table to materialise."""
    return f"{_scratch.get() or shared_dir(spark)}/answerloom-{uuid.uuid4().hex}"


#: A key is hot from this share of a table's rows on: 1 / HOT_SHARE.
HOT_SHARE = 1024


def hot_keys(counts: DataFrame, keys: Sequence[str], total: int) -> DataFrame | None:
    """Keys that hold over 1 / HOT_SHARE of total rows; counts(*keys, n) sum to total.

    There are fewer than HOT_SHARE of them, whatever the data look like, so they are
    named on the driver and may be broadcast. None if there are none.
    """
    few = counts.filter(F.col("n") * HOT_SHARE > F.lit(total)).select(*keys)
    rows = few.collect()
    return counts.sparkSession.createDataFrame(rows, few.schema) if rows else None


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """left inner join right on keys, where right has one bounded row a key.

    Rows of left with a key of hot (see hot_keys) meet a broadcast of those keys' rows
    where they stand; all others are shuffled. left is read twice, so it should be
    materialised.
    """
    keys = list(keys)
    if hot is None:
        return left.join(right, keys)
    few = F.broadcast(hot)
    cold = left.join(few, keys, "left_anti").join(right, keys)
    warm = left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys)
    return cold.unionByName(warm)


def even_parts(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt out by a hash of keys, before each turns into many.

    Adaptive execution joins partitions of few bytes into one, whose task would then
    make all of them; a partition number asked for is kept.
    """
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def row_key(*columns: Column) -> dict[str, Column]:
    """128 bits of a whole row, as columns __k1 and __k2; a null is a value of its own.

    The hash passes over nulls, so which columns are null goes first.
    """
    flags = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return {"__k1": F.xxhash64(flags, *columns), "__k2": F.xxhash64(F.lit(1), flags, *columns)}


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a path of any Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def vocabulary(name_or_path: str) -> str:
    """A tokenizer file: a path as it is, a bare name as the installed package's file."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def by_bytes(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Slices [i, j) of texts that hold about `most` bytes each, one text at least."""
    i = held = 0
    for j, t in enumerate(texts):
        if held and held + len(t) > most:
            yield i, j
            i, held = j, 0
        held += len(t)
    if i < len(texts):
        yield i, len(texts)


def utf8(array) -> list[bytes]:
    """An Arrow string array as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]
