"""Vector codes by product quantisation, assigned by Exponion search in exact integers.

A vector's components become integers, its parts are coded by the nearest entry of their
codebook, and codebooks move to the mean of what they were given, round by round. Each
round starts a part at the entry it had before, at distance u: every entry that is no
further away than u lies within 2u of that entry, by the triangle inequality. So only
its neighbour list, sorted once a round for all entries, is scanned, up to that radius
and no further. Squares of integers are compared, so the bound is exact and a tie goes
to the lower index wherever it stands in the list.

Vectors are written once as integers, and with their codes in every round, so a lost
executor costs its tasks. Only sums by entry, as many as a codebook has, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.llm.common import delete_path, hot_keys, materialise, scratch_path, skew_join

#: Fixed values of the contract.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers from this size on are refused: sums of their squares would leave 64 bits.
MOST = 1 << 24
#: Rows of one start that are compared with one stretch of its neighbour list.
BLOCK = 128
#: Integers below this are exact as doubles.
EXACT = 1 << 53


@dataclass(frozen=True)
class Codebook:
    """entries (k x width), and for every entry all entries by distance, ties by index."""

    entries: np.ndarray
    order: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebook:
        entries = np.asarray(entries, np.int64)
        d = np.stack([((entries - e) ** 2).sum(1) for e in entries])
        order = np.argsort(d, axis=1, kind="stable")
        return cls(entries, order, np.take_along_axis(d, order, 1))

    def assign(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) nearest to each row of x, and how many pairs were compared.

        start is any entry of each row; a better one makes the scan shorter.
        """
        best, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        u = ((x - self.entries[start]) ** 2).sum(1)
        reach = np.zeros(len(x), np.int64)
        rows = np.argsort(start, kind="stable")
        bounds = np.flatnonzero(np.diff(start[rows])) + 1
        compared = 0
        for some in np.split(rows, bounds) if len(rows) else ():
            a = start[some[0]]
            reach[some] = np.searchsorted(self.near[a], 4 * u[some], side="right")
            some = some[np.argsort(reach[some], kind="stable")]
            for i in range(0, len(some), BLOCK):
                block = some[i : i + BLOCK]
                listed = self.order[a, : reach[block[-1]]]
                d = squared(x[block], self.entries[listed])
                compared += int(reach[block].sum())
                least[block] = d.min(1)
                best[block] = np.where(d == least[block, None], listed, len(self.entries)).min(1)
        return best, least, compared


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: by doubles where all sums are exact in them."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most**2 < EXACT else np.int64
    a, b = x.astype(kind), y.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


@dataclass(frozen=True)
class Compressed:
    """rows (vec_id, label, codes, error), codes one byte a part; and the codebooks."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and place, comma-joined."""
        numbers = (str(c) for book in self.codebooks for c in book.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def integers(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, v) of vectors without a null or non-finite component."""
    e = F.col(embedding)
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")))
    scaled = F.transform(e, lambda c: c.cast("double") * scale)
    large = F.exists("v", lambda c: F.abs(c) >= MOST)
    told = F.raise_error(F.concat(F.lit("component too large for exact codes, vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    return (
        vectors.filter(e.isNotNull() & (F.size(e) > 0) & finite)
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), scaled.alias("v"))
        .withColumn("v", F.when(large, told.cast("array<double>")).otherwise(F.col("v")))
        .withColumn("v", F.transform("v", lambda c: F.floor(c).cast("int")))
    )


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Compressed:
    """Codes of all vectors, and the codebooks they were formed by.

    A component x becomes floor(scale * x). Codebooks start as the parts of the `entries`
    smallest ids' vectors (null ids last, equal ids by their components), fewer if there
    are fewer, and move `rounds` times to floor(sum / count); unused entries stay.

    Vectors that are null, empty, or hold a null or non-finite component are dropped;
    vectors of another length than the first one's take no part. Repeated rows and ids,
    and null ids and labels, are rows like others. No rows give none, and no codebooks. A
    component of 16,384 or more raises, as does a length that parts do not divide.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is one byte")
    spark, path = vectors.sparkSession, scratch_path(vectors.sparkSession)
    table = materialise(integers(vectors, vec_id, embedding, label, scale), path)
    first = [r["v"] for r in table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()]
    if not first:
        none = table.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error"))
        return Compressed(none, [])
    width, rest = divmod(len(first[0]), parts)
    if rest:
        raise ValueError(f"{len(first[0])} components are not {parts} equal parts")
    table = table.filter(F.size("v") == len(first[0]))
    start = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = list(np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2))
    table = table.withColumn("codes", F.lit(None).cast("binary"))
    for k in range(rounds + 1):
        given, old, path = assigned(table, books), path, scratch_path(spark)
        if k == rounds:
            table = materialise(given.select("vec_id", "label", "codes", "error"), path)
        else:
            table = materialise(given, path)
            books = moved(table, books)
        delete_path(spark, old)
    return Compressed(table, books)


def assigned(table: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """table (vec_id, label, v, codes) with new codes, and error, their squared distances' sum."""
    parts, (_, width) = len(books), books[0].shape
    fields = [f for f in table.schema.fields if f.name != "error"]
    schema = T.StructType([*fields, T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook.of(b) for b in books]
        for batch in batches:
            n = batch.num_rows
            x = batch.column("v").flatten().to_numpy().reshape(n, parts, width).astype(np.int64)
            before = codes_of(batch.column("codes"), parts)
            codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, book in enumerate(ready):
                codes[:, p], far, _ = book.assign(x[:, p], before[:, p])
                error += far
            held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), n, [None, pa.py_buffer(codes.tobytes())])
            out = {f.name: batch.column(f.name) for f in fields} | {"codes": held.cast(pa.binary()), "error": pa.array(error)}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return table.select(*[f.name for f in fields]).mapInArrow(run, schema)


def codes_of(column: pa.Array, parts: int) -> np.ndarray:
    """Codes as rows of entries; entry 0 where there is none yet."""
    if column.null_count:
        return np.zeros((len(column), parts), np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts).astype(np.int64)


def moved(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks at floor(sum / count) of what they were given; unused entries stay.

    A task sums what it reads by part and entry; one row an entry comes back.
    """
    parts, (k, width) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, parts, width)
            codes = codes_of(batch.column("codes"), parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=k)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "total"],
        )

    each = table.select("v", "codes").mapInArrow(run, "part int, entry int, n long, total array<long>")
    places = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    out = [b.copy() for b in books]
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *places).collect():
        out[r["part"]][r["entry"]] = np.array([r[f"t{i}"] for i in range(width)], np.int64) // r["n"]
    return out


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with label_error, the error summed over equal labels, nulls together."""
    keys = ["__label", "__none"]
    keyed = rows.withColumns({"__label": F.coalesce(F.col("label").cast("string"), F.lit("")), "__none": F.col("label").isNull()})
    totals = keyed.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    hot = hot_keys(totals, keys, rows.count())
    return skew_join(keyed, totals.drop("n"), keys, hot).drop(*keys)
