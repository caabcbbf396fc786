"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes are signs of centred vectors in a rotated principal basis; the rotation is
learned (iterative quantisation) on a bounded sample. A code is cut into substrings,
each of which indexes a shard's rows. If two codes differ by at most R bits, some
substring j differs by at most r_j bits, where the r_j + 1 sum to R + 1: probing the
buckets of substring j within r_j retrieves every code within R. What is retrieved is
checked against R and reranked by exact distances in double precision; no other row is
ever compared.

R grows with what is found. Until k rows are retrieved it grows by steps, so a list is
short only where the table is. Then it covers the k-th distance found: the sample tells
within how many bits nearly all pairs of that distance lie, so a query far from all
others, whose neighbours' codes differ in many bits, probes further than a crowded one.

Equal rows count once; different rows of one id are candidates each. Rows are dealt
evenly over shards, by id and vector. A shard's index is built once, in one task of
bounded size; the queries stream past it in batches, and at most k rows a query leave
it. Rows are moved once and copied never; a query is copied to each shard.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that codes are learned on, and rows and queries that the radius is learned on.
SAMPLE_ROWS, RADIUS_QUERIES = 8192, 256
ITERATIONS = 25
SUBSTRING_BITS = 8
#: Share of the sample's true neighbours, and of its pairs of some distance, whose codes lie within the radius.
COVERAGE = 0.96
#: Bits that the radius grows by while fewer than k rows are found; distances that it is learned for.
STEP, DISTANCES = 4, 64
#: Most rows of a shard, which one task holds, and rows below which more shards are no use.
MOST_ROWS, LEAST_ROWS = 1 << 17, 1 << 13
K = 10


@dataclass(frozen=True)
class Codes:
    """mean, projection (dimensions x bits), first Hamming radius, and the radius of each squared distance.

    covering holds ascending squared distances and the bits within which pairs up to them lie.
    """

    mean: np.ndarray
    projection: np.ndarray
    radius: int
    covering: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0, np.int64))

    @property
    def bits(self) -> int:
        return self.projection.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes, one substring a byte."""
        return np.packbits((x - self.mean) @ self.projection > 0, axis=1)

    def budgets(self, radius: int) -> list[int]:
        """Bits r_j to probe in each substring: the r_j + 1 sum to radius + 1."""
        parts = -(-self.bits // SUBSTRING_BITS)
        each, more = divmod(radius + 1, parts)
        return [min(each + (j < more) - 1, SUBSTRING_BITS) for j in range(parts)]

    def radius_of(self, squared: float) -> int:
        """Bits within which neighbours at this squared distance lie; all bits beyond the sample's distances."""
        far, bits = self.covering
        at = np.searchsorted(far, squared)
        return int(bits[at]) if at < len(far) else self.bits


def learn(x: np.ndarray, k: int = K) -> Codes:
    """Rotated codes and radii from sample rows x, without chance."""
    x = np.asarray(x, np.float64)
    dims = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(dims)
    _, vectors = np.linalg.eigh(np.cov((x - mean).T).reshape(dims, dims) if len(x) > 1 else np.eye(dims))
    basis = vectors[:, ::-1]
    rotation, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))
    v = (x - mean) @ basis
    for _ in range(ITERATIONS if len(x) > dims else 0):
        u, _, w = np.linalg.svd(v.T @ np.where(v @ rotation > 0, 1.0, -1.0))
        rotation = u @ w
    return _with_radii(Codes(mean, basis @ rotation, dims), x, k)


def _with_radii(codes: Codes, x: np.ndarray, k: int) -> Codes:
    """The first radius holds COVERAGE of the sample's neighbours, that of a distance as many of
    all pairs that are no further.

    The whole table has nearer neighbours than its sample, so this errs on the wide
    side.
    """
    different = np.unique(x, axis=0)
    if len(different) <= k + 1:
        return codes
    places = np.arange(0, len(different), max(1, len(different) // RADIUS_QUERIES))
    q, c = different[places], codes.encode(different)
    d = np.maximum(((q**2).sum(1)[:, None] - 2 * q @ different.T) + (different**2).sum(1), 0)
    bits = np.bitwise_count(c[places][:, None] ^ c[None]).sum(-1, dtype=np.int64)
    d[np.arange(len(places)), places] = np.inf  # not the query itself
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    radius = int(np.quantile(np.take_along_axis(bits, near, 1), COVERAGE, method="higher"))
    order = np.argsort(d, axis=None)[: d.size - len(places)]
    d, bits = d.ravel()[order], bits.ravel()[order]
    ends = np.unique(np.geomspace(min(k * len(places), len(d)), len(d), DISTANCES).astype(int))
    within = [int(np.quantile(bits[:n], COVERAGE, method="higher")) for n in ends]
    return Codes(codes.mean, codes.projection, radius, (d[ends - 1], np.maximum.accumulate(within)))


class Shard:
    """Rows of one shard under one index a substring; its queries are answered one by one."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes):
        order = np.argsort(ids, kind="stable")
        self.order, self.ids, self.x, self.codes = order, ids[order], x[order], codes
        self.bytes = codes.encode(self.x)
        self.rows = [np.argsort(c, kind="stable") for c in self.bytes.T]
        self.starts = [np.searchsorted(np.sort(c), np.arange(257)) for c in self.bytes.T]
        self.compared = 0

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from code by at most radius bits."""
        hit = np.zeros(len(self.ids), bool)
        for value, rows, starts, budget in zip(code, self.rows, self.starts, self.codes.budgets(radius), strict=True):
            for b in (near_masks(budget) ^ value).tolist():
                hit[rows[starts[b] : starts[b + 1]]] = True
        found = np.flatnonzero(hit)
        bits = np.bitwise_count(self.bytes[found] ^ code).sum(1, dtype=np.int64)
        return found[bits <= radius]

    def nearest(self, query_id: int, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the k nearest retrieved rows of other ids, ties to smaller ids."""
        radius, most = self.codes.radius, self.codes.bits
        known, squared = np.zeros(0, np.int64), np.zeros(0)
        while True:
            found = self.within(code, radius)
            new = np.setdiff1d(found[self.ids[found] != query_id], known, assume_unique=True)
            known = np.concatenate([known, new])
            squared = np.concatenate([squared, ((self.x[new] - q) ** 2).sum(1)])
            enough = len(known) >= k
            wanted = self.codes.radius_of(np.partition(squared, k - 1)[k - 1]) if enough else radius + STEP
            if radius >= most or wanted <= radius:
                break
            radius = min(wanted, most)
        self.compared += len(known)
        distance = np.sqrt(squared)
        if len(known) > k:
            kept = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
            known, distance = known[kept], distance[kept]
        best = np.lexsort((known, distance))[:k]  # rows stand in order of id
        return known[best], distance[best]


@functools.lru_cache(maxsize=SUBSTRING_BITS + 2)
def near_masks(radius: int) -> np.ndarray:
    """All substring values with at most radius bits set."""
    values = np.arange(1 << SUBSTRING_BITS)
    return values[np.bitwise_count(values) <= radius].astype(np.uint8)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of vectors that take part: finite, not zero, no null component."""
    e = F.col(embedding)
    ok = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")))
    return vectors.filter(
        F.col(vec_id).isNotNull() & e.isNotNull() & (F.size(e) > 0) & ok & F.exists(e, lambda c: c != 0)
    ).select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("v"))


def search(
    vectors: DataFrame,
    is_query: str,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query row.

    is_query is a SQL condition on vec_id; every usable row is a candidate of every
    other. score is the Euclidean distance on the original vectors; ties go to the
    smaller vec_id. Vectors that are null, empty, zero, or hold a null or non-finite
    component take no part, nor do null ids. Vectors of another length than the
    commonest in the sample take no part in its search. Equal rows count once. A
    repeated id is no candidate of its own queries, and each of its vectors asks, as one
    query: a candidate counts once, at its least distance. Only with fewer candidates
    than k are fewer rows returned, then all of them. A neighbour whose code differs in more
    bits than nearly all pairs of its distance is missed; what is returned has true scores.
    """
    rows = usable(vectors, vec_id, embedding)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE_ROWS).collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = int(np.bincount([len(r["v"]) for r in sample]).argmax())
    codes = learn(np.array([r["v"] for r in sample if len(r["v"]) == dims]), k)
    rows = rows.filter(F.size("v") == dims)
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-n // MOST_ROWS), min(cores, -(-n // LEAST_ROWS)), 1)
    rows = rows.dropDuplicates(["vec_id", "v"]).withColumn("row", F.xxhash64("vec_id", "v", F.lit(1)))
    index = rows.withColumn("shard", F.pmod("row", F.lit(shards)).cast("int")).withColumn("asks", F.lit(0))
    asked = rows.filter(is_query).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(1))
    met = index.unionByName(asked).select("shard", "asks", "vec_id", "row", "v")
    # In each shard the rows of the index come first, then the queries.
    met = met.repartitionById(shards, "shard").sortWithinPartitions("shard", "asks", "vec_id", "row")
    found = met.mapInArrow(_searching(codes, dims, k), "query_id long, vec_id long, row long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id", "row")
    # A repeated query id asks once: a candidate counts at its least distance.
    found = found.groupBy("query_id", "vec_id", "row").agg(F.min("score").alias("score"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _searching(codes: Codes, dims: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers the queries of each shard that streams by, behind its rows."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        number, shard, keys = -1, None, np.zeros(0, np.int64)
        for batch in batches:
            at, asks, ids, row = (batch.column(c).to_numpy() for c in ("shard", "asks", "vec_id", "row"))
            x = batch.column("v").flatten().to_numpy().reshape(-1, dims)
            ends = np.flatnonzero((np.diff(at) != 0) | (np.diff(asks) != 0)) + 1
            for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(at)], strict=True):
                if i == j:
                    continue
                if at[i] != number:
                    held, number, shard = [], at[i], None
                if not asks[i]:
                    held.append((ids[i:j], x[i:j], row[i:j]))
                    continue
                if shard is None:
                    all_ids, all_x, all_rows = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (ids[:0], x[:0], row[:0])
                    shard, held = Shard(all_ids, all_x, codes), []
                    keys = all_rows[shard.order]
                out: list[tuple[np.ndarray, ...]] = []
                for q, v, c in zip(ids[i:j].tolist(), x[i:j], codes.encode(x[i:j]), strict=True):
                    place, distance = shard.nearest(q, v, c, k)
                    out.append((np.full(len(place), q), shard.ids[place], keys[place], distance))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run
