"""Vectors in cells around coarse centres, as a table partitioned by cell.

Centres are learned on a bounded sample; every vector stands in the cell of its nearest
centre. A question reads the few cells whose centres are nearest, as many as the sample
showed to hold enough of its neighbours, and the scan prunes all others. On request the
answer is exact: a cell is as wide as its farthest member, so by the triangle inequality
it cannot hold anything nearer than its centre's distance less that width, and only cells
that may still better the k-th score found are read besides.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.operators.ranking import DIGITS, broadcast_if_small, top_k
from answerloom.operators.vectors import as_double, cosine

#: Rows that centres are learned on, and most centres; rows and neighbours that set the number of cells to read.
SAMPLE_ROWS, MOST_CELLS = 20_000, 4096
QUERIES, NEIGHBOURS = 256, 10
ITERATIONS = 10
#: Share of the sample's neighbours that stand in the cells read.
COVERAGE = 0.95
#: Cell of vectors without a direction: null, of length zero, of another size, or not finite. All their scores are 0.
NOWHERE = -1
EPS = 2 * 10.0**-DIGITS


@dataclass(frozen=True)
class CellIndex:
    """vectors(vec_id, embedding, cell), centres with each cell's reach and size, and how many cells to read."""

    vectors: DataFrame
    centres: np.ndarray
    reach: np.ndarray
    sizes: np.ndarray
    probes: int

    @classmethod
    def save(
        cls, vectors: DataFrame, path: str, cells: int | None = None, files: int = 64, vec_id: str = "vec_id", embedding: str = "embedding"
    ) -> CellIndex:
        """Writes the index of vectors below path. About as many cells as the root of the rows, unless told."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(vec_id).alias("vec_id"), as_double(F.col(embedding)).alias("embedding"))
        sample = rows.filter(F.size("embedding") > 0).orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE_ROWS)
        x = _directions([r["embedding"] for r in sample.collect()])
        cells = cells or int(min(MOST_CELLS, max(1, round(rows.count() ** 0.5))))
        centres = _centres(spark, x, min(cells, max(1, len(x) // 4)))
        probes = _probes(x, centres)
        placed = rows.mapInArrow(_placing(centres), T.StructType([*rows.schema, *_PLACE]))
        # Ranges of (cell, id): a cell of many vectors spans several files.
        placed = placed.repartitionByRange(files, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
        placed.write.partitionBy("cell").parquet(f"{path}/vectors")
        table = T.StructType([*rows.schema, *reversed(_PLACE)])
        saved = spark.read.schema(table).parquet(f"{path}/vectors")
        reach, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in saved.filter(F.col("cell") >= 0).groupBy("cell").agg(F.max("gap").alias("gap"), F.count("*").alias("n")).collect():
            reach[r["cell"]], sizes[r["cell"]] = r["gap"], r["n"]
        held = {"centres": centres.tolist(), "reach": reach.tolist(), "sizes": sizes.tolist(), "probes": probes, "table": table.json()}
        spark.createDataFrame([(json.dumps(held),)], "held string").coalesce(1).write.text(f"{path}/centres")
        return cls(saved, centres, reach, sizes, probes)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        held = json.loads(spark.read.text(f"{path}/centres", wholetext=True).first()[0])
        arrays = (np.array(held[n]) for n in ("centres", "reach", "sizes"))
        table = T.StructType.fromJson(json.loads(held["table"]))
        return cls(spark.read.schema(table).parquet(f"{path}/vectors"), *arrays, held["probes"])

    def cells_of(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(qid, q, cell): the cells that each query of queries(qid, q) reads at first."""
        centres, n = self.centres, probes or self.probes

        def nearest(q: np.ndarray, _: np.ndarray) -> np.ndarray:
            far = _distances(q, centres)
            return np.argsort(far, axis=1, kind="stable")[:, :n]

        return self._cells(queries.withColumn("floor", F.lit(None).cast("double")), nearest)

    def cells_beyond(self, floored: DataFrame, probes: int | None = None) -> DataFrame:
        """The other cells that may hold a score of at least the query's floor; all where it is null."""
        centres, reach, sizes, n = self.centres, self.reach, self.sizes, probes or self.probes

        def open_cells(q: np.ndarray, floor: np.ndarray) -> list[np.ndarray]:
            far = _distances(q, centres)
            best = 1 - np.maximum(far - reach, 0) ** 2 / 2
            may = (best >= np.nan_to_num(floor, nan=-2.0)[:, None] - EPS) & (sizes > 0)
            np.put_along_axis(may, np.argsort(far, axis=1, kind="stable")[:, :n], False, 1)
            return [np.flatnonzero(row) for row in may]

        return self._cells(floored, open_cells)

    def _cells(self, queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray], Sequence[np.ndarray]]) -> DataFrame:
        kind, dims = queries.schema["qid"].dataType, self.centres.shape[1]
        schema = T.StructType([T.StructField("qid", kind), T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    q = _directions(b.column("q").to_pylist(), dims)
                    found = choose(q, b.column("floor").to_numpy(zero_copy_only=False).astype(float))
                    at = pa.array(np.repeat(np.arange(len(q)), [len(c) for c in found]))
                    cells = pa.array(np.concatenate(found), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column("qid").take(at), b.column("q").take(at), cells], ["qid", "q", "cell"])

        return queries.select("qid", as_double(F.col("q")).alias("q"), "floor").mapInArrow(run, schema)

    def scored(self, asked: DataFrame, k: int) -> DataFrame:
        """(qid, vec_id, score, rank): the k best of the cells that asked(qid, q, cell) names."""
        names = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS
        read = self.vectors.filter(F.col("cell").isin(names)).select("vec_id", "embedding", "cell")
        met = read.join(broadcast_if_small(asked), "cell")
        each = met.select("qid", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), DIGITS).alias("score"))
        return top_k(each, ["qid"], _order(), k)

    def nowhere(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, vec_id, score, rank): what has score 0 for want of a direction, k ids of it at most."""
        lost = self.vectors.filter(F.col("cell") == NOWHERE).select("vec_id").orderBy("vec_id").limit(k)
        every = self.vectors.select("vec_id").orderBy("vec_id").limit(k)
        aimed = _has_direction(as_double(F.col("q")), self.centres.shape[1])
        meet = lambda qs, ids: qs.join(F.broadcast(ids)).select("qid", "vec_id", F.lit(0.0).alias("score"))  # noqa: E731  k rows
        return top_k(meet(queries.filter(aimed).select("qid"), lost).union(meet(queries.filter(~aimed).select("qid"), every)), ["qid"], _order(), k)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(qid, vec_id, score, rank) by cosine of the k best in the cells read; exact: of all vectors.

        Scores have DIGITS digits, ties go to the smaller id, repeated rows count each. A
        vector or query without a direction has score 0 with everything.
        """
        aimed = queries.filter(_has_direction(as_double(F.col("q")), self.centres.shape[1]))
        found = self.scored(self.cells_of(aimed, probes), k).union(self.nowhere(queries, k))
        if exact:
            floors = top_k(found.drop("rank"), ["qid"], _order(), k).filter(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
            floored = aimed.join(broadcast_if_small(floors, bound=queries.select("qid")), "qid", "left")
            found = found.union(self.scored(self.cells_beyond(floored, probes), k))
        return top_k(found.drop("rank"), ["qid"], _order(), k)

    def share_read(self, asked: DataFrame) -> float:
        """Rows that the cells of asked(qid, cell) hold, of all rows that its queries would meet in a scan."""
        of = asked.groupBy("cell").agg(F.count("*").alias("n")).collect()
        queries = asked.select("qid").distinct().count()
        return sum(r["n"] * self.sizes[r["cell"]] for r in of) / max(1, queries * int(self.sizes.sum()))


_PLACE = (T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType()))


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("vec_id")]


def _has_direction(v: Column, dims: int) -> Column:
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(v) == dims) & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def _directions(vectors: list, dims: int | None = None) -> np.ndarray:
    """Unit vectors; without dims the commonest length, and vectors without a direction go."""
    if dims is None:
        dims = int(np.bincount([len(v) for v in vectors]).argmax()) if vectors else 1
        vectors = [v for v in vectors if len(v) == dims and None not in v]
    x = np.array(vectors, np.float64).reshape(-1, dims)
    length = np.sqrt((x * x).sum(1))
    fine = np.isfinite(length) & (length > 0)
    return x[fine] / length[fine, None]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    return np.sqrt(np.maximum(d, 0))


def _centres(spark: SparkSession, x: np.ndarray, cells: int) -> np.ndarray:
    if len(x) <= 1 or cells == 1:
        return x.mean(0, keepdims=True) if len(x) else np.zeros((1, x.shape[1]))
    rows = spark.createDataFrame([(v,) for v in x.tolist()], "v array<double>").select(array_to_vector("v").alias("features"))
    model = KMeans(k=cells, seed=7, maxIter=ITERATIONS).fit(rows)
    return np.array(model.clusterCenters())


def _probes(x: np.ndarray, centres: np.ndarray) -> int:
    """Cells, by distance of their centres, that hold COVERAGE of the sample's neighbours."""
    if len(x) <= NEIGHBOURS + 1:
        return len(centres)
    q = x[:: max(1, len(x) // QUERIES)]
    near = np.argpartition(-(q @ x.T), NEIGHBOURS, axis=1)[:, : NEIGHBOURS + 1]
    cell = _distances(x, centres).argmin(1)
    place = np.argsort(np.argsort(_distances(q, centres), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return int(np.quantile(ranks, COVERAGE, method="higher")) + 1


def _placing(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds cell and gap, the distance from the centre, to rows of vectors."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding").to_pylist()
            cell, gap = np.full(len(vectors), NOWHERE, np.int32), np.zeros(len(vectors))
            sized = [i for i, v in enumerate(vectors) if v is not None and len(v) == dims and None not in v]
            x = np.array([vectors[i] for i in sized], np.float64).reshape(-1, dims)
            length = np.sqrt((x * x).sum(1))
            fine = np.isfinite(length) & (length > 0)
            at = np.array(sized, int)[fine]
            far = _distances(x[fine] / length[fine, None], centres)
            cell[at], gap[at] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(gap)], [*b.schema.names, "cell", "gap"])

    return run
