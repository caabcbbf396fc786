"""Connected components of a large graph, by joins and groupings alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import delete_path, materialise, scratch_path

#: Rounds after which the alternation is given up; it needs about log2 of the longest path.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node.

    Alternating large-star and small-star: every round hangs each node on the
    smallest neighbour it knows. Both steps are one grouping for the minimum and one
    join, so a node with very many links is pre-aggregated and its join is split by
    the engine as any skewed key; no neighbour list is ever collected. Rounds are
    written to the shared folder: a lost executor costs one round, not all. A round
    is deleted once the next stands.
    Self links and null ends are ignored; repeated links count once.
    """
    a, b = F.col(src), F.col(dst)
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession)
    links = materialise(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        path,
    )
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(MAX_ROUNDS):
        last, path = path, scratch_path(spark)
        links = materialise(_small_star(_large_star(links)), path)
        delete_path(spark, last)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(state) == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select("v", "v").distinct()
            )
        before = tuple(state)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour, itself included."""
    both = links.select("u", "v").union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    moved = links.join(least, links["v"] == least["w"]).select("u", F.col("m").alias("v"))
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node move to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
