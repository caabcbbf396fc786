"""Vector similarities, in double precision and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.operators.ranking import DIGITS, top_k

#: Queries that one row of the exploded index meets at a time.
BLOCK = 256


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; 0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))




def dense_top_k(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score, rank) by cosine, exact: the baseline that compares all with all.

    queries(qid, q) are packed into blocks of at most BLOCK vectors and each index
    row meets each block, so the join's output grows with rows times blocks; the
    scores are formed inside the row and pruned to k before they are shuffled.
    """
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    packed = (
        queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
        .groupBy("block").agg(F.collect_list(F.struct("qid", as_double(F.col("q")).alias("q"))).alias("asked"))
    )
    rows = index.select("vec_id", as_double(F.col("embedding")).alias("v")).withColumn(
        "block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))
    )
    scored = rows.join(packed, "block").select(
        "vec_id",
        F.inline(
            F.transform(
                "asked", lambda a: F.struct(a["qid"].alias("qid"), F.round(cosine(a["q"], F.col("v")), DIGITS).alias("score"))
            )
        ),
    )
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("vec_id")], k).select("qid", "vec_id", "score", "rank")


def squared_counts(words: Column) -> Column:
    """Sum over different words of their squared counts, in one pass over sorted words.

    The r-th of equal words adds 2r - 1, the step from one square to the next.
    """

    def step(s: Column, w: Column) -> Column:
        run = F.when(s["word"] == w, s["run"] + 1).otherwise(F.lit(1)).cast("long")
        return F.struct(w.alias("word"), run.alias("run"), (s["total"] + 2 * run - 1).alias("total"))

    start = F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(F.sort_array(words), start, step, lambda s: s["total"].cast("double"))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token arrays as bags of words: the default sentence similarity.

    The dot product sums, over b's occurrences of words that a has, their counts in a;
    so a, the question, should be the shorter. Both should be plain columns.
    """
    known = F.filter(b, lambda w: F.array_contains(a, w))
    shared = F.transform(known, lambda w: F.size(F.filter(a, lambda t: t == w)).cast("double"))
    length = F.sqrt(squared_counts(a)) * F.sqrt(squared_counts(b))
    return F.coalesce(F.try_divide(F.aggregate(shared, F.lit(0.0), lambda s, x: s + x), length), F.lit(0.0))
