"""Top-k, score normalisation, fusion, softmax: rankings within groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are rounded before they are ranked, so that ties do not hang on summation order.
DIGITS = 6
#: Fusion weights of reader, rank and similarity, and the zeroing threshold.
FUSION = (0.6, 0.2, 0.2)
THRESHOLD = 0.1
#: Bytes that a row may grow to in memory for each byte of it as text: n-gram profiles hold it several times.
PROFILE = 16


def broadcast_if_small(df: DataFrame, rows: int = 50_000, bound: DataFrame | None = None, size: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows and `size` bytes; else as it is.

    Bytes are those of the columns as text, arrays and strings among them, counted in
    the engine over at most `rows` rows. bound is measured in df's place where it has at
    least as many rows, no less text, and is cheaper.
    """
    measured = df if bound is None else bound
    text = F.octet_length(F.to_json(F.struct("*")))
    got = measured.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(text).alias("b")).first()
    return F.broadcast(df) if got["n"] <= rows and PROFILE * (got["b"] or 0) <= size else df


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group, numbered; pruned before the shuffle by the engine."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def minmax(value: Column, by: Sequence[str]) -> Column:
    """value on 0..1 within its group; 0 where all of the group are alike."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))


def zero_below(value: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(value < threshold, 0.0).otherwise(value)


def fuse(reader_raw: Column, rank: Column, similarity: Column, weights: Sequence[float] = FUSION) -> Column:
    """Weighted sum with the reader's raw score, not its normalised one."""
    a, b, c = weights
    return a * reader_raw + b * rank + c * similarity


def aggregate_score(score: Column, ctx_score: Column, weight: float = 0.5) -> Column:
    return weight * score + (1 - weight) * ctx_score


def best_answer(answers: DataFrame, by: Sequence[str], weight: float = 0.5) -> DataFrame:
    """Answer of the highest aggregate score in each group; the earliest wins ties."""
    total = answers.withColumn("total_score", aggregate_score(F.col("score"), F.col("ctx_score"), weight))
    return top_k(total, by, [F.desc("total_score"), F.asc("ord")], 1).drop("rank")


def softmax(value: Column, by: Sequence[str]) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(value - F.max(value).over(w))
    return e / F.sum(e).over(w)


def weighted_score(passage: Column, answer: Column, wp: float = 0.5, wa: float = 0.5) -> Column:
    return wp * passage + wa * answer


def best_indexes(logits: Column, n: int) -> Column:
    """Positions of the n largest values, largest first, earlier first among equals."""
    pairs = F.transform(logits, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: p["i"])


def scored_answers(answers: DataFrame, scorer: Callable[[DataFrame], Column]) -> DataFrame:
    """Adds score by a pluggable scorer, a column over the whole batch."""
    return answers.withColumn("score", scorer(answers))


def choose_best(answers: DataFrame, by: Sequence[str], scorer: Callable[[DataFrame], Column]) -> DataFrame:
    """Best answer of each group by the scorer; the earliest wins ties."""
    return top_k(scored_answers(answers, scorer), by, [F.desc("score"), F.asc("ord")], 1).drop("rank")
