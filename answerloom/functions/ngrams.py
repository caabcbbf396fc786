"""n-gram sets and overlaps over arrays of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.text import preprocess_text, words

CASES = ("lower", "upper")
SIZES = (1, 2, 3)
PROFILE_COLUMNS = tuple(f"{case}{n}" for case in CASES for n in SIZES)


def tokens(c: Column) -> Column:
    return words(F.replace(preprocess_text(c), F.lit(". "), F.lit(" ")))


def with_case(toks: Column, case: str) -> Column:
    """Tokens without, or with, an upper-case letter."""
    return F.filter(toks, lambda w: w.rlike(r"\p{Lu}") if case == "upper" else ~w.rlike(r"\p{Lu}"))


def gram_list(toks: Column, n: int) -> Column:
    """All n-grams in order, space-joined; none if there are fewer tokens."""
    if n > 1:
        first = F.slice(toks, 1, F.greatest(F.size(toks) - (n - 1), F.lit(0)))
        toks = F.transform(first, lambda w, i: F.concat_ws(" ", w, *[F.get(toks, i + j) for j in range(1, n)]))
    return F.coalesce(toks, F.array().cast("array<string>"))


def gram_set(toks: Column, n: int) -> Column:
    return F.array_distinct(gram_list(toks, n))


def with_profile(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds column name: a struct of PROFILE_COLUMNS, the n-gram sets of the text.

    Tokens and their cases are columns of their own on the way, so that the functions
    over them read an array instead of forming it anew for each element.
    """
    out = df.withColumn("__t", tokens(F.col(text)))
    out = out.withColumns({f"__{case}": with_case(F.col("__t"), case) for case in CASES})
    sets = [gram_set(F.col(f"__{case}"), n).alias(f"{case}{n}") for case in CASES for n in SIZES]
    return out.withColumn(name, F.struct(*sets)).drop("__t", *[f"__{case}" for case in CASES])


def overlap(a: Column, b: Column, compat: bool = False) -> Column:
    """Shared n-grams of two profiles, upper-case ones twice.

    compat counts a's own upper trigrams instead of the shared ones, a constant of
    each question that leaves the order of its passages as it is.
    """
    total = F.lit(0)
    for name in PROFILE_COLUMNS:
        own = compat and name == "upper3"
        shared = F.size(a[name]) if own else F.size(F.array_intersect(a[name], b[name]))
        total = total + shared * (2 if name.startswith("upper") else 1)
    return total.cast("long")


def characters(c: Column, n: int) -> Column:
    """Character n-grams in order, repeats kept."""
    count = F.length(c) - (n - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))


def char_similarity(a: Column, b: Column, n: int) -> Column:
    """a's character n-grams that b has, over the mean number; 0 where both have none."""
    x, y = characters(a, n), characters(b, n)
    hits = F.size(F.filter(x, lambda g: F.array_contains(y, g)))
    return F.coalesce(F.try_divide(hits * 2.0, F.size(x) + F.size(y)), F.lit(0.0))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Tokens that two arrays share, each as often as both have it."""
    count = lambda xs, w: F.size(F.filter(xs, lambda t: t == w))
    return F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w))
    ).cast("long")
