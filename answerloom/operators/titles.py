"""Titles by likeness: an index in buckets of length and character bag, best bound first.

The ratio of two strings is 2 M / T, with M characters in matching blocks and T in both.
M is no more than what both bags of characters share, nor than the longest common
subsequence. So a bucket of titles of one length and one bag has a bound, as has a
coarser bucket around it and the length alone: three levels of a tree whose steps are
equality joins. A query first goes down the best branches only, which gives it a floor,
and then into every bucket that can still reach the floor, and no other. Nothing that
could win is left out, ties included.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.operators.ranking import DIGITS, broadcast_if_small, top_k

#: Groups that characters fall into by their code, finely and coarsely; the first is a multiple of the second.
FINE, COARSE = 24, 4
#: Branches, buckets and titles that set a query's floor.
PROBE_BRANCHES, PROBE_BUCKETS, PROBES = 16, 64, 24
#: Slack for ratios and bounds that are rounded differently.
EPS = 1e-9


@dataclass(frozen=True)
class TitleIndex:
    """titles(title, length, bag); buckets(length, coarse, bag) and branches(length, coarse) hold each once."""

    titles: DataFrame
    buckets: DataFrame
    branches: DataFrame

    @classmethod
    def build(cls, titles: DataFrame, title: str = "title") -> TitleIndex:
        t = F.col(title)
        rows = titles.filter(t.isNotNull()).select(t.alias("title")).distinct()
        rows = rows.select("title", F.length("title").alias("length"), bag(F.col("title")).alias("bag"))
        buckets = rows.select("length", coarse(F.col("bag")).alias("coarse"), "bag").distinct()
        return cls(rows, buckets, buckets.select("length", "coarse").distinct())

    def write(self, path: str) -> None:
        """Titles stand in files by length, so a search reads the lengths its floors allow."""
        self.titles.sortWithinPartitions("length").write.partitionBy("length").parquet(f"{path}/titles")
        self.buckets.write.parquet(f"{path}/buckets")
        self.branches.write.parquet(f"{path}/branches")

    def stored(self, path: str) -> TitleIndex:
        self.write(path)
        return TitleIndex.read(self.titles.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TitleIndex:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("titles", "buckets", "branches")))

    def closest(self, queries: DataFrame, n: int = 1) -> DataFrame:
        """(qid, title, ratio, rank): the n closest of all titles, the largest string on ties.

        qid is one row. Equal titles count once; null titles are no titles, and null
        queries ask nothing.
        """
        asked = profiles(queries)
        found = exact_ratio(self.reachable(self.floors(asked, n), n))
        return ranked(found, n)

    def floors(self, asked: DataFrame, n: int = 1) -> DataFrame:
        """asked with floor: the n-th best ratio on the best branches among lengths half to
        double the query's; null where those hold fewer than n titles."""
        near = asked.withColumn("length", F.explode(F.expr("sequence(greatest(1, lq div 2), greatest(1, 2 * lq))")))
        at = near.join(self.branches, "length").withColumn("bound", bag_bound("coarse_q", "coarse"))
        at = top_k(at, ["qid"], [F.desc("bound"), F.asc("length"), F.asc("coarse")], PROBE_BRANCHES).drop("rank", "bound")
        at = at.join(self.buckets, ["length", "coarse"]).withColumn("bound", bag_bound("bag_q", "bag"))
        at = top_k(at, ["qid"], [F.desc("bound"), F.asc("length"), F.asc("bag")], PROBE_BUCKETS).drop("rank", "bound")
        at = at.join(self.titles, ["length", "bag"]).withColumn("bound", overlap_bound(F.col("query"), F.col("title")))
        at = top_k(at, ["qid"], [F.desc("bound"), F.desc("title")], max(n, PROBES)).drop("rank")
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("ratio")))
        nth = exact_ratio(at.select("qid", "query", "title")).withColumn("r", place).filter(F.col("r") == n)
        return asked.join(nth.select("qid", F.col("ratio").alias("floor")), "qid", "left")

    def reachable(self, floors: DataFrame, n: int = 1) -> DataFrame:
        """(qid, query, title, floor) of every title whose bound reaches its query's floor.

        A title that shares no character with the query has ratio 0; of these only the n
        largest strings can count, and they stand for all where the floor is no higher.
        """
        longest = self.branches.agg(F.max("length")).first()[0] or 0
        # A bound of at least one shared character, where there is no higher floor.
        f = F.greatest(F.coalesce(F.col("floor") - EPS, F.lit(0.0)), 1.0 / (F.col("lq") + F.lit(longest) + 1))
        low, high = F.ceil(F.col("lq") * f / (2 - f)), F.least(F.floor(F.col("lq") * (2 - f) / f), F.lit(longest))
        lengths = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
        at = floors.withColumn("length", F.explode(lengths))
        at = broadcast_if_small(at).join(self.branches, "length").filter(bag_bound("coarse_q", "coarse") >= f)
        at = at.join(self.buckets, ["length", "coarse"]).filter(bag_bound("bag_q", "bag") >= f)
        at = at.select("qid", "query", "floor", "length", "bag").join(self.titles, ["length", "bag"])
        met = at.withColumn("lq", F.length("query")).filter(overlap_bound(F.col("query"), F.col("title")) >= f)
        last = self.titles.orderBy(F.desc("title")).limit(n).agg(F.collect_list("title").alias("last"))
        none = floors.filter(F.coalesce("floor", F.lit(0.0)) <= EPS).join(F.broadcast(last))  # one row of n titles
        none = none.select("qid", "query", F.explode("last").alias("title"), "floor")
        return met.select("qid", "query", "title", "floor").union(none).distinct()


def codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def bag(text: Column, groups: int = FINE) -> Column:
    """How many characters of text fall into each group; their codes are formed once."""
    count = lambda cs: F.transform(F.lit(list(range(groups))), lambda k: F.size(F.filter(cs, lambda c: c % groups == k)))
    return F.get(F.transform(F.array(codes(text)), count), 0)


def coarse(fine: Column) -> Column:
    """The bag over COARSE groups that a bag over FINE groups adds up to."""
    sums = [sum((fine[j] for j in range(k + COARSE, FINE, COARSE)), fine[k]) for k in range(COARSE)]
    return F.array(*sums)


def profiles(queries: DataFrame) -> DataFrame:
    asked = queries.filter("query is not null").select("qid", "query", F.length("query").alias("lq"), bag(F.col("query")).alias("bag_q"))
    return asked.withColumn("coarse_q", coarse(F.col("bag_q")))


def bag_bound(query: str, title: str) -> Column:
    shared = F.aggregate(F.zip_with(query, title, lambda a, b: F.least(a, b)), F.lit(0), lambda s, c: s + c)
    return F.coalesce(F.try_divide(2.0 * shared, F.col("lq") + F.col("length")), F.lit(1.0))


def overlap_bound(a: Column, b: Column) -> Column:
    """Upper bound of the matching ratio: characters both have, over the mean length."""
    x, y = F.split(a, ""), F.split(b, "")
    count = lambda xs, c: F.size(F.filter(xs, lambda t: t == c))
    both = lambda p: F.aggregate(
        F.array_intersect(p["x"], p["y"]), F.lit(0), lambda s, c: s + F.least(count(p["x"], c), count(p["y"], c))
    )
    shared = F.get(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), both), 0)
    return F.coalesce(F.try_divide(2.0 * shared, F.length(a) + F.length(b)), F.lit(1.0))


@lru_cache(maxsize=4096)
def _places(text: str) -> dict[str, int]:
    """Bit i is set for each character that stands at place i."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table held in one number."""
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def _ratio(query: str, title: str) -> float:
    """2 M / T of the matching blocks; the query is the second sequence."""
    return difflib.SequenceMatcher(None, title, query).ratio()


def _reaches(query: str, title: str, floor: float | None) -> bool:
    if floor is None or floor != floor:
        return True
    total = len(query) + len(title)
    return not total or 2 * common_subsequence(query, title) / total >= floor - EPS


def exact_ratio(rows: DataFrame) -> DataFrame:
    """rows(query, title[, floor]) with ratio, in batches; rows that cannot reach their floor go.

    The cheaper subsequence bound is tried first where there is a floor.
    """
    floored = "floor" in rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if floored:
                pdf = pdf[[_reaches(q, t, f) for q, t, f in zip(pdf["query"], pdf["title"], pdf["floor"], strict=True)]]
            yield pdf.assign(ratio=[_ratio(q, t) for q, t in zip(pdf["query"], pdf["title"], strict=True)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, ratio double")


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """(qid, title, ratio, rank) of the n best rows of each query."""
    return top_k(rows, ["qid"], [F.desc("ratio"), F.desc("title")], n).select(
        "qid", "title", F.round("ratio", DIGITS).alias("ratio"), "rank"
    )
